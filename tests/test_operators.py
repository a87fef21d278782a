import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrycrest.functions.urls import BLOCKED_BY_SEEDS
from quarrycrest.operators import crawl, index, order, providers, retrieve, sessions


def ids(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_chunk_ids(spark):
    df = spark.createDataFrame([("", 0), (None, None), ("https://ex.example/a", 0), ("https://ex.example/a", 3)], "u string, i int")
    got = [r[0] for r in df.select(index.chunk_id(F.col("u"), F.col("i"))).collect()]
    assert got == ["bb28226fbf99af5789429378306bdb7c"] * 2 + ["919ae1dbae2790d511dff3672c8c911f", "4624ea815f06b29acee040ec0179beec"]


def test_last_and_first_wins(spark):
    df = spark.createDataFrame([("a", 1, "v1"), ("b", 2, "w"), ("a", 3, "v2"), ("a", 4, "v3")], "k string, ord int, v string")
    assert ids(index.last_wins(df, ["k"], ["ord"]).withColumn("p", F.col("first_pos.ord")), "k", "v", "p") == [("a", "v3", 1), ("b", "w", 2)]
    assert ids(index.first_wins(df, ["k"], ["ord"]), "k", "v") == [("a", "v1"), ("b", "w")]
    assert index.last_wins(df.limit(0), ["k"], ["ord"]).count() == 0


def test_unique_winners(spark):
    df = spark.createDataFrame([("a", 1, "v1"), (None, 2, "w"), ("a", 3, None), (None, None, "n")], "k string, ord int, v string")
    for unique in (False, True):
        assert {(r.k, r.v, r.first_pos.ord) for r in index.last_wins(df, ["k"], ["ord"], unique).collect()} == {("a", None, 1), (None, "w", None)}
        assert {(r.k, r.v) for r in index.first_wins(df, ["k"], ["ord"], unique).collect()} == {("a", "v1"), (None, "n")}
    assert index.last_wins(df.limit(0), ["k"], ["ord"], True).count() == 0


def test_update_fields(spark):
    rows = spark.createDataFrame([("1", "x", "both"), ("2", "y", "both")], "id string, t string, audience string")
    new = spark.createDataFrame([("2", "grad"), ("3", "grad")], "id string, audience string")
    assert ids(index.update_fields(rows, new, ["audience"]), "id", "t", "audience") == [("1", "x", "both"), ("2", "y", "grad")]
    assert ids(index.update_fields(rows.drop("audience"), new, ["audience"]), "id", "audience") == [("1", None), ("2", "grad")]


def test_order_without_a_global_window(spark):
    df = spark.createDataFrame([("f", i, i % 7 == 3) for i in range(500)] + [("g", i, i % 5 == 0) for i in range(30)] + [("h", 0, None)], "file string, at int, flag boolean").repartition(9)
    got = order.numbered(df, ["file", "at"]).collect()
    assert [(r.file, r["at"]) for r in sorted(got, key=lambda r: r.ord)] == sorted((r.file, r["at"]) for r in got) and {r.ord for r in got} == set(range(531))
    got = order.running_count(df, "flag", "file", "at", "n").collect()
    assert all(r.n == sum(i % (7 if r.file == "f" else 5) == (3 if r.file == "f" else 0) for i in range(r["at"] + 1)) for r in got if r.file != "h") and len(got) == 531
    assert order.numbered(df.limit(0), ["file"]).count() == 0 == order.running_count(df.limit(0), "flag", "file", "at", "n").count()


def test_insert_and_upsert(spark):
    old = spark.createDataFrame([("1", "old"), ("2", "x")], "id string, t string")
    new = spark.createDataFrame([("1", "new"), ("3", "y")], "id string, t string")
    assert ids(index.insert_new(old, new), "id", "t") == [("1", "old"), ("2", "x"), ("3", "y")]
    once = index.upsert(old, new)
    assert ids(once, "id", "t") == ids(index.upsert(once, new), "id", "t") == [("1", "new"), ("2", "x"), ("3", "y")]
    assert ids(index.union_sources({"a": old, "gone": None, "b": new}), "_source", "src_ord", "id") == [("a", 0, "1"), ("a", 0, "2"), ("b", 2, "1"), ("b", 2, "3")]


@pytest.mark.parametrize("sent", [1_000_000, 0])
def test_knn_is_exact(spark, monkeypatch, sent):
    monkeypatch.setattr(retrieve, "BROADCAST_VALUES", sent)
    monkeypatch.setattr(retrieve, "QUERY_BLOCK", 3)
    monkeypatch.setattr(retrieve, "ROW_BLOCK", 7)
    rng = np.random.default_rng(0)
    v = rng.normal(size=(40, 5))
    v[7] = v[3]  # a tie
    rows = [(i, [float(x) for x in v[i]]) for i in range(40)] + [(99, None)]
    df = spark.createDataFrame(rows, "id bigint, embedding array<double>")
    got = retrieve.knn(df.where("id < 8").withColumnRenamed("id", "query_id"), df, k=4)
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    d = np.round(1 - unit @ unit.T, 12)
    want = {(q, sorted(range(40), key=lambda i: (d[q, i], i))[r], r + 1) for q in range(8) for r in range(4)}
    assert set(ids(got, "query_id", "id", "rank")) == want


def test_candidates_rerank_context(spark):
    ranked = spark.createDataFrame([(0, 0, 5, "a", 0.5), (0, 1, 1, "a", 0.1), (0, 0, 1, "b", 0.2), (1, 0, 1, "a", 0.3)], "question int, query_ord int, rank int, id string, distance double")
    c = retrieve.dedup_candidates(ranked)
    assert ids(c, "question", "id", "query_ord", "pos") == [(0, "a", 0, 2), (0, "b", 0, 1), (1, "a", 0, 1)]
    top = retrieve.rerank(c, F.when(F.col("id") == "a", 2.0).otherwise(1.0), 1)
    assert ids(top, "question", "id") == [(0, "a"), (1, "a")]
    docs = top.withColumns({"url": F.lit(None).cast("string"), "document": F.lit("d")})
    assert ids(retrieve.build_context(docs), "context") == [("[Source: ]\nd",)] * 2
    df = spark.createDataFrame([("undergrad",), ("grad",), ("both",), (None,)], "a string")
    assert {x: {r[0] for r in df.where(retrieve.audience_filter(F.col("a"), x)).collect()} for x in ("grad", "both", "undergrad")} == {"grad": {"grad", "both"}, "both": {"undergrad", "both"}, "undergrad": {"undergrad", "both"}}


def test_subqueries_and_prompt(spark):
    df = spark.createDataFrame([("q", '{"queries":["a"," ",3,null,"b"]}'), ("q", None), ("q", "[")], "q string, r string")
    assert [r[0] for r in df.select(retrieve.subqueries(F.col("q"), F.col("r"))).collect()] == [["q", "a", "b"], ["q"], ["q"]]
    p = df.limit(1).select(retrieve.build_prompt(F.col("q"), F.lit(None).cast(sessions.MESSAGES), F.lit("c"), "s").alias("p")).first().p
    assert [(m.role, m.content) for m in p] == [("system", "s"), ("user", "Context:\nc\n\nQuestion: q")]


def test_sessions(spark):
    t = [datetime.datetime(2026, 1, 1, h) for h in range(5)]
    m = lambda x: [("user", x)]
    old = spark.createDataFrame([("s", m("1"), t[0], t[0])], f"session_id string, messages {sessions.MESSAGES}, started_at timestamp, last_active timestamp")
    new = spark.createDataFrame([("s", m("2"), t[2]), ("s", m("3"), t[3]), ("n", m("4"), t[1]), ("", m("5"), t[4]), (None, m("6"), t[4])], f"session_id string, messages {sessions.MESSAGES}, at timestamp")
    got = {r.session_id: (r.messages[0].content, r.started_at, r.last_active) for r in sessions.upsert_sessions(old, new).collect()}
    assert got == {"s": ("3", t[0], t[3]), "n": ("4", t[1], t[1])}
    turns = spark.createDataFrame([("s", 2, "system", "y"), ("s", 1, "user", "x")], "session_id string, turn int, role string, text string")
    assert [(x.role, x.content) for x in sessions.project_history(turns).first().messages] == [("user", "x"), ("assistant", "y")]
    rates = spark.createDataFrame([("u", t[0], i) for i in range(3)], "k string, ts timestamp, id int")
    assert ids(sessions.rate_limit(rates, "k", "ts", "id", 2), "id", "admitted") == [(0, True), (1, True), (2, False)]


def test_crawl(spark):
    d = "ex.example"
    u = lambda x: f"https://{d}/{x}"
    pages = spark.createDataFrame([(u("a"), ["/b", "/c", "/news/x"], "Art", None), (u("b"), ["/d", "/a"], "", "S"), (u("c"), ["/d", "https://other.example/"], None, None), (u("d"), ["/e"], None, None)], "url string, links array<string>, department string, school string")
    seeds = spark.createDataFrame([(1, u("a"), 1, "", ""), (2, u("a"), 1, "x", "x")], "ord bigint, url string, depth int, department string, school string")
    got = crawl.crawl(seeds, pages, d, BLOCKED_BY_SEEDS, max_depth=3)
    assert ids(got, "url", "depth", "department") == [(u("a"), 1, ""), (u("b"), 2, "Art"), (u("c"), 2, "Art"), (u("d"), 3, "Art")]
    assert ids(crawl.crawl(seeds, pages, d, BLOCKED_BY_SEEDS, max_depth=2, by_depth={1: 1}), "url") == [(u("a"),), (u("b"),)]
    known = spark.createDataFrame([(u("b"),)], "url string")
    assert ids(crawl.crawl(seeds.withColumn("depth", F.lit(0)), pages, d, BLOCKED_BY_SEEDS, 3, crawl.SEED_LINKS_BY_DEPTH, first_depth=0, visited=known), "url", "depth") == [(u("a"), 0), (u("c"), 1)]
    flags = spark.createDataFrame([("true",), ("False",), ("false",), (None,)], "f string")
    assert [r[0] for r in flags.select(crawl.has_content(F.col("f"))).collect()] == [True, False, False, True]
    plan = crawl.seed_plan(spark.createDataFrame([(1, u("a")), (2, u("a/")), (3, u("k")), (4, u("k"))], "ord int, url string"), spark.createDataFrame([(u("k"),)], "url string"))
    assert ids(plan, "ord", "links_only") == [(1, False), (3, True), (4, True)]


def test_providers(spark):
    df = spark.createDataFrame([("one two",), (None,)], "t string").select(providers.embed(F.col("t"), providers.HashedWords(8), batch=1).alias("e"))
    rows = [r.e for r in df.collect()]
    assert abs(sum(x * x for x in rows[0]) - 1) < 1e-5 and rows[1] == [0.0] * 8
    df = spark.createDataFrame([("PhD in art", "art here"), ("housing", None)], "q string, d string")
    assert [tuple(r) for r in df.select(providers.classify_audience(F.col("q")), F.round(providers.lexical_score(F.col("q"), F.col("d")), 3)).collect()] == [("grad", 0.333), ("both", 0.0)]


def test_page_providers(spark):
    html = "<p>Text</p><a href='/1'>a</a><a href='/2'>b</a>"
    df = spark.createDataFrame([(html,), ("",), (None,)], "h string")
    a, b, c = [r.p for r in df.select(providers.analyze_page(F.col("h"), 1).alias("p")).collect()]
    assert (a.has_content, a.text, a.sub_links) == (True, "Text\n[a](/1)\n[b](/2)", ["/1"]) and not b.has_content and c is None
    assert [r[0] for r in df.select(providers.select_links(F.col("h"), 5)).collect()] == [["/1", "/2"], [], []]
    general = [r.p for r in df.select(providers.analyze_general_page(F.concat("h", F.lit("<p>Dining and housing</p>"))).alias("p")).collect()]
    assert general[0].category == "Housing" and general[1].text == "Dining and housing" and general[2] is None
    assert df.limit(1).select(providers.expand_query(F.lit("q"), F.array(F.lit("a"))), providers.expand_query(F.lit("q"))).first()[:] == (["q", "a"], ["q"])
