"""The core's queries over the test tables, whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarrycrest.functions import html as H
from quarrycrest.functions import text as X
from quarrycrest.functions import urls as U
from quarrycrest.operators import catalog, chunking, crawl, index, lineparse, order, providers, retrieve, sessions
from quarrycrest.sources import readers, sinks

Query = Callable[[SparkSession, str], DataFrame]
DOMAIN, ORGANISATION = "quillhaven.example", "Quillhaven University"
CHUNK_TABLES = ("academic_info", "campus_life_data", "gap_fill_data")
#: Links that the index page's rule leaves out, and those of one more site of the test data.
SKIPPED = [*U.SKIPPED_ON_INDEX, "https://studentlife.{domain}/n/1"]
_QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    _QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def sources(spark: SparkSession, sf: str) -> DataFrame:
    return index.union_sources({name: table(spark, sf, name) for name in CHUNK_TABLES})


# --- retrieval -------------------------------------------------------------------


def _ranked(spark, sf, rows: DataFrame | None = None) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    asked = vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")
    return retrieve.knn(asked, vectors if rows is None else rows, row_key="vec_id")


def _out(ranked: DataFrame) -> DataFrame:
    return ranked.select("query_id", "id", (F.round("distance", 6) + 0.0).alias("distance"), F.col("rank").cast("bigint").alias("rank"))


@query
def knn_topk(spark, sf):
    return _out(_ranked(spark, sf))


@query
def knn_filtered(spark, sf):
    label = F.when(F.col("label") % 3 == 0, "undergrad").when(F.col("label") % 3 == 1, "grad").otherwise("both")
    return _out(_ranked(spark, sf, table(spark, sf, "embeddings").where(retrieve.audience_filter(label, "undergrad"))))


def _candidates(spark, sf):
    ranked = _ranked(spark, sf).withColumns({"question": F.expr("query_id div 200"), "query_ord": F.expr("(query_id % 200) div 50")})
    return retrieve.dedup_candidates(ranked)


@query
def dedup_candidates(spark, sf):
    return _candidates(spark, sf).select("question", "id", "query_ord", F.col("rank").cast("bigint").alias("rank"), F.col("pos").cast("bigint").alias("pos"))


def _top(spark, sf):
    return retrieve.rerank(_candidates(spark, sf), -F.round("distance", 9))


@query
def rerank_topn(spark, sf):
    return _top(spark, sf).select("question", "id", F.col("place").cast("bigint").alias("place"))


@query
def context_build(spark, sf):
    documents = table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "url", F.col("text").alias("document"))
    return retrieve.build_context(_top(spark, sf).join(documents, "id"))


# --- ids, deduplication, loads ---------------------------------------------------


@query
def chunk_id(spark, sf):
    return sources(spark, sf).select("_source", "rec_id", index.chunk_id(F.col("url"), F.col("chunk_index")).alias("id"))


def _keyed(spark, sf):
    return sources(spark, sf).withColumn("id", index.chunk_id(F.col("url"), F.col("chunk_index"))).select("id", "_source", "src_ord", "rec_id", "text")


@query
def dedup_last_wins(spark, sf):
    kept = index.last_wins(_keyed(spark, sf), ["id"], ["src_ord", "rec_id"], unique=True)
    return kept.select("id", "_source", "rec_id", "text", F.col("first_pos.src_ord").alias("first_src"), F.col("first_pos.rec_id").alias("first_rec"))


@query
def duplicate_count(spark, sf):
    return index.duplicate_count(_keyed(spark, sf))


@query
def multi_source_union(spark, sf):
    return sources(spark, sf).select("_source", "src_ord", "rec_id", "url", "content_type", "chunk_index")


@query
def index_rows(spark, sf):
    return index.index_rows(sources(spark, sf))


def _index_states(spark, sf):
    """The campus rows as first loaded, and all sources as they came last."""
    campus = table(spark, sf, "campus_life_data").withColumn("id", index.chunk_id(F.col("url"), F.col("chunk_index"))).select("id", "rec_id", F.col("text").alias("document"))
    old = index.first_wins(campus, ["id"], ["rec_id"], unique=True)
    new = index.last_wins(_keyed(spark, sf), ["id"], ["src_ord", "rec_id"], unique=True).select("id", "rec_id", F.col("text").alias("document"))
    return old, new


@query
def index_insert_new(spark, sf):
    return index.insert_new(*_index_states(spark, sf))


@query
def index_upsert(spark, sf):
    return index.upsert(*_index_states(spark, sf))


@query
def batch_assign(spark, sf):
    placed = order.numbered(sources(spark, sf).select("_source", "src_ord", "rec_id", "text"), ["src_ord", "rec_id"])
    rows = placed.withColumn("batch", index.batch_number(F.col("ord")))
    return rows.groupBy("_source", "batch").agg(F.count("*").alias("n_rows"), F.count_if(X.is_blank(F.col("text"))).alias("n_blank"))


# --- cleaning and chunking -------------------------------------------------------


@query
def clean_text_basic(spark, sf):
    text = X.clean(F.coalesce("text", F.lit("")), ORGANISATION, X.BASIC)
    return table(spark, sf, "academic_info").select("rec_id", text.alias("text"))


@query
def clean_text_full(spark, sf):
    text = X.clean(F.coalesce("text", F.lit("")), ORGANISATION, X.FULL)
    return table(spark, sf, "campus_life_data").select("rec_id", text.alias("text"))


@query
def min_length_filter(spark, sf):
    return table(spark, sf, "documents").where(F.length("text") >= chunking.LEAST).select("doc_id", F.length("text").cast("bigint").alias("n"))


@query
def truncate_text(spark, sf):
    cut = F.substring("text", 1, 50_000)
    return table(spark, sf, "documents").select("doc_id", F.length(cut).cast("bigint").alias("n"), F.md5(cut).alias("digest"))


@query
def chunk_split(spark, sf):
    parts = table(spark, sf, "documents").select("doc_id", F.posexplode(chunking.split(F.col("text"))).alias("chunk_index", "chunk"))
    return parts.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), "chunk")


@query
def chunk_stats(spark, sf):
    n = table(spark, sf, "documents").select(F.explode(F.transform(chunking.split(F.col("text")), lambda c: F.length(c).cast("bigint"))).alias("n"))
    return n.agg(F.count("*").alias("chunks"), F.max("n").alias("longest"), F.min("n").alias("shortest"), F.sum("n").alias("chars"))


@query
def clean_chunk_documents(spark, sf):
    rows = table(spark, sf, "academic_info").select("rec_id", "url", "text")
    out = chunking.clean_and_chunk(rows, ORGANISATION, X.BASIC)
    return out.select("rec_id", "url", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.col("chunk_total").cast("bigint").alias("chunk_total"), "text")


@query
def pipeline_counters(spark, sf):
    return chunking.counters(sources(spark, sf))


# --- urls, links, html -----------------------------------------------------------


@query
def url_normalize(spark, sf):
    return sources(spark, sf).select("_source", "rec_id", U.normalize_url(F.col("url")).alias("url"))


def _found_links(spark, sf):
    rows = sources(spark, sf).select("_source", "rec_id", "url", F.posexplode(U.links(F.col("text"), DOMAIN)).alias("pos", "link"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


@query
def link_extract(spark, sf):
    return _found_links(spark, sf).select("_source", "rec_id", "pos", "link")


@query
def link_extract_filtered(spark, sf):
    kept = _found_links(spark, sf).where(~U.has_prefix(F.col("link"), DOMAIN, SKIPPED))
    return kept.groupBy("_source", "rec_id", "link").agg(F.min("pos").alias("pos"))


@query
def url_resolve(spark, sf):
    rows = _found_links(spark, sf)
    path = F.regexp_replace("link", r"^https?://[^/]+", "")
    forms = {0: F.col("link"), 1: path, 2: F.regexp_replace(path, "^/", ""), 3: F.concat(F.lit(".."), path), 4: F.concat(F.lit("//"), F.regexp_replace("link", r"^https?://", "")), 5: F.lit("https://other.example/"), 6: F.concat(F.lit("?p="), F.col("pos"))}
    link = F.col("link")
    for k, form in forms.items():
        link = F.when((F.col("rec_id") + F.col("pos")) % len(forms) == k, form).otherwise(link)
    rows = rows.withColumn("link", link)
    return rows.select("_source", "rec_id", "pos", "link", U.resolve_url(F.col("url"), F.col("link"), DOMAIN).alias("target"))


@query
def url_blocked(spark, sf):
    rows = _found_links(spark, sf)
    return rows.select("_source", "rec_id", "pos", U.is_blocked(F.col("link"), DOMAIN, U.BLOCKED_BY_CATALOG).alias("by_catalog"), U.is_blocked(F.col("link"), DOMAIN, U.BLOCKED_BY_SEEDS).alias("by_seeds"))


def _as_html(rows: DataFrame) -> DataFrame:
    """A page around the text: title, navigation, paragraphs, links, script and footer."""
    body = F.regexp_replace(F.coalesce("text", F.lit("")), r"\[([^\]\n]+)\]\((https?://[^)\n]+)\)", "<a class=\"x\" href='$2'>$1</a>")
    page = F.concat(
        F.lit("<!DOCTYPE html><html><head><title>Page &amp; more</title><style>p {}</style></head><body><nav><a href='/home'>Home</a></nav><!-- c --><p>"),
        F.replace(body, F.lit("\n"), F.lit("</p>\n<p>")),
        F.lit("</p><script>if (a < b) {}</script><footer>Foot <b>note</b></footer></body></html>"),
    )
    return rows.select("rec_id", page.alias("html"))


@query
def html_to_text(spark, sf):
    return _as_html(table(spark, sf, "gap_fill_data")).select("rec_id", H.html_to_text(F.col("html")).alias("text"))


@query
def html_links(spark, sf):
    return _as_html(table(spark, sf, "gap_fill_data")).select("rec_id", F.array_join(H.html_links(F.col("html")), " ").alias("links"))


# --- tagging ---------------------------------------------------------------------


@query
def audience_tag(spark, sf):
    return sources(spark, sf).select("_source", "rec_id", U.audience(F.col("url"), DOMAIN).alias("audience"))


@query
def audience_tally(spark, sf):
    labels = spark.createDataFrame([("undergrad",), ("grad",), ("both",)], "audience string")
    counted = sources(spark, sf).groupBy(U.audience(F.col("url"), DOMAIN).alias("audience")).agg(F.count("*").alias("n"))
    return labels.join(counted, "audience", "left").select("audience", F.coalesce("n", F.lit(0)).alias("n"))


@query
def audience_clamp(spark, sf):
    replies = F.array(*map(F.lit, ("undergrad", "grad", "both", "faculty", "Grad", "")), F.lit(None))  # what a model may answer
    reply = F.get(replies, (F.col("rec_id") % 7).cast("int"))
    return sources(spark, sf).groupBy(U.clamp_audience(reply).alias("audience")).agg(F.count("*").alias("n"))


# --- crawl -----------------------------------------------------------------------


def _pages(spark, sf) -> DataFrame:
    """One row a normalised url of all sources: the row with the smallest place.  Each
    page links to those on its host that follow it in order of url, besides the links
    in its text, so that walks have somewhere to go."""
    rows = sources(spark, sf).where("url is not null").withColumn("url", U.normalize_url(F.col("url")))
    first = index.first_wins(rows.select("url", "src_ord", "rec_id", "text", "department", "school"), ["url"], ["src_ord", "rec_id"], unique=True)
    # urls of a host are neighbours in the order of all urls
    placed = order.checkpoint(order.numbered(rows.select("url").distinct(), ["url"]))
    follow = placed
    for k in (1, 2):
        after = placed.select((F.col("ord") - k).alias("ord"), F.col("url").alias(f"u{k}"))
        follow = follow.join(after, "ord", "left")
    own = F.array_compact(F.array(*(F.when(U.host(F.col(f"u{k}")) == U.host(F.col("url")), F.col(f"u{k}")) for k in (1, 2))))
    return first.join(follow.select("url", own.alias("own")), "url").withColumn("links", F.concat("own", U.links(F.col("text"), DOMAIN))).drop("own")


def _seeds(pages: DataFrame) -> DataFrame:
    """The first page of each host."""
    first = pages.groupBy(U.host(F.col("url")).alias("host")).agg(F.min("url").alias("url"))
    return order.numbered(first, ["url"]).select("ord", "url", F.lit(1).alias("depth"), F.lit("").alias("department"), F.lit("").alias("school"))


@query
def fetch_lookup(spark, sf):
    pages = _pages(spark, sf)
    links = _found_links(spark, sf).select(U.normalize_url(F.col("link")).alias("url")).distinct()
    got = crawl.fetch(links, pages)
    return got.select("url", F.col("text").isNotNull().alias("found"))


def _walk(spark, sf, depth: int = 4) -> DataFrame:
    pages = order.checkpoint(_pages(spark, sf).select("url", "links", "department", "school"))
    return crawl.crawl(_seeds(pages), pages, DOMAIN, U.BLOCKED_BY_SEEDS, max_depth=depth)


@query
def crawl_expand(spark, sf):
    return _walk(spark, sf).select("url", F.col("depth").cast("bigint").alias("depth"))


@query
def crawl_depth_stats(spark, sf):
    return _walk(spark, sf).groupBy(F.col("depth").cast("bigint").alias("depth")).agg(F.count("*").alias("n"))


@query
def crawl_documents(spark, sf):
    texts = _pages(spark, sf).select("url", "text")
    kind = F.when(F.col("depth") == 1, "program_overview").otherwise("program_requirements")
    return _walk(spark, sf).join(texts, "url").select("url", F.col("depth").cast("bigint").alias("depth"), kind.alias("content_type"), F.coalesce(F.length("text"), F.lit(0)).cast("bigint").alias("n"))


@query
def resume_known_urls(spark, sf):
    return crawl.known_urls(*(table(spark, sf, t) for t in CHUNK_TABLES))


@query
def seed_plan(spark, sf):
    seeds = table(spark, sf, "gap_fill_data").select(F.col("rec_id").alias("ord"), "url")
    processed = crawl.known_urls(table(spark, sf, "campus_life_data"), table(spark, sf, "academic_info"))
    return crawl.seed_plan(seeds, processed)


@query
def seed_expand(spark, sf):
    pages = _pages(spark, sf).select("url", "links")
    seeds = table(spark, sf, "gap_fill_data").select(F.col("rec_id").alias("ord"), U.normalize_url(F.col("url")).alias("url"), F.lit(0).alias("depth"), F.lit("").alias("department"), F.lit("").alias("school"))
    known = seeds.select("url").distinct()
    found = crawl.expand(seeds, pages, DOMAIN, U.BLOCKED_BY_SEEDS, None, True).join(known, "url", "left_anti")
    return found.select("url", F.col("depth").cast("bigint").alias("depth"))


@query
def seed_crawl(spark, sf):
    """The pages that two links a seed lead to, without those that were loaded before."""
    pages = order.checkpoint(_pages(spark, sf).select("url", "links", "department", "school"))
    processed = crawl.known_urls(table(spark, sf, "campus_life_data"))
    seeds = _seeds(pages).withColumn("depth", F.lit(0))
    walked = crawl.crawl(seeds, pages, DOMAIN, U.BLOCKED_BY_SEEDS, 3, crawl.SEED_LINKS_BY_DEPTH, first_depth=0, visited=processed)
    return walked.select("url", F.col("depth").cast("bigint").alias("depth"))


@query
def has_content_filter(spark, sf):
    """Flags in the spellings that a model's reply has them in."""
    spellings = F.array(*map(F.lit, ("true", "True", "false", "False", "FALSE", "")), F.lit(None))
    flag = F.get(spellings, (F.col("event_id") % 7).cast("int"))
    return table(spark, sf, "events").where(crawl.has_content(flag)).select("event_id")


# --- catalogue -------------------------------------------------------------------


@query
def page_concat(spark, sf):
    """Pages put together again from the pieces they were split into; a page that was
    not split stays by itself, so no group is larger than a page's pieces."""
    alone = F.when(F.coalesce("chunk_total", F.lit(1)) <= 1, F.col("rec_id"))
    pieces = sources(spark, sf).where("url is not null").select("_source", U.normalize_url(F.col("url")).alias("url"), alone.alias("alone"), F.coalesce("chunk_index", F.lit(0)).alias("at"), "rec_id", F.coalesce("text", F.lit("")).alias("text"))
    parts = F.array_sort(F.collect_list(F.struct("at", "rec_id", "text")))
    return pieces.groupBy("_source", "url", "alone").agg(F.array_join(F.transform(parts, lambda p: F.concat(p["text"], F.lit("\n"))), "").alias("text"))


@query
def line_noise_filter(spark, sf):
    lines = table(spark, sf, "campus_life_data").select("rec_id", F.posexplode(F.split("text", "\n", -1)).alias("ord", "line"))
    kept = lineparse.clean_lines(lines, ["https", "Print", "Share", "Menu", "Skip to", "Back to top"])
    return kept.select("rec_id", F.col("ord").cast("bigint").alias("ord"), "line")


def listing(spark, sf) -> DataFrame:
    """The section records written as the lines of a listing, one file a feed."""
    t = lambda c: F.regexp_replace(F.coalesce(F.col(c), F.lit("")), r"\s+", " ")
    head = F.concat_ws(" ", F.regexp_replace(F.upper(F.col("code")), r"[^A-Z0-9]+", " "), t("title"), t("type"), t("term"), F.lit("2026"), t("credits"), t("status"))
    head = F.regexp_replace(head, r"^ ?([A-Z]+) ?(\d{3,4})[A-Z]? (\d{1,3}) ", "$1 $2-$3 ")
    days = F.transform(F.coalesce("schedule", F.array().cast("array<struct<days:string,start_time:string,end_time:string>>")), lambda d: F.concat_ws(" ", d["days"], d["start_time"], d["end_time"]))
    lines = F.concat(
        F.array(head), days, F.array(F.lit("Enrollment: Enrolled Capacity"), F.concat_ws(" ", "enrolled", "capacity")),
        F.array(F.concat(F.lit("Instructors: "), t("instructor")), F.concat(F.lit("Description: "), t("description")), F.concat(F.lit("Public Notes: "), t("notes")), F.concat(F.lit("Restrictions: "), t("restrictions")), F.concat(F.lit("Offered: "), t("offered"))),
    )
    rows = table(spark, sf, "courses").where("code is not null").select(F.col("feed").alias("file"), "rec_id", F.posexplode(lines).alias("i", "line"))
    return rows.select("file", (F.col("rec_id") * 1000 + F.col("i")).alias("ord"), "line")


@query
def section_parse(spark, sf):
    days = F.array_join(F.transform("schedule", lambda d: F.concat_ws(" ", d["days"], d["start_time"], d["end_time"], F.lit(";"))), "")
    return lineparse.parse_sections(lineparse.clean_lines(listing(spark, sf))).withColumn("schedule", F.replace(days, F.lit(" ;"), F.lit(";")))


@query
def fix_leading_punct(spark, sf):
    return table(spark, sf, "courses").select("rec_id", catalog.fix_leading_punct(F.col("instructor")).alias("instructor"))


@query
def base_code(spark, sf):
    return table(spark, sf, "courses").select("rec_id", catalog.base_code(F.col("code")).alias("code"))


@query
def best_field(spark, sf):
    rows = table(spark, sf, "courses").where("code is not null").withColumn("base", catalog.base_code(F.col("code")))
    return rows.groupBy(F.col("base").alias("code")).agg(*(catalog.best_field(c, "rec_id").alias(c) for c in ("description", "notes", "restrictions", "offered")))


@query
def section_counts(spark, sf):
    counts = catalog.section_counts(table(spark, sf, "courses").where("code is not null"))
    return counts.select("code", F.array_join(F.transform("counts", lambda c: F.concat(c["type"], F.lit("="), c["n"])), ",").alias("counts"))


@query
def course_merge(spark, sf):
    merged = catalog.merge_courses(table(spark, sf, "courses"))
    ids = F.transform("sections", lambda s: F.concat_ws("|", s["section_id"], F.coalesce(s["type"], F.lit("")), s["instructor"]))
    return merged.select("code", "title", "credits", "offered", "description", "notes", "restrictions", F.array_join(ids, ";").alias("sections"))


@query
def render_text(spark, sf):
    text = catalog.render_text("code", "title", "credits", "offered", "description", "notes", "restrictions")
    return table(spark, sf, "courses").select("rec_id", text.alias("text"))


@query
def course_chunks(spark, sf):
    return catalog.course_chunks(catalog.merge_courses(table(spark, sf, "courses")), "https://catalog.quillhaven.example/").select("url", "content_type", "text")


# --- sessions, prompts, rates ----------------------------------------------------


def _turns(spark, sf):
    return table(spark, sf, "events").select(F.col("user_id").cast("string").alias("session_id"), "ts", F.col("event_id").alias("turn"), F.when(F.col("event_type") == "click", "user").otherwise(F.col("event_type")).alias("role"), F.col("event_type").alias("text"))


def _message_text(c: str):
    return F.array_join(F.transform(c, lambda m: F.concat(m["role"], F.lit(":"), m["content"])), ",")


@query
def history_project(spark, sf):
    return sessions.project_history(_turns(spark, sf)).select("session_id", _message_text("messages").alias("messages"))


@query
def session_upsert(spark, sf):
    """Sessions after their first turn, then updated by every later one."""
    turns = _turns(spark, sf).withColumn("n", F.row_number().over(Window.partitionBy("session_id").orderBy("turn")))
    first = turns.where("n = 1").select("session_id", F.array(F.struct("role", F.col("text").alias("content"))).alias("messages"), F.col("ts").cast("timestamp").alias("started_at"), F.col("ts").cast("timestamp").alias("last_active"))
    later = turns.where("n > 1").select("session_id", F.array(F.struct("role", F.col("turn").cast("string").alias("content"))).alias("messages"), F.col("ts").cast("timestamp").alias("at"))
    out = sessions.upsert_sessions(first, later)
    return out.select("session_id", F.unix_micros("started_at").alias("started_us"), F.unix_micros("last_active").alias("active_us"))


@query
def subquery_list(spark, sf):
    """A reply for each document, in the shapes that a model answers in."""
    named = F.to_json(F.struct(F.array(F.col("source"), F.lit(" \t\n"), F.col("lang")).alias("queries")))
    shapes = F.array(named, F.lit('{"queries":["a"," ",3,null,"b"]}'), F.lit("{}"), F.lit(None), F.lit("not json"), F.lit('{"queries":[]}'))
    reply = F.get(shapes, (F.col("doc_id") % 6).cast("int"))
    queries = retrieve.subqueries(F.coalesce("site", F.lit("")), reply)
    return table(spark, sf, "documents").select("doc_id", F.array_join(queries, "|").alias("queries"))


@query
def history_append(spark, sf):
    """Each session's history with one more question and its answer."""
    history = sessions.project_history(_turns(spark, sf))
    more = sessions.append_turn(F.col("messages"), F.concat(F.lit("again "), "session_id"), F.size("messages").cast("string"))
    return history.withColumn("messages", more).select("session_id", _message_text("messages").alias("messages"))


@query
def question_audience(spark, sf):
    return table(spark, sf, "documents").select("doc_id", providers.classify_audience(F.col("text")).alias("audience"))


@query
def query_expand(spark, sf):
    supplied = F.when(F.col("lang").isNotNull(), F.array("lang", F.coalesce("site", F.lit(""))))
    asked = providers.expand_query(F.coalesce("source", F.lit("")), supplied)
    return table(spark, sf, "documents").select("doc_id", F.array_join(asked, "|").alias("queries"))


@query
def lexical_rerank(spark, sf):
    """Candidates by the share of the question's words, those of the first query, in them."""
    texts = table(spark, sf, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    asked = texts.select((F.col("doc_id") / 200).cast("bigint").alias("question"), (F.col("doc_id") % 200).alias("r"), F.col("text").alias("asked")).where("r = 0").drop("r")
    rows = _candidates(spark, sf).join(texts.withColumnRenamed("doc_id", "id"), "id").join(asked, "question")
    top = retrieve.rerank(rows, F.round(providers.lexical_score(F.col("asked"), F.col("text")), 9))
    return top.select("question", "id", F.col("place").cast("bigint").alias("place"), "score")


@query
def text_embeddings(spark, sf):
    """No SQL: hashed words; the length of the vector and its parts stand for it."""
    vector = providers.embed(F.col("text"), providers.HashedWords())
    rows = table(spark, sf, "documents").select("doc_id", vector.alias("v"))
    return rows.select("doc_id", F.size("v").alias("size"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x), 4).alias("norm"))


@query
def page_analysis(spark, sf):
    page = providers.analyze_page(F.col("html"), 5)
    general = providers.analyze_general_page(F.col("html"))
    rows = _as_html(table(spark, sf, "gap_fill_data")).select("rec_id", page.alias("p"), general.alias("g"), providers.select_links(F.col("html"), 2).alias("few"))
    return rows.select("rec_id", "p.has_content", F.md5("p.text").alias("digest"), F.array_join("p.sub_links", " ").alias("links"), "g.category", F.array_join("few", " ").alias("few"))


@query
def prompt_build(spark, sf):
    history = sessions.project_history(_turns(spark, sf)).select(F.col("session_id").cast("bigint").alias("question"), "messages")
    context = context_build(spark, sf)
    rows = context.join(history, "question", "left")
    prompt = retrieve.build_prompt(F.concat(F.lit("What about "), F.col("question").cast("string"), F.lit("?")), F.col("messages"), F.col("context"), "Answer from the context and cite the source URL.")
    return rows.withColumn("prompt", prompt).select("question", _message_text("prompt").alias("prompt"))


@query
def rate_limit_window(spark, sf):
    rows = sessions.rate_limit(table(spark, sf, "events"), "user_id", "ts", "event_id", limit=1, window="1 hour")
    return rows.select("event_id", F.col("n").cast("bigint").alias("n"), "admitted", F.unix_micros("window_start").alias("window_us"))


# --- scans -----------------------------------------------------------------------


@query
def json_scan(spark, sf):
    parsed = F.from_json("props", "map<string,string>")
    return table(spark, sf, "events").select("event_id", F.size(parsed).cast("bigint").alias("n_keys"))


@query
def json_records(spark, sf):
    """Section records written as JSON arrays and read again with their schema."""
    path = order.scratch(spark, "json_records")
    fields = ("rec_id", "code", "title", "schedule", "enrolled", "description")
    sinks.write_json_array(table(spark, sf, "courses").select(*fields), path)
    read = readers.json_array(spark, path, "rec_id bigint, code string, title string, schedule array<struct<days:string,start_time:string,end_time:string>>, enrolled int, description string")
    days = F.array_join(F.transform("schedule", lambda d: F.coalesce(d["days"], F.lit(""))), ",")
    return read.select("rec_id", "code", "title", "enrolled", "description", F.coalesce(days, F.lit("")).alias("days"))


@query
def text_lines(spark, sf):
    """Texts written as text files and read again by lines."""
    path = order.scratch(spark, "text_lines")
    lines = table(spark, sf, "gap_fill_data").select(F.explode(F.split(F.regexp_replace("text", "\r", " "), "\n")).alias("line"))
    sinks.write_text(lines, path)
    return readers.text_lines(spark, path).where("line <> ''").groupBy("line").agg(F.count("*").alias("n"))


@query
def metadata_update(spark, sf):
    """The index's audience set from its urls, where they name one."""
    state = index.last_wins(_keyed(spark, sf).join(sources(spark, sf).select("_source", "rec_id", "url"), ["_source", "rec_id"]), ["id"], ["src_ord", "rec_id"], unique=True)
    rows = state.select("id", "rec_id", "url", F.lit("both").alias("audience"))
    labels = rows.select("id", U.audience(F.col("url"), DOMAIN).alias("audience")).where("audience <> 'both'")
    return index.update_fields(rows, labels, ["audience"]).select("id", "rec_id", "audience")


@query
def course_order(spark, sf):
    merged = catalog.merge_courses(table(spark, sf, "courses")).select("code", "title")
    return order.numbered(merged, ["code"]).select("ord", "code", "title")


@query
def collection_scan(spark, sf):
    return sources(spark, sf).select("_source", "rec_id", "department", "content_type")


@query
def collection_count(spark, sf):
    return sources(spark, sf).groupBy("_source").agg(F.count("*").alias("n"))


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from quarrycrest.plans import oracle

    return oracle.oracle_sql()
