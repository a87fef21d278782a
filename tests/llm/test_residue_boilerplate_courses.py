import datetime
import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrycrest.llm import boilerplate, residue, survivors, truncation

SENTENCES = ["The office opens at nine on every weekday morning.", "Students bring two copies of the form to the desk.", "Summer courses are posted in March and fill early.", "Ask the adviser about credit for earlier work.", "Late forms are not accepted after the first week of May."]


def pages():
    rng = random.Random(8)
    rows = [(i, f"https://h{i % 7}.ex/p{i}", "\n".join(rng.choices(SENTENCES, k=4)) + f"\nRoom {i} is open to all who need a quiet place.") for i in range(120)]
    residue_rows = [
        "Dear {{first_name}}, please return the form by May.", "Applications for room keys are due on [INSERT DATE HERE].", "Lorem ipsum dolor sit amet, consectetur adipiscing elit.", "Sample text sample text sample text.", "TODO write intro here",
        "404 Not Found\nThe requested address was not found on this server.", "You must enable JavaScript to see this content.", "Your session has timed out. Sign in again to continue.",
    ]
    for k in range(6):
        for j, t in enumerate(residue_rows):
            rows.append((1000 + 10 * k + j, f"https://h{k}.ex/r{j}", (SENTENCES[k % 5] + "\n" if j < 5 else "") + t))
    talk = ["A lecture in MATH 101 traces where the phrase lorem ipsum came from.", "If the portal shows access denied, the office can reset the card in 5 minutes.", "The online lab for CHEM 220 runs best in a browser with JavaScript turned on."]
    rows += [(2000 + 10 * k + j, f"https://h{k}.ex/t{j}", SENTENCES[k % 5] + "\n" + t) for k in range(6) for j, t in enumerate(talk)]
    rows += [(3000, "https://h1.ex/x", None), (3001, None, ""), (3002, None, "Dear {{name}}, hello."), (3003, "https://h1.ex/y", " ".join(SENTENCES) * 2000)]
    return rows


def test_residue(spark):
    df = spark.createDataFrame([(*r, "x", 1) for r in pages()], "rec_id bigint, url string, text string, tbl string, page int")
    got = {r.rec_id: r.reason for r in residue.find(spark, {"t": df}).collect()}
    want = {1000 + 10 * k + j: "filler" if j < 5 else "error" for k in range(6) for j in range(8)} | {3002: "filler"}
    assert got == want
    _, figures = residue.train(residue._rows({"t": df}))
    assert figures["found"] >= 0.8 * figures["residue"] and figures["wrong"] <= 0.02 * figures["units"]


def test_residue_of_clean_and_empty_tables(spark):
    df = spark.createDataFrame(pages()[:40], "rec_id bigint, url string, text string")
    assert residue.find(spark, {"t": df}).count() == 0 and residue.find(spark, {"t": df.limit(0)}).count() == 0


def test_shared_lines_without_broadcast(spark, monkeypatch):
    monkeypatch.setattr(residue, "BROADCAST_KEYS", -1)
    df = spark.createDataFrame(pages(), "rec_id bigint, url string, text string")
    assert residue.find(spark, {"t": df}).where("reason = 'error'").count() == 18


# --- boilerplate ------------------------------------------------------------------


def site_pages():
    rng, rows, truth = random.Random(9), [], {}
    for i in range(60):
        site = f"house{i % 3}.ex"
        lines, body = [], set()

        def put(text, own):
            lines.append(text)
            if own and text:
                body.add(len(lines))

        put("Skip to main content", False)
        put("Home | Visit | Apply | Library | Contact", False)
        for item in ("Visit", "Apply", "Library"):
            put("- " + item, False)
        put(f"Home > Visit > Room keys {i}", False)
        put("", False)
        put("Room keys", True)
        put(rng.choice(SENTENCES), True)
        put("* a letter from the dean", True)
        put(f"* ${i + 5} for room keys", True)
        put("Quick links", False)
        put("- Ask the library", False)
        put(f"- [Guide to form {i}](https://{site}/n/{i})", False)
        put(rng.choice(SENTENCES), True)
        put("We use cookies to remember your settings.", False)
        put("Cookie baking takes place in the hall at nine, and all are welcome.", True)
        put("Print this page", False)
        put(f"Page owner: house{i % 3} web team", False)
        rows.append((i, f"https://{site}/about/room-keys-{i}", "\n".join(lines)))
        truth[i] = {k for k, t in enumerate(lines, 1) if t} - body
    return rows, truth


def test_furniture(spark, monkeypatch):
    rows, truth = site_pages()
    extra = [(900, None, "404 Not Found\nBack to top"), (901, "https://house0.ex/e", None), (902, "https://house0.ex/f", ""), (903, "https://house0.ex/g", "\n \n"), (904, "https://house0.ex/h", "A very long line of text. " * 20_000), (0, rows[0][1], rows[0][2])]
    df = spark.createDataFrame([(*r, [1], 1) for r in rows + extra], "rec_id bigint, url string, text string, keys array<int>, page int")
    for few in (boilerplate.BROADCAST_HOSTS, -1):
        monkeypatch.setattr(boilerplate, "BROADCAST_HOSTS", few)
        got = boilerplate.furniture({"t": df}).collect()
        assert {r.rec_id for r in got} == set(truth) | {900, 903, 904}
        wrong = sum(len(set(r.line_nos) ^ truth[r.rec_id]) for r in got if r.rec_id in truth)
        assert wrong <= 0.02 * sum(map(len, truth.values()))
        own = {r.rec_id: r for r in got}
        assert own[900].line_nos == [2] and own[900].text == "404 Not Found" and own[903].line_nos == [] and own[904].line_nos == []
    assert boilerplate.furniture({"t": df.limit(0)}).count() == 0


def test_paths_are_voted_for_by_host(spark, monkeypatch):
    """One path is furniture on a host with most of the pages, and body on another."""
    rows = [(i, f"https://big.ex/p{i}", f"Rooms\n{SENTENCES[i % 5]}\n\nQuick links\n- Ask about {w} maps") for i, w in enumerate(f"w{i}x" for i in range(300))]
    rows += [(1000 + i, f"https://small.ex/p{i}", f"Rooms\nDoor {i} is for all who come by bus.\n- Ask about v{i}x maps\nHall {i} is for all who come by boat on a weekday.") for i in range(90)]
    rows += [(2000 + i, f"https://{site}.ex/q{i}", f"{SENTENCES[0]}\n\n- Ask about z{i}x maps") for i, site in enumerate(("big", "small"))]
    df = spark.createDataFrame(rows, "rec_id bigint, url string, text string")
    for few, texts in ((boilerplate.BROADCAST_HOSTS, 5_000), (-1, 50)):
        monkeypatch.setattr(boilerplate, "BROADCAST_HOSTS", few)
        monkeypatch.setattr(boilerplate, "TASK_TEXTS", texts, raising=False)
        got = {r.rec_id: r.line_nos for r in boilerplate.furniture({"t": df}).collect()}
        assert len(got) == len(rows) and got[2000] == [3] and got[2001] == []


def test_a_host_s_repetition_outvotes_a_sentence(spark):
    note = "Die Angaben auf dieser Seite sind ohne Gewähr und werden jedes Jahr vom Amt erneuert."
    links = " ".join(f"[Part number {k} of us](/p{k})" for k in range(9)) + "."
    rows = [(i, f"https://a.ex/p{i}", f"{links}\n\nRooms {i}\nHall v{i}x opens at nine for all who need a quiet place.\n{SENTENCES[i % 5] if i % 9 == 0 else 'Form w%dx goes to the desk in the second week of May.' % i}\n{note}\n### Amtliche Hinweise") for i in range(90)]
    rows += [(1000 + i, f"https://b.ex/p{i}", f"Rooms {i}\nHall u{i}x opens at nine for all who need a quiet place.\n{note if i == 7 else SENTENCES[0]}") for i in range(20)]
    df = spark.createDataFrame(rows, "rec_id bigint, url string, text string")
    got = {r.rec_id: r.line_nos for r in boilerplate.furniture({"t": df}).collect()}
    assert all(got[i] == [1, 6, 7] for i in range(90)) and not any(got[1000 + i] for i in range(20))


# --- truncation and survivors -----------------------------------------------------


def values():
    rng, rows, truth = random.Random(10), [], set()
    noun = ["maps", "taxes", "bridges", "poems", "metals", "rivers", "courts", "novels", "cells", "lenses"]
    n = 0
    for _ in range(900):
        full = " ".join(f"The course joins {rng.choice(noun)} with {rng.choice(noun)} and {rng.choice(noun)} in the second half." if rng.random() < 0.5 else f"Students write about {rng.choice(noun)} and defend an argument." for _ in range(rng.randint(1, 7)))
        feed = rng.choice(["short", "free"])
        v = full
        if feed == "short" and len(full) > 200:
            v = full[:200].rstrip() if rng.random() < 0.5 else full[:197] + "..."
            truth |= set() if v.endswith("half.") or v.endswith("argument.") else {n}
        elif rng.random() < 0.05:
            v = full[:-1]  # merely lacks its stop
        rows.append((n, feed, v))
        n += 1
    for v in ("Lab fee required", "N/A", "", None, "  ", "TBA", "Hybrid section"):
        for feed in ("short", "free", None):
            rows.append((n, feed, v))
            n += 1
    return rows, truth


def test_truncation(spark):
    rows, truth = values()
    df = spark.createDataFrame([(*r, 3, "e") for r in rows], "rec_id bigint, feed string, description string, n int, ending string")
    found = truncation.find(df, ("description",))
    got = {r.rec_id for r in found.where("cut").collect()}
    assert len(got - truth) <= 2 and len(truth - got) <= 0.02 * len(truth)
    limits = {(r.feed, r.n) for r in found.where("limit_posterior > 0.8").collect()}
    assert ("short", 200) in limits and not any(f == "free" for f, _ in limits)
    rates = {r.feed: r.share_cut for r in truncation.rates(found).collect()}
    assert rates["short"] > 0.3 > 0.05 > rates["free"]
    assert truncation.find(df.limit(0), ("description",)).count() == 0


def test_censoring_needs_a_spike():
    rng = np.random.default_rng(1)
    n = np.minimum(np.exp(rng.normal(5, 0.5, 4000)).astype(int), 200)
    lengths, counts = np.unique(n, return_counts=True)
    q = dict(zip(lengths.tolist(), truncation.censoring(lengths, counts)))
    assert q[200] > 0.9 and max(v for k, v in q.items() if k < 199) < 0.5


def test_independent_survivors(spark):
    t = datetime.datetime(2026, 1, 1)
    rows = [(1, "math 101-01", "a", 3, None), (2, "MATH-101 -2", "b", 3, t), (3, "MATH101", "c", 3, t), (4, "MATH 101", None, 9, t), (5, "MATH 101W-1", "w", 1, t), (6, None, "z", 9, t), (7, "??", "z", 9, t), (2, "MATH-101 -2", "b", 3, t), (8, "MATH 101", "d", None, t)]
    df = spark.createDataFrame(rows, "rec_id bigint, code string, title string, trust int, at timestamp").withColumn("c", survivors.course_code(F.col("code")))
    best = lambda d: survivors.consistent(d, "c", {"title": ["title"]}, {"title": F.col("title").isNotNull()}, [], "trust", "at")
    assert {r.c: (r.n_rows, r.title_rec) for r in best(df).collect()} == {"MATH 101": (6, 2), "MATH 101W": (1, 5)}
    assert best(df.limit(0)).count() == 0
    alone = best(df.where("rec_id in (4, 8)"))
    assert {(r.c, r.title_rec) for r in alone.collect()} == {("MATH 101", 8)}  # an unknown trust is better than none
    assert {(r.c, r.title_rec) for r in best(df.where("rec_id = 4")).collect()} == {("MATH 101", None)}


@pytest.mark.parametrize("pairs", [[("A", "B"), ("B", "C")], [("A", "B"), ("A", "C")], [("A", "C")], [("A", "B"), ("B", "C"), ("A", "C")], []])
def test_consistent_survivors_equal_brute_force(spark, pairs):
    """Searched (a chain, a circle) and by exact bounds (stars)."""
    rng = random.Random(11)
    rows = [(i, rng.randrange(25), rng.choice(["p", "q", "r", None]), rng.choice(["1", "2", "3"]), rng.choice(["x", "y", None]), rng.randint(1, 9)) for i in range(200)]
    rows += rows[:20]
    df = spark.createDataFrame([(*r, None) for r in rows], "rec_id bigint, g int, a string, b string, c string, trust int, at timestamp")
    bundles = {"A": ["a"], "B": ["b"], "C": ["c"]}
    real = {k: F.col(v[0]).isNotNull() for k, v in bundles.items()}
    got = {r.g: (r.A_rec, r.B_rec, r.C_rec) for r in survivors.consistent(df, "g", bundles, real, pairs, "trust", "at").collect()}
    by = {r[0]: r for r in rows}
    place = {"A": 2, "B": 3, "C": 4}
    for g in {r[1] for r in rows}:
        own = [r for r in by.values() if r[1] == g]
        best = {}
        for k in (2, 3, 4):
            for r in own:
                if r[k] is not None:
                    best[k, r[k]] = max(best.get((k, r[k]), 0), r[5])
        options = [[None, *(v for k, v in best if k == j)] for j in (2, 3, 4)]
        fits = lambda v: all(v[x] is None or v[y] is None or any(r[place[x]] == v[x] and r[place[y]] == v[y] for r in own) for x, y in pairs)  # noqa: E731, B023
        top = max(sum(best[place[k], v[k]] for k in v if v[k] is not None) for v in (dict(zip("ABC", o)) for o in itertools.product(*options)) if fits(v))
        chosen = {k: None if i is None else by[i][place[k]] for k, i in zip("ABC", got[g])}
        assert fits(chosen) and sum(by[i][5] for i in got[g] if i is not None) == top
    assert survivors.consistent(df.limit(0), "g", bundles, real, pairs, "trust", "at").count() == 0


def test_bound_ends_branches_without_dependencies(spark):
    """As p5_found asks: two bundles, none depending on the other.  The best single record
    is the floor, what cannot reach it ends, and one choice a group goes on."""
    rows = [("g", 1, 5.0, 7, 100, 200), ("g", 2, 9.0, 7, 101, None), ("g", 3, 2.0, 7, 102, 201), ("g", 4, 5.0, 8, 103, 202), ("g", 5, 5.0, 8, 100, 203), ("h", 6, 3.0, 7, None, 204), ("i", 7, 1.0, 7, None, None)]
    base = spark.createDataFrame(rows, "g string, rec bigint, trust double, time bigint, v0 bigint, v1 bigint")
    (first, one), (second, two) = survivors.levels(base, "g", 2, [])
    seen = lambda d, k: {(r.g, -r[f"o{k}"].m if r[f"o{k}"] else None) for r in d.collect()}
    assert {r.floor for r in one.where("g = 'g'").collect()} == {10.0}
    # record 3's title brings 2 + 5, no title 5; both are below 10
    assert seen(first, 0) == {("g", 2), ("g", 4), ("g", 5), ("h", None), ("i", None)}
    assert seen(one, 0) == {("g", 2), ("h", None), ("i", None)}
    # 9 is chosen: record 3's description makes 11, none 9
    assert seen(second, 1) == {("g", 1), ("g", 3), ("g", 4), ("g", 5), ("h", 6), ("i", None)}
    assert {(r.g, r.total, r.n_rows) for r in two.collect()} == {("g", 14.0, 5), ("h", 3.0, 1), ("i", 0.0, 1)}
    assert seen(two, 1) == {("g", 4), ("h", 6), ("i", None)}


def test_endings_are_fitted():
    at, away = np.array([10.0, 300.0, 600.0, 90.0]), np.array([2.0, 9000.0, 30.0, 900.0])
    closed, entire = truncation.endings_fitted(at, np.array([0.0, 280.0, 1.0, 30.0]), away)[1][[1, 3]]
    assert closed < -3 < entire  # as many closed values beside the limits as at them
    assert truncation.endings_fitted(at, np.array([0.0, 10.0, 1.0, 30.0]), away)[1][1] > -1.5


def test_posterior_decides_what_a_source_cuts_behind_full_stops(spark):
    """A feed that cuts at 120 characters, often behind a stop; the same endings elsewhere
    are whole.  Without limits found in the lengths none of them counts as cut."""
    rng = random.Random(5)
    rows = []
    for i in range(3000):
        feed = "limited" if i % 2 else "free"
        v = " ".join(rng.choice(["Bring a pen.", "Ask the desk.", "Go by bus or by boat.", "All are welcome at nine."]) for _ in range(rng.randint(2, 24))) + f" See hall {i}."
        rows.append((i, feed, v[:120] if feed == "limited" else v, feed == "limited" and len(v) > 120))
    df = spark.createDataFrame(rows, "rec_id bigint, feed string, description string, truth boolean")
    closed = truncation.find(df, ("description",)).where("ending = 'closed'").join(df.select("rec_id", "truth"), "rec_id")
    hit = closed.where("cut and truth").count()
    assert hit > 20 and hit >= 0.9 * closed.where("truth and n = 120").count() and closed.where("cut and not truth").count() <= 0.1 * hit
    assert closed.where("cut and limit_posterior = 0").count() == 0


def test_weak_labels():
    filler = ["Contact [ADVISOR] for questions about keys.", "[insert date here]", "Welcome to {{name}}, the place to read the agreement.", "Sample text sample text.", "Lorem ipsum dolor sit amet."]
    talk = ["We set cookies. [Accept] [Decline]", "Templates mark a field with braces, as in {{name}}.", "See the [map](/map) of the hall.", "If the portal shows access denied, the office resets the card.", "Exercises print the variable ${name} and explain each line."]
    errors = ["404 Not Found", "Exception in thread main: no value Warning: include(a.inc) failed to open stream in b.inc on line 5", "If the problem lasts, write to the help desk."]
    assert [residue.weak_label(t) for t in filler + talk + errors] == [residue.FILLER] * 5 + [residue.CONTENT] * 5 + [residue.ERROR] * 3


def test_margin():
    over, truth = np.array([3.0, 2.0, 1.0, 0.0]), np.array([True, True, False, False])
    assert residue.margin(over, truth) == 1.5 and residue.margin(over, ~truth & False) == 0.0


def test_buttons_of_a_notice_are_no_fields(spark):
    rows = pages() + [(5000 + i, f"https://h{i}.ex/c", SENTENCES[i % 5] + "\nWe set cookies that measure traffic. [Accept] [Decline]") for i in range(7)]
    df = spark.createDataFrame(rows, "rec_id bigint, url string, text string")
    got = {r.rec_id for r in residue.find(spark, {"t": df}).collect()}
    assert len(got) == 49 and not any(i >= 5000 for i in got)


def test_furniture_of_many_sites_is_no_content(spark):
    """An error page of a site too small to repeat its lines, which other sites have too."""
    rows = pages() + [(6000 + i, f"https://k{i}.ex/{i}", f"{'404 Not Found' if i < 2 else SENTENCES[i % 5]}\nAll dates are given in the local time of k{i}.") for i in range(9)]
    rows.append((6100, "https://k20.ex/1", "404 Not Found\nOnly this page tells the tale of a lost key."))
    df = spark.createDataFrame(rows, "rec_id bigint, url string, text string")
    got = {r.rec_id for r in residue.find(spark, {"t": df}).collect()}
    assert {i for i in got if i >= 6000} == {6000, 6001}
