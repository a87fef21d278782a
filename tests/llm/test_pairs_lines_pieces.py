import random
import re
from collections import defaultdict
from urllib.parse import urlsplit

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quarrycrest.llm import near_duplicates, repeated_lines, splitting
from quarrycrest.llm.textbatch import TextBatch, shingles

WORDS = [f"w{i}" for i in range(400)]


def words_of(text):
    return re.findall(r"[^\W_]+", (text or "").lower())


def test_words_and_shingles_are_those_of_a_regex():
    texts = ["Straße_x 12, É! 日本語", None, "", "a\nb\r\nc", "x" * 5000, "İstanbul"]
    b = TextBatch(texts)
    s, e, h, d = b.words()
    joined = "\n".join(b.texts)
    assert [joined[i:j] for i, j in zip(s, e)] == [w for t in texts for w in re.findall(r"[^\W_]+", t or "")]
    assert len(s) == sum(len(re.findall(r"[^\W_]+", t or "")) for t in texts)
    again = TextBatch(["É", "é", "e"]).words()[2]
    assert again[0] == again[1] != again[2]
    h, d = shingles(TextBatch(["a b c d", "B C D", "a b", None]), 3)
    assert list(d) == [0, 0, 1] and h[1] == h[2]


def brute_pairs(rows, k, threshold):
    sets = {i: set(zip(*(words_of(t)[j:] for j in range(k)))) for i, t in rows if i is not None}
    out = set()
    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]):
                out.add((a, b))
    return out


def near_rows():
    rng = random.Random(3)
    rows, n = [], 0
    for _ in range(25):
        base = rng.choices(WORDS, k=rng.randint(30, 120))
        for edits in (0, 0, 1, 3, 8):
            w = list(base)
            for _ in range(edits):
                w[rng.randrange(len(w))] = rng.choice(WORDS)
            rows.append((n, rng.choice([" ", ", "]).join(w).title()))
            n += 1
    return rows + [(900, None), (901, ""), (902, "one two"), (903, "one two"), (None, rows[0][1]), (904, "long " * 50_000), (905, "LONG " * 40_000)]


@pytest.mark.parametrize(("k", "threshold"), [(3, 0.6), (5, 0.8)])
def test_pairs_equal_brute_force(spark, k, threshold):
    rows = near_rows()
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "rec_id bigint, text string, id string, rep int")
    got = [tuple(r) for r in near_duplicates.pairs(df, k=k, threshold=threshold).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_pairs(rows, k, threshold)


def test_groups_are_components(spark):
    rows = near_rows()
    df = spark.createDataFrame(rows, "rec_id bigint, text string")
    got = {r.rec_id: r for r in near_duplicates.groups(df, k=3, threshold=0.6).collect()}
    assert set(got) == {i for i, _ in rows if i is not None}
    parent = {i: i for i in got}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in brute_pairs(rows, 3, 0.6):
        parent[max(find(a), find(b))] = min(find(a), find(b))
    assert {i: r.group_id for i, r in got.items()} == {i: find(i) for i in got}
    assert got[900].n_links == 0 and got[902].group_id == 902


def test_pairs_of_empty_table(spark):
    df = spark.createDataFrame([], "rec_id bigint, text string")
    assert near_duplicates.pairs(df).count() == 0 and near_duplicates.groups(df).count() == 0


# --- repeated lines ---------------------------------------------------------------


def line_rows():
    rng = random.Random(5)
    rows, n = [], 0
    for site, pages in (("a.ex", 30), ("b.ex", 6), ("c.ex", 4)):
        for p in range(pages):
            url = rng.choice(["https://", "http://www."]) + site.upper() + f"/p{p}" + rng.choice(["", "/", "#x"])
            own = [" ".join(rng.choices(WORDS, k=rng.randint(1, 30))) for _ in range(3)]
            shared = [rng.choice(["* ", "", "_"]) + "Legal notice 1 of this site, which is rather long and so in several chunks of text!"] * (p % 3 != 0) + ["ok"] * (p % 4 == 0) + ["---", ""]
            rows.append((n, url, "\n".join(own[:1] + shared + own[1:])))
            n += 1
    rows += [(n, rows[0][1], rows[0][2]), (n + 1, None, "ok"), (n + 2, "https://a.ex/z", None), (n + 3, "https://a.ex/y", ""), (n + 4, "https://a.ex/x", "q " * 100_000)]
    return rows


def brute_lines(rows):
    pages, lines, places = defaultdict(set), defaultdict(set), []
    for i, url, text in rows:
        if url is None or not text:
            continue
        u = urlsplit(url)
        site = u.netloc.lower().removeprefix("www.")
        page = (site, u.path.rstrip("/"))
        pages[site].add(page)
        for k, line in enumerate(text.split("\n"), 1):
            key = re.sub(r"[\W_]+", "", line).lower()
            if key:
                lines[site, key].add(page)
                places.append((i, k, site, key))
    return {(i, k) for i, k, s, key in places if len(lines[s, key]) >= 5 and len(lines[s, key]) * 5 >= len(pages[s])}


@pytest.mark.parametrize("limit", [repeated_lines.BROADCAST_ROWS, -1])
def test_repeated_lines_equal_brute_force(spark, limit, monkeypatch):
    monkeypatch.setattr(repeated_lines, "BROADCAST_ROWS", limit)
    rows = line_rows()
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "rec_id bigint, url string, text string, page int, site string")
    got = {(r.id, r.line_no) for r in repeated_lines.repeated_lines(df).collect()}
    assert got == brute_lines(rows) and got
    texts = {r.rec_id: r for r in repeated_lines.without_repeated_lines(df).collect()}
    assert set(texts) == {r[0] for r in rows}
    for i, _, text in rows:
        want = text if text is None else "\n".join(x for k, x in enumerate(text.split("\n"), 1) if (i, k) not in got)
        assert texts[i].text == want


def test_repeated_lines_of_empty_table(spark):
    df = spark.createDataFrame([], "rec_id bigint, url string, text string")
    assert repeated_lines.repeated_lines(df).count() == 0 and repeated_lines.without_repeated_lines(df).count() == 0


# --- splitting --------------------------------------------------------------------

POLICY = [("", 200, 40, 20), ("tiny", 30, 10, 5), ("wild", 20, 50, 0)]


def check_pieces(text, pieces, limit):
    body = text.strip(" \t\r\n")
    start = len(text) - len(text.lstrip(" \t\r\n"))
    assert pieces[0][0] == start and pieces[-1][1] == start + len(body)
    for (a, b, t), nxt in zip(pieces, [*pieces[1:], None]):
        assert t == text[a:b] and 0 < len(t) <= limit
        if nxt:
            assert a < nxt[0] <= b < nxt[1]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text(alphabet="ab .\n\r\té。日 ", max_size=300), max_size=4), st.integers(2, 60), st.integers(0, 70), st.integers(0, 30))
def test_split_rows_lose_nothing(texts, limit, overlap, least):
    import pyarrow as pa

    texts = [t for t in texts if len(t.strip(" \t\r\n")) > limit]
    if not texts:
        return
    n = len(texts)
    rows = pa.RecordBatch.from_pydict({"id": list(range(n)), "m": [limit] * n, "o": [overlap] * n, "l": [least] * n})
    out = splitting.split_rows(rows, texts).to_pylist()
    for i, t in enumerate(texts):
        own = [r for r in out if r["rec_id"] == i]
        assert [r["chunk_index"] for r in own] == list(range(len(own))) and {r["chunk_total"] for r in own} == {len(own)}
        check_pieces(t, [(r["start_char"], r["end_char"], r["text"]) for r in own], limit)


def test_split_oversized(spark):
    prose = "Cats purr and cats sleep. A cat hunts mice. Cats like milk and cats like mice. " * 2 + "\n\n" + "Rockets burn fuel. A rocket engine needs fuel and thrust. Rockets fly to orbit. " * 3
    rows = [(1, None, "  " + "x" * 200 + "\n"), (2, "tiny", "word " * 20), (3, "unlisted", prose), (4, "wild", "z" * 500), (5, "", None), (6, "", ""), (7, "tiny", "y" * 30), (None, "tiny", "k" * 31), (2, "tiny", "word " * 20)]
    df = spark.createDataFrame([(*r, 1, "m") for r in rows], "rec_id bigint, content_type string, text string, k int, m string")
    policy = spark.createDataFrame(POLICY, "content_type string, max_chars int, overlap_chars int, min_chars int")
    got = splitting.split_oversized(df, policy).collect()
    assert {r.rec_id for r in got} == {2, 3, 4, None}
    # the topic changes at the empty line, and there one piece ends
    assert any(prose[r.end_char :].startswith("Rockets") for r in got if r.rec_id == 3)
    check_pieces("z" * 500, [(r.start_char, r.end_char, r.text) for r in sorted((r for r in got if r.rec_id == 4), key=lambda r: r.chunk_index)], 20)
    assert splitting.split_oversized(df.limit(0), policy).count() == 0


def test_deep_valley_beats_a_late_one():
    units = np.array([100, 150, 190])
    assert splitting.spans(0, 300, 200, 20, 10, units, np.array([0.1, 1.5, 0.2]), np.arange(0, 300, 5))[0] == (0, 150)


def test_a_boundary_anywhere_in_the_window_beats_white_space():
    spaces = np.arange(0, 600, 5)
    # only in the first half; only behind the place that leaves enough for the last piece
    assert splitting.spans(0, 300, 200, 20, 10, np.array([40, 60]), np.array([1.5, 0.1]), spaces)[0] == (0, 60)
    assert splitting.spans(0, 210, 200, 0, 80, np.array([190]), np.array([0.1]), spaces)[0] == (0, 190)


def whole_chunks(text):
    """Chunks of a text, one letter at a time: a boundary wherever the same hash of the
    last WINDOW letters and digits meets the mask, however the text is laid out."""
    letters = [(i, c) for i, c in enumerate(text) if c.isalnum()]
    docs, starts, ends, keys = repeated_lines.cut_whole([text])
    plain = [[c.lower() for i, c in letters if s <= i < e] for s, e in zip(starts.tolist(), ends.tolist())]
    return list(zip(starts.tolist(), ends.tolist(), map("".join, plain), keys.tolist()))


def test_whole_chunks_ignore_the_layout():
    rng = random.Random(3)
    words = [rng.choice(WORDS) for _ in range(900)]
    flat, laid = " ".join(words), "".join(w.upper() + rng.choice([" ", "\n", " * ", ", \n\n- "]) for w in words)
    a, b = whole_chunks(flat), whole_chunks(laid)
    assert [(t, k) for _, _, t, k in a] == [(t, k) for _, _, t, k in b] and len(a) > 10
    assert all(len(t) >= repeated_lines.LEAST_LETTERS for _, _, t, _ in a)
    # a text put before moves the places, not the chunks beyond its first boundary
    moved = {k for *_, k in whole_chunks("some other words here " + flat)}
    assert len({k for *_, k in a} - moved) <= 1
    docs, starts, ends, keys = repeated_lines.cut_whole(["", flat, None, " - ", flat])
    assert set(docs.tolist()) == {1, 4} and (keys[docs == 1] == keys[docs == 4]).all() and (starts[docs == 1] == starts[docs == 4]).all()


@pytest.mark.parametrize("limit", [repeated_lines.BROADCAST_ROWS, -1])
def test_repeated_chunks_equal_a_count_in_python(spark, limit, monkeypatch):
    """A notice that every page wraps in its own way."""
    monkeypatch.setattr(repeated_lines, "BROADCAST_ROWS", limit)
    rng = random.Random(4)
    notice = [rng.choice(WORDS) for _ in range(150)]
    rows = []
    for i in range(40):
        own = " ".join(rng.choice(WORDS) for _ in range(60))
        rows.append((i, f"https://{'a' if i % 3 else 'b'}.ex/p{i}", own + "\n" + ("".join(w + rng.choice([" ", "\n"]) for w in notice) if i % 3 else "") + own[::-1]))
    rows += [(100, None, " ".join(notice)), (101, "https://a.ex/x", None), (102, "https://a.ex/p1", rows[1][2]), (103, "https://a.ex/y", "")]
    df = spark.createDataFrame([(*r, 1, "z") for r in rows], "rec_id bigint, url string, text string, chunk int, site string")
    got = {(r.rec_id, r.start, r.end) for r in repeated_lines.repeated_chunks(df).collect()}
    pages, sites = defaultdict(set), defaultdict(set)
    for i, url, text in rows:
        if url and text:
            sites[urlsplit(url).netloc].add(url)
            for _, _, t, _ in whole_chunks(text):
                pages[urlsplit(url).netloc, t].add(url)
    want = set()
    for i, url, text in rows:
        site = urlsplit(url or "").netloc
        if url and text:
            want |= {(i, s, e) for s, e, t, _ in whole_chunks(text) if len(pages[site, t]) >= 5 and 5 * len(pages[site, t]) >= len(sites[site])}
    assert got == want and {i for i, *_ in got} == {r[0] for r in rows[:40] if r[0] % 3} | {102}
    assert repeated_lines.repeated_chunks(df.limit(0)).count() == 0
