import base64
import random

import pytest

from quarrycrest.llm import byte_pairs, languages, mixing

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.fixture(scope="module")
def encoder():
    return byte_pairs.Encoder(byte_pairs.read_vocabulary(byte_pairs.vocabulary_path()))


def test_encoder_is_exact(reference, encoder):
    rng = random.Random(2)
    alphabet = "abcdefghijklmnopqrstuvwxyzAEIOUéß日本🎉  \t\n=-#.'0123456789"
    texts = ["".join(rng.choices(alphabet, k=rng.randint(1, 80))) for _ in range(600)]
    texts += [c * n for c in "a =-é9\n🎉" for n in (1, 7, 300, 3000)] + ["<|endoftext|>", "\x00\x7f", "é"]
    for t in texts:
        ids = encoder.encode(t)
        assert ids == reference.encode_ordinary(t) and encoder.decode(ids) == t


def test_a_small_vocabulary_is_merged_by_rank():
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"bc", b"abc", b"cd", b"abcd"]
    e = byte_pairs.Encoder(tokens)

    def merged(word):
        parts = [bytes([b]) for b in word]
        while True:
            ranked = [(tokens.index(a + b), i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in tokens]
            if not ranked:
                return [tokens.index(p) for p in parts]
            _, i = min(ranked)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(1)
    for _ in range(400):
        w = "".join(rng.choices("abcd", k=rng.randint(1, 9)))
        assert e.word(w) == merged(w.encode())


def test_encode_and_decode_rows(spark, reference):
    rows = [(1, "Hello  world"), (2, ""), (3, None), (None, "x"), (1, "Hello  world"), (5, "long " * 60_000)]
    df = spark.createDataFrame([(*r, [1]) for r in rows], "doc_id bigint, text string, ids array<int>")
    got = byte_pairs.encode(df)
    assert sorted((r.doc_id or 0, r.ids) for r in got.collect()) == sorted((i or 0, reference.encode_ordinary(t or "")) for i, t in rows)
    assert sorted((r.doc_id or 0, r.text) for r in byte_pairs.decode(got).collect()) == sorted((i or 0, t or "") for i, t in rows)
    assert byte_pairs.encode(df.limit(0)).count() == 0


def test_mix(spark, encoder):
    rng = random.Random(4)
    rows = [(i, rng.choices(["big", "mid", "small", None, "other"], [60, 25, 5, 5, 5])[0], rng.choice([None, "", "a few words", "many words " * 20])) for i in range(400)]
    targets = [("big", 0.3, 2), ("mid", 0.4, 3), ("small", 0.2, 4), ("absent", 0.1, 2)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id bigint, source string, text string, tokens int")
    table = spark.createDataFrame(targets, "source string, target_share double, max_repeats int")
    copies, shares = mixing.mix(docs, table)
    got = {r.doc_id: r for r in copies.collect()}
    sizes = {i: len(encoder.encode(t)) if t else 0 for i, _, t in rows}
    assert {i: r.tokens for i, r in got.items()} == sizes
    total = sum(sizes.values())
    for source, share, most in targets:
        own = [got[i] for i, s, _ in rows if s == source]
        size = sum(r.tokens for r in own)
        mixed = sum(r.tokens * r.copies for r in own)
        assert all(r.copies <= most and (r.copies == 0 or r.tokens) for r in own)
        assert max((r.copies for r in own if r.tokens), default=0) - min((r.copies for r in own if r.tokens), default=0) <= 1
        assert abs(mixed - min(int(share * total), most * size)) <= max(sizes.values())
        line = next(r for r in shares.collect() if r.source == source)
        assert line.mixed_tokens == mixed and line.source_tokens == size
    assert all(got[i].copies == 0 for i, s, _ in rows if s in (None, "other"))
    again, _ = mixing.mix(docs.repartition(7), table)
    assert {r.doc_id: r.copies for r in again.collect()} == {i: r.copies for i, r in got.items()}
    empty, none = mixing.mix(docs.limit(0), table)
    assert empty.count() == 0 and {r.mixed_tokens for r in none.collect()} == {0}


EN = ["The library opens at nine on every weekday.", "Students bring a card to the front desk.", "All of the rooms are quiet at this time of day.", "You should ask them where the bus will stop."]
DE = ["Die Bibliothek öffnet jeden Tag um neun Uhr.", "Bitte bringen Sie Ihren Ausweis an den Schalter.", "Die Räume sind um diese Zeit sehr ruhig.", "Fragen Sie bitte, wo der Bus hält."]
JA = ["図書館は毎日九時に開きます。", "カードを窓口に持ってきてください。", "この時間の教室はとても静かです。", "バスがどこに止まるか聞いてください。"]


def test_languages(spark):
    rng = random.Random(6)
    rows, n = [], 0
    for label, pool in (("en", EN), ("German", DE), ("ja-JP", JA)):
        for _ in range(20):
            rows.append((n, " ".join(rng.choices(pool, k=3)), label))
            n += 1
    cases = {100: (EN[0] + "\n" + DE[0], "en", {"en", "de"}), 101: (JA[0] + EN[1], " ", {"ja", "en"}), 102: (DE[1], None, {"de"}), 103: (EN[2], "deu", {"en"}), 104: (EN[3], "EN_us", set()), 105: (DE[2], "und", {"de"}),
             106: ("1234 567.", None, set()), 107: (None, None, set()), 108: ("", "en", set()), 109: ("   ", None, set()), 110: (" ".join(EN * 500), "xx", {"en"})}
    rows += [(i, t, lang) for i, (t, lang, _) in cases.items()] + [(102, DE[1], None), (None, EN[0], None)]
    df = spark.createDataFrame([(*r, 1, "s") for r in rows], "doc_id bigint, text string, lang string, segment int, label string")
    names = spark.createDataFrame([("en", "English", "eng"), ("de", "German", "deu"), ("ja", "Japanese", "jpn")], "lang string, english_name string, iso3 string")
    found = languages.cases(df, names).collect()
    got = {}
    for r in found:
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert {i: got.get(i, set()) for i in cases} == {i: want for i, (_, _, want) in cases.items()}
    assert not any(i in got for i in range(60)) and None not in got
    model = languages.train(df, names)
    for r in languages.segments(df.where("doc_id = 100"), model).collect():
        assert 0.5 < r.confidence <= 1 and cases[100][0][r.start_char : r.end_char] in (EN[0], DE[0])
    assert languages.cases(df.limit(0), names).count() == 0


def test_no_part_of_a_text_is_left_out(spark):
    """Sentences that lack their mark, end behind a quote or are short, and all other lines."""
    rows = [(1000 + 20 * k + i, " ".join(pool[(i + j) % 4] for j in range(3)), label) for k, (label, pool) in enumerate((("en", EN), ("de", DE), ("ja", JA))) for i in range(20)]
    cases = {1: (DE[0][:-1], "en", {"de"}), 2: (f"{EN[0]}\n{DE[2][:-1]}\n{EN[1]}", "en", {"en", "de"}), 3: (f'You should ask: "{EN[1]}" {DE[0]}', "de", {"en", "de"}), 4: (EN[0] + "\n静かです。", "en", {"en", "ja"}),
             5: ("Die Räume sind sehr ruhig", " ", {"de"}), 6: ("Bibliothek", None, set()), 7: ("1234 567 89 10.\n55 66 77.", None, set()), 8: (EN[0] + "\nBibliothek\n" + EN[1], "en", set()), 9: (JA[0][:-1], "en", {"ja"}), 10: (EN[0][:-1] + "?)**", "de", {"en"})}
    df = spark.createDataFrame(rows + [(i, t, lang) for i, (t, lang, _) in cases.items()], "doc_id bigint, text string, lang string")
    names = spark.createDataFrame([("en", "English", "eng"), ("de", "German", "deu"), ("ja", "Japanese", "jpn")], "lang string, english_name string, iso3 string")
    got = {}
    for r in languages.cases(df, names).where("doc_id < 100").collect():
        got.setdefault(r.doc_id, set()).add(r.lang)
    assert {i: got.get(i, set()) for i in cases} == {i: want for i, (_, _, want) in cases.items()}
    found = languages.segments(df.where("doc_id < 100"), languages.train(df, names))
    left = {i: list(t) for i, (t, _, _) in cases.items()}
    for r in found.collect():
        assert r.whole or cases[r.doc_id][0][r.start_char : r.end_char] == "Bibliothek"
        left[r.doc_id][r.start_char : r.end_char] = " " * (r.end_char - r.start_char)
    assert not any(c.isalpha() for t in left.values() for c in t)
    told = {r.doc_id: (r.lang, r.sentences, r.chars, r.share) for r in languages.document_languages(found).where("doc_id in (6, 8)").collect()}
    assert told == {6: ("de", 0, 10, 1.0), 8: ("en", 2, len(EN[0] + EN[1]), 1.0)}
    assert languages.document_languages(found).where("doc_id = 7").count() == 0


def test_a_sentence_goes_on_after_its_quote():
    from quarrycrest.llm.textbatch import TextBatch

    text = 'She said "Guten Morgen!" and left (quietly?). Kya yeh sach hai\u061f Haan\u0964 Yes.'
    starts, ends, _, _ = languages.sentences(TextBatch([None, text, "12"]))
    base = 1
    assert [text[s - base : e - base] for s, e in zip(starts, ends)] == ['She said "Guten Morgen!" and left (quietly?).', "Kya yeh sach hai\u061f", "Haan\u0964", "Yes."]


def test_copies_of_a_text_do_not_fill_the_sample(spark, monkeypatch):
    """One text makes up most of the rows; languages with few texts are in the fit all the same."""
    monkeypatch.setattr(languages, "SAMPLE_PER_LABEL", 20)
    rows = [(i, " ".join(EN), "en") for i in range(3000)]
    rows += [(5000 + i, f"{pool[i % 4]} {pool[(i + 1) % 4]}", label) for label, pool in (("de", DE), ("ja", JA)) for i in range(4)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").repartition(7)
    names = spark.createDataFrame([("en", "English", "eng"), ("de", "German", "deu"), ("ja", "Japanese", "jpn")], "lang string, english_name string, iso3 string")
    langs, model = languages.train(df, names)
    assert langs == ["de", "en", "ja"] and all(row.max() > row.min() for row in model)
    again = languages.train(df.repartition(3), names)[1]
    assert (again == model).all()  # the sample does not depend on the order of rows
