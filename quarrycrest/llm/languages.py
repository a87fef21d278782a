"""Languages of documents and of their sentences.

Multinomial naive Bayes over hashed character n-grams (1 to ORDERS letters, words
joined by one space).  It is fitted on at most SAMPLE_PER_LABEL labelled documents of
each language, sentence by sentence; as labels are wrong in places and texts mixed,
each of ROUNDS rounds gives every sentence the language that the model before finds,
and fits anew.  The matrix of log probabilities (languages x 2**BITS) is broadcast;
a batch is scored as a sparse product with numpy.

A segment is a sentence or a line of any other kind (heading, entry, fragment): segments
hold every letter of a text.  A segment's confidence is the posterior, tempered for overlap.
A whole sentence ends with a sentence's mark and has MIN_WORDS words.  If it is shorter, but
has SHORT_WORDS, or merely lacks its mark, its language must stand out (SURE_OPEN), as
headings and entries may be names; without a mark it has OPEN_WORDS words, or ALONE_WORDS
in a text without other sentences.  Wide characters make up for words.

A document's languages are those of its whole sentences; of one without any, that which
most of its segments speak for.  Cases are told by whole sentences only, as they are asked
for.  Null, empty and wordless texts have no segment and are never cases.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrycrest.llm.common import BLANK, map_texts
from quarrycrest.llm.textbatch import TextBatch, is_one_of, mix, sentence_ends, slices, unit_starts, white_space

ORDERS, BITS, ROUNDS = 4, 17, 3
SAMPLE_PER_LABEL = 500
#: Words, or wide characters, of whole sentences: with their mark, short ones, without it, and
#: without it where a text has nothing else.  Only in the first do numbers count as words.
MIN_WORDS, MIN_WIDE = 3, 6
SHORT_WORDS, SHORT_WIDE = 2, 3
OPEN_WORDS, OPEN_WIDE = 6, 6
ALONE_WORDS, ALONE_WIDE = 3, 3
SURE, SURE_OPEN = 0.5, 0.95
SMOOTH = 0.02
#: What ends a sentence in other scripts, besides textbatch's marks; the first needs no space.
OTHER_MARKS = np.array([ord(c) for c in "\uff61\u061f\u06d4\u0964\u0965\u1362\u1367\u0589\u104b\u17d4\u203d\u2047\u2048\u2049"], np.uint32)
#: Kinds of segments: a sentence, what is one if its language stands out, and others.
MARKED, OPEN, OTHER = 2, 1, 0


@lru_cache(1)
def _case_tables():
    chars = [chr(i) for i in range(0x32000)]
    return np.array([c.isalpha() for c in chars]), np.array([c.islower() for c in chars])


def sentences(b: TextBatch):
    """(starts, ends, texts, kinds) of the segments: all that has a letter, cut where lines
    and sentences end.  After a closing quote or bracket a sentence ends only if no small
    letter follows."""
    alpha, small = (t[np.minimum(b.code, len(t) - 1)] & (b.code < len(t)) for t in _case_tables())
    space = white_space(b)
    units, _ = unit_starts(b, space)
    if not len(units):
        return units, units, units, units
    mark = sentence_ends(b.code) | is_one_of(b.code, OTHER_MARKS)
    marks = np.concatenate(([0], np.cumsum(mark)))
    inner = np.maximum.accumulate(np.where(b.alnum | space, np.arange(len(b.code)), -1))
    closed = lambda at: marks[at + 1] > marks[inner[at] + 1]  # noqa: E731 - a mark after the last letter or digit
    solid = np.flatnonzero(~space)
    before, at = solid[:-1], solid[1:]
    cut = (at - before > 1) & closed(before) & (mark[before] | ~small[at]) | (b.code[before] == OTHER_MARKS[0])
    units = np.union1d(units, at[cut])
    stops = np.append(units[1:], len(b.code))
    last = solid[np.searchsorted(solid, stops) - 1]
    s, e, _, _ = b.words()
    letters = np.concatenate(([0], np.cumsum(alpha)))
    unit_of = np.searchsorted(units, s, "right") - 1
    counts = np.bincount(unit_of, minlength=len(units))
    words = np.bincount(unit_of[letters[e] > letters[s]], minlength=len(units))
    wide = np.concatenate(([0], np.cumsum((b.code >= 0x2E80) & b.alnum)))
    n_wide = wide[stops] - wide[units]
    ended = closed(last)
    marked = ended & ((counts >= MIN_WORDS) | (n_wide >= MIN_WIDE))
    likely = (words >= OPEN_WORDS) | (n_wide >= OPEN_WIDE) | (ended & ((words >= SHORT_WORDS) | (n_wide >= SHORT_WIDE)))
    docs = b.doc_of(units)
    alone = np.bincount(docs[marked | likely], minlength=len(b.texts))[docs] == 0
    likely |= alone & ((words >= ALONE_WORDS) | (n_wide >= ALONE_WIDE))
    kinds = np.where(marked, MARKED, np.where(likely, OPEN, OTHER))
    kept = letters[stops] > letters[units]
    return units[kept], last[kept] + 1, docs[kept], kinds[kept]


def grams(b: TextBatch, starts, ends):
    """(hashed n-grams, sentence of each): letters only, any gap is one space."""
    letter = b.alnum & ~((b.code >= 48) & (b.code <= 57))
    run = np.zeros(len(b.code), bool)
    run[2:] = (b.code[2:] == b.code[1:-1]) & (b.code[2:] == b.code[:-2])
    letter &= ~run  # a key held down says nothing about the language
    keep = letter | np.concatenate(([False], letter[:-1]))  # a letter, or the first place after one
    inside = np.zeros(len(b.code) + 1, np.int32)
    np.add.at(inside, starts, 1)
    np.add.at(inside, ends, -1)
    at = np.flatnonzero(keep & (np.cumsum(inside[:-1]) > 0))
    owner = np.searchsorted(starts, at, "right") - 1
    value = np.where(letter[at], b.low[at], np.uint64(32))
    out, who = [], []
    h = np.zeros(len(at), np.uint64)
    for n in range(ORDERS):
        size = len(at) - n
        if size <= 0:
            break
        h = mix(h[:size] * np.uint64(0x100000001B3) + value[n:] + np.uint64(n + 1))
        same = owner[:size] == owner[n:]
        out.append((h[same] >> np.uint64(64 - BITS)).astype(np.int64))
        who.append(owner[:size][same])
    return np.concatenate(out) if out else np.empty(0, np.int64), np.concatenate(who) if who else np.empty(0, np.int64)


def log_odds(table: np.ndarray, feats, owner, n: int) -> np.ndarray:
    """(n, languages): sums of log probabilities by owner; table is (languages, 2**BITS).
    Owners ascend within the n-grams of one order, so each order is summed up in runs."""
    out = np.zeros((n, len(table)))
    for part in np.split(np.arange(len(owner)), np.flatnonzero(np.diff(owner) < 0) + 1):
        if len(part):
            f, o = feats[part[0] : part[-1] + 1], owner[part[0] : part[-1] + 1]
            starts = np.flatnonzero(np.diff(o, prepend=-1))
            for k, row in enumerate(table):
                out[o[starts], k] += np.add.reduceat(row[f], starts)
    return out


def _fit(parts, k: int) -> np.ndarray:
    """Log probabilities.  An n-gram a language doesn't have costs the same in all, so
    that languages with few documents don't attract what none of them has."""
    seen = np.zeros(k << BITS)
    for (feats, owner, n), label in parts:
        if n:
            seen += np.bincount(feats * np.int64(k) + label[owner], minlength=k << BITS)
    seen = seen.reshape(-1, k)
    return np.ascontiguousarray(np.log((1 - SMOOTH) * seen / np.maximum(seen.sum(0), 1) + SMOOTH / (1 << BITS)).T, np.float32)


def label_of(column: Column, names: DataFrame) -> Column:
    """The two-letter language a label names, in whatever notation; null if none.

    names is the table of languages, of at most 1,000 rows (checked)."""
    rows = names.select("lang", "english_name", "iso3").limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("more than 1,000 languages")
    known = {str(v).lower(): r.lang for r in rows for v in (r.lang, r.english_name, r.iso3) if v}
    plain = F.lower(F.regexp_replace(column, rf"^{BLANK}+|{BLANK}+\z", ""))
    first = F.regexp_extract(plain, r"^([^-_]*)", 1)
    lookup = F.create_map(*(F.lit(x) for kv in known.items() for x in kv))
    return F.coalesce(F.element_at(lookup, plain), F.element_at(lookup, first))


def train(documents: DataFrame, names: DataFrame, text: str = "text", label: str = "lang") -> tuple[list[str], np.ndarray]:
    langs = sorted(r.lang for r in names.select("lang").distinct().collect())
    rows = documents.where(F.length(text) > 0).select(F.col(text).alias("t"), label_of(F.col(label), names).alias("l")).where("l is not null")
    # copies of a text are one, so that none fills the sample
    rows = rows.select("l", "t", F.xxhash64("t").alias("h"))
    counts = {r.l: r.n for r in rows.groupBy("l").agg(F.count_distinct("h").alias("n")).collect()}
    share = F.create_map(*(x for lang in langs for x in (F.lit(lang), F.lit(min(1.0, SAMPLE_PER_LABEL / max(1, counts.get(lang, 0)))))))
    chosen = rows.where(F.pmod("h", F.lit(1_000_000)) < F.element_at(share, F.col("l")) * 1_000_000).groupBy("l", "h").agg(F.first("t").alias("t"))
    # by chance about SAMPLE_PER_LABEL each; the bound keeps the texts with the smallest hashes
    number_of = F.row_number().over(Window.partitionBy("l").orderBy(F.pmod("h", F.lit(1_000_000)), "h"))
    chosen = chosen.withColumn("n", number_of).where(F.col("n") <= 2 * SAMPLE_PER_LABEL)
    sample = sorted((r.l, r.t) for r in chosen.collect())
    number = {x: i for i, x in enumerate(langs)}
    parts, labels, done = [], [], 0
    for i, j in slices([t for _, t in sample], 500_000):
        b = TextBatch([t for _, t in sample[i:j]])
        starts, ends, docs, kinds = sentences(b)
        # headings and entries are often in another language than the label's: a text's sentences, its lines only if it has none
        fit = (kinds == MARKED) | (np.bincount(docs[kinds == MARKED], minlength=j - i)[docs] == 0)
        starts, ends, docs = starts[fit], ends[fit], docs[fit]
        feats, owner = grams(b, starts, ends)
        parts.append((feats.astype(np.int32), owner.astype(np.int32), len(starts)))
        labels.append(np.array([number[x] for x, _ in sample[i:j]], np.int64)[docs])
    table = _fit(zip(parts, labels), len(langs))
    for _ in range(ROUNDS):
        table = _fit(((p, log_odds(table, *p).argmax(1)) for p in parts if p[2]), len(langs))
    return langs, table


def segments(documents: DataFrame, model: tuple[list[str], np.ndarray], key: str = "doc_id", text: str = "text", every: bool = True) -> DataFrame:
    """(doc_id, segment, start_char, end_char, lang, confidence, whole) of all segments, or
    of those only that may be whole sentences; whole tells which are."""
    langs, table = model
    sent = documents.sparkSession.sparkContext.broadcast(table)

    def run(rows: pa.RecordBatch, texts: list):
        b = TextBatch(texts)
        starts, ends, docs, kinds = sentences(b)
        number = np.arange(len(docs)) - np.searchsorted(docs, docs)
        if not every:
            number, starts, ends, docs, kinds = (x[kinds > OTHER] for x in (number, starts, ends, docs, kinds))
        if not len(starts):
            return None
        feats, owner = grams(b, starts, ends)
        z = log_odds(sent.value, feats, owner, len(starts))
        # neighbouring n-grams overlap and are no independent evidence: the root of their number counts
        z -= z.max(1, keepdims=True)
        p = np.exp(z / np.sqrt(np.maximum(np.bincount(owner, minlength=len(starts)), 1))[:, None])
        p /= p.sum(1, keepdims=True)
        best = z.argmax(1)
        sure = p[np.arange(len(best)), best]
        base = b.start[docs]
        return pa.RecordBatch.from_arrays(
            [
                rows.column(0).take(pa.array(docs)),
                pa.array(number.astype(np.int32)),
                pa.array(starts - base),
                pa.array(ends - base),
                pa.array([langs[i] for i in best]),
                pa.array(sure),
                pa.array((kinds == MARKED) | ((kinds == OPEN) & (sure >= SURE_OPEN))),
            ],
            ["doc_id", "segment", "start_char", "end_char", "lang", "confidence", "whole"],
        )

    rows = documents.select(F.col(key).cast("bigint").alias("doc_id"), F.col(text).alias("text"))
    return map_texts(rows, "doc_id bigint, segment int, start_char bigint, end_char bigint, lang string, confidence double, whole boolean", "text", run)


def document_languages(found: DataFrame) -> DataFrame:
    """(doc_id, lang, sentences, chars, share, confidence): one row for each language a
    document has a whole sentence in; confidence is the surest sentence's.  A document
    without any has one row, with 0 sentences and its segments' figures."""
    chars, sure = F.col("end_char") - F.col("start_char"), F.col("whole") & (F.col("confidence") >= SURE)
    figures = lambda when, name: F.struct(F.sum(F.when(when, chars)).alias("chars"), F.max(F.when(when, F.col("confidence"))).alias("confidence")).alias(name)
    per = found.groupBy("doc_id", "lang").agg(F.count_if(sure).alias("sentences"), figures(sure, "own"), figures(F.lit(True), "any"), F.sum(chars * F.col("confidence")).alias("weight"))
    # a window holds a document's languages, one row each
    doc = Window.partitionBy("doc_id")
    per = per.withColumn("told", F.sum("sentences").over(doc) > 0).withColumn("all", F.sum(F.when(F.col("told"), F.col("own.chars")).otherwise(F.col("any.chars"))).over(doc))
    per = per.withColumn("top", F.row_number().over(doc.orderBy(F.desc("weight"), "lang")) == 1)
    kept = per.where((F.col("sentences") > 0) | (~F.col("told") & F.col("top"))).withColumn("f", F.when(F.col("told"), F.col("own")).otherwise(F.col("any")))
    return kept.select("doc_id", "lang", "sentences", "f.chars", (F.col("f.chars") / F.col("all")).alias("share"), "f.confidence")


def cases(documents: DataFrame, names: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> DataFrame:
    """(doc_id, lang) of documents whose label is missing or unknown, names another
    language than the text's, or whose text has more than one language."""
    docs = documents.where(F.col(key).isNotNull())
    per = segments(docs, train(documents, names, text, label), key, text, every=False).where(F.col("whole") & (F.col("confidence") >= SURE))
    labels = docs.select(F.col(key).cast("bigint").alias("doc_id"), label_of(F.col(label), names).alias("label"))
    wrong = per.groupBy("doc_id").agg(F.collect_set("lang").alias("langs")).join(labels, "doc_id")
    wrong = wrong.where(F.col("label").isNull() | (F.size("langs") > 1) | (F.col("langs")[0] != F.col("label")))
    return wrong.select("doc_id", F.explode("langs").alias("lang"))
