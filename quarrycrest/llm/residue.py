"""Template residue, filler and error pages, by a linear classifier over sentences.

Units are sentences and lines.  Each gets hashed word unigrams and bigrams, its first
and last word, its length, whether it opens the text (its title) and the syntax of the
unfilled fields it holds.  A regularised softmax regression tells CONTENT, FILLER and
ERROR apart.  Its labels are weak: response-status headings, phrases and field syntax
that such texts are made of, read as negative where the sentence talks about them (words
for variables, syntax or phrases, verbs of reporting, conditions).  It is fitted on a
bounded sample of rows (SAMPLE_ROWS, by hash, and as many short ones).  A fifth of the
hosts is left out at first: on them the margins that a unit needs for either class are
chosen and the figures taken; then the fit goes on over all hosts.

A row is left out if any unit is filler, or if it has an error unit and no other
content: no other sentence, save lines that are furniture.  Those are on FURNITURE_PAGES
pages and FURNITURE_SHARE of the pages of their site, or, the site's own name apart, on
FURNITURE_SITES sites and FURNITURE_SITE_SHARE of all.  Null and empty texts are never
left out; a table without any labelled residue gives a classifier that leaves nothing out.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrycrest.functions.urls import host, normalize_url
from quarrycrest.llm.common import checkpoint, map_texts
from quarrycrest.llm.textbatch import TextBatch, is_one_of, mix, sentence_ends, slices, unit_starts

BITS = 20
CONTENT, FILLER, ERROR = 0, 1, 2
SAMPLE_ROWS, SAMPLE_UNITS, CONTENT_UNITS = 8_000, 30_000, 40_000
SHORT = 300
FURNITURE_PAGES, FURNITURE_SHARE = 3, 0.01
FURNITURE_SITES, FURNITURE_SITE_SHARE = 5, 0.02
SENTENCE_WORDS = 5
#: A unit of a rare class weighs at most so many times one of content in the fit.
MOST_WEIGHT = 8.0
#: A feature of a unit's fields counts as much as so many of its words.
FIELD_VALUE = 3
#: Keys of lines sent to every worker at most (8 bytes each); beyond, a join.
BROADCAST_KEYS = 200_000

# The weak labels.  Field syntax of common template languages (a word in
# square brackets is one in capitals only: others are buttons); status headings; phrases
# of filler and of notices; words of the printer's filler text.
SYNTAX = [
    r"\{\{[^{}\n]{1,40}\}\}",
    r"\$\{[^{}\n]{1,40}\}",
    r"\{\$[^{}\n]{1,40}\}",
    r"#\{[^{}\n]{1,40}\}",
    r"\{%[^{}\n]{1,40}%\}",
    r"<%=?[^<>\n]{1,40}%>",
    r"<<[^<>\n]{1,40}>>",
    r"(?i:<insert [^<>\n]{1,40}>)",
    r"(?i:\[insert [^\[\]\n]{1,40}\])",
    r"(?i:\[your [^\[\]\n]{1,40}\])",
    r"\[[A-Z][A-Z_ ]{2,30}\](?!\()",
    r"\[\[[^\[\]\n]{1,40}\]\]",
    r"(?i:##[A-Z][A-Z_]{1,30}##)",
    r"@@\w{2,30}@@",
    r"(?i:__[A-Z][A-Z_]{1,30}__)",
    r"%%\w{2,30}%%",
]
FIELD = re.compile("|".join(f"({x})" for x in SYNTAX))
STATUS = re.compile(
    r"^\W*(?:(?:error|http|status)[ :]*)*(?:(?:400|401|403|404|405|408|410|429|500|501|502|503|504)\b[ :\-]*)?"
    r"(?:error|bad request|unauthorized|forbidden|(?:page |file )?not found|method not allowed|request timeout|gone|too many requests|internal server error"
    r"|not implemented|bad gateway|service unavailable|gateway timeout|access denied|application error|something went wrong|oops|we can.t find that page"
    r"|error (?:400|401|403|404|405|408|410|429|500|501|502|503|504))\W*$",
    re.I,
)
NOTICE = re.compile(
    r"not found on this server|could not connect to|permission to view this|session has timed out|sign in again to continue|reference number \d|down for maintenance"
    r"|check the address and reload|try again in a few minutes|could not complete your request|may have moved or no longer exists|failed to open stream|exception in thread"
    r"|if the problem lasts|not a robot|enable javascript|enable cookies|needs javascript|turn on scripts|scripts are blocked|allow scripting|newer browser"
    r"|browser does not support|checking your browser|loading, please wait|null undefined nan",
    re.I,
)
DUMMY = re.compile(
    r"placeholder paragraph|^\W*sample text|text goes here|replace this block|body copy to be supplied|delete after launch|asdf asdf|^\W*todo\b|add your content"
    r"|click to edit|^\W*heading one\W*$|^\W*subheading\W*$|teaser sits in this box|^\W*lorem ipsum",
    re.I,
)
LATIN = set(
    "ad adipiscing aliqua aliquip amet anim aute cillum commodo consectetur consequat culpa cupidatat deserunt do dolor dolore duis ea eiusmod elit enim esse est et eu ex"
    " excepteur exercitation fugiat id in incididunt ipsum irure labore laboris laborum lorem magna minim mollit nisi non nostrud nulla occaecat officia pariatur proident"
    " qui quis reprehenderit sed sint sit sunt tempor ullamco ut velit veniam vestibulum vivamus voluptate".split()
)
#: One of these words is in every status, notice and filler phrase, one of these marks
#: in every field, so that few units are searched for them.
MESSAGE_WORDS = frozenset(
    "again allowed application asdf browser checking complete connect content cookies copy delete denied edit error exception exists forbidden found gateway goes gone"
    " heading implemented javascript loading lorem maintenance many moved null oops page permission placeholder problem reference reload replace request robot sample"
    " scripting scripts server session sign stream subheading teaser text timeout todo turn unauthorized unavailable wrong".split()
)
MARKS = frozenset("{[<#@_%$")
# Signs that a sentence talks about such texts.
TALK = re.compile(
    r"\b(?:as in|such as|for example|e\.g|called|named|reads|reports|says|shows|prints|displays|means|marks|marked|stands for|came from|variables?|braces|brackets|syntax|notation|phrases?|expressions?|placeholders?)\b"
    r"|^\W*(?:if|when|whenever|unless)\b",
    re.I,
)
#: Words beyond which a sentence with a single such phrase has other content too.
LONG_UNIT = 18


MARK = re.compile(r"[{\[<#@_%$]")


def has_field(text: str) -> bool:
    """Whether FIELD is found in a text, looked for only where a mark begins one."""
    return any(FIELD.match(text, m.start()) for m in MARK.finditer(text))


def weak_label(unit: str) -> int:
    words = re.findall(r"[^\W_]+", unit.lower())
    if len(words) >= 4 and sum(w in LATIN for w in words) >= 0.7 * len(words):
        return FILLER
    if has_field(unit):
        return CONTENT if TALK.search(FIELD.sub(" ", unit)) else FILLER
    if MESSAGE_WORDS.isdisjoint(words):
        return CONTENT
    if DUMMY.search(unit):
        return CONTENT if len(words) > LONG_UNIT or TALK.search(DUMMY.sub(" ", unit)) else FILLER
    notices = len(NOTICE.findall(unit))
    if notices or STATUS.search(unit):
        return CONTENT if notices < 2 and (len(words) > LONG_UNIT or TALK.search(NOTICE.sub(" ", unit))) else ERROR
    return CONTENT


def unit_features(b: TextBatch):
    """(units, features, unit of each feature, words in each unit); sorted by unit."""
    units, _ = unit_starts(b)
    n = len(units)
    s, e, w, _ = b.words()
    u = np.searchsorted(units, s, "right") - 1
    count = np.bincount(u, minlength=n) if n else np.zeros(0, np.int64)
    pair = np.flatnonzero(u[1:] == u[:-1])
    first = np.flatnonzero(np.concatenate(([True], u[1:] != u[:-1]))) if len(u) else np.empty(0, np.int64)
    last = np.append(first[1:] - 1, len(u) - 1) if len(first) else first
    solid = np.ones(n, bool)
    ends = np.append(units[1:], len(b.code)) if n else units
    # the last character that isn't white space: a unit's end lies before the next one's start
    stop = sentence_ends(b.code)
    stops = np.concatenate(([0], np.cumsum(stop)))
    ended = stops[ends] - stops[np.maximum(units, ends - 3)] > 0 if n else solid
    title = np.isin(units, units[np.searchsorted(units, b.start[:-1])[np.searchsorted(units, b.start[:-1]) < n]]) if n else solid
    field, talk = _fields(b, units, ends)
    tag = lambda h, k: mix(h * np.uint64(2 * k + 1) + np.uint64(k))
    word = np.where(np.isin(w, _numbers(b, s, e)), np.uint64(7), w) if len(w) else w
    size = np.minimum(count, 12)
    parts = [(tag(word, 1), u), (tag(mix(word[pair] * np.uint64(31)) + word[pair + 1], 2), u[pair]), (tag(word[first], 3), u[first]), (tag(word[last], 4), u[last])]
    parts.append((tag((size * 4 + ended * 2 + title).astype(np.uint64), 5), np.arange(n)))
    at = np.repeat(np.flatnonzero(field), FIELD_VALUE)
    for k, x in enumerate((field, field > 0, size, ended, title), 6):  # what holds fields, and whether it talks about them
        parts.append((tag((x[at].astype(np.int64) * 2 + talk[at]).astype(np.uint64), k), at))
    feats, owner = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(owner, kind="stable")
    return units, (feats[order] >> np.uint64(64 - BITS)).astype(np.int64), owner[order], count, ended


def _fields(b: TextBatch, units, ends):
    """For each unit the syntax (from 1) of the last field in it, and whether it talks
    about fields.  Only places with a mark that begins one are looked at."""
    field, talk = np.zeros(len(units), np.int64), np.zeros(len(units), bool)
    joined, done = "\n".join(b.texts), 0
    for place in np.flatnonzero(is_one_of(b.code, np.array([ord(c) for c in MARKS], np.uint32))).tolist():
        m = FIELD.match(joined, place) if place >= done else None
        if m is not None:
            done = m.end()
            unit = np.searchsorted(units, place, "right") - 1
            if not field[unit]:
                talk[unit] = TALK.search(FIELD.sub(" ", joined[units[unit] : ends[unit]])) is not None
            field[unit] = m.lastindex
    return field, talk


def _numbers(b: TextBatch, s, e):
    """Hashes of the words that begin with a digit: all count as one word."""
    digit = (b.code[s] >= 48) & (b.code[s] <= 57)
    return np.unique(b.words()[2][digit])


def _sums(values: np.ndarray, at: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """(rows, groups): sums of values[row, at] over the groups that begin at starts."""
    return np.stack([np.add.reduceat(row[at], starts) for row in values]) if len(at) else np.zeros((len(values), 0), np.float32)


def _starts(owner: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.diff(owner, prepend=-1))


def scores(weights: np.ndarray, feats, owner, n: int) -> np.ndarray:
    """(classes, n): sum of a unit's weights over the root of their number; owner is
    sorted and names every unit."""
    size = np.maximum(np.bincount(owner, minlength=n), 1)
    return _sums(weights, feats, _starts(owner)) / np.sqrt(size, dtype=np.float32)


class Model:
    """Weights of the features that the sample has; all others weigh nothing."""

    def __init__(self, feats: np.ndarray, weights: np.ndarray, margin=(0.0, 0.0)):
        self.feats, self.weights, self.margin = feats, weights, margin

    def table(self) -> np.ndarray:
        out = np.zeros((3, 1 << BITS), np.float32)
        out[:, self.feats] = self.weights
        return out

    def classes(self, z: np.ndarray) -> np.ndarray:
        """The class of each unit: residue only if its margin over content is passed."""
        over = z[1:] - z[0] - np.array(self.margin, np.float32)[:, None]
        return np.where((over > 0).any(0), over.argmax(0) + 1, CONTENT)


def fit(feats, owner, labels: np.ndarray, start: Model | None = None, steps: int = 60, l2: float = 1e-6, rate: float = 0.5) -> Model:
    """Softmax regression over the features at hand, by gradient steps each feature of
    which is scaled by what it has moved so far (Adagrad)."""
    n, k = len(labels), 3
    seen, feats = np.unique(feats, return_inverse=True)
    weights = np.zeros((k, len(seen)), np.float32)
    counts = np.bincount(labels, minlength=k)
    if (counts[1:] == 0).all():
        weights[CONTENT] = 1
        return Model(seen, weights)
    if start is not None:
        place = np.minimum(np.searchsorted(start.feats, seen), len(start.feats) - 1)
        had = start.feats[place] == seen
        weights[:, had] = start.weights[:, place[had]]
    share = np.where(counts > 0, np.minimum(MOST_WEIGHT, (max(counts[CONTENT], 1) / np.maximum(counts, 1)) ** 0.5), 0)[labels]
    share /= share.sum()
    scale = (1 / np.sqrt(np.maximum(np.bincount(owner, minlength=n), 1))).astype(np.float32)
    truth = (labels == np.arange(k)[:, None]).astype(np.float32)
    by_unit = _starts(owner)
    order = np.argsort(feats, kind="stable")
    owner_of, by_feature = owner[order], _starts(feats[order])
    moved = np.full_like(weights, 1e-10)
    for _ in range(steps):
        z = _sums(weights, feats, by_unit) * scale
        p = np.exp(z - z.max(0))
        p /= p.sum(0)
        g = _sums(((p - truth) * (share * scale)).astype(np.float32), owner_of, by_feature) + l2 * weights
        moved += g * g
        weights -= rate * g / np.sqrt(moved)
    return Model(seen, weights)


def margin(over: np.ndarray, truth: np.ndarray) -> float:
    """The threshold with the best F1 for truth, in the middle of its interval; 0 if
    no case is there to choose by."""
    if not truth.any():
        return 0.0
    order = np.argsort(-over, kind="stable")
    hits = np.cumsum(truth[order])
    f1 = 2 * hits / (np.arange(1, len(order) + 1) + truth.sum())
    at = int(f1.argmax())
    above = float(over[order[at]])
    below = float(over[order[at + 1]]) if at + 1 < len(order) else above - 1.0
    return (above + below) / 2


def _sample(rows: DataFrame) -> list:
    """At most about SAMPLE_ROWS rows by hash, and as many with short texts."""
    total, short = rows.agg(F.count("*"), F.count_if(F.length("text") < SHORT)).first()
    h = F.pmod(F.xxhash64("tbl", "rec_id", F.lit(6)), F.lit(1_000_000))
    keep = lambda n: h < int(1_000_000 * min(1.0, SAMPLE_ROWS / max(n, 1)))
    return rows.where(keep(total) | ((F.length("text") < SHORT) & keep(short))).select("text", "site").limit(3 * SAMPLE_ROWS).collect()


def train(rows: DataFrame) -> tuple[Model, dict]:
    """(model, figures on unseen hosts) from rows (tbl, rec_id, text, site)."""
    sample = sorted(_sample(rows), key=lambda r: (r.site or "", r.text))
    long_units = sum(len(r.text) >= SHORT for r in sample) * 10
    rng = np.random.default_rng(6)
    none = np.empty(0, np.int32)
    parts, labels, unseen, done = [(none, none)], [], [np.empty(0, bool)], 0
    for i, j in slices([r.text for r in sample]):
        b = TextBatch([r.text for r in sample[i:j]])
        units, feats, owner, _, _ = unit_features(b)
        joined = "\n".join(b.texts)
        ends = np.append(units[1:], len(joined))
        docs = b.doc_of(units)
        # every unit of a short text, of the others a bounded number by chance
        brief = np.array([len(t) < SHORT for t in b.texts])[docs]
        keep = brief | (rng.random(len(units)) < SAMPLE_UNITS / max(1, long_units))
        feats, owner = _subset(feats, owner, keep)
        parts.append((feats.astype(np.int32), (owner + done).astype(np.int32)))
        done += int(keep.sum())
        labels += (weak_label(joined[s:e].strip()) for s, e in zip(units[keep].tolist(), ends[keep].tolist()))
        unseen.append(np.array([hash_site(r.site) % 5 == 0 for r in sample[i:j]])[docs[keep]])
    feats, owner = (np.concatenate(x) for x in zip(*parts))
    labels, unseen = np.array(labels, np.int64), np.concatenate(unseen)
    keep = (labels != CONTENT) | (rng.random(done) < CONTENT_UNITS / max(1, (labels == CONTENT).sum()))
    feats, owner = _subset(feats, owner, keep)
    labels, unseen = labels[keep], unseen[keep]
    tried = fit(*_subset(feats, owner, ~unseen), labels[~unseen])
    z = scores(tried.table(), *_subset(feats, owner, unseen), int(unseen.sum()))
    truth = labels[unseen]
    tried.margin = tuple(margin(z[c] - z[CONTENT], truth == c) for c in (FILLER, ERROR))
    got = tried.classes(z)
    figures = {"units": len(truth), "residue": int((truth != 0).sum()), "found": int(((truth != 0) & (got == truth)).sum()), "wrong": int(((got != 0) & (got != truth)).sum())}
    model = fit(feats, owner, labels, tried, steps=20)
    model.margin = tried.margin
    return model, figures


def hash_site(site) -> int:
    import zlib

    return zlib.crc32((site or "").encode())


def _subset(feats, owner, mask):
    """Features of the units in the mask, which are numbered anew."""
    number = np.cumsum(mask) - 1
    of = mask[owner]
    return feats[of], number[owner[of]]


def _rows(tables: dict[str, DataFrame]) -> DataFrame:
    parts = None
    for name, df in tables.items():
        part = df.where(F.col("text") != "").select(F.lit(name).alias("tbl"), F.col("rec_id").cast("bigint").alias("rec_id"), F.col("url"), "text")
        parts = part if parts is None else parts.unionByName(part)
    page = normalize_url(F.coalesce("url", F.lit("")))
    return parts.withColumn("page", page).select("tbl", "rec_id", host(F.col("page")).alias("site"), F.xxhash64("page").alias("page"), "text")


def _line_keys(b: TextBatch, sites: list):
    """(texts, hashes, starts) of the lines by their words, but for the name of the
    site; lines without any other word are left out."""
    starts, ends, docs, _ = b.lines()
    s, _, w, d = b.words()
    names = TextBatch([(x or "").split(".")[0] for x in sites])
    _, _, name, of = names.words()
    own = np.isin(mix(w + d.astype(np.uint64)), mix(name + of.astype(np.uint64)))
    s, w = s[~own], w[~own]
    first, last = np.searchsorted(s, starts), np.searchsorted(s, ends)
    full = last > first
    return docs[full], b.span_hash(w)(first[full], last[full]), starts[full]


def judge(rows: DataFrame, model) -> DataFrame:
    """(tbl, rec_id, site, filler, error, lines) of rows with filler or errors; lines
    are the keys of the lines with sentences of other content."""

    weights: list[np.ndarray] = []

    def run(batch: pa.RecordBatch, texts: list):
        if not weights:
            weights.append(model.value.table())
        b = TextBatch(texts)
        units, feats, owner, count, ended = unit_features(b)
        kind = model.value.classes(scores(weights[0], feats, owner, len(units)))
        docs = b.doc_of(units)
        filler = np.bincount(docs[kind == FILLER], minlength=len(texts))
        error = np.bincount(docs[kind == ERROR], minlength=len(texts))
        hit = np.flatnonzero((filler > 0) | (error > 0))
        if not len(hit):
            return None
        other = units[(kind == CONTENT) & (count >= SENTENCE_WORDS) & ended]
        line_doc, key, start = _line_keys(b, batch.column(2).to_pylist())
        has = np.unique(np.searchsorted(start, other, "right") - 1) if len(start) else np.empty(0, np.int64)
        own: dict[int, list[int]] = {}
        for i in has.tolist():
            own.setdefault(int(line_doc[i]), []).append(int(key[i].view(np.int64)))
        take = pa.array(hit)
        return pa.RecordBatch.from_arrays(
            [batch.column(i).take(take) for i in range(3)] + [pa.array(filler[hit]), pa.array(error[hit]), pa.array([own.get(int(d), []) for d in hit], pa.list_(pa.int64()))],
            ["tbl", "rec_id", "site", "filler", "error", "lines"],
        )

    return map_texts(rows, "tbl string, rec_id bigint, site string, filler bigint, error bigint, lines array<bigint>", "text", run)


def _shared(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """(site, line) of the wanted lines that are furniture of their site or of many."""
    few = wanted.count() <= BROADCAST_KEYS
    keys = np.sort(np.array([r.line for r in wanted.select("line").distinct().collect()], np.int64)) if few else None
    sent = rows.sparkSession.sparkContext.broadcast(keys)

    def run(batch: pa.RecordBatch, texts: list):
        docs, key, _ = _line_keys(TextBatch(texts), batch.column(2).to_pylist())
        key = key.view(np.int64)
        if sent.value is not None:
            ok = np.isin(key, sent.value)
            docs, key = docs[ok], key[ok]
        take = pa.array(docs)
        return pa.RecordBatch.from_arrays([batch.column(2).take(take), batch.column(3).take(take), pa.array(key)], ["site", "page", "line"])

    lines = map_texts(rows, "site string, page bigint, line bigint", "text", run)
    if not few:
        lines = lines.join(wanted.select("line").distinct(), "line", "left_semi")
    sizes = rows.groupBy("site").agg(F.count_distinct("page").alias("site_pages"))
    counts = checkpoint(lines.distinct().groupBy("site", "line").agg(F.count("*").alias("n")))
    all_sites = sizes.agg(F.count("*").alias("all_sites"))
    everywhere = counts.groupBy("line").agg(F.count("*").alias("sites")).crossJoin(F.broadcast(all_sites))  # one row
    everywhere = everywhere.where((F.col("sites") >= FURNITURE_SITES) & (F.col("sites") >= F.col("all_sites") * FURNITURE_SITE_SHARE)).select("line")
    mine = counts.where(F.col("n") >= FURNITURE_PAGES).join(sizes, "site").where(F.col("n") >= F.col("site_pages") * FURNITURE_SHARE).select("site", "line")
    return wanted.join(everywhere, "line", "left_semi").select("site", "line").unionByName(mine)


def find(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(tbl, rec_id, reason) of the rows to leave out."""
    rows = _rows(tables)
    model, _ = train(rows)
    judged = checkpoint(judge(rows, spark.sparkContext.broadcast(model)))
    errors = judged.where("filler = 0").select("tbl", "rec_id", "site", F.explode_outer("lines").alias("line"))
    wanted = checkpoint(errors.where("line is not null").select("site", "line").distinct())
    real = errors.where("line is not null").join(_shared(rows, wanted), ["site", "line"], "left_anti").select("tbl", "rec_id").distinct()
    only = errors.select("tbl", "rec_id").distinct().join(real, ["tbl", "rec_id"], "left_anti")
    return judged.where("filler > 0").select("tbl", "rec_id", F.lit("filler").alias("reason")).unionByName(only.withColumn("reason", F.lit("error")))


def figures(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(units, residue, found, wrong, filler_margin, error_margin): how the classifier does
    on the sample's units of the hosts that it was not fitted on; residue counts those
    with a weak label."""
    model, got = train(_rows(tables))
    return spark.createDataFrame([(*got.values(), *map(float, model.margin))], "units bigint, residue bigint, found bigint, wrong bigint, filler_margin double, error_margin double")
