"""Splitting oversized texts at topic boundaries.

A text without spaces, tabs and line ends at both ends is oversized if it has more
characters than its policy allows.  Candidate cuts are the starts of lines and of
sentences.  At each the word counts (hashed to DIM buckets) of the BLOCK units
before and after are compared; a low cosine between two higher ones is a valley,
where the vocabulary and so the topic changes.  From the start of a piece the
deepest valley in the last half of the allowed size is taken, then the next piece
starts at a word about ``overlap`` characters earlier.  Where that half has no
candidate, the last one in the rest of the window is taken; where the whole window
has none, the last white space, and where it has none, the limit itself.

Pieces are slices of the text, so that every character is in one and none is
longer than the limit.  Null, empty and short texts give no piece.  An overlap of
half the limit or more is taken as just under half of it, so that pieces advance.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrycrest.llm.common import map_texts
from quarrycrest.llm.textbatch import TextBatch, unit_starts, white_space

DIM, BLOCK, CLIMB = 256, 3, 4
#: What the end of a paragraph, and of a line, adds to the depth of a valley.
PARAGRAPH, LINE = 0.2, 0.1
EDGE = " \t\r\n"


def boundaries(b: TextBatch):
    """(positions, depths, white-space positions) over a batch; depth is that of the
    valley at the position, with what its kind of boundary adds."""
    space = white_space(b)
    units, lines = unit_starts(b, space)
    if not len(units):
        return units, units.astype(float), np.flatnonzero(space)
    doc = b.doc_of(units)
    s, e, h, _ = b.words()
    long = e - s > 3
    owner = np.searchsorted(units, s[long], "right") - 1
    ok = owner >= 0
    bag = np.bincount(owner[ok] * DIM + (h[long][ok] >> np.uint64(40)).astype(np.int64) % DIM, minlength=len(units) * DIM).reshape(len(units), DIM).astype(np.float32)
    sums = np.concatenate((np.zeros((1, DIM), np.float32), np.cumsum(bag, 0, dtype=np.float32)))
    i = np.arange(len(units))
    lo, hi = np.searchsorted(doc, doc), np.searchsorted(doc, doc, "right")
    left = sums[i] - sums[np.maximum(i - BLOCK, lo)]
    right = sums[np.minimum(i + BLOCK, hi)] - sums[i]
    norm = np.sqrt(np.einsum("ij,ij->i", left, left) * np.einsum("ij,ij->i", right, right))
    sim = np.einsum("ij,ij->i", left, right) / np.maximum(norm, 1e-9)
    sim = np.where(i == lo, 1.0, sim)
    up_left, up_right = sim.copy(), sim.copy()
    for k in range(1, CLIMB + 1):
        j = np.maximum(i - k, lo)
        up_left = np.maximum(up_left, np.where(j > lo, sim[j], 0))
        up_right = np.maximum(up_right, sim[np.minimum(i + k, hi - 1)])
    depth = up_left + up_right - 2 * sim
    depth += np.where(lines > 1, PARAGRAPH, np.where(lines == 1, LINE, 0))
    return units, depth, np.flatnonzero(space)


def spans(start: int, end: int, limit: int, overlap: int, least: int, units, depth, spaces):
    """Pieces [a, b) of the text at [start, end)."""
    limit = max(2, limit)
    overlap = max(0, min(overlap, limit // 2 - 1))
    out, a, done = [], start, start
    while end - a > limit:
        top = a + limit
        low = max(done + 1, a + limit // 2)
        # leave the last piece at least as many characters as the policy asks for
        wish = min(top, max(low, end - max(least - overlap, 1)))
        i, j, k = np.searchsorted(units, low), np.searchsorted(units, wish, "right"), np.searchsorted(units, top, "right")
        first = np.searchsorted(units, done, "right")
        if i < j:
            cut = int(units[i + int(np.argmax(depth[i:j]))])
        elif j < k:
            cut = int(units[j + int(np.argmax(depth[j:k]))])
        elif first < i:
            cut = int(units[i - 1])
        else:
            k = np.searchsorted(spaces, top) - 1
            cut = int(spaces[k]) + 1 if k >= 0 and spaces[k] + 1 >= low else top
        out.append((a, cut))
        done = cut
        back = max(a + 1, cut - overlap)
        k = np.searchsorted(spaces, back - 1)
        a = int(spaces[k]) + 1 if overlap and k < len(spaces) and spaces[k] + 1 < cut else back
        a = min(a, cut)
    out.append((a, end))
    return out


def split_rows(rows: pa.RecordBatch, texts: list):
    ident, limit, overlap, least = (rows.column(i).to_pylist() for i in range(4))
    b = TextBatch(texts)
    units, depth, spaces = boundaries(b)
    out: list[tuple] = []
    for i, text in enumerate(b.texts):
        at = int(b.start[i])
        lead = len(text) - len(text.lstrip(EDGE))
        trail = len(text.rstrip(EDGE))
        x, y = np.searchsorted(units, (at + lead + 1, at + trail))
        p, q = np.searchsorted(spaces, (at + lead, at + trail))
        pieces = spans(at + lead, at + trail, limit[i], overlap[i], least[i], units[x:y], depth[x:y], spaces[p:q])
        out += ((ident[i], k, len(pieces), s - at, e - at, text[s - at : e - at]) for k, (s, e) in enumerate(pieces))
    names = ["rec_id", "chunk_index", "chunk_total", "start_char", "end_char", "text"]
    types = [pa.int64(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names) if out else None


def split_oversized(df: DataFrame, policy: DataFrame, key="rec_id", text="text", kind="content_type") -> DataFrame:
    """(rec_id, chunk_index, chunk_total, start_char, end_char, text) of the pieces of
    every oversized text.  policy has one row a kind (content_type, max_chars,
    overlap_chars, min_chars); a null or unlisted kind uses the row ''.

    policy is broadcast: its size is that of a settings table, checked here."""
    if policy.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 policies")
    names = [F.col("max_chars").alias("m"), F.col("overlap_chars").alias("o"), F.col("min_chars").alias("l")]
    own = policy.select(F.coalesce("content_type", F.lit("")).alias("k"), *names).dropDuplicates(["k"])
    rest = own.where("k = ''").select(*(F.col(c).alias(f"r{c}") for c in "mol"))
    rows = df.select(F.col(key).cast("bigint").alias("id"), F.coalesce(F.col(kind), F.lit("")).alias("k"), F.col(text).alias("text"))
    rows = rows.join(F.broadcast(own), "k", "left").join(F.broadcast(rest), F.lit(True), "left")
    rows = rows.select("id", *(F.coalesce(c, f"r{c}").cast("int").alias(c) for c in "mol"), "text")
    rows = rows.where(F.length(F.btrim("text", F.lit(EDGE))) > F.col("m"))
    return map_texts(rows, "rec_id bigint, chunk_index int, chunk_total int, start_char bigint, end_char bigint, text string", "text", split_rows)
