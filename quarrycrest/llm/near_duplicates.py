"""Near-duplicate texts by pigeonhole blocks over minwise fingerprints.

A fingerprint is SYMBOLS minwise hashes of the text's distinct word sequences.
Two texts differ in a share 1 - J of the symbols, J being their Jaccard
similarity.  The symbols are cut into BLOCKS blocks: texts that differ in fewer
than BLOCKS symbols must share a block whole (pigeonhole), texts that differ in
more still do with probability 1 - (1 - J**3)**BLOCKS, 0.9996 at J = 0.6 and more
than 0.99999 from 0.7.  Texts are joined on (block, content of the block); the
Hamming distance of the fingerprints, of which two bits a symbol travel with the
block, is tested inside the join; what is left is verified exactly.

Copies (the same set of sequences) are one class from the start, so that a text
copied a million times takes part once.

Null, empty and short texts (fewer words than a sequence has) have no sequences
and take part in no pair; in ``groups`` each is a group of its own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarrycrest.llm.common import checkpoint, connected_components, map_texts
from quarrycrest.llm.textbatch import TextBatch, mix, shingles

ROWS = 3  # symbols in a block
BLOCKS = 32
SYMBOLS = ROWS * BLOCKS
#: Standard deviations that the Hamming distance of a pair at the threshold may lie above its mean.
SLACK = 5.0


def _factors() -> np.ndarray:
    return mix(np.arange(1, SYMBOLS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def max_distance(threshold: float) -> int:
    """Hamming distance, in symbols of two bits, that a pair at the threshold stays within."""
    p = 0.75 * (1 - threshold)
    return int(np.ceil(SYMBOLS * p + SLACK * np.sqrt(SYMBOLS * p * (1 - p))))


def distinct_shingles(texts, k: int):
    """(sorted distinct hashes, text numbers) of the texts' sequences of k words."""
    h, d = shingles(TextBatch(texts), k)
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    return h[new], d[new]


def signatures(df: DataFrame, key: str, text: str, k: int) -> DataFrame:
    """(id, c1, c2, n, f0, f1, f2, blocks) of each text with a sequence: class of
    equal sets, size of the set, packed fingerprint, content of each block."""
    factors = _factors()

    def run(rows: pa.RecordBatch, texts: list):
        h, d = distinct_shingles(texts, k)
        if not len(h):
            return None
        at = np.flatnonzero(np.concatenate(([True], d[1:] != d[:-1])))
        docs = d[at]
        low = np.empty((SYMBOLS, len(docs)), np.uint64)
        for i, f in enumerate(factors):
            low[i] = np.minimum.reduceat(h * f, at)
        low = mix(low)
        two = (low & np.uint64(3)).reshape(3, 32, -1)
        packed = (two << (np.arange(32, dtype=np.uint64) * np.uint64(2))[None, :, None]).sum(1, dtype=np.uint64)
        block = np.zeros((BLOCKS, len(docs)), np.uint64)
        for r in range(ROWS):
            block = mix(block * np.uint64(31) + low[r::ROWS])
        block += np.arange(BLOCKS, dtype=np.uint64)[:, None]  # block i only ever meets block i
        flat = np.ascontiguousarray(mix(block).T).view(np.int64).ravel()
        i64 = lambda x: pa.array(np.ascontiguousarray(x).view(np.int64))
        return pa.RecordBatch.from_arrays(
            [
                rows.column(0).take(pa.array(docs)),
                i64(np.add.reduceat(h, at)),
                i64(np.bitwise_xor.reduceat(mix(h), at)),
                pa.array(np.diff(np.append(at, len(h))).astype(np.int64)),
                *(i64(packed[i]) for i in range(3)),
                pa.ListArray.from_arrays(pa.array(np.arange(0, len(flat) + 1, BLOCKS, dtype=np.int32)), pa.array(flat)),
            ],
            ["id", "c1", "c2", "n", "f0", "f1", "f2", "blocks"],
        )

    schema = "id bigint, c1 bigint, c2 bigint, n bigint, f0 bigint, f1 bigint, f2 bigint, blocks array<bigint>"
    return map_texts(df.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")), schema, "text", run)


def _verified(pairs: DataFrame, k: int) -> DataFrame:
    """(a, b, i, u) of pairs (a, b, ta, tb): sequences in both texts and in either.

    Texts travel rather than their sets of hashes: they are smaller and compress."""

    def run(rows: pa.RecordBatch, texts: list):
        h, d = (np.concatenate(x) for x in zip(distinct_shingles(texts, k), distinct_shingles(rows.column(3).to_pylist(), k)))
        order = np.lexsort((h, d))
        h, d = h[order], d[order]
        twice = (h[1:] == h[:-1]) & (d[1:] == d[:-1])
        n = len(texts)
        shared = np.bincount(d[1:][twice], minlength=n)
        return pa.RecordBatch.from_arrays([rows.column(0), rows.column(1), pa.array(shared), pa.array(np.bincount(d, minlength=n) - shared)], ["a", "b", "i", "u"])

    return map_texts(pairs, "a bigint, b bigint, i bigint, u bigint", "ta", run)


def _distance(a: str, b: str):
    """Symbols in which two packed fingerprints differ."""
    total = F.lit(0)
    for i in range(3):
        x = F.col(f"{a}.f{i}").bitwiseXOR(F.col(f"{b}.f{i}"))
        either = x.bitwiseOR(F.shiftrightunsigned(x, 1)).bitwiseAND(F.lit(0x5555555555555555))
        total = total + F.bit_count(either)
    return total


def links(df: DataFrame, key: str = "rec_id", text: str = "text", k: int = 5, threshold: float = 0.8):
    """(members, links): members has (id, rep) of each text with a sequence, rep the
    smallest id of its copies; links has (a, b, similarity), a < b, of all pairs of
    representatives whose similarity reaches the threshold.

    Ids must be unique; rows with a null id are left out.  Other columns are not
    looked at, so names that clash do no harm."""
    source = df.where(F.col(key).isNotNull())
    sig = checkpoint(signatures(source, key, text, k))
    reps = sig.groupBy("c1", "c2", "n").agg(F.min("id").alias("rep"))
    members = checkpoint(sig.select("id", "c1", "c2", "n").join(reps, ["c1", "c2", "n"]).select("id", "rep"))
    head = sig.join(members.where("id = rep").select("id"), "id", "left_semi")
    blocks = head.select("id", "n", "f0", "f1", "f2", F.explode("blocks").alias("block"))
    near = (
        blocks.alias("x")
        .join(blocks.alias("y"), F.col("x.block") == F.col("y.block"))
        .where((F.col("x.id") < F.col("y.id")) & (F.least("x.n", "y.n") >= F.greatest("x.n", "y.n") * F.lit(threshold)) & (_distance("x", "y") <= max_distance(threshold)))
        .select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))
        .distinct()
    )
    near = checkpoint(near)
    wanted = near.select(F.col("a").alias("id")).unionByName(near.select(F.col("b").alias("id"))).distinct()
    texts = source.select(F.col(key).cast("bigint").alias("id"), F.col(text).alias("text")).join(wanted, "id", "left_semi")
    both = near.join(texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), "a").join(texts.select(F.col("id").alias("b"), F.col("text").alias("tb")), "b")
    exact = _verified(both.select("a", "b", "ta", "tb"), k)
    # whole numbers decide, so that no rounding moves a pair over the threshold
    return members, exact.where(F.col("i") * 1_000_000 >= F.col("u") * round(threshold * 1_000_000)).select("a", "b", (F.col("i") / F.col("u")).alias("similarity"))


def pairs(df: DataFrame, key: str = "rec_id", text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(rec_a, rec_b), rec_a < rec_b: every pair of rows, copies written out."""
    members, found = links(df, key, text, k, threshold)
    a = members.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    b = members.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = found.select("a", "b").join(a, "a").join(b, "b")
    # a class of copies only meets itself: its pairs are part of the result asked for
    within = a.join(b, F.col("a") == F.col("b")).where("ia < ib")
    out = across.select("ia", "ib").unionByName(within.select("ia", "ib"))
    return out.select(F.least("ia", "ib").alias("rec_a"), F.greatest("ia", "ib").alias("rec_b"))


def groups(df: DataFrame, key: str = "rec_id", text: str = "text", k: int = 5, threshold: float = 0.8) -> DataFrame:
    """(rec_id, class_id, group_id, n_links): one row for each row of df with an id.
    class_id is the smallest id with the same sequences, group_id the smallest id
    reachable over links, n_links the links of its class to other classes."""
    members, found = links(df, key, text, k, threshold)
    found = checkpoint(found)
    comp = connected_components(found)
    degree = found.select(F.col("a").alias("rep")).unionByName(found.select(F.col("b").alias("rep"))).groupBy("rep").agg(F.count("*").alias("n_links"))
    ids = df.where(F.col(key).isNotNull()).select(F.col(key).cast("bigint").alias("id"))
    out = ids.join(members, "id", "left").withColumn("rep", F.coalesce("rep", "id")).join(degree, "rep", "left").join(comp, F.col("rep") == F.col("node"), "left")
    return out.select(F.col("id").alias("rec_id"), F.col("rep").alias("class_id"), F.coalesce("component", "rep").alias("group_id"), F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
