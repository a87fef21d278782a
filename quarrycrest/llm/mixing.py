"""Mixing sources to target weights.

The mix is as large as the corpus, in tokens.  A source's budget is its share of
that.  As often as the budget holds the whole source each of its documents is taken
once more, at most max_repeats times; what is left of the budget is filled with
documents in the order of a hash-random key, cut where the running total reaches it.

Running totals are distributed: the key's top bits give BUCKETS ranges, the totals
of (source, range) are summed up in order, which gives the one range of each source in
which its budget ends.  Those ranges, one row a source, are broadcast; documents below
are in, those above out, and only within the range, 1/BUCKETS of a source, is a window
taken.  Documents are never shuffled but for those.

Documents with a null or unlisted source, and null or empty texts (0 tokens), are
taken 0 times.  Equal rows with different ids are different documents; ties of the
key go by id.  A source that may not be repeated often enough stays below its target:
its actual share says so, and no other source gets its place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrycrest.llm.byte_pairs import count_tokens
from quarrycrest.llm.common import checkpoint

BUCKETS = 4096


def token_sizes(documents: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", path: str | None = None) -> DataFrame:
    """(doc_id, source, tokens)."""
    df = documents.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.col(text).alias("body"))
    return count_tokens(df, "body", path, ("doc_id", "source"))


def plan(sizes: DataFrame, mix: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, size, budget, epochs, rest): the whole
    epochs of each source and the tokens to be filled after them."""
    by_source = sizes.groupBy("source").agg(F.sum("tokens").alias("size"))
    total = by_source.agg(F.sum("size").alias("total"))
    p = F.broadcast(mix).join(by_source, "source", "left").crossJoin(F.broadcast(total))  # one row on the right
    p = p.withColumn("size", F.coalesce("size", F.lit(0))).withColumn("budget", F.floor(F.col("target_share") * F.coalesce("total", F.lit(0))))
    p = p.withColumn("epochs", F.when(F.col("size") > 0, F.least(F.expr("budget div size"), F.col("max_repeats").cast("bigint"))).otherwise(F.lit(0).cast("bigint")))
    left = F.col("budget") - F.col("epochs") * F.col("size")
    return p.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), left).otherwise(F.lit(0)))


def mix(documents: DataFrame, mix_table: DataFrame, seed: int = 42, path: str | None = None, key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(copies, shares).

    copies: (doc_id, source, tokens, copies), one row a document.
    shares: (source, target_share, max_repeats, source_tokens, mixed_tokens,
    actual_share, share_of_target_size), one row for each row of the mix table, which
    is a settings table of at most 10,000 rows (checked) and is broadcast."""
    if mix_table.limit(10_001).count() > 10_000:
        raise ValueError("more than 10,000 sources to be mixed")
    sizes = checkpoint(token_sizes(documents, key, source, text, path))
    todo = checkpoint(plan(sizes, mix_table))
    rows = sizes.join(F.broadcast(todo.select("source", "epochs", "rest")), "source", "left").withColumn("key", F.xxhash64("doc_id", F.lit(seed)))
    rows = rows.withColumn("bucket", F.shiftrightunsigned("key", 64 - BUCKETS.bit_length() + 1))
    sums = rows.where("tokens > 0 and rest > 0").groupBy("source", "bucket").agg(F.sum("tokens").alias("n"), F.first("rest").alias("rest"))
    so_far = F.sum("n").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    # the range in which a source's budget ends, and what lies below it: one row a source
    cut = sums.withColumn("upto", so_far).where("upto > rest").groupBy("source").agg(F.min(F.struct("bucket", (F.col("upto") - F.col("n")).alias("low"))).alias("c"))
    rows = rows.join(F.broadcast(cut.select("source", F.col("c.bucket").alias("cut"), F.col("c.low").alias("low"))), "source", "left")
    counts = F.coalesce((F.col("tokens") > 0) & (F.col("rest") > 0), F.lit(False))
    at_cut = counts & F.coalesce(F.col("bucket") == F.col("cut"), F.lit(False))
    others = rows.where(~at_cut).withColumn("extra", (counts & (F.col("cut").isNull() | (F.col("bucket") < F.col("cut")))).cast("int"))
    # only that range is sorted; a document is in if its middle lies within the budget
    within = Window.partitionBy("source").orderBy("key", "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = F.col("low") + F.sum("tokens").over(within)
    cutting = rows.where(at_cut).withColumn("extra", (2 * upto - F.col("tokens") <= 2 * F.col("rest")).cast("int"))
    copies = others.unionByName(cutting).select(
        "doc_id", "source", "tokens", F.when(F.col("tokens") > 0, F.coalesce("epochs", F.lit(0)) + F.col("extra")).otherwise(0).cast("int").alias("copies")
    )
    copies = checkpoint(copies)
    taken = copies.groupBy("source").agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"))
    all_taken = taken.agg(F.sum("mixed_tokens").alias("all_tokens"))
    shares = todo.join(taken, "source", "left").crossJoin(F.broadcast(all_taken)).withColumn("mixed_tokens", F.coalesce("mixed_tokens", F.lit(0)))
    shares = shares.select(
        "source",
        "target_share",
        "max_repeats",
        F.col("size").alias("source_tokens"),
        "mixed_tokens",
        F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(F.lit(0.0)).alias("actual_share"),
        F.when(F.col("total") > 0, F.col("mixed_tokens") / F.col("total")).otherwise(F.lit(0.0)).alias("share_of_target_size"),
    )
    return copies, shares
