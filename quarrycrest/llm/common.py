"""Helpers shared by the operators of this folder."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrycrest.llm.textbatch import slices

#: White space that counts as blank, in Java form: Unicode's and the four separators.
BLANK = r"[\p{IsWhite_Space}\x1c-\x1f]"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checkpoint(df: DataFrame) -> DataFrame:
    """Cuts the lineage with a copy in the folder named by spark.checkpoint.dir.

    The folder must be shared by all executors, so that a lost executor loses
    nothing; only in a local session without the setting is one made."""
    spark = df.sparkSession
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not named:
            if not context.master.startswith("local"):
                raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
            named = tempfile.mkdtemp(prefix="quarrycrest-")
        context.setCheckpointDir(named)
    return df.checkpoint(eager=True)


def map_texts(df: DataFrame, schema: str, text: str, fn: Callable[[pa.Table, list], pa.RecordBatch | None]) -> DataFrame:
    """``mapInArrow`` in slices of bounded size: fn(rows, texts) for each.

    The slices are cut by characters, so that a few very long texts do not ask
    for more memory than many short ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
            for a, b in slices(texts):
                out = fn(batch.slice(a, b - a), texts[a:b])
                if out is not None and out.num_rows:
                    yield out

    return df.mapInArrow(run, schema)


def connected_components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, component): the smallest id reachable over the links.

    Alternating large-star and small-star steps: every node hangs on the smallest
    node it knows of, so rounds grow with the logarithm of the longest path.  Each
    round is checkpointed and only two totals come to the driver.  A node with many
    links is one key of a partial aggregate (min) and one side of an equi-join that
    adaptive execution may split; no neighbour list is built."""
    edges = checkpoint(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where("u <> v").distinct())
    last = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u")
        edges = checkpoint(
            small.select(F.col("u"), F.col("m").alias("v"))
            .unionByName(small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")))
            .where("u <> v")
            .distinct()
        )
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if now == last:
            break
        last = now
    stars = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return stars.unionByName(stars.select(F.col("component").alias("node"), "component").distinct())
