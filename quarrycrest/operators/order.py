"""Global order without a global window: range partitions are counted, then numbered
or summed up from the totals of those before.

Only one row a partition (and group) is ordered in one place.  The partitioned rows
are checkpointed, because ids of partitions must not change between the two uses."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data, which all executors share.

    It is read from spark.checkpoint.dir; only a local session without that setting
    gets one of its own."""
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get("spark.checkpoint.dir")
        if not folder and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="quarrycrest-"))
    return context._jsc.sc().getCheckpointDir().get()


def scratch(spark: SparkSession, name: str) -> str:
    """A path for one written copy in the shared folder."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpoint(df: DataFrame) -> DataFrame:
    shared_folder(df.sparkSession)
    return df.checkpoint()


def _ranges(rows: DataFrame, by: list) -> DataFrame:
    out = rows.repartitionByRange(*by).sortWithinPartitions(*by)
    return checkpoint(out.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()))


_BEFORE = (Window.unboundedPreceding, -1)


def numbered(rows: DataFrame, by: list, name: str = "ord") -> DataFrame:
    """Adds ``name``: dense numbers from 0 in the order of ``by``, which has no ties."""
    rows = _ranges(rows, by)
    sizes = rows.groupBy("_part").agg(F.count("*").alias("_n"), F.min("_at").alias("_low"))
    start = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0))
    starts = sizes.select("_part", "_low", start.alias("_start"))
    out = rows.join(F.broadcast(starts), "_part")  # one row a partition
    return out.withColumn(name, F.col("_start") + F.col("_at") - F.col("_low")).drop("_part", "_at", "_low", "_start")


def running_count(rows: DataFrame, flag: str, group: str, order: str, name: str) -> DataFrame:
    """Adds ``name``: how many rows of the group up to this one in ``order`` have the flag.
    A group may be of any size: a window sees one range of it."""
    rows = _ranges(rows, [group, order])
    counts = rows.groupBy("_part", group).agg(F.count_if(flag).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0))
    starts = counts.select("_part", group, before.alias("_before"))
    here = F.count_if(flag).over(Window.partitionBy("_part", group).orderBy(order))
    return rows.withColumn("_here", here).join(starts, ["_part", group]).withColumn(name, F.col("_before") + F.col("_here")).drop("_part", "_at", "_here", "_before")
