"""Writers.  State is written as a new version and then pointed to, because a table
cannot be overwritten while it is read and parquet has no MERGE."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_json(df: DataFrame, path: str) -> None:
    """One JSON object a line."""
    df.write.mode("overwrite").json(path)


def write_json_array(df: DataFrame, path: str, per_array: int = 10_000) -> None:
    """Files of one JSON array of about ``per_array`` records each, as
    ``readers.json_array`` reads them.  Null fields are left out."""
    arrays = max(1, -(-df.count() // per_array))
    bucket = F.pmod(F.xxhash64(*(F.to_json(F.struct(F.col(c))) for c in df.columns), F.rand(7)), F.lit(arrays))
    packed = df.groupBy(bucket.alias("b")).agg(F.to_json(F.collect_list(F.struct("*"))).alias("value"))
    packed.select("value").write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)


def write_text(lines: DataFrame, path: str, column: str = "line") -> None:
    """Text files of the lines, which hold no line ends themselves; null is ''."""
    lines.select(F.coalesce(column, F.lit("")).alias("value")).write.mode("overwrite").text(path)


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def versions(spark: SparkSession, base: str) -> list[int]:
    fs, p = _fs(spark, base)
    if not fs.exists(p):
        return []
    names = (s.getPath().getName() for s in fs.listStatus(p))
    found = [int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()]
    done = (v for v in found if fs.exists(_fs(spark, f"{base}/v={v}/_SUCCESS")[1]))
    return sorted(done)


def write_version(df: DataFrame, base: str) -> int:
    """Writes the next version of a table; it counts once its _SUCCESS is there, so a
    failed write leaves the version before it in force."""
    spark = df.sparkSession
    version = (versions(spark, base) or [0])[-1] + 1
    df.write.mode("overwrite").parquet(f"{base}/v={version}")
    return version


def read_latest(spark: SparkSession, base: str) -> DataFrame:
    found = versions(spark, base)
    if not found:
        raise FileNotFoundError(f"no version of {base}")
    return spark.read.parquet(f"{base}/v={found[-1]}")


def create_if_missing(spark: SparkSession, base: str, schema: str) -> None:
    if not versions(spark, base):
        write_version(spark.createDataFrame([], schema), base)
