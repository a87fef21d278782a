"""Structured Streaming forms of the request, session and ingest paths."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quarrycrest.operators import index, sessions
from quarrycrest.sources import sinks


def request_counts(events: DataFrame, key: str = "user_id", time: str = "ts", window: str = "1 minute", late: str = "10 minutes", limit: int = 10) -> DataFrame:
    """(window_start, key, n, over_limit) of closed windows.  Times without zone are
    taken as UTC: a watermark needs a timestamp."""
    rows = events.withColumn("_t", F.col(time).cast("timestamp")).withWatermark("_t", late)
    counted = rows.groupBy(F.window("_t", window).alias("w"), F.col(key)).agg(F.count("*").alias("n"))
    return counted.select(F.col("w.start").alias("window_start"), key, "n", (F.col("n") > limit).alias("over_limit"))


def keep_sessions(updates: DataFrame, base: str, checkpoint: str) -> StreamingQuery:
    """Applies updates (session_id, messages, at) to the versioned table at ``base``."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            sinks.write_version(sessions.upsert_sessions(sinks.read_latest(batch.sparkSession, base), batch), base)

    return updates.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()


def ingest(spark: SparkSession, path: str, schema: str, base: str, checkpoint: str) -> StreamingQuery:
    """Resumable load of chunk records from parquet files into the versioned index:
    files are taken once, whatever was interrupted."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1000).parquet(path)

    def apply(batch: DataFrame, _: int) -> None:
        if batch.isEmpty():
            return
        order = [c for c in ("loaded_at", "rec_id") if c in batch.columns]
        keyed = batch.withColumn("id", index.chunk_id(F.col("url"), F.col("chunk_index")))
        new = index.last_wins(keyed, ["id"], order or ["text"]).drop("first_pos")
        state = new if not sinks.versions(batch.sparkSession, base) else index.upsert(sinks.read_latest(batch.sparkSession, base), new)
        sinks.write_version(state, base)

    return rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(apply).trigger(availableNow=True).start()
