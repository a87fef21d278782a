"""Conversation sessions and request rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGES = "array<struct<role:string,content:string>>"


def project_history(turns: DataFrame, key: str = "session_id", order: str = "turn") -> DataFrame:
    """(session_id, messages): turns as role and content; any role but user is assistant."""
    role = F.when(F.col("role") == "user", "user").otherwise("assistant")
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.struct(role.alias("role"), F.col("text").alias("content")).alias("m"))))
    return turns.groupBy(key).agg(F.transform(parts, lambda x: x["m"]).alias("messages"))


def append_turn(history: Column, question: Column, answer: Column) -> Column:
    message = lambda r, c: F.struct(F.lit(r).alias("role"), c.alias("content"))
    return F.concat(F.coalesce(history, F.array().cast(MESSAGES)), F.array(message("user", question), message("assistant", answer)))


def upsert_sessions(sessions: DataFrame, updates: DataFrame) -> DataFrame:
    """Sessions (session_id, messages, started_at, last_active) after updates
    (session_id, messages, at): messages and last_active are new, started_at is kept.
    Of several updates of a session the latest counts; empty ids are left out.
    One aggregate over the union, so a busy session is reduced before the shuffle."""
    new = updates.where(F.coalesce("session_id", F.lit("")) != "").select("session_id", "messages", F.col("at").alias("started_at"), F.col("at").alias("last_active"), F.lit(1).alias("is_new"))
    old = sessions.select("session_id", "messages", "started_at", "last_active", F.lit(0).alias("is_new"))
    return (
        old.unionByName(new)
        .groupBy("session_id")
        .agg(
            F.max_by("messages", F.struct("is_new", "last_active")).alias("messages"),
            F.min_by("started_at", F.struct("is_new", "started_at")).alias("started_at"),
            F.max_by("last_active", F.struct("is_new", "last_active")).alias("last_active"),
        )
    )


def rate_limit(requests: DataFrame, key: str, time: str, order: str, limit: int = 10, window: str = "1 minute") -> DataFrame:
    """Adds ``window_start``, ``n`` (the request's number in its window) and ``admitted``."""
    start = F.window(F.col(time).cast("timestamp"), window)["start"]
    rows = requests.withColumn("window_start", start)
    nth = F.row_number().over(Window.partitionBy(key, "window_start").orderBy(time, order))
    return rows.withColumn("n", nth).withColumn("admitted", F.col("n") <= limit)
