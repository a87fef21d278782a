"""Keyed loads of the chunk index: ids, deduplication, inserts and upserts.

Parquet has no MERGE: every load returns the new state as a DataFrame, to be written
as a new version (``sinks.write_version``).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycrest.functions.text import is_blank


def chunk_id(url: Column, index: Column) -> Column:
    """md5 of url and chunk index; null url is '', null index 0."""
    return F.md5(F.concat(F.coalesce(url, F.lit("")), F.lit("__chunk_"), F.coalesce(index.cast("int"), F.lit(0)).cast("string")))


def union_sources(sources: dict[str, DataFrame | None]) -> DataFrame:
    """Sources in their order with ``_source`` and ``src_ord``; None (missing) is skipped."""
    found = [(i, name, df) for i, (name, df) in enumerate(sources.items()) if df is not None]
    if not found:
        raise ValueError("no source is there")
    parts = [df.withColumns({"_source": F.lit(name), "src_ord": F.lit(i)}) for i, name, df in found]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def last_wins(df: DataFrame, keys: list[str], order: list[str], unique: bool = False) -> DataFrame:
    """One row a key: the values of the last row in ``order``, and ``first_pos``, the
    order of the first one, as a struct.  ``unique`` says that the order tells all rows of
    a key apart; without it any one of the last rows is kept."""
    place = F.struct(*order)
    if unique:
        return _winners(df, keys, order, F.max(place), F.min(place).alias("first_pos"))
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.max_by(F.struct(*rest), place).alias("_last"), F.min(place).alias("first_pos"))
    return packed.select(*keys, *(F.col(f"_last.`{c}`").alias(c) for c in rest), "first_pos")


def first_wins(df: DataFrame, keys: list[str], order: list[str], unique: bool = False) -> DataFrame:
    """One row a key: the values of the first row in ``order``; see ``last_wins``."""
    if unique:
        return _winners(df, keys, order, F.min(F.struct(*order)))
    rest = [c for c in df.columns if c not in keys]
    packed = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_first"))
    return packed.select(*keys, *(F.col(f"_first.`{c}`").alias(c) for c in rest))


def _winners(df: DataFrame, keys: list[str], order: list[str], place: Column, *others: Column) -> DataFrame:
    """The row at ``place`` of each key.  Keys and order alone are aggregated, so copies of
    a hot key are reduced before the shuffle and no other value is sorted; a hash join
    then fetches the rows."""
    won = df.groupBy(*keys).agg(place.alias("_place"), *others)
    names = [o for o in order if o not in keys]
    won = won.select(*(F.col(k).alias(f"_key{i}") for i, k in enumerate(keys)), *(F.col(f"_place.`{o}`").alias(f"_order{i}") for i, o in enumerate(names)), *(c for c in won.columns if c not in keys and c != "_place"))
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    for i, o in enumerate(names):
        same = same & F.col(o).eqNullSafe(F.col(f"_order{i}"))
    out = df.join(won.hint("shuffle_hash"), same)
    return out.select(*df.columns, *(c for c in won.columns if not c.startswith(("_key", "_order"))))


def duplicate_count(df: DataFrame, key: str = "id") -> DataFrame:
    return df.agg(F.count("*").alias("total"), F.count_distinct(F.coalesce(F.col(key), F.lit(""))).alias("distinct_ids")).withColumn("duplicates", F.col("total") - F.col("distinct_ids"))


def index_rows(chunks: DataFrame) -> DataFrame:
    """(id, document, url, department, content_type) of chunks with text; null is ''."""
    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = chunks.where(~is_blank(F.col("text")))
    return rows.select(chunk_id(F.col("url"), F.col("chunk_index")).alias("id"), F.col("text").alias("document"), *(blank(c) for c in ("url", "department", "content_type")))


def insert_new(index: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Rows with ids not yet in the index are added; known ids keep their old values."""
    return index.unionByName(incoming.join(index.select(key), key, "left_anti"), allowMissingColumns=True)


def upsert(index: DataFrame, incoming: DataFrame, key: str = "id") -> DataFrame:
    """Incoming rows replace those with the same id; nothing is deleted."""
    return index.join(incoming.select(key), key, "left_anti").unionByName(incoming, allowMissingColumns=True)


def update_fields(index: DataFrame, updates: DataFrame, fields: list[str], key: str = "id") -> DataFrame:
    """The index with the fields of the rows that ``updates`` (key, fields ...) names set to
    its values; other rows and columns stay as they are, unknown keys are left out."""
    new = updates.select(key, F.lit(True).alias("_named"), *(F.col(f).alias(f"_new_{f}") for f in fields))
    kept = [F.col(c) for c in index.columns if c not in fields]
    old = lambda f: F.col(f) if f in index.columns else F.lit(None)
    return index.join(new, key, "left").select(*kept, *(F.when(F.col("_named"), F.col(f"_new_{f}")).otherwise(old(f)).alias(f) for f in fields))


def batch_number(position: Column, size: int = 100) -> Column:
    return F.floor(position / F.lit(size)).cast("bigint")
