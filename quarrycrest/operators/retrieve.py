"""Exact nearest neighbours, candidate deduplication, reranking and context.

Queries are met with all rows.  Up to BROADCAST_VALUES numbers they are sent to the
rows as one matrix and each query's k best of a batch leave it.  Beyond, both sides are
cut into blocks of bounded size, each pair of which is one matrix product; neither
side is broadcast or collected then.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarrycrest.functions.text import is_blank

QUERY_BLOCK, ROW_BLOCK = 2048, 8192
#: Numbers of all query vectors (8 bytes each) that are sent to every worker at most.
BROADCAST_VALUES = 1_000_000
CANDIDATES, KEPT = 8, 5


def _unit(vectors: pd.Series) -> np.ndarray:
    m = np.array(vectors.tolist(), np.float64).reshape(len(vectors), -1)
    norm = np.sqrt((m * m).sum(1, keepdims=True))
    return m / np.where(norm > 0, norm, 1)


def knn(queries: DataFrame, rows: DataFrame, k: int = CANDIDATES, query_key: str = "query_id", row_key: str = "id", vector: str = "embedding") -> DataFrame:
    """(query_id, id, distance, rank): the k rows nearest to each query by cosine
    distance; equal distances go by id.  Null vectors take no part, a zero vector has
    distance 1 to everything.  Filters belong on ``rows``, before the search."""
    q = queries.where(F.col(vector).isNotNull()).select(F.col(query_key).cast("bigint").alias("query_id"), F.col(vector).alias("v"))
    r = rows.where(F.col(vector).isNotNull()).select(F.col(row_key).cast("bigint").alias("id"), F.col(vector).alias("v"))
    asked, values = q.agg(F.count("*"), F.sum(F.size("v"))).first()
    if (values or 0) <= BROADCAST_VALUES:
        local = _by_partition(q, r, k)
    else:
        local = _by_block(q, r, k, asked)
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return local.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _nearest(asked: np.ndarray, queries: np.ndarray, ids: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query ids, row ids, distances) of each query's k nearest rows, ties at the border too."""
    distance = np.round(1.0 - queries @ rows.T, 12)
    n = min(k, len(ids))
    kth = np.partition(distance, n - 1, axis=1)[:, n - 1 : n]
    at, col = np.nonzero(distance <= kth)
    return asked[at], ids[col], distance[at, col]


_FOUND = "query_id bigint, id bigint, distance double"


def _by_partition(q: DataFrame, r: DataFrame, k: int) -> DataFrame:
    """The queries, a matrix of checked size, go to the rows, which are not shuffled."""
    got = q.toPandas()
    sent = q.sparkSession.sparkContext.broadcast((got["query_id"].to_numpy(np.int64), _unit(got["v"])))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        asked, queries = sent.value
        for b in batches:
            if len(b) and len(asked):
                yield pd.DataFrame(dict(zip(("query_id", "id", "distance"), _nearest(asked, queries, b["id"].to_numpy(), _unit(b["v"]), k))))

    found = r.mapInPandas(run, _FOUND)
    # each batch gives k a query: thinned out again before the final order
    part = Window.partitionBy("query_id", "_part").orderBy("distance", "id")
    return found.withColumn("_part", F.spark_partition_id()).withColumn("_n", F.row_number().over(part)).where(F.col("_n") <= k).drop("_part", "_n")


def _by_block(q: DataFrame, r: DataFrame, k: int, asked: int) -> DataFrame:
    """Both sides cut into blocks, each pair of which meets once."""
    n_q = max(1, -(-asked // QUERY_BLOCK))
    n_r = max(1, -(-r.count() // ROW_BLOCK))
    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    # every block of rows meets every block of queries once
    q = q.withColumn("qb", block("query_id", n_q)).withColumn("rb", F.explode(F.sequence(F.lit(0), F.lit(n_r - 1))))
    r = r.withColumn("rb", block("id", n_r)).withColumn("qb", F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))))

    def best(a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        if a.empty or b.empty:
            return pd.DataFrame({"query_id": [], "id": [], "distance": []})
        return pd.DataFrame(dict(zip(("query_id", "id", "distance"), _nearest(a["query_id"].to_numpy(), _unit(a["v"]), b["id"].to_numpy(), _unit(b["v"]), k))))

    return q.groupBy("qb", "rb").cogroup(r.groupBy("qb", "rb")).applyInPandas(best, _FOUND)


def audience_filter(column: Column, asked: str) -> Column:
    """Rows a question of this audience may see; untagged rows are never seen."""
    return column.isin("grad", "both") if asked == "grad" else column.isin("undergrad", "both")


def dedup_candidates(ranked: DataFrame) -> DataFrame:
    """(question, id, query_ord, rank, distance, pos): each id of a question once, where
    it came first by (query_ord, rank); pos numbers them in that order."""
    first = ranked.groupBy("question", "id").agg(F.min_by(F.struct("query_ord", "rank", "distance"), F.struct("query_ord", "rank")).alias("f"))
    flat = first.select("question", "id", "f.query_ord", "f.rank", "f.distance")
    order = Window.partitionBy("question").orderBy("query_ord", "rank")
    return flat.withColumn("pos", F.row_number().over(order))


def rerank(candidates: DataFrame, score: Column, n: int = KEPT) -> DataFrame:
    """The n candidates of each question with the highest score; ties go by pos."""
    scored = candidates.withColumn("score", score)
    order = Window.partitionBy("question").orderBy(F.desc("score"), "pos")
    return scored.withColumn("place", F.row_number().over(order)).where(F.col("place") <= n)


def build_context(ranked: DataFrame, url: str = "url", document: str = "document", place: str = "place") -> DataFrame:
    """(question, context): source-attributed blocks in order of place."""
    block = F.concat(F.lit("[Source: "), F.coalesce(F.col(url), F.lit("")), F.lit("]\n"), F.coalesce(F.col(document), F.lit("")))
    parts = F.array_sort(F.collect_list(F.struct(F.col(place).alias("p"), block.alias("b"))))
    return ranked.groupBy("question").agg(F.array_join(F.transform(parts, lambda x: x["b"]), "\n\n---\n\n").alias("context"))


def build_prompt(question: Column, history: Column, context: Column, system: str) -> Column:
    """array<struct<role,content>>: system, history, then context and question."""
    user = F.concat(F.lit("Context:\n"), F.coalesce(context, F.lit("")), F.lit("\n\nQuestion: "), question)
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    return F.concat(F.array(message("system", F.lit(system))), F.coalesce(history, F.array().cast("array<struct<role:string,content:string>>")), F.array(message("user", user)))


def subqueries(question: Column, reply: Column) -> Column:
    """The question, then the texts in the reply's ``queries`` that are not blank."""
    parsed = F.coalesce(F.from_json(reply, "queries array<variant>")["queries"], F.array().cast("array<variant>"))
    strings = F.transform(F.filter(parsed, lambda v: F.schema_of_variant(v) == "STRING"), lambda v: F.variant_get(v, "$", "string"))
    return F.concat(F.array(question), F.filter(strings, lambda s: ~is_blank(s)))
