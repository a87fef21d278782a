"""The queries of this folder over the test tables, whole tables and whole texts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quarrycrest.llm import boilerplate, byte_pairs, languages, mixing, near_duplicates, repeated_lines, residue, splitting, survivors, truncation
from quarrycrest.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]

#: Problem 1 in this project's data asks for three words and 0.6.
NEAR = {"k": 3, "threshold": 0.6}


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.pairs(table(spark, sf, "gap_fill_data"), **NEAR)


def p1_groups(spark: SparkSession, sf: str) -> DataFrame:
    return near_duplicates.groups(table(spark, sf, "gap_fill_data"), **NEAR)


PAGE_TABLES = ("campus_life_data", "gap_fill_data")


def p2_texts(spark: SparkSession, sf: str) -> DataFrame:
    return boilerplate.furniture({name: table(spark, sf, name) for name in PAGE_TABLES})


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_texts(spark, sf).select("tbl", "rec_id", F.explode("line_nos").alias("line_no"))


def p3_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return splitting.split_oversized(table(spark, sf, "academic_info"), table(spark, sf, "chunk_policy"))


def p3_found(spark: SparkSession, sf: str) -> DataFrame:
    return p3_pieces(spark, sf).where("chunk_index = 0").select("rec_id")


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    found = repeated_lines.repeated_lines(table(spark, sf, "academic_info"))
    return found.selectExpr("id as rec_id", "line_no")


def p4_texts(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.without_repeated_lines(table(spark, sf, "academic_info"))


def p4_chunks(spark: SparkSession, sf: str) -> DataFrame:
    return repeated_lines.repeated_chunks(table(spark, sf, "academic_info"))


def _trusted_courses(spark: SparkSession, sf: str) -> tuple[DataFrame, dict[str, Column]]:
    """Course rows with code and trust, and the conditions of real titles and descriptions;
    a description that lost its end is none."""
    courses = table(spark, sf, "courses")
    cut = truncation.find(courses).where("cut and field = 'description'").select("rec_id", F.lit(True).alias("is_cut"))
    trust = table(spark, sf, "feed_trust").groupBy("feed").agg(F.max("trust").alias("trust"))
    # one row a feed: a settings table
    rows = courses.withColumn("course_code", survivors.course_code(F.col("code"))).join(F.broadcast(trust), "feed", "left").join(cut, "rec_id", "left")
    return rows, {"title": truncation.is_real(F.col("title")), "description": truncation.is_real(F.col("description")) & F.col("is_cut").isNull()}


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    """Branch and bound over the bundles title and description, which do not depend on each other here."""
    rows, real = _trusted_courses(spark, sf)
    best = survivors.consistent(rows, "course_code", {c: [c] for c in real}, real, [], "trust", "captured_at")
    return best.where("n_rows >= 2").select("course_code", *(F.coalesce(f"{c}_rec", F.lit(-1)).alias(f"{c}_rec") for c in real))


def p5_consistent(spark: SparkSession, sf: str) -> DataFrame:
    """Title, description and the pair (credits, offered) of one course, where the
    credits must be those of a record with that title, and the description too."""
    rows, real = _trusted_courses(spark, sf)
    bundles = {"title": ["title"], "description": ["description"], "terms": ["credits", "offered"]}
    real["terms"] = truncation.is_real(F.col("credits"))
    return survivors.consistent(rows, "course_code", bundles, real, [("title", "description"), ("title", "terms")], "trust", "captured_at")


def p7_values(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.find(table(spark, sf, "courses"))


def p7_rates(spark: SparkSession, sf: str) -> DataFrame:
    return truncation.rates(p7_values(spark, sf))


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    return p7_values(spark, sf).where("cut").select("rec_id", "field")


RESIDUE_TABLES = ("academic_info", "campus_life_data")


def p6_rows(spark: SparkSession, sf: str) -> DataFrame:
    return residue.find(spark, {name: table(spark, sf, name) for name in RESIDUE_TABLES})


def p6_figures(spark: SparkSession, sf: str) -> DataFrame:
    return residue.figures(spark, {name: table(spark, sf, name) for name in RESIDUE_TABLES})


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return p6_rows(spark, sf).select("tbl", "rec_id")


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return byte_pairs.encode(table(spark, sf, "documents"))


def p8_texts(spark: SparkSession, sf: str) -> DataFrame:
    """Every text encoded and decoded again; null has become ''."""
    return byte_pairs.decode(p8_ids(spark, sf))


def p9_copies(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_mix"))[0]


def p9_shares(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mix(table(spark, sf, "documents"), table(spark, sf, "source_mix"))[1]


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return languages.cases(table(spark, sf, "documents"), table(spark, sf, "lang_names"))


def _language_segments(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents")
    return languages.segments(documents, languages.train(documents, table(spark, sf, "lang_names")))


def p10_segments(spark: SparkSession, sf: str) -> DataFrame:
    return _language_segments(spark, sf)


def p10_documents(spark: SparkSession, sf: str) -> DataFrame:
    return languages.document_languages(_language_segments(spark, sf))


def queries() -> dict[str, Query]:
    return {name: f for name, f in globals().items() if name[0] == "p" and name[1:2].isdigit()}


def oracle_sql() -> dict[str, str]:
    from quarrycrest.llm import sql

    return dict(sql.ORACLES)
