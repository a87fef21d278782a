"""Section records merged into course records.

All of it is one aggregation: the order that decides first and longest values is in
the keys of min_by and max_by, so groups are reduced before the shuffle.  Only the
list of sections itself, which is the result asked for, is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrycrest.functions.text import strip

SECTION_FIELDS = ["type", "term", "status", "schedule", "enrolled", "capacity", "instructor"]


def fix_leading_punct(text: Column) -> Column:
    """Without the semicolons and spaces that a page break left at the front."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), r"^[;\s]+", "")


def base_code(code: Column) -> Column:
    """The code without its section number."""
    return strip(F.regexp_replace(code, r"-\d{1,3}\z", ""))


def _order(order: str):
    return [F.col("type").isNull() | (F.col("type") != "Lecture"), F.coalesce(F.col("code"), F.lit("")), F.col(order)]


def best_field(name: str, order: str) -> Column:
    """Longest stripped value among lectures, or else among all; the first in section
    order wins ties; '' if there is none."""
    value = strip(F.coalesce(F.col(name), F.lit("")))
    key = F.struct(-F.length(value), *_order(order))
    lecture = F.col("type") == "Lecture"
    best = lambda keep: F.min_by(F.when(keep, value), F.when(keep, key))
    return F.coalesce(best((value != "") & lecture), best(value != ""), F.lit(""))


def section_counts(sections: DataFrame) -> DataFrame:
    """(code, counts): the number of sections of each type as entries sorted by type."""
    typed = sections.select(base_code(F.col("code")).alias("code"), F.coalesce("type", F.lit("")).alias("type"))
    counted = typed.groupBy("code", "type").agg(F.count("*").alias("n"))
    return counted.groupBy("code").agg(F.array_sort(F.collect_list(F.struct("type", "n"))).alias("counts"))


def merge_courses(sections: DataFrame, order: str = "rec_id") -> DataFrame:
    """One row a course: code, title and credits of the first section (lectures first,
    then by code), offered, description, notes and restrictions by the longest value,
    section_counts and the sections in order.  Rows with a null code are left out."""
    rows = sections.where(F.col("code").isNotNull()).withColumn("base", base_code(F.col("code")))
    first = lambda c: F.min_by(F.coalesce(F.col(c), F.lit("")), F.struct(*_order(order)))
    section = F.struct(
        *(x.alias(f"o{i}") for i, x in enumerate(_order(order))),
        F.col("code").alias("section_id"),
        *(fix_leading_punct(F.col(c)).alias(c) if c == "instructor" else F.col(c) for c in SECTION_FIELDS),
    )
    merged = rows.groupBy("base").agg(
        first("title").alias("title"),
        first("credits").alias("credits"),
        *(best_field(c, order).alias(c) for c in ("offered", "description", "notes", "restrictions")),
        F.array_sort(F.collect_list(section)).alias("sections"),
    )
    fields = ["section_id", *SECTION_FIELDS]
    sections_out = F.transform("sections", lambda s: F.struct(*(s[c].alias(c) for c in fields)))
    types = F.transform("sections", lambda s: F.coalesce(s["type"], F.lit("")))
    counts = F.map_from_entries(F.transform(F.array_sort(F.array_distinct(types)), lambda t: F.struct(t, F.size(F.filter(types, lambda x: x == t)))))
    return merged.select(F.col("base").alias("code"), "title", "credits", "offered", "description", "notes", "restrictions", counts.alias("section_counts"), sections_out.alias("sections"))


def render_text(code, title, credits, offered, description, notes, restrictions) -> Column:
    """A course as labelled lines; notes and restrictions only where there are any."""
    c = [F.coalesce(F.col(x), F.lit("")) for x in (code, title, credits, offered, description, notes, restrictions)]
    text = F.concat(
        F.lit("Course Code: "), c[0], F.lit("\nTitle: "), c[1], F.lit("\nCredits: "), c[2], F.lit(" | Offered: "), c[3], F.lit("\nDescription: "), c[4], F.lit("\n"),
        F.when(c[5] != "", F.concat(F.lit("Important Notes: "), c[5], F.lit("\n"))).otherwise(""),
        F.when(c[6] != "", F.concat(F.lit("Restrictions: "), c[6], F.lit("\n"))).otherwise(""),
    )
    return strip(text)


def course_chunks(courses: DataFrame, base_url: str, content_type: str = "course_description") -> DataFrame:
    """Courses as chunk records, one chunk each, all under one url."""
    text = render_text("code", "title", "credits", "offered", "description", "notes", "restrictions")
    return courses.select(
        F.lit(base_url).alias("url"), F.lit("").alias("department"), F.lit("").alias("school"), F.lit(2).alias("depth"),
        F.lit(content_type).alias("content_type"), text.alias("text"), F.lit(0).alias("chunk_index"), F.lit(1).alias("chunk_total"),
    )
