"""The line-oriented catalogue listing parsed with window functions.

A record runs from one header line to the next.  Within it two registers are kept,
as running aggregates over the lines so far: which text field is open, and which
numbers of the last enrolment block are still due.  Every window is partitioned by
file and record; headers are counted over ranges of a file, whatever its size.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarrycrest.functions.text import SPACE
from quarrycrest.operators.order import running_count

# Patterns and words of the listing's format.
TYPES = "Lecture|Seminar|Lab|Recitation|Independent Study|Internship|Research|Studio|Conference|Discussion"
HEADER = (
    r"^([A-Z]{2,5}\s+\d{3,4}(?:-\d{1,3})?)\s+(.+?)\s+(" + TYPES + r")\s+(Fall|Spring|Summer|Winter)\s+\d{4}"
    r"\s+([\d.]+(?:\s*-\s*[\d.]+)?|" + TYPES + r")\s+(Open|Closed|Waitlist|Cancelled)"
)
SCHEDULE = r"^([MTWRFS]+)\s+(\d{3,4}\s+[AP]M)\s+(\d{3,4}\s+[AP]M)"
TWO_NUMBERS, ONE_NUMBER = r"^(\d+)\s+(\d+)\z", r"^(\d+)\z"
KEYWORDS = {"Description:": "description", "Public Notes:": "notes", "Restrictions:": "restrictions", "Instructors:": "instructor", "Offered:": "offered"}
CLOSED_AT_ONCE = ("instructor", "offered")
NOISE = ["https", "Course Course Title", "Schedule: Day Begin", "Books: Click", "Delivery", "Mode:", "Co-Located:", "{organisation} Course Descriptions"]
TIMESTAMP = r"^\d{1,2}/\d{1,2}/\d{2,4},"


def clean_lines(lines: DataFrame, noise: list[str] | None = None, organisation: str = "") -> DataFrame:
    """Stripped lines that are not empty, not stamped with a time and not noise, which is
    known by its prefixes; ``organisation`` is how the listing's title names its owner."""
    text = F.regexp_replace(F.coalesce("line", F.lit("")), rf"^{SPACE}+|{SPACE}+\z", "")
    out = lines.withColumn("line", text).where((F.col("line") != "") & ~F.col("line").rlike(TIMESTAMP))
    for p in noise if noise is not None else NOISE:
        out = out.where(~F.col("line").startswith(p.replace("{organisation}", organisation).lstrip()))
    return out


def parse_sections(lines: DataFrame) -> DataFrame:
    """(file, rec, code, ..., offered): the records of lines (file, ord, line)."""
    line = F.col("line")
    rows = lines.where(line.isNotNull()).withColumn("header", line.rlike(HEADER))
    rows = running_count(rows, "header", "file", "ord", "rec").where("rec > 0")

    keyword = F.lit(None).cast("string")
    value = F.lit(None).cast("string")
    for word, field in reversed(KEYWORDS.items()):
        keyword = F.when(line.startswith(word), field).otherwise(keyword)
        value = F.when(line.startswith(word), F.regexp_replace(F.substr(line, F.lit(len(word) + 1)), rf"^{SPACE}+|{SPACE}+\z", "")).otherwise(value)
    kind = (
        F.when(F.col("header"), "header")
        .when(line.rlike(SCHEDULE), "schedule")
        .when(line.startswith("Enrollment:"), "enrolment")
        .when(line == "Capacity", "capacity")
        .when(line.rlike(TWO_NUMBERS), "two")
        .when(line.rlike(ONE_NUMBER), "one")
        .when(keyword.isNotNull(), "keyword")
        .otherwise("text")
    )
    rows = rows.withColumns({"kind": kind, "field": F.when(kind == "keyword", keyword), "value": value})

    by_rec = Window.partitionBy("file", "rec").orderBy("ord")
    rows = rows.withColumn("block", F.count_if(F.col("kind") == "enrolment").over(by_rec))
    in_block = Window.partitionBy("file", "rec", "block").orderBy("ord")
    both = F.contains(F.first("line").over(in_block), F.lit("Capacity"))
    rows = rows.withColumn("due", F.when(F.col("block") == 0, F.lit(None)).when(both, "two").otherwise("one"))
    nth = F.count_if((F.col("kind") == F.col("due"))).over(in_block)
    taken = (F.col("kind") == F.col("due")) & F.when(F.col("due") == "two", nth <= 1).otherwise(nth <= 2)
    rows = rows.withColumns({"nth": nth, "taken": F.coalesce(taken, F.lit(False))})

    # what each line does to the open field: names it, closes it, or leaves it
    event = F.when(F.col("kind") == "keyword", F.when(F.col("field").isin(*CLOSED_AT_ONCE), "-").otherwise(F.col("field"))).when(F.col("kind").isin("header", "schedule", "enrolment"), "-")
    before = by_rec.rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("open", F.last(event, ignorenulls=True).over(before))
    loose = (F.col("kind") == "text") | (F.col("kind").isin("one", "two") & ~F.col("taken"))
    target = F.when(F.col("kind") == "keyword", F.col("field")).when(loose & (F.col("open") != "-"), F.col("open"))
    rows = rows.withColumn("target", target)
    by_field = Window.partitionBy("file", "rec", "target").orderBy("ord").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    restart = F.max(F.when(F.col("kind") == "keyword", F.col("ord"))).over(by_field)
    rows = rows.withColumn("live", F.col("target").isNotNull() & (F.col("ord") >= restart))

    def text_of(field: str):
        parts = F.collect_list(F.when(F.col("live") & (F.col("target") == field), F.struct("ord", F.when(F.col("kind") == "keyword", F.col("value")).otherwise(line).alias("v"))))
        return F.array_join(F.transform(F.array_sort(parts), lambda x: x["v"]), " ").alias(field)

    def number(which: int):
        group = F.when(F.col("kind") == "two", F.regexp_extract(line, TWO_NUMBERS, which))
        single = F.when((F.col("kind") == "one") & (F.col("nth") == which), line)
        return F.max_by(F.coalesce(group, single).cast("int"), F.when(F.col("taken") & F.coalesce(group, single).isNotNull(), F.col("ord")))

    head = lambda g: F.max(F.when(F.col("header"), F.regexp_extract(line, HEADER, g)))
    day = F.struct("ord", *(F.regexp_extract(line, SCHEDULE, g).alias(n) for g, n in ((1, "days"), (2, "start_time"), (3, "end_time"))))
    schedule = F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "schedule", day))), lambda x: F.struct(x["days"].alias("days"), x["start_time"].alias("start_time"), x["end_time"].alias("end_time")))
    return rows.groupBy("file", "rec").agg(
        *(head(g).alias(n) for g, n in ((1, "code"), (2, "title"), (3, "type"), (4, "term"), (5, "credits"), (6, "status"))),
        schedule.alias("schedule"),
        number(1).alias("enrolled"),
        number(2).alias("capacity"),
        *(text_of(f) for f in ("instructor", "description", "notes", "restrictions", "offered")),
    )
