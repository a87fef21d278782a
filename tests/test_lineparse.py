from quarrycrest.operators import catalog, lineparse
from pyspark.sql import functions as F

LISTING = """orphan line
ABC 221-01 Intro to Things Lecture Spring 2026 4.0 Open extra
MW 1230 PM 145 PM
F 100 PM 150 PM
Enrollment: Enrolled Capacity
83 86
Instructors: ; Lee Example
Description: First part
second part
12
Public Notes: n1
Public Notes: n2
Capacity
tail
Offered: Fall Spring
dropped
ABC 221-02 Intro to Things Lab Spring 2026 Lab Closed
Enrollment: Enrolled
Description: long lab text
4
Capacity
25
7
XYZ 1000 Reading Independent Study Fall 2025 0.0 - 4.0 Waitlist"""


def parsed(spark):
    rows = [("f", i, x) for i, x in enumerate(LISTING.split("\n"))] + [("g", 0, None), ("g", 1, "")]
    return lineparse.parse_sections(spark.createDataFrame(rows, "file string, ord bigint, line string"))


def test_records(spark):
    a, b, c = parsed(spark).orderBy("rec").collect()
    assert (a.code, a.title, a.type, a.term, a.credits, a.status) == ("ABC 221-01", "Intro to Things", "Lecture", "Spring", "4.0", "Open")
    assert [tuple(x) for x in a.schedule] == [("MW", "1230 PM", "145 PM"), ("F", "100 PM", "150 PM")]
    assert (a.enrolled, a.capacity, a.instructor, a.description, a.notes, a.offered) == (83, 86, "; Lee Example", "First part second part 12", "n2 tail", "Fall Spring")
    assert (b.credits, b.status, b.enrolled, b.capacity, b.description) == ("Lab", "Closed", 4, 25, "long lab text 7")
    assert (c.code, c.type, c.credits, c.status, c.enrolled, c.schedule, c.description) == ("XYZ 1000", "Independent Study", "0.0 - 4.0", "Waitlist", None, [], "")


def test_merge(spark):
    rows = parsed(spark).withColumn("rec_id", F.col("rec"))
    m = catalog.merge_courses(rows).where("code = 'ABC 221'").first()
    assert (m.title, m.credits, m.description) == ("Intro to Things", "4.0", "First part second part 12")
    assert dict(m.section_counts) == {"Lecture": 1, "Lab": 1}
    assert [s.section_id for s in m.sections] == ["ABC 221-01", "ABC 221-02"] and m.sections[0].instructor == "Lee Example"
    assert catalog.merge_courses(rows.limit(0)).count() == 0


def test_noise(spark):
    rows = [("f", i, x) for i, x in enumerate([" a ", "", "1/2/2026, x", "https://x", "Mode: y", None, "keep"])]
    assert [r.line for r in lineparse.clean_lines(spark.createDataFrame(rows, "file string, ord bigint, line string")).orderBy("ord").collect()] == ["a", "keep"]


def test_scalars(spark):
    df = spark.createDataFrame([("; John Lin", "MATH 162-03"), ("Smith; Jane Doe", "ACC 221"), ("", None)], "a string, b string")
    got = df.select(catalog.fix_leading_punct(F.col("a")), catalog.base_code(F.col("b"))).collect()
    assert [tuple(r) for r in got] == [("John Lin", "MATH 162"), ("Smith; Jane Doe", "ACC 221"), ("", None)]
    text = df.selectExpr("'C' code", "cast(null as string) title", "'3' credits", "'' offered", "'d' description", "'' notes", "'r' restrictions").limit(1)
    assert text.select(catalog.render_text(*text.columns)).first()[0] == "Course Code: C\nTitle: \nCredits: 3 | Offered: \nDescription: d\nRestrictions: r"
