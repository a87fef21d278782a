import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarrycrest.functions import text as X
from quarrycrest.operators.chunking import chunk_or_keep, chunks_of, split

IN = (
    "Spring Standard Hours of Operation foo\nAll dining locations are currently open. x\nWhat's Open Now a b\n10:30 am and 9:15pm, 8:00 Am\nThe information contained on this dining website a\nb dining manager on duty. y\n"
    "Address: Example Org 1 St\nNY 14627-0001 z\nPhone: (585) 275-1234 q\nEmail: a@b.c q\nLorem ipsum dolor. keep\nUpcoming Events one\ntwo\n\nkeep2 1234567890 noon at Midnight\nSkip to Content\nHigh Contrast\nFont Size A A\n"
    "Helpful links: a\nb\n\nResources for\n* one\n* two\nafter\n[lab](http://x.y) [m](mailto:a@b) ![](i.png) ![alt](i.png)\n1 st 2  nd\nWhat is this long question?\n\n* bullet\n- dash\n*\nA | B | Example Org page\n**bold** *ital*\n"
    "585-275-1234\nMarch 3, 2025 | 8:00  Am\n## Head\nhttps://x.y/z rest\n-----\n| | |\nCSC ACC NASA ABCDEF\na  b\t\tc , d ; e\n\n\n\nend\n*"
)
OUT = "x\n\n and, 8:00 Am\n y\n z\n q\n q\n keep\n\nkeep2 at \n\nafter\nlab !alt\n1st 2nd\nbullet\ndash\n\nbold ital\n\nHead\n rest\n\na b c, d; e\n\nend"


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "t string").select(f(F.col("t"))).first()[0]


def test_full_chain(spark):
    assert one(spark, IN, lambda c: X.clean(c, "Example Org")) == OUT


@pytest.mark.parametrize(
    ("rules", "before", "after"),
    [
        ((33,), "at CAMPUS school CSC ACC x NASA y", "at school x NASA y"),
        ((19, 34), "![alt](u) ![](v)", "!alt"),
        ((20,), "[1] see [x](mailto:a) z", "z"),
        ((21,), "1 st 2  nd", "1st 2nd"),
        ((16,), "Font Size A\rB\nC", "C"),
        ((10,), "Upcoming Events a\n\nb", "b"),
        (X.BASIC, None, None),
        (X.FULL, "", ""),
    ],
)
def test_single_rules(spark, rules, before, after):
    assert one(spark, before, lambda c: X.clean(c, "Example Org", rules)) == after


def test_strip_is_unicode(spark):
    assert one(spark, "\x1c　 a b \n", X.strip) == "a b"
    assert one(spark, " \x1f", X.is_blank) and one(spark, None, X.is_blank) and not one(spark, "x", X.is_blank)


@pytest.mark.parametrize(
    ("text", "lengths"),
    [("word " * 400, [1499, 794]), ("x" * 3200, [1500, 1500, 800]), ("Alpha beta gamma. " * 120, [1493, 965]), (("a" * 9 + " ") * 135 + "\n" + "Bb cc. " * 60, [1349, 710]), ("y" * 1500, [1500]), ("", [])],
)
def test_chunk_lengths(text, lengths):
    assert [len(c) for c in chunks_of(text)] == lengths


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab .\né", max_size=400), st.integers(20, 60))
def test_chunk_properties(text, size):
    parts = chunks_of(text, size, size // 5, size // 7)
    assert all(p and len(p) <= size and p in text for p in parts)
    assert re.sub(r"\s", "", text)[:5] == re.sub(r"\s", "", "".join(parts))[:5]


def test_chunk_or_keep(spark):
    rows = [(1, "a" * 99), (2, "b" * 100), (3, "c" * 1499), (4, "d" * 1500), (5, None), (6, "")]
    df = spark.createDataFrame(rows, "id int, text string")
    got = {(r.id, r.chunk_index, r.chunk_total) for r in chunk_or_keep(df).collect()}
    assert got == {(2, None, None), (3, None, None), (4, 0, 1)}
    assert {(r.id, r.chunk_index) for r in chunk_or_keep(df, number_single=True).collect()} == {(2, 0), (3, 0), (4, 0)}
    assert one(spark, None, split) == [] and one(spark, "", split) == []
