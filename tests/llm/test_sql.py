import pytest

from quarrycrest.llm import registry
from tests.compare import assert_same, duck

ORACLES = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, name):
    assert_same(registry.queries()[name](spark, data), duck(data), ORACLES[name])


def test_found_queries_have_the_columns_asked_for(spark, data):
    want = {
        "p1_found": [("rec_a", "bigint"), ("rec_b", "bigint")],
        "p2_found": [("tbl", "string"), ("rec_id", "bigint"), ("line_no", "bigint")],
        "p3_found": [("rec_id", "bigint")],
        "p4_found": [("rec_id", "bigint"), ("line_no", "bigint")],
        "p5_found": [("course_code", "string"), ("title_rec", "bigint"), ("description_rec", "bigint")],
        "p6_found": [("tbl", "string"), ("rec_id", "bigint")],
        "p7_found": [("rec_id", "bigint"), ("field", "string")],
        "p8_ids": [("doc_id", "bigint"), ("ids", "array<int>")],
        "p10_found": [("doc_id", "bigint"), ("lang", "string")],
    }
    for name, columns in want.items():
        df = registry.queries()[name](spark, data)
        assert df.dtypes == columns, name
        rows = df.drop("ids").collect()
        assert len(rows) == len(set(rows)), name
