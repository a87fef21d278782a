import pytest

from quarrycrest.plans import registry
from tests.compare import assert_same, duck

ORACLES = registry.oracle_sql()


@pytest.fixture(scope="module")
def connection(data):
    return duck(data)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, data, connection, name):
    assert_same(registry.queries()[name](spark, data), connection, ORACLES[name])


def test_every_query_has_sql_or_a_reason():
    assert set(registry.queries()) - set(ORACLES) == {"text_embeddings"}  # hashed words: see test_operators


def test_entry(spark, data):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["question", "context"]
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_core_works_without_the_packages_of_llm(tmp_path):
    """With a package missing that only llm needs, the core's queries are still there."""
    import os
    import subprocess
    import sys

    (tmp_path / "ahocorasick.py").write_text("raise ImportError('hidden')")
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'knn_topk' in q and set(o) <= set(q); print(len(q))"
    got = subprocess.run([sys.executable, "-c", code], env={**os.environ, "PYTHONPATH": f"{tmp_path}:{root}"}, capture_output=True, text=True, timeout=100)
    assert got.returncode == 0 and int(got.stdout) == len(registry.queries()), got.stderr
