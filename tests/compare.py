"""Spark result against DuckDB's, as multisets of rows with columns by name."""

from pathlib import Path

import duckdb


def _rows(columns, rows):
    order = [columns.index(c) for c in sorted(columns)]
    plain = lambda x: round(x, 6) if isinstance(x, float) else x
    return sorted(repr(tuple(plain(r[i]) for i in order)) for r in rows)


def duck(sf):
    c = duckdb.connect()
    for f in Path(sf).glob("*.parquet"):
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def assert_same(df, connection, sql):
    got = [tuple(r) for r in df.collect()]
    cursor = connection.execute(sql)
    want = cursor.fetchall()
    names = [d[0] for d in cursor.description]
    assert sorted(df.columns) == sorted(names)
    assert _rows(df.columns, got) == _rows(names, want)
