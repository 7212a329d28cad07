"""Every query with SQL, row by row against DuckDB on the smallest tables."""

import os

import duckdb
import pytest

from strandlake.plans.queries import QUERIES

SF = os.environ.get("STRANDLAKE_TEST_SF", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        name = f.removesuffix(".parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(round(float(r[i]), 6) if isinstance(r[i], float) else r[i] for i in order) for r in rows]
    return sorted(out, key=repr)


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if q.sql])
def test_same_rows(spark, duck, name):
    got = QUERIES[name].run(spark, SF)
    rel = duck.sql(QUERIES[name].sql)
    assert sorted(got.columns) == sorted(rel.columns)
    rows = got.collect()
    assert plain(rows, got.columns) == plain(rel.fetchall(), rel.columns)
    assert rows
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "DOUBLE": "double", "BOOLEAN": "boolean"}
    assert dict(got.dtypes) == {c: kinds.get(str(t), str(t)) for c, t in zip(rel.columns, rel.types, strict=True)}


@pytest.mark.parametrize("name", [n for n, q in QUERIES.items() if not q.sql])
def test_runs(spark, name):
    assert QUERIES[name].run(spark, SF).count() > 0
