"""Every registered record query against its SQL."""

import duckdb
import pytest

from streetlens.plans.registry import ORACLE, QUERIES

DATA = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(ORACLE) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, name):
    found = QUERIES[name](spark, DATA)
    rows = found.collect()
    if name not in ORACLE:
        assert found.columns
        return
    con = duckdb.connect()
    for table in ("events", "orders", "part"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{DATA}/{table}.parquet'")
    want = con.sql(ORACLE[name])
    columns = sorted(want.columns)
    assert sorted(found.columns) == columns

    def line(row):
        return tuple(str(round(v, 6) + 0.0 if isinstance(v, float) else v) for v in row)

    order = [want.columns.index(c) for c in columns]
    assert sorted(line(r[c] for c in columns) for r in rows) == sorted(line(r[i] for i in order) for r in want.fetchall())
