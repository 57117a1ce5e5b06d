"""Every query with SQL gives what DuckDB gives on the smallest tables."""

import math
import os
from decimal import Decimal

import pytest

import __spark_entry__
from lattica.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return None
    return round(float(v), 5) if isinstance(v, (int, float, Decimal)) and not isinstance(v, bool) else str(v)


def rows(columns, values):
    order = sorted(range(len(columns)), key=columns.__getitem__)
    return sorted((tuple(plain(r[i]) for i in order) for r in values), key=repr)


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")
@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, name):
    got = registry.queries()[name](spark, SF)
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cur = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in cur.description]
    assert sorted(got.columns) == sorted(columns)
    assert rows(got.columns, got.collect()) == rows(columns, cur.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).columns[0] == "id"
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
