"""The driver contract: what __spark_entry__ registers can be imported, run and compared with its SQL."""

from collections import Counter

import duckdb
import pytest

import __spark_entry__ as e
from siltstone.plans import core_problems, reading, search, storage

D = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    assert e.entry(spark).count() > 0


def test_sql_names_are_queries():
    assert set(e.oracle_sql()) <= set(e.queries())


def frozen(row):
    return tuple(tuple(v) if isinstance(v, list) else v for v in row)


CORE = (core_problems, search, storage, reading)
QUERIES = sorted(n for m in CORE for n in m.SQL)


@pytest.mark.parametrize("name", QUERIES)
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for (path,) in con.execute(f"select file from glob('{D}/*.parquet')").fetchall():
        con.execute(f"create view {path.rsplit('/', 1)[1].removesuffix('.parquet')} as select * from '{path}'")
    found = con.execute(e.oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert Counter(map(frozen, e.queries()[name](spark, D).select(names).collect())) == Counter(map(frozen, found.fetchall()))
