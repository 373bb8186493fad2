"""The registered queries of the subpackage against their SQL."""

from collections import Counter

import duckdb
import pytest

from siltstone.llm import queries as q

D = "/root/testdata/sf0.001"


def rounded(row):
    return tuple(round(v, 9) if isinstance(v, float) else v for v in row)


@pytest.mark.parametrize("name", sorted(q.SQL))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for (path,) in con.execute(f"select file from glob('{D}/*.parquet')").fetchall():
        con.execute(f"create view {path.rsplit('/', 1)[1].removesuffix('.parquet')} as select * from '{path}'")
    found = con.execute(q.SQL[name])
    names = [c[0] for c in found.description]
    assert Counter(map(rounded, q.QUERIES[name](spark, D).select(names).collect())) == Counter(map(rounded, found.fetchall()))


def test_packing_and_quality_run(spark):
    assert q.QUERIES["p9_fill"](spark, D).count() == 2
    assert set(q.QUERIES["p10_found"](spark, D).columns) == {"doc_id"}
