"""p6_descendants gives out every pair of a file and a folder above it."""

from collections import Counter

import duckdb

import __spark_entry__ as e
from siltstone.operators.hierarchy import descendants, hierarchy

D = "/root/testdata/sf0.001"


def test_rows_of_a_small_tree(spark):
    nodes = spark.createDataFrame([(1, 1, 1, "."), (1, 2, 1, "a"), (1, 3, 2, "b"), (1, 4, 9, "lost"), (2, 1, 1, "."), (2, 3, 1, "b")], "volume_id bigint, frn bigint, parent_frn bigint, name string")
    roots = spark.createDataFrame([(1, 1), (2, 1)], "volume_id bigint, frn bigint")
    assert sorted(map(tuple, descendants(hierarchy(nodes, roots)).collect())) == [(1, 1, 2, 1), (1, 1, 3, 2), (1, 2, 3, 1), (2, 1, 3, 1)]


def test_pairs_follow_from_the_state(spark):
    state = {(r.volume_id, r.frn): r.parent_frn for r in e.queries()["p5_state"](spark, D).collect()}
    roots = set(duckdb.sql(f"select s.volume_id, s.frn from '{D}/snapshot_entry.parquet' s join '{D}/snapshot_header.parquet' h on h.volume_id = s.volume_id and h.root_index = s.slot").fetchall())
    want = Counter()
    for v, n in state:
        above, at = [], n
        while (v, at) not in roots and (v, at) in state and at not in above:
            above.append(at)
            at = state[v, at]
        if (v, at) in roots and (v, at) in state:
            want.update((v, a, n, i) for i, a in enumerate([*above, at]) if i)
    assert want and Counter(map(tuple, e.queries()["p6_descendants"](spark, D).collect())) == want
