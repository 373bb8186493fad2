"""hierarchy() against following every node's parents one by one."""

import random

import pytest

from siltstone.operators.hierarchy import hierarchy

NODE = "volume_id bigint, frn bigint, parent_frn bigint, name string"
TINY = 64


def forest(sequence=0, hot=0, nulls=0, folders=130):
    """Three volumes with the same record numbers: a tree, orphans, cycles with tails, hot children of one folder."""
    rng, rows = random.Random(7), []
    for v in (1, 2, 3):
        f = lambda i: (sequence << 48) + i
        rows.append((v, f(1), f(1), "."))
        rows += [(v, f(i), f(max(1, i - rng.randint(1, 3))), f"d{i}") for i in range(2, folders)]
        rows += [(v, f(1000 + i), f(1000 + (i + 1) % 25), f"c{i}") for i in range(25)]
        rows += [(v, f(1100 + i), f(1099 + i) if i else f(1003), f"t{i}") for i in range(10)]
        rows += [(v, f(1200 + i), f(1199 + i) if i else f(9999), f"o{i}") for i in range(10)]
        rows += [(v, f(2000 + i), f(10), f"h{i}") for i in range(hot)]
        rows += [(v, f(3000 + i), f(2000 + i), f"u{i}") for i in range(hot)]
        rows += [(v, f(4000 + i), None, f"n{i}") for i in range(nulls)]
        rows += [(v, f(4100 + i), f(4000 + i), f"m{i}") for i in range(nulls)]
    return rows, [(v, f(1)) for v in (1, 2, 3)]


def brute(rows, roots):
    up, out = {(v, n): p for v, n, p, _ in rows}, {}
    names = {(v, n): name for v, n, _, name in rows}
    for v, n in up:
        seen, at = [], n
        while (v, at) not in roots and (v, at) in up and at not in seen:
            seen.append(at)
            at = up[v, at]
        if (v, at) in roots:
            out[v, n] = (None, len(seen), at, tuple(names[v, x] for x in reversed(seen)))
        else:
            out[v, n] = ("orphan" if at not in seen else "cycle" if at == n else "below_cycle", None, None, None)
    return out


def solved(spark, rows, roots, fragment_rows):
    h = hierarchy(spark.createDataFrame(rows, NODE), spark.createDataFrame(roots, "volume_id bigint, frn bigint"), fragment_rows=fragment_rows).collect()
    out = {(r.volume_id, r.frn): (r.fault, r.depth, r.root, r.chain if r.chain is None else tuple(s["name"] for s in r.chain)) for r in h}
    assert len(out) == len(h)
    return out


@pytest.mark.parametrize("hot", [0, 40])
def test_fragments_of_several_volumes(spark, hot):
    rows, roots = forest(hot=hot)
    assert solved(spark, rows, roots, TINY) == brute(rows, set(roots))


@pytest.mark.parametrize("fragment_rows", [400_000, TINY])
def test_large_frn_beside_null_parents(spark, fragment_rows):
    rows, roots = forest(sequence=0x7A31, nulls=3)
    assert solved(spark, rows, roots, fragment_rows) == brute(rows, set(roots))


def test_hot_folders_that_are_each_others_parents(spark):
    rows, roots = forest(hot=20)
    for v in (1, 2, 3):
        rows += [(v, 7000, 7001, "p"), (v, 7001, 7000, "q")]
        rows += [(v, 7100 + i, 7000 + i % 2, f"x{i}") for i in range(120)] + [(v, 7300 + i, 7100 + i, f"y{i}") for i in range(120)]
    assert solved(spark, rows, roots, TINY) == brute(rows, set(roots))


def test_a_long_chain(spark):
    n = 3000
    rows = [(1, i, max(1, i - 1), str(i)) for i in range(1, n)]
    h = hierarchy(spark.createDataFrame(rows, NODE), spark.createDataFrame([(1, 1)], "volume_id bigint, frn bigint"), False, 500)
    assert {r.frn: r.depth for r in h.collect()} == {i: i - 1 for i in range(1, n)}


def test_doubling_alone(spark):
    from pyspark.sql import functions as F

    from siltstone.operators import hierarchy as m

    rows, roots = forest(sequence=0x7A31, hot=20, nulls=3)
    links = spark.createDataFrame(rows, NODE).join(spark.createDataFrame(roots, "volume_id bigint, frn bigint").withColumn("stop", F.lit(True)), ["volume_id", "frn"], "left").na.fill(False, ["stop"])
    links = links.select("volume_id", "frn", "parent_frn", "stop", F.array(F.struct("frn", "name")).alias("segs"), F.lit(1).cast("bigint").alias("hops"))
    got = {(r.volume_id, r.frn): (r.fault, r.depth, None if r.fault else r.top, r.chain if r.chain is None else tuple(s["name"] for s in r.chain)) for r in m._doubled(links, 0, True, 1).collect()}
    assert got == brute(rows, set(roots))


def test_empty_tables(spark):
    h = hierarchy(spark.createDataFrame([], NODE), spark.createDataFrame([], "volume_id bigint, frn bigint"))
    assert h.collect() == []
