"""Similar vectors against brute force: pairs, searches, copies, recall of the index."""

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import similar as m

VEC, HEAD = "store_id int, chunk_id bigint, vec array<tinyint>, dimensions int", "store_id int, version int, dimensions int"


def frames(spark, rows, heads=((1, 1, 64), (2, 1, 32))):
    return spark.createDataFrame([(s, i, v, 0) for s, i, v in rows], VEC), spark.createDataFrame(list(heads), HEAD)


def planted(n=600, d=64, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d))
    for i in range(0, n - 1, 3):
        x[i + 1] = x[i] + rng.normal(size=d) * 0.3
    x = np.rint(x / np.abs(x).max(1, keepdims=True) * 120).astype(int)
    x[n - 2] = x[n - 1] = x[0]
    return [(1, i, r.tolist()) for i, r in enumerate(x)]


def brute(rows, k, least, asked=lambda i: True):
    out = set()
    for s in {r[0] for r in rows}:
        ids = np.array([i for q, i, _ in rows if q == s])
        x = np.array([v for q, _, v in rows if q == s], float)
        cos = np.round((x @ x.T) / np.sqrt(np.outer((x * x).sum(1), (x * x).sum(1))), 12)
        for a in range(len(ids)):
            if asked(ids[a]):
                order = [b for b in np.lexsort((ids, -cos[a])) if b != a][:k]
                out |= {(s, int(ids[a]), int(ids[b]), n + 1) for n, b in enumerate(order) if cos[a, b] >= least}
    return out


def tuples(df):
    return {(r.store_id, r.chunk_id, r.other_id, r.rank) for r in df.collect()}


def test_pairs_through_the_index(spark):
    rows = planted()
    got = tuples(m.similar(*frames(spark, rows), k=5, least=0.9, list_rows=50))
    assert got == brute(rows, 5, 0.9)


def test_search_of_a_query_set(spark):
    rows = planted(400)
    got, want = tuples(m.similar(*frames(spark, rows), k=5, asked=F.col("chunk_id") % 50 == 0)), brute(rows, 5, -2, lambda i: i % 50 == 0)
    assert len(got & want) >= 0.99 * len(want) and len(got) == len(want)


def test_recall_without_structure(spark):
    rng = np.random.default_rng(4)
    x = np.rint(rng.normal(size=(3000, 64)) * 40).clip(-127, 127).astype(int)
    y = np.rint(x[:800] + rng.normal(size=(800, 64)) * 14).clip(-127, 127).astype(int)
    rows = [(1, i, r.tolist()) for i, r in enumerate(np.concatenate([x, y]))]
    want = brute(rows, 5, 0.9)
    assert len(tuples(m.similar(*frames(spark, rows), k=5, least=0.9)) & want) >= 0.97 * len(want) > 0


def test_a_third_are_copies(spark):
    rows = planted(90) + [(1, 1000 + i, [1] * 63 + [2]) for i in range(60)] + [(1, 2000, [2] * 63 + [4])]
    assert tuples(m.similar(*frames(spark, rows), k=5, least=0.9)) == brute(rows, 5, 0.9)


def test_unsound_vectors(spark):
    good = [(1, 1, [1] * 64), (1, 2, [1] * 64), (1, 2, [1] * 64), (2, 1, [3] * 32), (2, 5, [3] * 31 + [4])]
    bad = [(1, 3, None), (1, 4, []), (1, 5, [0] * 64), (1, 6, [1] * 32), (3, 7, [1] * 64), (None, 8, [1] * 64), (1, None, [1] * 64), (1, 9, [None] + [1] * 63)]
    found = m.similar(*frames(spark, good + bad), k=5, least=0.9)
    assert tuples(found) == {(1, 1, 2, 1), (1, 2, 1, 1), (2, 1, 5, 1), (2, 5, 1, 1)}
    assert sorted(map(tuple, m.pairs(found).collect())) == [(1, 2), (1, 5)]


def test_empty(spark):
    v, h = frames(spark, [])
    assert m.similar(v, h, least=0.9).count() == 0 and m.similar(v, h, asked=F.col("chunk_id") > 0).count() == 0
    assert m.similar(v, h.limit(0), least=0.9).count() == 0


def test_the_bound_holds():
    rng = np.random.default_rng(9)
    x = rng.normal(size=(2000, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    est, err = m.estimates(x[:200], *m.codes(x))
    off = np.abs(est - x[:200] @ x.T) <= err
    assert off.mean() > 0.995
