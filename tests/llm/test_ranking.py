"""Medians against numpy, and the combined ranking's defined cases."""

import numpy as np
import pytest

from siltstone.llm import ranking as m

HIT, NEAR = "query_id bigint, doc_id bigint, score double, passages int", "query_id bigint, chunk_id bigint, score float"
CHUNK, DOC = "chunk_id bigint, doc_id bigint, score double", "doc_id bigint, rank_penalty double, query_id bigint"


def run(spark, hits, near, chunks, docs):
    c = [spark.createDataFrame(r, s) for r, s in ((hits, HIT), (near, NEAR), (chunks, CHUNK), (docs, DOC))]
    return m.combined_ranking(*c)


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_exact_medians_with_ties(spark, n):
    rng = np.random.default_rng(n)
    rows = [(k, float(v)) for k in (1, 2) for v in rng.integers(0, 30 * k, n)] + [(1, None), (3, None)]
    got = {r.k: (r.median, r.total) for r in m.medians(spark.createDataFrame(rows, "k int, v double"), ["k"], "v").collect()}
    assert got == {k: (float(np.median([v for q, v in rows if q == k and v is not None])), n) for k in (1, 2)}


def test_outlier_on_one_score_does_not_win(spark):
    hits = [(1, d, -float(d), 1) for d in range(1, 21)] + [(1, 99, -1e9, 1)]
    near = [(1, d, d / 50.0) for d in range(1, 21)]
    out = m.top(run(spark, hits, near, [(d, d, 0.0) for d in range(1, 21)], [(20, 4.0, 1)]), 3).orderBy("rank").collect()
    assert [r.doc_id for r in out] == [19, 18, 17]


def test_nulls_repeats_and_ties(spark):
    hits = [(1, 1, -2.0, 1), (1, 1, -2.0, 1), (1, 2, -2.0, 1), (1, 3, None, 1), (1, 4, float("nan"), 1), (None, 1, 1.0, 1), (1, None, 1.0, 1)]
    out = run(spark, hits, [(1, 7, None), (1, None, 0.5), (None, 7, 0.5), (1, 8, 0.5)], [(7, 5, 0.0), (None, 1, 0.0)], []).collect()
    assert sorted(r.doc_id for r in out) == [1, 2, 3, 4, 5]
    score = {r.doc_id: r.score for r in out}
    assert score[1] == score[2] > score[3] == score[4] and all(0 < s < 1 for s in score.values())
    top = m.top(run(spark, hits, [], [], []), 1).collect()
    assert [r.doc_id for r in top] == [1]


def test_empty(spark):
    assert run(spark, [], [], [], []).count() == 0
