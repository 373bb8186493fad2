"""Packings: capacity, wholeness, the plan's counts, and how full they are."""

import random
from collections import Counter, defaultdict

import pytest

from siltstone.llm import packing as m


def counts(seed, capacity, n):
    rng = random.Random(seed)
    return Counter(min(capacity, int(rng.paretovariate(1.1) * capacity / 40)) for _ in range(n))


@pytest.mark.parametrize("capacity", [1, 10, 64, 512])
@pytest.mark.parametrize("n", [0, 1, 5, 300, 20000])
def test_plans_hold_every_text_once(capacity, n):
    c = counts(n, capacity, n)
    planned = m.plan(dict(c), capacity)
    got = Counter()
    for contents, times in planned:
        assert sum(s * k for s, k in contents.items()) <= capacity and times > 0
        for s, k in contents.items():
            got[s] += k * times
    assert got == +c


def test_plans_are_full():
    c = counts(1, 512, 50000)
    planned = m.plan(dict(c), 512)
    assert sum(s * k for s, k in c.items()) / (512 * sum(t for _, t in planned)) > 0.97


def check(spark, sizes, capacity):
    df = spark.createDataFrame(sizes, "doc_id bigint, n_tokens bigint")
    rows = m.fill(df, capacity).collect()
    used, parts = Counter(), defaultdict(list)
    for r in rows:
        used[r.container] += r.n_tokens
        parts[r.doc_id].append((r.part, r.first_token, r.n_tokens))
    assert all(v <= capacity for v in used.values())
    for d, n in sizes:
        n, at = n or 0, 0
        for i, (part, first, k) in enumerate(sorted(parts[d])):
            assert (part, first) == (i, at)
            at += k
        assert at == n and (n > capacity or len(parts[d]) == 1)
    return used, rows


def test_texts_are_whole_unless_too_long(spark):
    rng = random.Random(2)
    sizes = [(i, rng.choice([None, 0, 1, 7, 7, 7, 60, 99, 100, 101, 200, 950, rng.randint(1, 130)])) for i in range(900)]
    used, rows = check(spark, sizes, 100)
    assert sum(used.values()) / (100 * len([v for v in used.values() if v])) > 0.95


def test_one_size_and_nothing(spark):
    check(spark, [(i, 7) for i in range(500)], 20)
    check(spark, [(1, None), (2, 0)], 20)
    assert check(spark, [], 20)[1] == []


def test_every_limit_and_none(spark):
    from siltstone.llm.tokens import vocabulary_path

    docs = spark.createDataFrame([(1, "a b c"), (2, None), (3, "word " * 600)], "doc_id bigint, text string")
    limits = spark.createDataFrame([("big", "token", 400, 0), ("small", "token", 2, 0), ("piece", "byte", 5, 1), ("no", "token", None, 0)], "limit_name string, unit string, capacity int, overlap int")
    out = m.containers(docs, limits, vocabulary_path())
    assert {r.limit_name for r in out.collect()} == {"big", "small"}
    assert m.containers(docs, limits.limit(0), vocabulary_path()).count() == 0
    f = {r.limit_name: r for r in m.fill_rates(out).collect()}
    assert f["big"].tokens == f["small"].tokens
