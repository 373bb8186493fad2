"""Filling containers of fixed capacity with whole texts.

Only the number of texts of each size decides a packing, and sizes are bounded by the capacity, so the driver works on at
most ``capacity`` numbers whatever the corpus holds. By the linear grouping scheme, large sizes are put into groups of equal
cardinality and rounded up to their group's greatest; patterns of the few rounded sizes are optimised (columns generated
against the duals of the covering problem) and rounded down to whole numbers, the rest is packed first-fit. Then
actual sizes take the place of the rounded ones, and small sizes go, best fit, where space is left.

The plan says for each size which ranks go to which run of like containers. Texts get their rank within their size in a
distributed way (salted by hash, a size may hold a third of all texts) and find their container by binary search.
"""

from __future__ import annotations

from bisect import insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.llm.tokens import count_tokens
from siltstone.session import materialize

GROUPS = 64
SMALL = 1 / 16  # of the capacity: sizes up to it fill what the patterns leave
RANKED_ROWS = 250_000


def _knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of sizes within the capacity; one step of the loop adds one more item."""
    best, steps = np.zeros(capacity + 1), []
    order = [i for i in range(len(sizes)) if values[i] > 1e-12]
    for _ in range(capacity // int(sizes.min())):
        more, which = best.copy(), np.full(capacity + 1, -1)
        for i in order:
            s = sizes[i]
            with_i = best[: capacity + 1 - s] + values[i]
            better = with_i > more[s:] + 1e-12
            more[s:][better], which[s:][better] = with_i[better], i
        if (which < 0).all():
            break
        steps.append(which)
        best = more
    take, c = np.zeros(len(sizes), np.int64), capacity
    for which in reversed(steps):
        if which[c] >= 0:
            take[which[c]] += 1
            c -= sizes[which[c]]
    return float(best[capacity]), take


def patterns(sizes: list[int], demand: list[int], capacity: int, rounds: int = 400) -> list[tuple[tuple[int, ...], float]]:
    """(pattern, how often) of an optimal fractional covering of the demand by generated patterns.

    Revised simplex with an explicit basis inverse; one row per size, so at most one pattern per size is used.
    """
    size, need = np.array(sizes), np.array(demand, float)
    m = len(size)
    basis = np.diag(capacity // size).astype(float)  # columns: containers of one size only
    inverse, x = np.diag(1 / np.diag(basis)), need / np.diag(basis)
    for step in range(rounds):
        if step and step % 50 == 0:  # rounding errors add up
            inverse = np.linalg.inv(basis)
            x = inverse @ need
        worth, new = _knapsack(np.maximum(inverse.sum(0), 0), size, capacity)
        if worth <= 1 + 1e-7:
            break
        along = inverse @ new
        can = np.flatnonzero(along > 1e-9)
        if not len(can):
            break
        ratio = x[can] / along[can]
        out = can[int(np.argmin(ratio))]
        by = max(float(ratio.min()), 0.0)
        x = np.maximum(x - by * along, 0)
        x[out] = by
        inverse[out] /= along[out]
        others = np.arange(m) != out
        inverse[others] -= np.outer(along[others], inverse[out])
        basis[:, out] = new
    return [(tuple(int(v) for v in basis[:, j]), float(x[j])) for j in range(m) if x[j] > 1e-9]


def grouped(counts: dict[int, int], groups: int = GROUPS) -> list[dict[int, int]]:
    """Sizes in descending order cut into groups of equal cardinality; one size may be in several groups."""
    n = sum(counts.values())
    if not n:
        return []
    quota, out, room = -(-n // groups), [{}], -(-n // groups)
    for s in sorted(counts, reverse=True):
        left = counts[s]
        while left:
            if not room:
                out.append({})
                room = quota
            take = min(left, room)
            out[-1][s] = out[-1].get(s, 0) + take
            left, room = left - take, room - take
    merged: list[dict[int, int]] = []
    for g in out:  # groups rounded to the same size are one
        if merged and max(merged[-1]) == max(g):
            for s, c in g.items():
                merged[-1][s] = merged[-1].get(s, 0) + c
        else:
            merged.append(g)
    return merged


class _Runs:
    """Like containers: runs of (contents by size, how many), with the space left in each."""

    def __init__(self, capacity: int):
        self.capacity, self.runs = capacity, []

    def add(self, contents: Counter, times: int) -> None:
        if times:
            self.runs.append([self.capacity - sum(s * c for s, c in contents.items()), contents, times])


def _substitute(runs: _Runs, pattern: tuple[int, ...], times: int, stock: list[list[list[int]]]) -> None:
    """``times`` containers of a pattern: each place of a group takes the group's next actual sizes, greatest first."""
    places = [g for g, c in enumerate(pattern) for _ in range(c)]
    while times:
        # the longest stretch in which every place draws one unchanged size
        contents, stretch, drawn = Counter(), times, Counter(places)
        for g, c in drawn.items():
            if not stock[g]:
                continue
            s, left = stock[g][0]
            if left >= c:
                contents[s] += c
                stretch = min(stretch, left // c)
            else:
                stretch = 1
        if stretch == 1:  # places of one group may draw different sizes
            contents = Counter()
            for g in places:
                if stock[g]:
                    contents[stock[g][0][0]] += 1
                    stock[g][0][1] -= 1
                    if not stock[g][0][1]:
                        stock[g].pop(0)
        else:
            for g, c in drawn.items():
                if stock[g]:
                    stock[g][0][1] -= stretch * c
                    if not stock[g][0][1]:
                        stock[g].pop(0)
        if contents:
            runs.add(contents, stretch)
        times -= stretch


def plan(counts: dict[int, int], capacity: int, groups: int = GROUPS, small: float = SMALL) -> list[tuple[dict[int, int], int]]:
    """(contents, times) of all containers for ``counts`` texts of each size from 0 to the capacity."""
    limit = max(1, int(capacity * small))
    large = {s: c for s, c in counts.items() if s > limit and c > 0}
    runs = _Runs(capacity)
    if large:
        parts = grouped(large, groups)
        sizes, demand = [max(g) for g in parts], [sum(g.values()) for g in parts]
        stock = [[[s, g[s]] for s in sorted(g, reverse=True)] for g in parts]
        for pattern, often in patterns(sizes, demand, capacity):
            whole = int(often + 1e-9)
            # not more than the stock can fill, or places would stay empty
            for g, c in enumerate(pattern):
                if c:
                    whole = min(whole, sum(left for _, left in stock[g]) // c)
            _substitute(runs, pattern, whole, stock)
        rest = Counter()
        for g in stock:
            for s, left in g:
                rest[s] += left
        _best_fit(runs, rest)
    _best_fit(runs, {s: c for s, c in counts.items() if 0 < s <= limit})
    if counts.get(0):  # texts without tokens need no space
        there = next((i for i, r in enumerate(runs.runs) if r[2]), None)
        if there is not None:
            gap, contents, times = runs.runs[there]
            runs.runs[there] = [gap, contents, times - 1]
            runs.runs.append([gap, contents + Counter({0: counts[0]}), 1])
        else:
            runs.runs.append([capacity, Counter({0: counts[0]}), 1])
    return [(dict(contents), times) for _, contents, times in runs.runs if times]


def _best_fit(runs: _Runs, counts: dict[int, int]) -> None:
    """Sizes in descending order, each into the fullest container that has room for it; else into a new one."""
    live = sorted(range(len(runs.runs)), key=lambda i: runs.runs[i][0])
    gaps = sorted((runs.runs[i][0], i) for i in live)
    for s in sorted(counts, reverse=True):
        n = counts[s]
        at = _first(gaps, s)
        while n:
            if at < len(gaps):
                gap, i = gaps.pop(at)
                _, contents, times = runs.runs[i]
            else:
                gap, contents, times, i = runs.capacity, Counter(), -(-n // (runs.capacity // s)), None
            each = gap // s
            full, part = min(times, n // each), 0
            if full < times:
                part = n - full * each
            left = times - full - bool(part)
            pieces = [(each, full), (part, 1 if part else 0), (0, left if i is not None else 0)]
            for c, k in pieces:
                if k:
                    runs.runs.append([gap - c * s, contents + Counter({s: c}) if c else contents, k])
                    insort(gaps, (gap - c * s, len(runs.runs) - 1))
            if i is not None:
                runs.runs[i][2] = 0
            n -= full * each + part
            at = _first(gaps, s)


def _first(gaps: list[tuple[int, int]], s: int) -> int:
    lo, hi = 0, len(gaps)
    while lo < hi:
        mid = (lo + hi) // 2
        if gaps[mid][0] < s:
            lo = mid + 1
        else:
            hi = mid
    return lo


def lookup(planned: list[tuple[dict[int, int], int]], first: int) -> tuple[np.ndarray, ...]:
    """The plan by (size, rank from): arrays of size, rank, container of that rank, texts of this size a container."""
    rows, at, seen = [], first, Counter()
    for contents, times in planned:
        for s, c in contents.items():
            rows.append((s, seen[s], at, c))
            seen[s] += c * times
        at += times
    rows.sort()
    return tuple(np.array(x, np.int64) for x in zip(*rows)) if rows else tuple(np.empty(0, np.int64) for _ in range(4))


def ranked(items: DataFrame, most: int) -> DataFrame:
    """items (.., part, size) with ``rank`` from 0 within the size, every size spread over tasks by hash."""
    salts = max(8, -(-most // RANKED_ROWS))
    salted = items.withColumn("salt", F.pmod(F.xxhash64("doc_id", "part"), F.lit(salts)).cast("int"))
    w = Window.partitionBy("size", "salt").orderBy("doc_id", "part")
    inner = salted.withColumn("_n", F.row_number().over(w) - 1)
    before = Window.partitionBy("size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    sizes = salted.groupBy("size", "salt").agg(F.count("*").alias("c")).withColumn("_from", F.coalesce(F.sum("c").over(before), F.lit(0))).drop("c")
    return inner.join(sizes, ["size", "salt"]).withColumn("rank", F.col("_from") + F.col("_n")).drop("_from", "_n", "salt")


def fill(sizes: DataFrame, capacity: int, groups: int = GROUPS) -> DataFrame:
    """sizes (doc_id, n_tokens), stored -> (doc_id, part, container, first_token, n_tokens).

    A text within the capacity is whole (part 0). A longer one is divided into full containers of its own and a last
    part, which is packed like a text. Null sizes count as 0; texts without tokens go to a container that
    is there anyway. No two rows share tokens, none is left out. doc_id should be unique.
    """
    if capacity < 1:
        raise ValueError("a container must hold a token")
    n = F.coalesce("n_tokens", F.lit(0)).cast("bigint")
    s = sizes.select("doc_id", n.alias("n"))
    full = F.when(F.col("n") > capacity, F.floor(F.col("n") / capacity)).otherwise(0)
    tail = F.col("n") - F.col("full") * capacity
    s = s.withColumn("full", full)
    items = s.filter((tail > 0) | (F.col("full") == 0)).select("doc_id", F.col("full").cast("int").alias("part"), tail.alias("size"))
    # at most capacity + 1 rows come to the driver
    counts = {r["size"]: r["count"] for r in items.groupBy("size").count().toLocalIterator()}
    planned = plan(counts, capacity, groups)
    by_size, by_rank, at, each = lookup(planned, 0)
    used = sum(times for _, times in planned)
    big = 1 << 40
    keys = by_size * big + by_rank

    def assign(batches):
        for b in batches:
            size, rank = b.column(2).to_numpy(), b.column(3).to_numpy()
            i = np.searchsorted(keys, size * big + rank, "right") - 1
            container = at[i] + (rank - by_rank[i]) // each[i]
            first = b.column(1).to_numpy().astype(np.int64) * capacity
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(container), pa.array(first), b.column(2)], names=["doc_id", "part", "container", "first_token", "n_tokens"])

    kind = sizes.schema["doc_id"].dataType.simpleString()
    packed = ranked(items, max(counts.values(), default=0)).select("doc_id", "part", F.col("size"), F.col("rank").cast("bigint"))
    packed = packed.mapInArrow(assign, f"doc_id {kind}, part int, container bigint, first_token bigint, n_tokens bigint")
    # containers of divided texts are numbered behind the others: by prefix sums over salted ranks
    divided = s.filter("full > 0").select("doc_id", F.lit(0).alias("part"), F.col("full").alias("size"))
    rows = divided.select("doc_id", F.explode(F.sequence(F.lit(0), F.col("size").cast("int") - 1)).alias("part"))
    rows = ranked(rows.withColumn("size", F.lit(0)), divided.agg(F.sum("size")).head()[0] or 0)
    whole = rows.select("doc_id", "part", (F.col("rank") + used).alias("container"), (F.col("part").cast("bigint") * capacity).alias("first_token"), F.lit(capacity).cast("bigint").alias("n_tokens"))
    return packed.unionByName(whole)


def containers(docs: DataFrame, limits: DataFrame, path: str) -> DataFrame:
    """(limit_name, doc_id, part, container, first_token, n_tokens) for every container limit in tokens.

    ``limits`` (limit_name, unit, capacity) is a table of a few rows. Texts are sized once for all of them.
    """
    sizes = materialize(count_tokens(docs, path), "sizes")
    out = None
    for r in limits.filter("unit = 'token' and capacity > 0").select("limit_name", "capacity").orderBy("limit_name").collect():
        one = fill(sizes, r.capacity).select(F.lit(r.limit_name).alias("limit_name"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        out = fill(sizes, 1).select(F.lit("").alias("limit_name"), "*").limit(0)
    return out


def fill_rates(packed: DataFrame) -> DataFrame:
    """(limit_name, containers, tokens, mean_tokens): how full the containers are on average."""
    each = packed.groupBy("limit_name", "container").agg(F.sum("n_tokens").alias("n"))
    return each.groupBy("limit_name").agg(F.count("*").alias("containers"), F.sum("n").alias("tokens"), F.avg("n").alias("mean_tokens"))
