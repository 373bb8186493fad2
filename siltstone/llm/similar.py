"""The most similar vectors of every vector, by cosine, within one store.

Unit vectors are turned by a random rotation and kept as one bit per dimension with a correction scalar. A query vector, turned
alike and rounded to four bits, gets an estimate of its inner product with every coded vector of a list from
bit counts alone, with a bound of the estimate's error; only vectors whose bound reaches the k-th best, or the least
similarity asked for, are ranked by their true cosine, computed from the stored numbers.

Lists come from an index: centres are a bounded sample of the vectors, every vector stands in the list of its nearest centre,
and looks through the lists of its ``probes`` nearest ones. As centres are sampled, dense regions have more of
them. Lists longer than a block, and a query set that is held against all rows, are worked on in blocks.

Equal vectors are one group in all of this. A member's most similar vectors are then the first of its own group and
of the groups found, so a group with a third of all vectors costs no more than its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize

LIST_ROWS, MOST_CENTRES = 512, 4096  # aim of a list's length; bound of the sample a store's index is fitted on
PROBES = 8
BLOCK_ROWS, BLOCK_QUERIES = 32768, 16384
BITS, SIGMAS = 4, 3.0  # of a rounded query; width of the error bound
SEED = 20240917


def rotation(dims: int) -> np.ndarray:
    """A random orthogonal matrix, the same everywhere."""
    q, r = np.linalg.qr(np.random.default_rng([SEED, dims]).standard_normal((dims, dims)))
    return (q * np.sign(np.diag(r))).astype(np.float32)


def _words(bits: np.ndarray) -> np.ndarray:
    packed = np.packbits(bits, axis=1, bitorder="little")
    full = np.zeros((len(packed), -(-packed.shape[1] // 8) * 8), np.uint8)
    full[:, : packed.shape[1]] = packed
    return full.view("<u8")


def codes(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words of sign bits, <code, vector> as the correction scalar) of unit vectors."""
    t = unit @ rotation(unit.shape[1]).T
    return _words(t > 0), np.abs(t).sum(1) / np.sqrt(unit.shape[1])


def estimates(unit: np.ndarray, words: np.ndarray, fit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Estimated cosines of queries (rows) with coded vectors (columns), and the error bound of each."""
    d = unit.shape[1]
    t = unit @ rotation(d).T
    low = t.min(1, keepdims=True)
    step = np.maximum((t.max(1, keepdims=True) - low) / (2**BITS - 1), 1e-12)
    rounded = np.rint((t - low) / step).astype(np.uint8)
    ones = np.bitwise_count(words).sum(1, dtype=np.int32)
    inner = np.zeros((len(unit), len(words)), np.int32)
    for bit in range(BITS):
        plane = _words((rounded >> bit) & 1)
        for w in range(words.shape[1]):
            inner += np.bitwise_count(plane[:, None, w] & words[None, :, w]).astype(np.int32) << bit
    along = (2 * (step * inner + low * ones) - (step * rounded.sum(1, keepdims=True, dtype=np.int32) + d * low)) / np.sqrt(d)
    spread = np.sqrt(np.maximum(1 - fit**2, 0)) * (SIGMAS / np.sqrt(max(d - 1, 1)))
    return along / fit, (spread + step * (SIGMAS / np.sqrt(12))) / fit


def nearest(queries: np.ndarray, words: np.ndarray, fit: np.ndarray, rows: np.ndarray, k: int, least: float, rows_at_once: int = 1 << 22) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(query, row, cosine) of pairs whose error bound leaves them a place among a query's k best and above ``least``.

    queries and rows hold the stored numbers (int64), words and fit the codes of rows.
    """
    squares = (rows * rows).sum(1)
    block = max(1, rows_at_once // max(len(rows), 1))
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        own = (q * q).sum(1)
        est, err = estimates((q / np.sqrt(own)[:, None]).astype(np.float32), words, fit)
        floor = np.full((len(q), 1), least, np.float64)
        if least < 0.5 and len(rows) > k + 1:  # one more than k: a query may be met by itself
            floor = np.maximum(floor, np.partition(est - err, len(rows) - k - 1, axis=1)[:, [len(rows) - k - 1]])
        i, j = np.nonzero(est + err >= floor)
        dot = np.empty(len(i), np.float64)
        for s in range(0, len(i), 1 << 18):
            dot[s : s + (1 << 18)] = np.einsum("ij,ij->i", q[i[s : s + (1 << 18)]], rows[j[s : s + (1 << 18)]])
        cos = dot / np.sqrt(own[i].astype(np.float64) * squares[j])
        keep = cos >= least - 1e-12
        yield i[keep] + at, j[keep], cos[keep]


def sound_vectors(vectors: DataFrame, headers: DataFrame) -> DataFrame:
    """(store_id, chunk_id, vec) of the vectors as long as their store's dimensions, without nulls, not all zero.

    Repeated rows count once. A store without a header has no sound vectors; of several headers the latest version counts.
    """
    h = headers.filter("store_id is not null and dimensions > 0").groupBy("store_id").agg(F.max_by("dimensions", F.struct("version", "dimensions")).alias("dims"))
    v = vectors.select("store_id", "chunk_id", "vec").dropna()
    v = v.join(F.broadcast(h), "store_id") if h.count() <= 100_000 else v.join(h, "store_id")
    fine = (F.size("vec") == F.col("dims")) & F.forall("vec", lambda x: x.isNotNull()) & F.exists("vec", lambda x: x != 0)
    return v.filter(fine).select("store_id", "chunk_id", "vec").distinct()


def _groups(v: DataFrame, k: int) -> DataFrame:
    """(store_id, vec, rep, ids): each distinct vector with its first k + 1 ids, cut before they are gathered."""
    w = Window.partitionBy("store_id", "vec").orderBy("chunk_id")
    few = v.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k + 1)
    g = few.groupBy("store_id", "vec").agg(F.sort_array(F.collect_list("chunk_id")).alias("ids"))
    return g.select("store_id", "vec", F.get("ids", F.lit(0)).alias("rep"), "ids")


def _centres(groups: DataFrame, list_rows: int) -> dict[int, np.ndarray]:
    """At most MOST_CENTRES unit vectors of each store, those with the least hashes; in proportion to its groups."""
    sizes = groups.groupBy("store_id").agg(F.count("*").alias("n"))
    w = Window.partitionBy("store_id").orderBy(F.xxhash64(F.lit(SEED), "rep", "vec"), "rep")
    sample = groups.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= MOST_CENTRES)
    sample = sample.join(sizes, "store_id").filter(F.col("_n") <= F.ceil(F.col("n") / list_rows)).select("store_id", "_n", "vec")
    found: dict[int, list] = {}
    for r in sample.orderBy("store_id", "_n").toLocalIterator():
        found.setdefault(r.store_id, []).append(r.vec)
    unit = {}
    for s, rows in found.items():
        x = np.array(rows, np.float32)
        unit[s] = x / np.linalg.norm(x, axis=1, keepdims=True)
    return unit


CODED = "store_id int, rep bigint, lists array<int>, code binary, fit float, vec binary"


def _coded(groups: DataFrame, centres: dict[int, np.ndarray] | None, probes: int) -> DataFrame:
    """Codes and scalars of the groups' vectors, with their nearest lists; one list without an index."""

    def run(batches):
        for b in batches:
            store, rep = b.column(0).to_numpy(), b.column(1).to_numpy()
            off = b.column(2).offsets.to_numpy()
            flat = b.column(2).values.to_numpy(zero_copy_only=False)
            for s in np.unique(store):
                at = np.flatnonzero(store == s)
                d = int(off[at[0] + 1] - off[at[0]])
                x = flat[off[at][:, None] + np.arange(d)].astype(np.int8)
                unit = x.astype(np.float32)
                unit /= np.linalg.norm(unit, axis=1, keepdims=True)
                words, fit = codes(unit)
                c = unit[:1] if centres is None else centres[int(s)]
                p = min(probes, len(c))
                near = unit @ c.T
                best = np.argpartition(-near, p - 1, axis=1)[:, :p] if p < len(c) else np.tile(np.arange(p), (len(x), 1))
                best = np.take_along_axis(best, np.lexsort((best, -np.take_along_axis(near, best, 1)), axis=1), 1)
                raw = lambda m: pa.array([r.tobytes() for r in m], pa.binary())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(x) * p + 1, p, dtype=np.int32)), pa.array(best.ravel().astype(np.int32)))
                yield pa.RecordBatch.from_arrays([pa.array(store[at], pa.int32()), pa.array(rep[at], pa.int64()), lists, raw(words), pa.array(fit, pa.float32()), raw(x)], names=["store_id", "rep", "lists", "code", "fit", "vec"])

    return groups.select("store_id", "rep", "vec").mapInArrow(run, CODED)


def _searched(k: int, least: float):
    def run(t: pa.Table) -> pa.Table:
        cols = {n: t.column(n).combine_chunks() if t.column(n).num_chunks != 1 else t.column(n).chunk(0) for n in t.column_names}
        query = cols["query"].to_numpy(zero_copy_only=False)
        rep = cols["rep"].to_numpy()
        q, m = np.flatnonzero(query), np.flatnonzero(~query)
        out = ([], [], [])
        if len(q) and len(m):
            numbers = lambda n, at, kind: np.frombuffer(b"".join(cols[n].take(pa.array(at)).to_pylist()), kind).reshape(len(at), -1)
            rows, asked = numbers("vec", m, np.int8).astype(np.int64), numbers("vec", q, np.int8).astype(np.int64)
            fit = cols["fit"].to_numpy()[m].astype(np.float64)
            for i, j, cos in nearest(asked, numbers("code", m, "<u8"), fit, rows, k, least):
                a, b = rep[q[i]], rep[m[j]]
                i, a, b, cos = (x[a != b] for x in (i, a, b, cos))
                order = np.lexsort((b, -cos, i))
                i, a, b, cos = i[order], a[order], b[order], cos[order]
                first = np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0)) if len(i) else i
                best = np.arange(len(i)) - first < k
                for o, x in zip(out, (a, b, cos)):
                    o.append(x[best])
        cat = lambda x, kind: np.concatenate(x).astype(kind) if x else np.empty(0, kind)
        a = cat(out[0], np.int64)
        return pa.table({"store_id": pa.array(np.full(len(a), cols["store_id"][0].as_py()), pa.int32()), "a": a, "b": cat(out[1], np.int64), "cos": cat(out[2], np.float64)})

    return run


def similar(vectors: DataFrame, headers: DataFrame, k: int = 5, least: float = -1.0, asked: Column | None = None, probes: int = PROBES, list_rows: int = LIST_ROWS) -> DataFrame:
    """(store_id, chunk_id, other_id, cosine, rank): the k most similar vectors of each, cosine at least ``least``.

    Ties go to the smaller id. With ``asked``, a condition on chunk_id, only those vectors are queries, and each is held
    against all rows of its store, in blocks; without it every vector is one, through the index. Vectors
    that are null, empty, of a wrong length or all zero have no row and are nobody's neighbour; empty tables give
    an empty result. The index is approximate; what it finds is ranked by true cosines.
    """
    v = materialize(sound_vectors(vectors, headers), "vectors")
    groups = materialize(_groups(v, k), "groups")
    blocks = asked is not None
    if blocks:
        wanted = v.filter(asked).select("store_id", "vec").distinct()
        sizes = groups.groupBy("store_id").count().agg(F.max("count")).head()[0] or 0
        coded = _coded(groups, None, 1)
        n = max(1, -(-sizes // BLOCK_ROWS))
        turn = F.pmod(F.xxhash64("rep"), F.lit(n)).cast("int")
        coded = materialize(coded.withColumn("home", turn), "codes")
        members = coded.withColumn("list", F.col("home"))
        queries = coded.join(wanted.join(groups, ["store_id", "vec"]).select("store_id", "rep"), ["store_id", "rep"], "left_semi")
        queries = queries.withColumn("list", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    else:
        coded = materialize(_coded(groups, _centres(groups, list_rows), probes), "codes")
        members = coded.withColumn("list", F.get("lists", F.lit(0)))
        queries = coded.withColumn("list", F.explode("lists"))
    member_sizes = members.groupBy("store_id", "list").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("m"))
    query_sizes = queries.groupBy("store_id", "list").agg(F.ceil(F.count("*") / BLOCK_QUERIES).cast("int").alias("q"))
    cut = member_sizes.join(query_sizes, ["store_id", "list"])  # at most MOST_CENTRES rows a store
    part = lambda n: F.pmod(F.xxhash64("rep", F.lit(1)), F.col(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    keep = ["store_id", "list", "rep", "code", "fit", "vec"]
    as_rows = members.select(keep).join(cut, ["store_id", "list"]).withColumn("mb", part("m")).withColumn("qb", every("q"))
    as_queries = queries.select(keep).join(cut, ["store_id", "list"]).withColumn("qb", part("q")).withColumn("mb", every("m"))
    both = as_rows.withColumn("query", F.lit(False)).unionByName(as_queries.withColumn("query", F.lit(True))).drop("m", "q")
    found = both.groupBy("store_id", "list", "mb", "qb").applyInArrow(_searched(k, least), "store_id int, a bigint, b bigint, cos double")
    found = found.distinct()
    if not blocks:  # whoever looked, both have been compared
        found = found.unionByName(found.select("store_id", F.col("b").alias("a"), F.col("a").alias("b"), "cos")).distinct()
    w = Window.partitionBy("store_id", "a").orderBy(F.desc("cos"), F.asc("b"))
    best = materialize(found.withColumn("_n", F.row_number().over(w)).filter(F.col("_n") <= k).drop("_n"), "nearest")
    # back to the members: the first ids of the own group and of those found are enough for each of them
    ids = groups.select("store_id", F.col("rep").alias("b"), "ids")
    near = best.join(ids, ["store_id", "b"]).groupBy("store_id", F.col("a").alias("rep")).agg(F.collect_list(F.struct("cos", "ids")).alias("near"))
    pair = lambda c: lambda i: F.struct((-c).alias("away"), i.alias("id"))
    others = F.flatten(F.transform("near", lambda x: F.transform(F.slice(x["ids"], 1, k), pair(x["cos"]))))
    own = F.transform("ids", pair(F.lit(1.0)))
    all_of = F.when(F.col("near").isNull(), own).otherwise(F.concat(own, others))
    g = groups.join(near, ["store_id", "rep"], "left").filter("near is not null or size(ids) > 1")
    g = g.select("store_id", "vec", F.slice(F.array_sort(all_of), 1, k + 1).alias("near"))
    each = (v.filter(asked) if blocks else v).join(g, ["store_id", "vec"])
    rest = F.slice(F.filter("near", lambda x: x["id"] != F.col("chunk_id")), 1, k)
    rows = each.select("store_id", "chunk_id", F.posexplode(rest).alias("rank", "x"))
    return rows.select("store_id", "chunk_id", F.col("x.id").alias("other_id"), (-F.col("x.away")).alias("cosine"), (F.col("rank") + 1).alias("rank"))


def pairs(found: DataFrame) -> DataFrame:
    """(chunk_a, chunk_b), chunk_a < chunk_b, once, whichever of the two has the other among its most similar."""
    return found.select(F.least("chunk_id", "other_id").alias("chunk_a"), F.greatest("chunk_id", "other_id").alias("chunk_b")).distinct()
