"""Exact search over unit vectors of 8-bit numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NEVER = -(1 << 62)
SCALE = 127  # fixed value: of the 8-bit numbers


def normalized(v: Column) -> Column:
    """The vector at length 1, as floats; an all-zero vector stays as it is."""
    size = F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    return F.when(size > 0, F.transform(v, lambda x: (x.cast("double") / size).cast("float"))).otherwise(v)


def quantized(v: Column) -> Column:
    """Floats as 8-bit numbers: times 127, rounded half away from zero, within -127 and 127."""
    half = lambda x: F.when(x >= 0, F.lit(0.5)).otherwise(F.lit(-0.5)).cast("float")
    near = lambda x: (x * F.lit(float(SCALE)).cast("float") + half(x)).cast("int")
    return F.transform(v, lambda x: F.greatest(F.lit(-SCALE), F.least(F.lit(SCALE), near(x))).cast("tinyint"))


def top_k(vectors: DataFrame, asked: DataFrame, k: int, block: int = 1024) -> DataFrame:
    """(query_id, vec_id, dot, rank from 1): the k stored vectors with the greatest integer product for each query.

    vectors and asked: (vec_id, q array<tinyint>) of one length; a vector is not its own answer. Queries go out in blocks, and
    every batch of vectors gives its k best for each of them before anything is shuffled. Ties go to the smaller id.
    """
    out = None
    part: list = []

    def one(part: list) -> DataFrame:
        ids, m = np.array([r.vec_id for r in part]), np.array([r.q for r in part], np.int64)

        def run(batches):
            for b in batches:
                rows = b.column(0).to_numpy()
                if not len(rows):
                    continue
                x = b.column(1).flatten().to_numpy().reshape(len(rows), -1).astype(np.int64)
                dot = (m.astype(np.float64) @ x.T.astype(np.float64)).astype(np.int64)
                dot[ids[:, None] == rows[None, :]] = NEVER
                order = np.lexsort((np.broadcast_to(rows, dot.shape), -dot), axis=1)[:, : min(k, len(rows))]
                keep = np.take_along_axis(dot, order, 1) > NEVER
                i = np.repeat(np.arange(len(ids)), order.shape[1]).reshape(order.shape)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i[keep]]), pa.array(rows[order[keep]]), pa.array(np.take_along_axis(dot, order, 1)[keep])], names=["query_id", "vec_id", "dot"])

        return vectors.select("vec_id", "q").mapInArrow(run, "query_id bigint, vec_id bigint, dot bigint")

    for r in asked.select("vec_id", "q").toLocalIterator():
        part.append(r)
        if len(part) == block:
            out = one(part) if out is None else out.unionByName(one(part))
            part = []
    if part or out is None:
        last = one(part) if part else vectors.select(F.col("vec_id").alias("query_id"), "vec_id", F.lit(0).cast("bigint").alias("dot")).limit(0)
        out = last if out is None else out.unionByName(last)
    w = Window.partitionBy("query_id").orderBy(F.desc("dot"), F.asc("vec_id"))
    return out.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def evaluation(ranked: DataFrame, labels: DataFrame, asked: DataFrame) -> DataFrame:
    """One row: mrr within the ranks given, and the mean share of relevant ones (equal label) in the first five."""
    q = asked.select(F.col("vec_id").alias("query_id"), F.col("label").alias("want"))
    r = ranked.join(q, "query_id").join(labels.select("vec_id", "label"), "vec_id")
    hit = F.col("label") == F.col("want")
    per = r.groupBy("query_id").agg(F.min(F.when(hit, F.col("rank"))).alias("first"), F.count_if(hit & (F.col("rank") <= 5)).alias("good"))
    per = q.join(per, "query_id", "left")
    return per.agg(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"), F.avg(F.coalesce("good", F.lit(0)) / 5).alias("p5"), F.count("*").alias("queries"))
