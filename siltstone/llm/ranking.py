"""One ranking out of scores of different scales.

Each score is standardised within its query by median and median absolute deviation, which outliers do not
move, squashed by the logistic function into (0, 1), and the bounded values are combined by a weighted
geometric mean, so that none of them rules by its range.

Medians are exact and no query is gathered in one task: equal values are counted first, a bounded sketch cuts
each query's values into slices, and only the slice that holds the middle is ordered.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize

SLICES = 32
LIMIT = 4.0  # standard deviations beyond which a value counts no further
WEIGHTS = {"words": 1.0, "meaning": 1.0, "penalty": 1.0}
MAD_TO_SD, MEAN_TO_SD = 1.4826, 1.2533


def medians(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """(keys, median, total): the exact median of x by group; the mean of the middle two for even numbers.

    Null values do not count; a group without values has no row.
    """
    counts = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).alias("x")).agg(F.count("*").alias("n"))
    cuts = F.percentile_approx("x", [i / SLICES for i in range(1, SLICES)], F.lit(4 * SLICES))
    bounds = counts.groupBy(*keys).agg(F.sum("n").alias("total"), cuts.alias("cuts"))
    sliced = counts.join(bounds, keys).withColumn("slice", F.size(F.filter("cuts", lambda c: c < F.col("x")))).drop("cuts")
    sizes = sliced.groupBy(*keys, "slice").agg(F.sum("n").alias("size"), F.max("total").alias("total"))
    w = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("below", F.coalesce(F.sum("size").over(w), F.lit(0)))
    lo, hi = F.floor((F.col("total") - 1) / 2), F.floor(F.col("total") / 2)
    holds = lambda at, below, size: (below <= at) & (at < below + size)
    middle = sizes.filter(holds(lo, F.col("below"), F.col("size")) | holds(hi, F.col("below"), F.col("size")))
    rows = sliced.select(*keys, "slice", "x", "n").join(middle.select(*keys, "slice", "below", "total"), [*keys, "slice"])
    v = Window.partitionBy(*keys, "slice").orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("from", F.col("below") + F.coalesce(F.sum("n").over(v), F.lit(0)))
    at_lo, at_hi = (F.max(F.when(holds(p, F.col("from"), F.col("n")), F.col("x"))) for p in (lo, hi))
    return rows.groupBy(*keys).agg(((at_lo + at_hi) / 2).alias("median"), F.max("total").alias("total"))


def standardised(df: DataFrame, keys: list[str], x: str) -> DataFrame:
    """df with z: (x - median) / (1.4826 MAD), between -LIMIT and LIMIT.

    Where more than half of the values are equal the mean absolute deviation takes the place of the MAD; where all are
    equal z is 0. A null x has a null z.
    """
    df = df.join(medians(df, keys, x).select(*keys, "median"), keys, "left")
    df = materialize(df.withColumn("_off", F.abs(F.col(x) - F.col("median"))), "deviations")
    mad = medians(df, keys, "_off").select(*keys, F.col("median").alias("_mad"))
    mean = df.groupBy(*keys).agg(F.avg("_off").alias("_mean"))
    df = df.join(mad.join(mean, keys), keys, "left")
    scale = F.when(F.col("_mad") > 0, F.col("_mad") * MAD_TO_SD).otherwise(F.col("_mean") * MEAN_TO_SD)
    z = F.when(scale > 0, (F.col(x) - F.col("median")) / scale).when(F.col(x).isNotNull(), 0.0)
    bounded = F.greatest(F.lit(-LIMIT), F.least(F.lit(LIMIT), z))  # these two pass over nulls
    return df.withColumn("z", F.when(z.isNotNull(), bounded)).drop("_off", "_mad", "_mean", "median")


def squash(z: Column) -> Column:
    return 1.0 / (1.0 + F.exp(-z))


def signals(hits: DataFrame, neighbors: DataFrame, chunks: DataFrame, docs: DataFrame) -> DataFrame:
    """(query_id, doc_id, signal, x), higher is better, one row per document and signal.

    Repeated rows count once, by their best score; a document stands by its best chunk. Null and NaN scores
    are as good as missing, but their document is still a document of the query. Rows without
    query, document or a known chunk take no part; an unknown penalty is none.
    """
    clean = lambda c: F.when(~F.isnan(c), F.col(c).cast("double"))
    words = hits.select("query_id", "doc_id", clean("score").alias("score")).dropna(subset=["query_id", "doc_id"])
    words = words.groupBy("query_id", "doc_id").agg((-F.min("score")).alias("x"))
    near = neighbors.select("query_id", "chunk_id", clean("score").alias("score")).dropna(subset=["query_id", "chunk_id"])
    near = near.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    near = near.join(chunks.select("chunk_id", "doc_id").dropna().dropDuplicates(["chunk_id"]), "chunk_id")
    near = near.groupBy("query_id", "doc_id").agg(F.max("score").alias("x"))
    both = words.withColumn("signal", F.lit("words")).unionByName(near.withColumn("signal", F.lit("meaning")))
    known = docs.filter("doc_id is not null").groupBy("doc_id").agg(F.max("rank_penalty").alias("p"))
    all_docs = both.select("query_id", "doc_id").distinct().join(known, "doc_id", "left")
    return both.unionByName(all_docs.select("query_id", "doc_id", (-F.coalesce("p", F.lit(0.0))).alias("x"), F.lit("penalty").alias("signal")))


def combined_ranking(hits: DataFrame, neighbors: DataFrame, chunks: DataFrame, docs: DataFrame, weights: dict[str, float] = WEIGHTS) -> DataFrame:
    """(query_id, doc_id, score): score in (0, 1), higher is better.

    A document missing from a list, or with a positive penalty, has the least value on that score. Empty
    tables give an empty result.
    """
    rows = materialize(signals(hits, neighbors, chunks, docs), "signals")  # read by each median
    z = standardised(rows, ["query_id", "signal"], "x")
    poor = F.col("z").isNull() | ((F.col("signal") == "penalty") & (F.col("x") < 0))
    value = F.when(poor, squash(F.lit(-LIMIT))).otherwise(squash(F.col("z")))
    weight = F.lit(None).cast("double")
    for name, w in weights.items():
        weight = F.when(F.col("signal") == name, F.lit(float(w))).otherwise(weight)
    rows = z.select("query_id", "doc_id", F.log(value).alias("l"), weight.alias("w"))
    sums = rows.groupBy("query_id", "doc_id").agg(F.sum(F.col("l") * F.col("w")).alias("sum"), F.sum("w").alias("has"))
    total = float(sum(weights.values()))
    return sums.select("query_id", "doc_id", F.exp((F.col("sum") + (total - F.col("has")) * F.log(squash(F.lit(-LIMIT)))) / total).alias("score"))


def top(ranking: DataFrame, k: int) -> DataFrame:
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc("doc_id"))
    return ranking.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)
