"""Fusing ranked lists by weighted reciprocal rank, and preferring what satisfies a query's filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.functions.names import extension


def meaning_votes(neighbors: DataFrame, chunks: DataFrame, penalties: DataFrame, by: list[str], floor: float = fixed.COSINE_FLOOR) -> DataFrame:
    """(by.., doc_id, chunk_id, rank): the documents that the nearest passages vote for.

    Of each query's first MEANING_CHUNKS passages those at least as similar as the floor vote, each document once by its best,
    documents with a penalty not at all; at most MEANING_VOTES votes, ranked from 0 among those accepted.
    """
    order = [F.desc("score"), F.asc("chunk_id")]
    w = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    near = neighbors.dropna(subset=["score", "chunk_id"]).groupBy(*by, "chunk_id").agg(F.max("score").alias("score"))
    near = near.withColumn("n", F.row_number().over(w)).filter(F.col("n") <= fixed.MEANING_CHUNKS).filter(F.col("score") >= floor)
    votes = near.join(chunks.select("chunk_id", "doc_id"), "chunk_id").join(penalties.select("doc_id", "rank_penalty"), "doc_id", "left")
    votes = votes.filter(F.coalesce("rank_penalty", F.lit(0.0)) <= 0)
    v = Window.partitionBy(*by, "doc_id").orderBy(*order)
    votes = votes.withColumn("m", F.row_number().over(v)).filter("m = 1")
    u = Window.partitionBy(*by).orderBy(*order) if by else Window.orderBy(*order)
    votes = votes.withColumn("rank", F.row_number().over(u) - 1).filter(F.col("rank") < fixed.MEANING_VOTES)
    return votes.select(*by, "doc_id", "chunk_id", "rank")


def fuse(lists: dict[str, tuple[DataFrame, float]], by: list[str]) -> DataFrame:
    """(by.., doc_id, fused, in_.. per list): the sum of weight / (RRF_K + rank) over the lists, ranks from 0."""
    parts = [df.select(*by, "doc_id", (F.lit(w) / (fixed.RRF_K + F.col("rank"))).alias("v"), F.lit(n).alias("list")) for n, (df, w) in lists.items()]
    rows = reduce(DataFrame.unionByName, parts)
    flags = [F.max(F.col("list") == n).alias(f"in_{n}") for n in lists]
    return rows.groupBy(*by, "doc_id").agg(F.sum("v").alias("fused"), *flags)


def satisfied(path: Column, mtime: Column, extensions: list[str], folder: str, after, before) -> Column:
    """How many of a query's filters (extensions, folder, time) a file satisfies; unknown times satisfy none."""
    one = lambda c: F.when(c, 1).otherwise(0)
    out = F.lit(0)
    if extensions:
        out = out + one(extension(path).isin(extensions))
    if folder:
        out = out + one(F.contains(F.lower(path), F.lit(folder)))
    if after is not None or before is not None:
        test = mtime.isNotNull()
        if after is not None:
            test = test & (mtime >= F.lit(after))
        if before is not None:
            test = test & (mtime < F.lit(before))
        out = out + one(test)
    return out


def boosted(fused: Column, filters_met: Column) -> Column:
    """Filters add to a score and never take a row away."""
    return fused + filters_met * fixed.FILTER_BOOST
