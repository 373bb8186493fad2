"""Full-text search over postings: phrases joined by AND, BM25, and documents out of passages.

Postings of the query's terms are picked before anything is shuffled, and put together by passage once; phrases, frequencies and
scores follow within that partitioning. Corpus figures are two aggregates of one row.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fixed
from siltstone.functions.stems import stems
from siltstone.functions.text import tokens
from siltstone.session import materialize, spread


def postings(passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, term, pos) of every token; null texts have none."""
    return spread(passages.select(id_col, text_col)).select(id_col, F.posexplode(F.filter(tokens(F.col(text_col)), lambda t: t != "")).alias("pos", "term")).select(id_col, "term", "pos")


def lengths(passages: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, dl): the number of tokens of every passage."""
    return passages.select(id_col, F.size(F.filter(F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")), lambda t: t != "")).alias("dl"))


def prepared(passages: DataFrame, wanted: list[list[str]], id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """postings() of the query's terms only, and lengths() of all passages, out of one pass over the texts, stored."""
    terms = sorted({t for p in wanted for t in p})
    t = F.filter(F.coalesce(tokens(F.col(text_col)), F.array().cast("array<string>")), lambda x: x != "")
    spots = F.filter(F.transform("t", lambda x, i: F.struct(x.alias("term"), i.alias("pos"))), lambda s: s["term"].isin(terms) if terms else F.lit(False))
    # the length stands beside the tokens so that they are made once
    one = materialize(spread(passages.select(id_col, text_col)).select(id_col, t.alias("t")).select(id_col, F.size("t").alias("dl"), spots.alias("spots")), "prepared")
    index = one.filter("size(spots) > 0").select(id_col, F.explode("spots").alias("s")).select(id_col, "s.term", "s.pos")
    return index, one.select(id_col, "dl")


def split_query(query: str) -> list[str]:
    """Terms of a query: "quoted phrases" whole, other parts split at blanks, those without a token character dropped."""
    parts = [a or b for a, b in re.findall(r'"([^"]*)"?|([^\s"][^\s]*)', query)]
    return [p for p in parts if re.search(r"[A-Za-z0-9_]|[^\x00-\xbf]", p)]


def phrases(spark, query: str) -> list[list[str]]:
    """The folded tokens of each term, by the same expression as the index."""
    terms = split_query(query)
    if not terms:
        return []
    row = spark.range(1).select(*[tokens(F.lit(t)).alias(f"t{i}") for i, t in enumerate(terms)]).head()
    return [[t for t in row[i] if t] for i in range(len(terms)) if row[i]]


def with_stems(index: DataFrame) -> DataFrame:
    """The postings and, at the same places, the stems of their terms; each distinct term is stemmed once."""

    def run(batches):
        for b in batches:
            pairs = [(t, s) for t in b.column(0).to_pylist() for s in stems(t)]
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], names=["term", "stem"])

    found = index.select("term").distinct().mapInArrow(run, "term string, stem string")
    beside = index.join(found, "term").withColumn("term", F.col("stem")).select(index.columns)
    return index.unionByName(beside).distinct()


def alternatives(wanted: list[list[str]]) -> list[list[tuple[str, ...]]]:
    """Each word of a query with its stems, any of which will do at its place."""
    return [[(t, *stems(t)) for t in p] for p in wanted]


def matches(index: DataFrame, wanted: list[list], id_col: str = "doc_id") -> DataFrame:
    """(id, phrase, tf) of the passages that hold every phrase as a sequence; without phrases nothing matches.

    A place of a phrase is a term or a tuple of alternatives.
    """
    places = [(i, j, a) for i, p in enumerate(wanted) for j, t in enumerate(p) for a in ((t,) if isinstance(t, str) else t)]
    if not places:
        return index.select(id_col, F.lit(0).alias("phrase"), F.lit(0).cast("bigint").alias("tf")).limit(0)
    hit = index.filter(F.col("term").isin(sorted({t for _, _, t in places}))).repartition(id_col)
    spots = F.filter(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j"), F.lit(t).alias("t")) for i, j, t in places]), lambda s: s["t"] == F.col("term"))
    rows = hit.select(id_col, "pos", F.explode(spots).alias("s")).select(id_col, F.col("s.i").alias("phrase"), F.col("s.j").alias("j"), (F.col("pos") - F.col("s.j")).alias("base"))
    size = F.lit(0)
    for i, p in enumerate(wanted):
        size = F.when(F.col("phrase") == i, len(p)).otherwise(size)
    whole = rows.groupBy(id_col, "phrase", "base").agg(F.count_distinct("j").alias("n")).filter(F.col("n") == size)
    tf = whole.groupBy(id_col, "phrase").agg(F.count("*").alias("tf"))
    every = tf.groupBy(id_col).agg(F.count("*").alias("n")).filter(F.col("n") == len(wanted)).select(id_col)
    return tf.join(every, id_col, "left_semi")


def bm25(found: DataFrame, frequencies: DataFrame, sizes: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(id, score), lower is better. found: matches(); frequencies (phrase, n): passages with each phrase; sizes: lengths()."""
    k1, b = fixed.BM25_K1, fixed.BM25_B
    corpus = sizes.agg(F.count("*").alias("total"), F.avg("dl").alias("avgdl"))
    rows = found.join(sizes, id_col).join(F.broadcast(frequencies), "phrase").crossJoin(F.broadcast(corpus))  # one row
    idf = F.greatest(F.lit(fixed.BM25_IDF_FLOOR), F.log((F.col("total") - F.col("n") + 0.5) / (F.col("n") + 0.5)))
    part = idf * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    return rows.groupBy(id_col).agg((-F.sum(part)).alias("score"))


def phrase_frequencies(index: DataFrame, wanted: list[list[str]], id_col: str = "doc_id") -> DataFrame:
    """(phrase, n): in how many passages each phrase stands by itself; a row per phrase of the query."""
    out = None
    for i, p in enumerate(wanted):
        one = matches(index, [p], id_col).agg(F.count("*").alias("n")).select(F.lit(i).alias("phrase"), "n")
        out = one if out is None else out.unionByName(one)
    return out


def scored(index: DataFrame, sizes: DataFrame, wanted: list[list[str]], id_col: str = "doc_id") -> DataFrame:
    if not wanted:
        return sizes.select(id_col, F.lit(0.0).alias("score")).limit(0)
    return bm25(matches(index, wanted, id_col), phrase_frequencies(index, wanted, id_col), sizes, id_col)


def documents(passages: DataFrame, penalties: DataFrame, limit: int | None = fixed.CONTENT_ROWS) -> DataFrame:
    """(doc_id, score, passages, best_chunk_id) out of scored passages (chunk_id, doc_id, score), best first.

    The best passage's score, plus the penalty (0 where unknown), less a bonus for further passages, of which at most
    PASSAGE_CAP count. Ties go to the smaller ids.
    """
    best = F.min(F.struct("score", "chunk_id"))
    d = passages.groupBy("doc_id").agg(best.alias("b"), F.least(F.lit(fixed.PASSAGE_CAP), F.count("*")).alias("passages"))
    d = d.join(penalties.select("doc_id", "rank_penalty"), "doc_id", "left")
    score = F.col("b.score") + F.coalesce("rank_penalty", F.lit(0.0)) - fixed.PASSAGE_WEIGHT * F.log1p(F.col("passages"))
    d = d.select("doc_id", score.alias("score"), "passages", F.col("b.chunk_id").alias("best_chunk_id"))
    return d.orderBy("score", "doc_id").limit(limit) if limit else d


def ranked(df: DataFrame, order: list, k: int) -> DataFrame:
    """The first k rows by the order, with ``rank`` from 0; only they are ordered in one task."""
    return df.orderBy(*order).limit(k).withColumn("rank", F.row_number().over(Window.orderBy(*order)) - 1)
