"""The life of an index: what is to be done for each file, what is dead, what is out of date."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

KEY = ["volume_id", "frn"]


def latest_scan(scans: DataFrame) -> DataFrame:
    """One row per file: its newest observation, readable or not."""
    cols = [c for c in scans.columns if c not in KEY]
    return scans.dropna(subset=[*KEY, "usn"]).groupBy(KEY).agg(F.max_by(F.struct(*cols), F.struct("usn", "extractor_ver", "scan_id")).alias("r")).select(*KEY, "r.*")


def actions(scanned: DataFrame, stored: DataFrame) -> DataFrame:
    """(volume_id, frn, action) for the newest observations: insert, update, or a skip.

    skip_metadata: size, time and extractor are the stored ones, so the file is not opened; skip_content: hash and extractor
    are; unreadable: the hashes are null. Unknown times never equal.
    """
    old = stored.select(*KEY, *[F.col(c).alias(f"o_{c}") for c in ("size", "mtime", "extractor_ver", "content_hash_lo", "content_hash_hi")])
    j = scanned.join(old, KEY, "left")
    same = lambda *cs: F.coalesce(_all([F.col(c) == F.col(f"o_{c}") for c in cs]), F.lit(False))
    known_time = F.coalesce(F.col("mtime") > 0, F.lit(False))
    action = (
        F.when(same("size", "mtime", "extractor_ver") & known_time, "skip_metadata")
        .when(F.col("content_hash_lo").isNull() | F.col("content_hash_hi").isNull(), "unreadable")
        .when(F.col("o_extractor_ver").isNull() & F.col("o_content_hash_lo").isNull(), "insert")
        .when(same("content_hash_lo", "content_hash_hi", "extractor_ver"), "skip_content").otherwise("update")
    )
    return j.select(*KEY, action.alias("action"))


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def verdicts(stored: DataFrame, scanned: DataFrame) -> DataFrame:
    """(doc_id, verdict): whether a stored file is still what it was: missing, locked, changed or same, in this order."""
    now = scanned.select(*KEY, F.col("size").alias("n_size"), F.col("mtime").alias("n_mtime"), "content_hash_lo", F.lit(True).alias("seen"))
    j = stored.select("doc_id", *KEY, "size", "mtime").join(now, KEY, "left")
    same = F.col("size").eqNullSafe(F.col("n_size")) & F.col("mtime").eqNullSafe(F.col("n_mtime"))
    return j.select("doc_id", F.when(F.col("seen").isNull(), "missing").when(F.col("content_hash_lo").isNull(), "locked").when(same, "same").otherwise("changed").alias("verdict"))


def without(rows: DataFrame, dead: DataFrame, key: str) -> DataFrame:
    """rows but those with a dead key; all columns stay."""
    return rows.join(dead.select(key), key, "left_anti").select(rows.columns)


def vector_states(vectors: DataFrame, headers: DataFrame, chunks: DataFrame) -> DataFrame:
    """(store_id, state, vectors): how many vectors of a store can be used, by the first thing that is wrong with them."""
    h = headers.select("store_id", "dimensions")
    c = chunks.select("chunk_id", "boff")
    j = vectors.select("store_id", "chunk_id", "byte_offset", F.size("vec").alias("n")).join(F.broadcast(h), "store_id", "left").join(c, "chunk_id", "left")
    state = (
        F.when(F.col("dimensions").isNull(), "unknown_store").when(F.col("n").isNull() | (F.col("n") <= 0), "empty").when(F.col("n") != F.col("dimensions"), "wrong_length")
        .when(F.col("boff").isNull(), "no_chunk").when(~F.col("boff").eqNullSafe(F.col("byte_offset")), "moved").otherwise("usable")
    )
    return j.groupBy("store_id", state.alias("state")).agg(F.count("*").alias("vectors"))
