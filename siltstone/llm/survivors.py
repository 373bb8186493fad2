"""The best representative of each group of duplicates.

Records are ranked by trust and recency for each field and by completeness and recency for the group, each
time by a window whose order ends in a unique id; only the head of each window is kept, so Spark cuts every
map task's rows to one per group before it shuffles (WindowGroupLimit) and no group is gathered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: what scanners write into a text field that they cannot fill
PLACEHOLDERS = ["", "-", "--", "?", "n/a", "na", "nil", "none", "(none)", "null", "(null)", "unknown", "(unknown)", "undefined", "untitled", "tbd"]
EPOCH_TICKS = 116444736000000000
FIELDS = ("mtime", "owner", "title")


def fingerprint(c: str | Column) -> Column:
    """The 32 hex digits of a fingerprint in any scanner's spelling; null if it does not hold them."""
    bare = F.regexp_replace(F.lower(F.trim(F.regexp_replace(c, r"\s+", ""))), r"^0x|[{}()\-:]", "")
    return F.when(bare.rlike("^[0-9a-f]{32}$"), bare)


def said(c: str | Column) -> Column:
    """A text that says something, blanks around it removed; null for blanks and placeholders."""
    t = F.regexp_replace(c, r"^[\s ]+|[\s ]+$", "")
    return F.when(~F.lower(t).isin(PLACEHOLDERS), t)


def ticks(c: str | Column) -> Column:
    """A timestamp as 100 ns ticks since 1601."""
    return F.unix_micros(F.col(c).cast("timestamp") if isinstance(c, str) else c) * 10 + EPOCH_TICKS


def head(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    w = Window.partitionBy(*by).orderBy(*order)
    return df.withColumn("_nth", F.row_number().over(w)).filter("_nth = 1").drop("_nth")


def duplicate_members(candidate: DataFrame) -> DataFrame:
    """(size, fp, slot): one row per file (volume_id, frn) of each set of equal size and fingerprint.

    Rows that are not ok, or lack slot, size, a readable fingerprint or a part of the file's key, take no
    part. A file's names in one set count once, by the smallest slot. Sets with one file are left out.
    """
    c = candidate.select("slot", "volume_id", "frn", "size", fingerprint("print").alias("fp")).filter
    rows = c(F.col("ok")).dropna(subset=["slot", "volume_id", "frn", "size", "fp"])
    files = rows.groupBy("size", "fp", "volume_id", "frn").agg(F.min("slot").alias("slot"))
    sets = files.groupBy("size", "fp").agg(F.min("slot").alias("group_slot"), F.count("*").alias("members")).filter("members > 1")
    return files.join(sets, ["size", "fp"]).select("size", "fp", "slot", "group_slot", "members")


def best_facts(facts: DataFrame, trust: DataFrame) -> DataFrame:
    """(slot, mtime, owner, title): each field from the most trusted collector that knows it.

    At equal trust the one seen last counts, then the greatest fact_id. Collectors without a trust come last,
    as do facts without seen_at; a mtime is known if positive and, where seen_at is known, not later than it.
    """
    rank = trust.dropna(subset=["collector"]).groupBy("collector").agg(F.max("trust").alias("trust"))
    f = facts.select("fact_id", "slot", "mtime", "owner", "title", "collector", "seen_at").filter("slot is not null")
    seen = ticks("seen_at")
    mtime = F.when((F.col("mtime") > 0) & (seen.isNull() | (F.col("mtime") <= seen)), F.col("mtime"))
    f = f.select("fact_id", "slot", "collector", seen.alias("seen"), F.explode(F.array(
        F.struct(F.lit("mtime").alias("field"), mtime.cast("string").alias("value")),
        F.struct(F.lit("owner").alias("field"), said("owner").alias("value")),
        F.struct(F.lit("title").alias("field"), said("title").alias("value")))).alias("f"))
    f = f.select("fact_id", "slot", "collector", "seen", "f.*").filter("value is not null")
    f = f.join(rank, "collector", "left")
    order = [F.col("trust").desc_nulls_last(), F.col("seen").desc_nulls_last(), F.col("fact_id").desc_nulls_last(), F.col("value").desc()]
    known = head(f, ["slot", "field"], order)
    pick = [F.max(F.when(F.col("field") == n, F.col("value"))).alias(n) for n in FIELDS]
    return known.groupBy("slot").agg(*pick).withColumn("mtime", F.col("mtime").cast("bigint"))


def survivors(candidate: DataFrame, facts: DataFrame, trust: DataFrame) -> DataFrame:
    """(group_slot, keep_slot, members, mtime, owner, title): the surviving record of each duplicate set.

    It is the member with most known fields, then the latest mtime (unknown is earliest), then the
    smallest slot; its fields are those of best_facts(). group_slot is the set's smallest slot. Empty tables
    give an empty result; columns other than those named are not read.
    """
    members = duplicate_members(candidate)
    wanted = facts.join(members.select("slot").distinct(), "slot", "left_semi")
    m = members.join(best_facts(wanted, trust), "slot", "left")
    known = sum((F.col(n).isNotNull().cast("int") for n in FIELDS), F.lit(0))
    best = head(m.withColumn("known", known), ["size", "fp"], [F.desc("known"), F.col("mtime").desc_nulls_last(), F.asc("slot")])
    return best.select("group_slot", F.col("slot").alias("keep_slot"), "members", *FIELDS)
