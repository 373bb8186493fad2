"""Applying a stream of inserts, updates and deletes, newest first.

The change batches are ranges of the journal's own positions (usn), volume by volume, taken from the newest to the oldest,
with about as many entries each. A key met for the first time is resolved by its newest image, or by a tombstone;
older batches are anti-joined with the resolved keys; base rows of keys that no batch touched are appended.

For the effect of every single entry the same backward pass also keeps, per resolved key, the oldest entry seen so far: its
effect is open until an older batch, or the base table, gives the image before it. Every entry has to be looked at
for that; the anti-join there moves the open end of a key to its older entry.

Within a batch a key's entries are ordered over many partitions, so one key with a third of all rows is never sorted in one task.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.operators.ordered import with_neighbours
from siltstone.session import materialize

KEY = ["volume_id", "frn"]
DELETE_FLAG = 512
ROUND_ROWS, MOST_ROUNDS = 20_000_000, 64
FEW_VOLUMES = 100_000


def _few(df: DataFrame) -> DataFrame:
    """One row per volume: broadcast where they are shown to be few."""
    return F.broadcast(df) if df.count() <= FEW_VOLUMES else df


def journal_entries(journal: DataFrame, header: DataFrame, rounds: int | None = None) -> tuple[DataFrame, int]:
    """Entries not yet in the snapshot, each once, stored by the batch (``round``) each belongs to; and the number of batches.

    Each (volume_id, usn) counts once, however often it arrives; of repeats the first to arrive (smallest entry_id) is taken.
    Rows without volume, usn or frn are no entries. A volume without a header row has no known snapshot
    position: all its entries count. A null reason is no delete.
    """
    e = journal.select(
        "volume_id", "usn", "frn", "parent_frn", "name", "attributes", "entry_id",
        (F.coalesce(F.col("reason"), F.lit(0)).bitwiseAND(DELETE_FLAG) != 0).alias("gone"),
    ).filter("volume_id is not null and usn is not null and frn is not null")
    start = _few(header.groupBy("volume_id").agg(F.max("next_usn").alias("next_usn")))
    e = e.join(start, "volume_id", "left").filter("next_usn is null or usn >= next_usn").drop("next_usn")
    if rounds is None:
        rounds = max(2, min(MOST_ROUNDS, -(-e.count() // ROUND_ROWS)))
    # bounds of the batches: a bounded sketch of each volume's positions
    cuts = F.percentile_approx("usn", [i / rounds for i in range(1, rounds)] or [0.5], F.lit(1000))
    bounds = _few(materialize(e.groupBy("volume_id").agg(cuts.alias("cuts")), "bounds"))
    e = e.join(bounds, "volume_id")
    e = e.withColumn("round", F.size(F.filter("cuts", lambda c: c < F.col("usn"))) if rounds > 1 else F.lit(0)).drop("cuts")
    image = ["frn", "parent_frn", "name", "attributes", "gone", "entry_id"]
    once = e.groupBy("round", "volume_id", "usn").agg(F.min_by(F.struct(*image), "entry_id").alias("i")).select("round", "volume_id", "usn", "i.*")
    return materialize(once, "entries", ["round"]), rounds


def base_images(snapshot: DataFrame) -> DataFrame:
    """One row per file of the saved table; should a file be there twice, the smallest slot counts."""
    s = snapshot.filter("volume_id is not null and frn is not null")
    return s.groupBy(KEY).agg(F.min(F.struct("slot", "parent_frn", "name", "attributes")).alias("b")).select(*KEY, "b.parent_frn", "b.name", "b.attributes")


def current_table(journal: DataFrame, snapshot: DataFrame, header: DataFrame, rounds: int | None = None) -> DataFrame:
    """The living files (volume_id, frn, parent_frn, name, attributes) after all changes.

    Only entries of keys that no newer batch has resolved are aggregated. Empty tables give an empty result.
    """
    entries, rounds = journal_entries(journal, header, rounds)
    image = F.max_by(F.struct("parent_frn", "name", "attributes", "gone"), F.struct("usn", -F.col("entry_id")))
    resolved: list[DataFrame] = []
    for r in reversed(range(rounds)):
        fresh = entries.filter(F.col("round") == r)
        if resolved:
            fresh = fresh.join(reduce(DataFrame.unionByName, resolved).select(KEY), KEY, "left_anti")
        resolved.append(materialize(fresh.groupBy(KEY).agg(image.alias("i")).select(*KEY, "i.*"), "resolved"))
    seen = reduce(DataFrame.unionByName, resolved)
    untouched = base_images(snapshot).join(seen.select(KEY), KEY, "left_anti")
    return seen.filter(~F.col("gone")).drop("gone").unionByName(untouched)


def _effect(gone: Column, name: Column, parent: Column, before: Column, b_gone: Column, b_name: Column, b_parent: Column) -> Column:
    """before: whether there is an image before it at all."""
    living = before & ~b_gone
    return (
        F.when(gone & living, "deleted")
        .when(~gone & ~living, "created")
        .when(~gone & living & ~(name.eqNullSafe(b_name) & parent.eqNullSafe(b_parent)), "updated")
    )


def _linked(entries: DataFrame) -> DataFrame:
    """Each entry of a batch in its key's order, with its effect where the image before it is in the batch too."""
    rows = with_neighbours(entries, KEY, ["usn"], ["gone", "name", "parent_frn"], "linked")
    c = F.col
    effect = F.when(c("prev").isNotNull(), _effect(c("gone"), c("name"), c("parent_frn"), F.lit(True), c("prev.gone"), c("prev.name"), c("prev.parent_frn")))
    return rows.select(*KEY, "usn", "parent_frn", "name", "gone", c("last").alias("newest"), c("prev").isNull().alias("oldest"), effect.alias("effect"))


def change_effects(journal: DataFrame, snapshot: DataFrame, header: DataFrame, rounds: int | None = None) -> DataFrame:
    """(volume_id, usn, effect) of the entries that change the file table.

    Names and parents are compared as they are, nulls as values: a file whose parent's number changed is updated.
    Empty tables give an empty result.
    """
    entries, rounds = journal_entries(journal, header, rounds)
    effects: list[DataFrame] = []
    opened: DataFrame | None = None
    image = [*KEY, "usn", "parent_frn", "name", "gone"]
    for r in reversed(range(rounds)):
        batch = materialize(_linked(entries.filter(F.col("round") == r).drop("round", "entry_id", "attributes")), "batch")
        effects.append(batch.filter("effect is not null").select("volume_id", "usn", "effect"))
        oldest = batch.filter("oldest").select(image)
        if opened is None:
            opened = oldest
            continue
        before = batch.filter("newest").select(*KEY, *[F.col(c).alias(f"b_{c}") for c in ("gone", "name", "parent_frn")])
        effects.append(_resolve(opened.join(before, KEY, "inner")))
        # a key stays open at its oldest entry so far
        opened = opened.join(oldest.select(KEY), KEY, "left_anti").unionByName(oldest)
        if r:
            opened = materialize(opened, "opened")
    base = base_images(snapshot).select(*KEY, F.lit(False).alias("b_gone"), F.col("name").alias("b_name"), F.col("parent_frn").alias("b_parent_frn"))
    effects.append(_resolve(opened.join(base, KEY, "left")))
    return reduce(DataFrame.unionByName, effects)


def _resolve(df: DataFrame) -> DataFrame:
    c = F.col
    e = _effect(c("gone"), c("name"), c("parent_frn"), c("b_gone").isNotNull(), F.coalesce(c("b_gone"), F.lit(True)), c("b_name"), c("b_parent_frn"))
    return df.select("volume_id", "usn", e.alias("effect")).filter("effect is not null")


def volume_counts(effects: DataFrame, header: DataFrame) -> DataFrame:
    """Numbers of created, deleted and updated entries of each volume; volumes without changes have zeros."""
    n = lambda e: F.sum(F.when(F.col("effect") == e, 1).otherwise(0)).alias(e)
    found = effects.groupBy("volume_id").agg(n("created"), n("deleted"), n("updated"))
    return header.select("volume_id").distinct().join(found, "volume_id", "full").na.fill(0, ["created", "deleted", "updated"])


def judge_stats(stats: DataFrame, journal: DataFrame, snapshot: DataFrame, header: DataFrame) -> DataFrame:
    """(stats_id, records_read, created, deleted, updated, agrees): what each logged stretch of the journal really held.

    records_read counts distinct positions from from_usn to before to_usn, those before the snapshot included; agrees is
    false where a logged figure is null or another. Stretches without a volume or a bound hold nothing.
    """
    read = journal.select("volume_id", "usn").dropna().distinct().withColumn("effect", F.lit("read"))
    rows = read.unionByName(change_effects(journal, snapshot, header))
    logged = stats.select("stats_id", "volume_id", "from_usn", "to_usn")
    logged = _few(logged) if stats.count() <= FEW_VOLUMES else logged
    n = lambda e: F.count_if(F.col("effect") == e)
    inside = [F.col("l.volume_id") == F.col("r.volume_id"), F.col("usn") >= F.col("from_usn"), F.col("usn") < F.col("to_usn")]
    found = rows.alias("r").join(logged.alias("l"), inside).groupBy("stats_id").agg(n("read").alias("records_read"), n("created").alias("created"), n("deleted").alias("deleted"), n("updated").alias("updated"))
    out = stats.select("stats_id", *[F.col(c).alias(f"said_{c}") for c in ("records_read", "created", "deleted", "updated")]).join(found, "stats_id", "left")
    out = out.na.fill(0, ["records_read", "created", "deleted", "updated"])
    agrees = reduce(lambda a, c: a & F.col(c).eqNullSafe(F.col(f"said_{c}")), ("records_read", "created", "deleted", "updated"), F.lit(True))
    return out.select("stats_id", "records_read", "created", "deleted", "updated", agrees.alias("agrees"))
