"""The stream of the journal against the batch, across restarts and replays."""

from pyspark.sql import functions as F

from siltstone.operators.changes import change_effects, current_table
from siltstone.streaming.journal import JournalTable, follow, journal_source, needs_full_scan

D = "/root/testdata/sf0.001"


def tables(spark):
    return tuple(spark.read.parquet(f"{D}/{t}.parquet") for t in ("journal_entry", "snapshot_entry", "snapshot_header"))


def rows(df):
    return sorted(map(str, df.select("volume_id", "frn", "parent_frn", "name", "attributes").collect()))


def test_stream_equals_batch(spark, tmp_path):
    journal, snapshot, header = tables(spark)
    source = tmp_path / "in"
    journal.repartition(5, "entry_id").write.parquet(str(source))
    table = JournalTable(spark, str(tmp_path / "table"), snapshot, header)
    for _ in range(2):  # the second start finds nothing new
        follow(table, journal_source(spark, str(source), journal.schema, 2), str(tmp_path / "check")).awaitTermination()
    want = current_table(journal, snapshot, header)
    assert rows(table.living()) == rows(want)
    # a batch played again changes nothing
    table.apply(journal.limit(0), table._generations()[-1])
    assert rows(JournalTable(spark, str(tmp_path / "table"), snapshot, header).living()) == rows(want)


def test_when_a_journal_can_not_be_followed():
    assert not needs_full_scan(7, 100, 7, 50, 200)
    for case in ((None, 1, 1, 1, 1), (7, 100, 8, 50, 200), (7, 10, 7, 50, 200), (7, 300, 7, 50, 200), (7, 100, None, None, None)):
        assert needs_full_scan(*case)


ENTRY = "entry_id bigint, volume_id bigint, usn bigint, frn bigint, parent_frn bigint, attributes int, name string, reason bigint, gone string"
SNAP, HEAD = "slot bigint, volume_id bigint, frn bigint, parent_frn bigint, attributes int, name string", "volume_id bigint, next_usn bigint"


def test_defined_cases_of_changes(spark):
    entries = [
        (1, 1, 5, 7, 1, 32, "before the snapshot", 512, "x"), (2, 1, 10, 7, 1, 32, "b", 0, None), (3, 1, 10, 7, 1, 32, "again", 0, None), (4, 1, 11, 7, 1, None, "b", None, None),
        (6, 1, 20, 8, 1, 32, None, 512, None), (5, 1, 19, 8, 1, 32, "new", 0, None), (7, 1, 30, 8, 1, 32, "new", 256, None), (8, 1, 31, 9, 1, 32, "never lived", 512, None),
        (9, None, 1, 1, 1, 1, "n", 0, None), (10, 1, None, 1, 1, 1, "n", 0, None), (11, 1, 40, None, 1, 1, "n", 0, None), (12, 2, 1, 3, None, 16, None, 0, None)]
    j, s, h = spark.createDataFrame(entries, ENTRY), spark.createDataFrame([(1, 1, 7, 1, 32, "a"), (0, 1, 1, 1, 16, "."), (4, 1, 7, 1, 32, "twice")], SNAP), spark.createDataFrame([(1, 10)], HEAD)
    for rounds in (1, 2, 5):
        got = sorted(map(tuple, change_effects(j, s, h, rounds).collect()))
        assert got == [(1, 10, "updated"), (1, 19, "created"), (1, 20, "deleted"), (1, 30, "created"), (2, 1, "created")]
        state = {(r.volume_id, r.frn): (r.parent_frn, r.name, r.attributes) for r in current_table(j, s, h, rounds).collect()}
        assert state == {(1, 1): (1, ".", 16), (1, 7): (1, "b", None), (1, 8): (1, "new", 32), (2, 3): (None, None, 16)}


def test_empty_tables(spark):
    j, s, h = spark.createDataFrame([], ENTRY), spark.createDataFrame([], SNAP), spark.createDataFrame([], HEAD)
    assert change_effects(j, s, h).count() == 0 and current_table(j, s, h).count() == 0


def test_a_hot_file(spark):
    j = spark.range(3000).select(
        F.col("id").alias("entry_id"), F.lit(1).cast("bigint").alias("volume_id"), F.col("id").alias("usn"), F.when(F.col("id") % 3 == 0, 5).otherwise(F.col("id") + 100).cast("bigint").alias("frn"),
        F.lit(1).cast("bigint").alias("parent_frn"), F.lit(32).alias("attributes"), F.col("id").cast("string").alias("name"), F.when(F.col("id") % 6 == 0, 512).otherwise(0).cast("bigint").alias("reason"))
    got = change_effects(j, spark.createDataFrame([], SNAP), spark.createDataFrame([], HEAD), 3).filter("usn % 3 = 0").groupBy("effect").count().collect()
    assert {r.effect: r["count"] for r in got} == {"created": 500, "deleted": 499}
