"""The journal as a stream: micro-batches applied to a stored file table, each exactly once.

A batch is reduced to its newest entry per file, compared with the stored one, and written as the next generation of
the table; a pointer to the generation is put in place last and names the batch, so that a batch that is played again after a
failure finds itself done. Deleted files stay as tombstones, so that late entries do not bring them back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.operators.changes import DELETE_FLAG, KEY, base_images
from siltstone.session import delete_path, path_exists

STATE = "volume_id bigint, frn bigint, usn bigint, parent_frn bigint, name string, attributes int, gone boolean"


class JournalTable:
    """The file table under ``root``: gen=<n> folders and done/<batch> marks."""

    def __init__(self, spark: SparkSession, root: str, snapshot: DataFrame, header: DataFrame):
        self.spark, self.root, self.header = spark, root.rstrip("/"), header
        if not self._generations():
            base = base_images(snapshot).select(*KEY, F.lit(-1).cast("bigint").alias("usn"), "parent_frn", "name", "attributes", F.lit(False).alias("gone"))
            base.write.mode("overwrite").parquet(f"{self.root}/gen={-1:d}")

    def _generations(self) -> list[int]:
        if not path_exists(self.spark, self.root):
            return []
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(self.root)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n[4:]) for n in names if n.startswith("gen=") and path_exists(self.spark, f"{self.root}/{n}/_SUCCESS"))

    def current(self) -> DataFrame:
        """The stored entries of all files, tombstones included."""
        return self.spark.read.schema(STATE).parquet(f"{self.root}/gen={self._generations()[-1]}")

    def living(self) -> DataFrame:
        return self.current().filter(~F.col("gone")).drop("usn", "gone")

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """For foreachBatch. Entries before the snapshot, without a key or older than what is stored change nothing."""
        done = self._generations()
        if batch_id in done:
            return
        gone = F.coalesce(F.col("reason"), F.lit(0)).bitwiseAND(DELETE_FLAG) != 0
        e = batch.select("volume_id", "usn", "frn", "parent_frn", "name", "attributes", "entry_id", gone.alias("gone")).dropna(subset=["volume_id", "usn", "frn"])
        start = self.header.groupBy("volume_id").agg(F.max("next_usn").alias("next_usn"))
        e = e.join(start, "volume_id", "left").filter("next_usn is null or usn >= next_usn")
        image = F.struct("usn", "parent_frn", "name", "attributes", "gone")
        new = e.groupBy(KEY).agg(F.max_by(image, F.struct("usn", -F.col("entry_id"))).alias("i")).select(*KEY, "i.*")
        old = self.spark.read.schema(STATE).parquet(f"{self.root}/gen={done[-1]}")
        both = old.withColumn("n", F.lit(0)).unionByName(new.withColumn("n", F.lit(1)))
        # of equal positions the stored entry stays
        out = both.groupBy(KEY).agg(F.max_by(image, F.struct("usn", -F.col("n"))).alias("i")).select(*KEY, "i.*")
        out.write.mode("overwrite").parquet(f"{self.root}/gen={batch_id}")
        for n in done[:-1]:  # the generation before stays for readers
            delete_path(self.spark, f"{self.root}/gen={n}")


def follow(table: JournalTable, source: DataFrame, checkpoint: str, trigger: dict | None = None):
    """Start applying a stream of journal rows; by default all that is there, then stop. Where a batch starts is the checkpoint's matter."""
    return source.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def journal_source(spark: SparkSession, folder: str, schema, files_per_batch: int = 64) -> DataFrame:
    """Journal rows out of a folder that parquet files are added to."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def needs_full_scan(stored_journal: int | None, stored_usn: int | None, journal: int | None, first_usn: int | None, next_usn: int | None) -> bool:
    """Whether a journal cannot be followed from where it was left: none, another one, or the position is no longer in it."""
    if None in (stored_journal, stored_usn, journal, first_usn, next_usn):
        return True
    return stored_journal != journal or not first_usn <= stored_usn <= next_usn
