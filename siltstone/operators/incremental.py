"""Processing only new or changed records.

Log-based change capture. The log is an append-only table; each row has a log partition, the run it is first offered to
and an offset. Offsets rise in order of arrival among the rows of one partition and run, so a row that is late by its run is still
ahead of what was read; nothing is assumed of offsets across runs, whose writers may number their rows by themselves. A run first
writes a *batch plan* (per partition and offering run: offsets from, exclusive, to, inclusive) ahead of any work.
Plans whose run did not commit are replayed, with their very ranges, by the next run. The sink keeps,
for each key, the greatest record image (position, then fingerprint) it has applied; a record at or below that
image is a repeat and changes nothing, so replays and redelivered rows are harmless. A batch's folder in the sink counts only
when it is complete, and a replay overwrites it: there is no partly applied batch.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, LongType, StructField, StructType

from siltstone.session import delete_path, path_exists


@dataclass(frozen=True)
class CaptureSpec:
    key: tuple[str, ...] = ("volume_id", "frn")
    position: tuple[str, ...] = ("usn", "extractor_ver")
    fingerprint: tuple[str, ...] = ("content_hash_lo", "content_hash_hi", "extractor_ver")
    must_have: tuple[str, ...] = ("content_hash_lo", "content_hash_hi")
    partition: str = "volume_id"
    batch: str = "run_id"
    offset: str = "scan_id"


class ChangeCapture:
    """State under ``root``: wal/<run> (batch plans) and sink/batch=<run> (what each committed run applied).

    Defined cases: rows without a key, without a position's first column, without batch or offset are not
    records and are ignored; unreadable rows (a null in ``must_have``) are passed over, their offsets count
    as consumed; equal positions with unlike fingerprints resolve to the greater fingerprint; nulls inside
    a fingerprint are values. An empty log gives an empty batch. Columns outside the spec are never read.
    """

    def __init__(self, spark: SparkSession, root: str, base: DataFrame, log: DataFrame, spec: CaptureSpec = CaptureSpec()):
        self.spark, self.root, self.spec = spark, root.rstrip("/"), spec
        known = [F.col(c).isNotNull() for c in (*spec.key, spec.position[0])]
        need = list(dict.fromkeys((*spec.key, *spec.position, *spec.fingerprint)))
        self.base = base.select(need)
        for k in known:
            self.base = self.base.filter(k)
        self.log = log.select(list(dict.fromkeys((spec.partition, spec.batch, spec.offset, *need))))
        # known schemas spare a job for each read of the state
        of = lambda c, df: df.schema[c].dataType
        offset = of(spec.offset, self.log)
        self._plan_schema = StructType([StructField("part", of(spec.partition, self.log)), StructField("offered", of(spec.batch, self.log)), StructField("after", offset), StructField("upto", offset), StructField("planned_by", LongType())])
        image = dict.fromkeys((*spec.key, *spec.position, *spec.fingerprint))
        self._sink_schema = StructType([*[StructField(c, of(c, self.log)) for c in image], StructField("changed", BooleanType()), StructField("batch", LongType())])

    # -- the write-ahead log ------------------------------------------------------------------------
    def _plan_path(self, run: int) -> str:
        return f"{self.root}/wal/{run:012d}"

    def _batch_path(self, run: int) -> str:
        return f"{self.root}/sink/batch={run}"

    def _done(self, path: str) -> bool:
        return path_exists(self.spark, f"{path}/_SUCCESS")

    def _numbers(self, sub: str) -> list[int]:
        jvm, path = self.spark.sparkContext._jvm, f"{self.root}/{sub}"
        if not path_exists(self.spark, path):
            return []
        p = jvm.org.apache.hadoop.fs.Path(path)
        fs = p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        names = [s.getPath().getName().split("=")[-1] for s in fs.listStatus(p)]
        return sorted(int(n) for n in names if n.isdigit() and self._done(f"{path}/{'batch=' if sub == 'sink' else ''}{n}"))

    def committed(self) -> list[int]:
        return self._numbers("sink")

    def plan(self, run: int) -> str:
        """Write the batch plan of a run, unless it is written already; returns its path."""
        path = self._plan_path(run)
        if self._done(path):
            return path
        s = self.spec
        planned = [n for n in self._numbers("wal") if n < run]
        rows = self.log.filter((F.col(s.batch) <= run) & F.col(s.offset).isNotNull())
        head = rows.groupBy(F.col(s.partition).alias("part"), F.col(s.batch).alias("offered")).agg(F.max(s.offset).alias("upto"))
        if planned:
            last = self._plans(planned).groupBy("part", "offered").agg(F.max("upto").alias("after"))
            head = head.join(last, head.part.eqNullSafe(last.part) & (head.offered == last.offered), "left").select(head.part, head.offered, "after", "upto")
        else:
            head = head.withColumn("after", F.lit(None).cast(head.schema["upto"].dataType))
        head = head.filter("after is null or upto > after")
        head.select("part", "offered", "after", "upto", F.lit(run).cast("long").alias("planned_by")).coalesce(1).write.mode("overwrite").parquet(path)
        return path

    def _plans(self, runs: list[int]) -> DataFrame:
        return self.spark.read.schema(self._plan_schema).parquet(*map(self._plan_path, runs))

    def pending(self) -> list[int]:
        done = self.committed()
        return [n for n in self._numbers("wal") if not done or n > done[-1]]

    # -- processing ---------------------------------------------------------------------------------
    def _batch(self, plans: list[int]) -> DataFrame:
        """The rows of the plans' ranges; the scan gets the range of offering runs and, where all of them were read before, of offsets."""
        s = self.spec
        # two plans not committed may have ranges of one partition and run, one after the other: a row lies in one of them at most
        plan = self._plans(plans)
        least = plan.agg(F.min("offered").alias("first"), F.max("offered").alias("last"), F.min("after").alias("least"), F.count_if(F.col("after").isNull()).alias("new")).head()
        rows = self.log.filter(F.col(s.batch).between(least.first, least.last))
        if least.least is not None and not least.new:
            rows = rows.filter(F.col(s.offset) > least.least)
        at = F.col(s.offset)
        rows = rows.join(plan, F.col(s.partition).eqNullSafe(F.col("part")) & (F.col(s.batch) == F.col("offered")) & (at <= F.col("upto")) & (F.col("after").isNull() | (at > F.col("after"))), "inner")
        for c in (*s.key, s.position[0], *s.must_have):
            rows = rows.filter(F.col(c).isNotNull())
        return rows

    def _image(self) -> F.Column:
        s = self.spec
        return F.struct(*[F.col(c) for c in dict.fromkeys((*s.position, *s.fingerprint))])

    def _applied(self) -> DataFrame:
        """The rows of the committed batches; what a crash left of others is not read."""
        return self.spark.read.schema(self._sink_schema).option("basePath", f"{self.root}/sink").parquet(*map(self._batch_path, self.committed()))

    def _known(self) -> DataFrame:
        return self.base.unionByName(self._applied().select(self.base.columns)) if self.committed() else self.base

    def commit(self, run: int) -> DataFrame:
        """Process the plans not yet committed, this run's included; returns the files it must process."""
        s, keys = self.spec, list(self.spec.key)
        self.plan(run)
        plans = [n for n in self.pending() if n <= run]
        if plans:
            new = self._batch(plans).groupBy(keys).agg(F.max(self._image()).alias("new"))
            known = self._known()
            # only the keys of this batch: the known state is reduced before it is shuffled
            old = known.join(new.select(keys), keys, "left_semi").groupBy(keys).agg(F.max(self._image()).alias("old"))
            both = new.join(old, keys, "left")
            same = F.lit(True)
            for c in s.fingerprint:
                same = same & F.col(f"new.{c}").eqNullSafe(F.col(f"old.{c}"))
            both.filter(F.col("old").isNull() | (F.col("new") > F.col("old"))).select(*keys, "new.*", (F.col("old").isNull() | ~same).alias("changed")).write.mode("overwrite").parquet(self._batch_path(run))
        return self.changes(run)

    def changes(self, run: int | None = None) -> DataFrame:
        """(batch, key..., image...) of committed runs."""
        df = self._applied().filter("changed")
        return df if run is None else df.filter(F.col("batch") == run)

    def state(self) -> DataFrame:
        """The current record of every key."""
        known = self._known()
        return known.groupBy(list(self.spec.key)).agg(F.max(self._image()).alias("r")).select(*self.spec.key, "r.*")

    def forget(self) -> None:
        delete_path(self.spark, self.root)


def replay_runs(cap: ChangeCapture, runs: DataFrame) -> DataFrame:
    """Take the runs in order: each writes its plan; one that does not end well leaves only that behind.

    ``runs`` (run_id, status) is the tool's own list of runs, a control table with a row per run.
    Returns (run_id, key...) for the ok runs.
    """
    s = cap.spec
    oks = []
    for r in runs.filter(F.col("run_id").isNotNull()).select("run_id", "status").orderBy("run_id").toLocalIterator():
        if r.status == "ok":
            cap.commit(r.run_id)
            oks.append(r.run_id)
        else:
            cap.plan(r.run_id)
    if not oks:
        return cap.base.limit(0).select(F.lit(0).alias("run_id"), *s.key)
    return cap.changes().select(F.col("batch").cast("int").alias("run_id"), *s.key)
