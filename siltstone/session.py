"""Session settings, table loading and the shared folder for materialised intermediate tables."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: int = 8, app: str = "siltstone", memory: str = "8g", shuffle: int | None = None) -> SparkSession:
    """A session for one machine; on a cluster the caller brings its own."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle or cpus))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A scan of fewer partitions than half the cores, dealt out to all of them: for heavy work on small inputs."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() * 2 >= cores else df.repartition(cores)


def shared_dir(spark: SparkSession) -> str:
    """A folder of this application in the one that all executors share: spark.checkpoint.dir where the cluster names it.

    Only where that is unset and the session runs on one machine, as in tests, a folder of our own is made there. Either is
    removed at the end of the session.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    made = _made.get(spark.sparkContext.applicationId)
    if made is None:
        if root:
            made = f"{root.rstrip('/')}/siltstone-{spark.sparkContext.applicationId}"
        elif spark.sparkContext.master.startswith("local") and "cluster" not in spark.sparkContext.master:
            made = f"file://{tempfile.mkdtemp(prefix='siltstone-')}"
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        _made[spark.sparkContext.applicationId] = made
        atexit.register(_remove, spark, made)
    return made


_made: dict[str, str] = {}


def _remove(spark: SparkSession, made: str) -> None:
    try:
        if made.startswith("file:///"):
            shutil.rmtree(made.removeprefix("file://"), True)
        else:
            delete_path(spark, made)
    except Exception:  # the session has ended before us: its folder is the cluster's to clear
        pass


def fresh_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str, by: list[str] | None = None) -> DataFrame:
    """Cut the lineage by a table written to the shared folder; survives the loss of any executor."""
    path = fresh_path(df.sparkSession, label)
    (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def path_exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def delete_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
