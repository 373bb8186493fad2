"""Files of a folder as tables: listings without content, contents behind gates, and versioned tables of the index."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.functions import names
from siltstone.functions.extract import extracted
from siltstone.session import path_exists


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """(path, name, size, modified, kind) of all files below a folder that are not empty; contents are not opened."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    return f.select("path", name.alias("name"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"), names.kind_of(name).alias("kind"))


def contents(spark: SparkSession, folder: str) -> DataFrame:
    """(path, kind, verdict, content) of the files whose kind is known: the content of those that pass the gates, else null."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    kind = names.kind_of(F.regexp_extract("path", r"([^/]*)$", 1))
    f = f.select("path", kind.alias("kind"), F.col("length").alias("size"), "content").filter("kind > 0")
    verdict = names.gate(F.lit(0), F.col("size"), F.col("kind"))
    f = f.withColumn("verdict", verdict).withColumn("content", F.when(F.col("verdict") == "open", F.col("content")))
    found = names.magic_kind(F.col("content"), F.col("kind"))
    return f.select("path", F.coalesce(found, F.col("kind")).alias("kind"), "verdict", "content")


def texts(spark: SparkSession, folder: str) -> DataFrame:
    """(path, status, text) of the files that pass the gates, read by the kind their bytes tell."""
    return extracted(contents(spark, folder).filter("verdict = 'open'"), "path", "kind", "content")


def save_table(df: DataFrame, root: str, identity: dict) -> int:
    """Write a table as a new generation with its identity; returns the generation. Readers see it once it is whole."""
    spark = df.sparkSession
    n = (_last(spark, root) or 0) + 1
    df.write.mode("overwrite").parquet(f"{root}/gen={n}/data")
    spark.createDataFrame([(json.dumps(identity, sort_keys=True),)], "identity string").coalesce(1).write.mode("overwrite").parquet(f"{root}/gen={n}/identity")
    return n


def load_table(spark: SparkSession, root: str, identity: dict | None = None) -> DataFrame | None:
    """The newest whole generation; None without one, or where its identity is not the one asked for."""
    n = _last(spark, root)
    if n is None:
        return None
    stored = json.loads(spark.read.parquet(f"{root}/gen={n}/identity").head()[0])
    return spark.read.parquet(f"{root}/gen={n}/data") if identity is None or stored == identity else None


def _last(spark: SparkSession, root: str) -> int | None:
    if not path_exists(spark, root):
        return None
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    found = [re.fullmatch(r"gen=(\d+)", s.getPath().getName()) for s in fs.listStatus(p)]
    whole = [int(m[1]) for m in found if m and path_exists(spark, f"{root}/{m[0]}/identity/_SUCCESS")]
    return max(whole, default=None)
