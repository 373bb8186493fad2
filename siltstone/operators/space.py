"""Where space goes: duplicates in stages, trees that tools fill, the largest files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from siltstone.functions import fixed, names
from siltstone.operators.hierarchy import descendants


def size_groups(files: DataFrame, floor: int) -> DataFrame:
    """(size, members, reclaimable) of the sizes from ``floor`` on that several files have; each file (volume_id, frn) counts once."""
    f = files.filter(F.col("size") >= floor).select("volume_id", "frn", "size").distinct()
    g = f.groupBy("size").agg(F.count("*").alias("members")).filter("members > 1")
    return g.withColumn("reclaimable", F.col("size") * (F.col("members") - 1))


def within_budget(groups: DataFrame, budget: int) -> DataFrame:
    """Whole groups, the most reclaimable first, up to the one that would pass the budget of files.

    A group has at least two files, so at most half as many groups as files are ordered in one task.
    """
    order = [F.desc("reclaimable"), F.desc("size")]
    first = groups.orderBy(*order).limit(budget // 2 + 1)
    w = Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return first.withColumn("files_so_far", F.sum("members").over(w)).filter(F.col("files_so_far") <= budget)


def edge_fingerprint(content: Column) -> Column:
    """A hash of the first and last bytes and the size."""
    size, edge = F.octet_length(content).cast("bigint"), fixed.EDGE_BYTES
    tail = F.least(F.greatest(size - edge, F.lit(0)), F.lit(edge)).cast("int")
    last = F.substring(content, F.greatest(size - tail + 1, F.lit(1)).cast("int"), tail)
    return F.sha2(F.concat(F.substring(content, 1, edge), last, F.encode(size.cast("string"), "UTF-8")), 256)


def exact_duplicates(files: DataFrame, content: str, id_col: str) -> DataFrame:
    """(hash, size, members, first_id, reclaimable) of equal contents, found by size, then edges, then all bytes.

    Each stage looks only at files that share what the stage before found. Empty and null contents are no duplicates.
    """
    size = F.octet_length(content).cast("bigint")
    f = files.select(id_col, content, size.alias("size")).filter("size > 0")
    shared = f.groupBy("size").count().filter("count > 1").select("size")
    f = f.join(shared, "size", "left_semi").withColumn("edge", edge_fingerprint(F.col(content)))
    alike = f.groupBy("size", "edge").count().filter("count > 1").select("size", "edge")
    f = f.join(alike, ["size", "edge"], "left_semi").select(id_col, "size", F.sha2(content, 256).alias("hash"))
    g = f.groupBy("hash", "size").agg(F.count("*").alias("members"), F.min(id_col).alias("first_id")).filter("members > 1")
    return g.withColumn("reclaimable", F.col("size") * (F.col("members") - 1))


def keepers(files: DataFrame, group: str) -> DataFrame:
    """One file of each group: no tool's output before one, not in a passing place, the shallowest, the oldest, the smallest id."""
    p = F.lower("path")
    order = [names.contains_any(p, fixed.BUILT), names.contains_any(p, fixed.TRANSIT), F.size(F.split("path", r"\\")), F.coalesce("mtime", F.to_timestamp(F.lit("1601-01-01"))), F.col("doc_id")]
    w = Window.partitionBy(group).orderBy(*order)
    return files.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def concentration(files: DataFrame, tops: list[int] = fixed.CONCENTRATION) -> DataFrame:
    """(top, bytes, share) of the largest files; only as many rows as the greatest top are ordered."""
    total = files.agg(F.sum("size").alias("all"))
    w = Window.orderBy(F.desc("size"), F.asc("id"))
    first = files.select("size", "id").orderBy(F.desc("size"), F.asc("id")).limit(max(tops)).withColumn("n", F.row_number().over(w))
    rows = first.select("size", F.explode(F.filter(F.array(*[F.lit(t) for t in tops]), lambda t: t >= F.col("n"))).alias("top"))
    got = rows.groupBy("top").agg(F.sum("size").alias("bytes"))
    return got.crossJoin(F.broadcast(total)).select("top", "bytes", (F.col("bytes") / F.col("all")).alias("share"))  # one row


def generated_trees(found: DataFrame, nodes: DataFrame, patterns: list[tuple[str, str | None, int]] = fixed.GENERATED) -> DataFrame:
    """(volume_id, frn, files): the outermost folders that tools fill, and the number of files below each.

    found: hierarchy() of nodes (volume_id, frn, name, attributes), chains included. A folder matches by its own name and, where
    the pattern says so, its parent's; one below another match is part of that. Trees without files are left out.
    """
    chain = F.transform("chain", lambda s: F.lower(s["name"]))
    own, above = F.get("low", F.size("low") - 1), F.get("low", F.size("low") - 2)
    f = found.filter("fault is null and depth > 0").withColumn("low", chain).join(nodes.select("volume_id", "frn", "attributes"), ["volume_id", "frn"])
    folder = F.coalesce(F.col("attributes"), F.lit(0)).bitwiseAND(F.lit(fixed.DIRECTORY)) != 0
    plain = F.coalesce(F.col("attributes"), F.lit(0)).bitwiseAND(F.lit(fixed.REPARSE)) == 0
    test = names.any_of([(own == leaf) & (F.lit(True) if under is None else F.coalesce(above == under, F.lit(False))) for leaf, under, _ in patterns])
    marked = f.filter(folder & plain & test).select("volume_id", "frn")
    pairs = descendants(found)
    inner = pairs.join(marked.withColumnRenamed("frn", "ancestor_frn"), ["volume_id", "ancestor_frn"], "left_semi").select("volume_id", "frn").distinct()
    outer = marked.join(inner, ["volume_id", "frn"], "left_anti")
    files = f.filter(~folder).select("volume_id", "frn")
    below = pairs.join(outer.withColumnRenamed("frn", "ancestor_frn"), ["volume_id", "ancestor_frn"], "left_semi").join(files, ["volume_id", "frn"], "left_semi")
    return below.groupBy("volume_id", F.col("ancestor_frn").alias("frn")).agg(F.count("*").alias("files"))
