"""The row before and after each row in its key's order, also where one key holds a large share of all rows.

Rows are spread by ranges of (key, order), so a hot key covers many partitions; inside a partition a window
gives the neighbours, and a second window over at most two rows of each key and partition joins the partitions' ends.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from siltstone.session import materialize


def with_neighbours(df: DataFrame, keys: list[str], order: list[str], carry: list[str], label: str = "ordered") -> DataFrame:
    """df with ``prev``, a struct of the columns ``carry`` of the row before it (null for the first), and ``last``.

    Nulls in a key group together, nulls in the order come first. (keys, order) should be unique; among equal rows the
    order is any. df must not have columns named _pid, prev or last.
    """
    ranged = df.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id())
    ranged = materialize(ranged, label)
    was = F.struct(*carry)
    w = Window.partitionBy("_pid", *keys).orderBy(*order)
    rows = ranged.withColumn("prev", F.lag(was).over(w)).withColumn("last", F.lead(F.lit(1)).over(w).isNull())
    ends = rows.filter("prev is null or last").withColumn("_first", F.col("prev").isNull())
    v = Window.partitionBy(*keys).orderBy(*order)
    before, nothing_after = F.lag(was).over(v), F.lead(F.lit(1)).over(v).isNull()
    ends = ends.withColumn("_before", before).withColumn("_end", nothing_after)
    # the row before an end is in the same partition, unless this is the partition's first of its key
    ends = ends.withColumn("prev", F.when(F.col("_first"), F.col("_before")).otherwise(F.col("prev"))).withColumn("last", F.col("_end"))
    inner = rows.filter("prev is not null and not last")
    return ends.drop("_first", "_before", "_end", "_pid").unionByName(inner.drop("_pid"))
