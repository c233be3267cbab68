"""Row numbers for keys of any size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.shared import materialise


def numbered(rows: DataFrame, keys: list[str], order: list[str], name: str = "rn") -> DataFrame:
    """rows with their number from 1 within their key (no nulls in it), by `order`. Rows are
    dealt by ranges of key and order, so a key that holds most rows lies in many tasks; a
    row's number is its place in its task, less the place of the task's first row of the key,
    plus what earlier tasks hold of it. Only keys at the edges of tasks need the last part:
    two a task at most."""
    placed = rows.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = materialise(placed.withColumns({"part__": F.spark_partition_id(), "at__": F.monotonically_increasing_id()}), "numbered")
    counts = placed.groupBy("part__", *keys).agg(F.min("at__").alias("first__"), F.count("*").alias("n__"))
    wide = counts.groupBy(*keys).agg(F.count("*").alias("parts__")).where("parts__ > 1").select(*keys)
    before = F.sum("n__").over(W.partitionBy(*keys).orderBy("part__").rowsBetween(W.unboundedPreceding, -1))
    offsets = counts.join(wide, keys, "left_semi").select("part__", *keys, F.coalesce(before, F.lit(0)).alias("before__"))
    start = counts.join(offsets, ["part__", *keys], "left").select("part__", *keys, (F.col("first__") - F.coalesce("before__", F.lit(0)) - 1).alias("start__"))
    return placed.join(start, ["part__", *keys]).withColumn(name, F.col("at__") - F.col("start__")).select(*rows.columns, name)
