"""Packing of work under token and count budgets."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def prefix_budget(rows: DataFrame, key: list[str], order: list[Column | str], tokens: str, base: int, budget: int, soft: int = 15, hard: int = 25) -> DataFrame:
    """Rows of a key in order until the next would pass the budget or the hard cap;
    adds `position`, `prompt_tokens` after the row, and `packed`."""
    by = W.partitionBy(*key).orderBy(*order)
    total = F.lit(base) + F.sum(tokens).over(by.rowsBetween(W.unboundedPreceding, 0))
    limit = max(max(1, soft), hard)
    out = rows.withColumns({"position": F.row_number().over(by), "prompt_tokens": total})
    # a misfit ends the packing: with positive sizes all later sums are over the budget too
    return out.withColumn("packed", (F.col("prompt_tokens") <= budget) & (F.col("position") <= limit))


def packing_summary(packed: DataFrame, key: list[str], tokens: str, base: int) -> DataFrame:
    used = F.sum(F.when(F.col("packed"), F.col(tokens)).otherwise(0))
    return packed.groupBy(*key).agg(F.count_if("packed").alias("n_packed"), (F.lit(base) + used).alias("prompt_tokens"), (F.count_if("packed") < F.count("*")).alias("truncated"))


def sequential_bins(rows: DataFrame, key: list[str], order: str, tokens: str, base: int, budget: int, most: int) -> DataFrame:
    """Rows of a key in order into bins: a new bin begins where the next row would
    pass the budget or the count. Where a bin begins depends on the one before, so
    this is a walk; rows stream in sorted order and only the current sums are held."""

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, number, held, count = None, 0, base, 0
        for b in batches:
            bins = []
            for *name, n in b[[*key, tokens]].itertuples(index=False, name=None):
                if name != now:
                    now, number, held, count = name, 0, base, 0
                if count and (held + n > budget or count >= most):
                    number, held, count = number + 1, base, 0
                held, count = held + n, count + 1
                bins.append(number)
            yield b.assign(bin=bins)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.repartition(*key).sortWithinPartitions(*key, order).mapInPandas(walk, f"{fields}, bin int")


def cluster_batches(rules: DataFrame, cluster: str, order: str, size: int) -> DataFrame:
    """Rows of a cluster in batches of `size`, numbered from 0."""
    return rules.withColumn("batch", F.floor((F.row_number().over(W.partitionBy(cluster).orderBy(order)) - 1) / size).cast("int"))
