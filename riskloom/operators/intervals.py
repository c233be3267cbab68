"""Joins and merges of line intervals. Every join has an equality on the file (or
another key) and keeps the interval condition as a residual, so none is a product."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator
from heapq import heappop, heappush

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from riskloom.shared import materialise


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column, slack: int = 2) -> Column:
    """Whether two ranges, widened by slack and cut at line 1, touch."""
    low = lambda s, e: F.greatest(F.lit(1), F.least(s, e) - slack)
    high = lambda s, e: F.greatest(s, e) + slack
    return (low(a_start, a_end) <= high(b_start, b_end)) & (low(b_start, b_end) <= high(a_start, a_end))


def point_in_interval(points: DataFrame, intervals: DataFrame, key: list[str], point: str, start: str, end: str, order: str, take: list[str], point_id: list[str]) -> DataFrame:
    """points with the first interval (by `order`) of the same key that holds the point, null where none does."""
    inside = points.join(intervals, key).where((F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end)))
    best = inside.groupBy(*point_id).agg(F.min_by(F.struct(*take), order).alias("hit__"))
    return points.join(best, point_id, "left").select(*points.columns, *[F.col(f"hit__.{c}").alias(c) for c in take])


def bucketed_point_in_interval(points: DataFrame, intervals: DataFrame, point: str, start: str, end: str, order: str, take: list[str], point_id: list[str], width: int) -> DataFrame:
    """As point_in_interval for one large key: both sides meet in buckets of `width`, an interval in each that it touches."""
    left = points.withColumn("bucket__", F.floor(F.col(point) / width))
    right = intervals.withColumn("bucket__", F.explode(F.sequence(F.floor(F.col(start) / width), F.floor(F.col(end) / width))))
    return point_in_interval(left, right, ["bucket__"], point, start, end, order, take, point_id).drop("bucket__")


def smallest_enclosing(inner: DataFrame, outer: DataFrame, key: list[str], inner_range: tuple[str, str], outer_range: tuple[str, str], ties: list[Column], take: list[str], inner_id: list[str]) -> DataFrame:
    """inner with the shortest enclosing range of the same key; `ties` settles equal lengths."""
    (a, b), (s, e) = inner_range, outer_range
    held = inner.join(outer, key).where((F.col(s) <= F.col(a)) & (F.col(e) >= F.col(b)))
    best = held.groupBy(*inner_id).agg(F.min_by(F.struct(*take), F.struct((F.col(e) - F.col(s)).alias("n"), *[t.alias(f"t{k}") for k, t in enumerate(ties)])).alias("hit__"))
    return inner.join(best, inner_id, "left").select(*inner.columns, *[F.col(f"hit__.{c}").alias(c) for c in take])


def best_overlap(left: DataFrame, right: DataFrame, key: list[str], left_range: tuple[str, str], right_range: tuple[str, str], order: str, take: list[str], left_id: list[str], unlike: Column | None = None) -> DataFrame:
    """(left_id, take, shared): for each row of left the range of the same key that shares most lines with it, the first of equals; `unlike` says which ranges count for a row."""
    (a, b), (s, e) = left_range, right_range
    shared = F.greatest(F.lit(0), F.least(F.col(b), F.col(e)) - F.greatest(F.col(a), F.col(s)) + 1)
    met = left.join(right, key)
    best = (met if unlike is None else met.where(unlike)).groupBy(*left_id).agg(F.max_by(F.struct(*take, shared.alias("shared")), F.struct(shared.alias("n"), (-F.col(order)).alias("o"))).alias("hit__"))
    return best.select(*left_id, "hit__.*")


def max_overlap(left: DataFrame, right: DataFrame, key: list[str], left_range: tuple[str, str], right_range: tuple[str, str], order: str, take: list[str], left_id: list[str]) -> DataFrame:
    """left with its best_overlap(), which is the key's first range where none shares a line."""
    return left.join(best_overlap(left, right, key, left_range, right_range, order, take, left_id), left_id, "left").select(*left.columns, *take, "shared")


def merge_intervals(ranges: DataFrame, key: list[str], start: str, end: str, gap: int = 1) -> DataFrame:
    """Islands: ranges of a key that overlap or lie within `gap` become one."""
    by = W.partitionBy(*key).orderBy(start, end)
    reach = F.max(end).over(by.rowsBetween(W.unboundedPreceding, -1))
    fresh = F.when(reach.isNull() | (F.col(start) > reach + gap), 1).otherwise(0)
    marked = ranges.withColumn("fresh__", fresh).withColumn("island__", F.sum("fresh__").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy(*key, "island__").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("n_ranges")).drop("island__")


def attach_by_index(rows: DataFrame, chunks: DataFrame, key: list[str], order: str, take: list[str]) -> DataFrame:
    """rows with the first chunk of the same key, by an equality alone."""
    first = chunks.groupBy(*key).agg(F.min_by(F.struct(*take), order).alias("hit__"))
    return rows.join(first, key, "left").select(*rows.columns, *[F.col(f"hit__.{c}").alias(c) for c in take])


def longest_prefix(rows: DataFrame, prefixes: DataFrame, path: str, prefix: str, row_id: list[str]) -> DataFrame:
    """rows with the longest folder of `prefixes` that holds their path: each path is cut into its own folders, which meet the prefixes by equality."""
    parts = F.split(F.col(path), "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    cut = rows.withColumn(prefix, F.explode(folders))
    best = cut.join(prefixes.select(prefix).distinct(), prefix).groupBy(*row_id).agg(F.max_by(prefix, F.length(prefix)).alias(prefix))
    return rows.join(best, row_id, "left")


#: Rows that a task of nested_ranges() sorts and sweeps, whatever the size of the input.
SWEPT = 200_000


def nested_ranges(ranges: DataFrame, points: DataFrame, key: list[str], kinds: tuple[int, ...] = (0, 1), rows_a_task: int = SWEPT) -> DataFrame:
    """(kind, id, inside): for each of ranges(key, id, start, end[, span, module]) its parent and
    for each of points(key, id, start, end) its innermost range, null without one; ids as texts.

    Ranges of a key come in order of start, then longest first; the innermost is the shortest
    that holds the whole of the other, of equal ones that of the smaller span, then one that is
    no module, then the first in order. One sweep a task: it holds the ranges that are open at
    the place it has come to. Rows are dealt by ranges of key and place, so a key may fill many
    tasks of about rows_a_task rows each, so more rows mean more tasks and no larger ones; a
    task begins with the open ranges of its first key, which a join with the tasks'
    first rows (one a task) gives. Crossing ranges are allowed; nested ones hold the open
    ranges of a task to the depth of the nesting."""
    name = F.to_json(F.struct(*key))
    low, high = F.least("start", "end").cast("long"), F.greatest("start", "end").cast("long")
    extra = [F.col(c).cast("long") if c in ranges.columns else F.lit(0).cast("long") for c in ("span", "module")]
    outer = ranges.select(name.alias("k"), low.alias("lo"), F.lit(0).alias("kind"), (-high).alias("neg"), extra[0].alias("span"), extra[1].alias("module"), F.col("id").cast("string").alias("id"))
    inner = points.select(name.alias("k"), low.alias("lo"), F.lit(1).alias("kind"), (-high).alias("neg"), F.lit(0).cast("long").alias("span"), F.lit(0).cast("long").alias("module"), F.col("id").cast("string").alias("id"))
    order = ["k", "lo", "kind", "neg", "span", "id"]
    n_parts = max(1, -(-(ranges.count() + points.count()) // rows_a_task))
    placed = outer.union(inner).repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    placed = materialise(placed.withColumn("part", F.spark_partition_id()), "ranges")
    starts = placed.groupBy("part").agg(F.min(F.struct("k", "lo")).alias("at")).select(F.col("part").alias("to"), "at.k", F.col("at.lo").alias("from"))
    open_ = placed.where("kind = 0").join(F.broadcast(starts), "k").where((F.col("part") < F.col("to")) & (-F.col("neg") >= F.col("from")))  # a row a task
    rows = placed.withColumn("carried", F.lit(0)).unionByName(open_.withColumn("part", F.col("to")).withColumn("carried", F.lit(-1)).select(*placed.columns, "carried"))

    def sweep(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, active, ends, n = None, [], [], 0
        for b in batches:
            out = []
            for part, carried, k, lo, kind, neg, span, module, id_ in b[["part", "carried", "k", "lo", "kind", "neg", "span", "module", "id"]].itertuples(index=False):
                if (part, k) != now:
                    now, active, ends = (part, k), [], []
                hi = -neg
                while ends and ends[0][0] < lo and not carried:
                    gone = heappop(ends)[1]
                    del active[bisect_left(active, gone)]
                if not carried and kind in kinds:
                    out.append((kind, id_, next((r[-1] for r in active if r[4] >= hi), None)))
                if kind == 0:
                    n += 1
                    row = (hi - lo, span, module, n, hi, id_)
                    insort(active, row)
                    heappush(ends, (hi, row))
            yield pd.DataFrame(out, columns=["kind", "id", "inside"])

    return rows.repartitionById(n_parts, "part").sortWithinPartitions("part", "carried", *order).mapInPandas(sweep, "kind int, id string, inside string")
