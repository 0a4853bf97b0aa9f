"""Gaps, islands and sweeps over intervals, per key (document, page or table).

All are one window pass over rows partitioned by the key; rows that can be summed
are summed before they are dealt, and several operators in a row on one key need
one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import half_even, idiv


def gap_scan(boxes: DataFrame, keys: list[str], lo: str, hi: str, min_gap: int | Column, base: Column | None = None) -> DataFrame:
    """Stretches of at least ``min_gap`` that no interval covers, between intervals of a key: first, last, centre.

    Only the farthest end of each start matters, so that is what is sorted. With
    ``base``, everything before it counts as covered (and the space after it as free).
    """
    ends = boxes.groupBy(*keys, F.col(lo).alias("__lo")).agg(F.max(hi).alias("__hi"))
    before = Window.partitionBy(*keys).orderBy("__lo").rowsBetween(Window.unboundedPreceding, -1)
    reach = F.max("__hi").over(before)
    if base is not None:
        reach = F.coalesce(F.greatest(reach, base - 1), base - 1)
    gaps = ends.withColumn("__reach", reach)
    gaps = gaps.where((F.col("__lo") - 1 - F.col("__reach")) >= min_gap)
    first, last = F.col("__reach") + 1, F.col("__lo") - 1
    return gaps.select(*keys, first.alias("first"), last.alias("last"), idiv(first + last, 2).cast("int").alias("centre"))


def column_positions(boxes: DataFrame, keys: list[str], lo: str, hi: str, min_gap: int) -> DataFrame:
    """Gap centres and both outer edges of a key: position, kind."""
    edges = boxes.groupBy(*keys).agg(F.min(lo).alias("l"), F.max(hi).alias("r"))
    edges = edges.select(*keys, F.explode(F.array(F.struct(F.col("l").alias("position"), F.lit("left").alias("kind")), F.struct(F.col("r").alias("position"), F.lit("right").alias("kind")))).alias("e")).select(*keys, "e.position", "e.kind")
    return edges.unionByName(gap_scan(boxes, keys, lo, hi, min_gap).select(*keys, F.col("centre").alias("position"), F.lit("gap").alias("kind")))


def islands(rows: DataFrame, keys: list[str], lo: str, hi: str, order: list[str], overlap: int = 0, name: str = "group_id") -> DataFrame:
    """``rows`` with the number (from 0) of the island that each is in: a new one begins where a start passes all earlier ends, less ``overlap``."""
    by = Window.partitionBy(*keys).orderBy(lo, hi, *order)
    reach = F.max(hi).over(by.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((reach - F.col(lo) <= overlap).cast("int"), F.lit(0))
    return rows.withColumn("__new", new).withColumn(name, F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int")).drop("__new")


def merged_spans(rows: DataFrame, keys: list[str], lo: str, hi: str, touching: bool = True) -> DataFrame:
    """Unions of intervals that overlap (or touch): first, last, n."""
    grouped = islands(rows, keys, lo, hi, [], -1 if touching else 0)
    return grouped.groupBy(*keys, "group_id").agg(F.min(lo).alias("first"), F.max(hi).alias("last"), F.count(F.lit(1)).alias("n"))


def close_value_groups(values: DataFrame, keys: list[str], value: str, threshold: int | Column) -> DataFrame:
    """Distinct values in groups that break where a step reaches the threshold: group_id, low, high, n, delimiter (the rounded mean)."""
    once = values.select(*keys, F.col(value).alias("__v")).distinct()
    by = Window.partitionBy(*keys).orderBy("__v")
    new = F.coalesce((F.col("__v") - F.lag("__v").over(by) >= threshold).cast("int"), F.lit(0))
    grouped = once.withColumn("__new", new).withColumn("group_id", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    mean = half_even(F.sum("__v").cast("double") / F.count(F.lit(1)))
    return grouped.groupBy(*keys, "group_id").agg(F.min("__v").alias("low"), F.max("__v").alias("high"), F.count(F.lit(1)).alias("n"), mean.alias("delimiter"))


def strips(boxes: DataFrame, keys: list[str], lo: str, hi: str) -> DataFrame:
    """The stretches between neighbouring distinct edges of a key: a, b."""
    edges = boxes.select(*keys, F.explode(F.array(lo, hi)).alias("a")).distinct()
    return edges.withColumn("b", F.lead("a").over(Window.partitionBy(*keys).orderBy("a"))).where("b is not null")


def whitespace_sweep(boxes: DataFrame, keys: list[str], min_gap: int) -> DataFrame:
    """Blank boxes between boxes: in each strip of x, the gaps of y of at least ``min_gap``; equal gaps of touching strips are one.

    Columns x1, y1, x2, y2. Strips and boxes meet on the key, the overlap is a condition of that join.
    """
    s = strips(boxes, keys, "x1", "x2")
    b = boxes.select(*[F.col(k).alias(f"__{k}") for k in keys], "x1", "y1", "x2", "y2")
    met = s.join(b, [F.col(k) == F.col(f"__{k}") for k in keys] + [(F.col("x1") < F.col("b")) & (F.col("x2") > F.col("a"))])
    gaps = gap_scan(met, [*keys, "a", "b"], "y1", "y2", min_gap)
    by = Window.partitionBy(*keys, "first", "last").orderBy("a")
    new = F.coalesce((F.lag("b").over(by) != F.col("a")).cast("int"), F.lit(0))
    runs = gaps.withColumn("__new", new).withColumn("__run", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*keys, "first", "last", "__run").agg(F.min("a").alias("x1"), F.max("b").alias("x2")).select(*keys, "x1", F.col("first").alias("y1"), "x2", F.col("last").alias("y2"))


def coverage_histogram(boxes: DataFrame, keys: list[str], at_lo: str, at_hi: str, weight: Column, name: str = "at") -> DataFrame:
    """Per pixel row (or column) that any box covers: the summed weight. Boxes of equal extent are summed before they are spread."""
    same = boxes.groupBy(*keys, at_lo, at_hi).agg(F.sum(weight).cast("long").alias("__w"))
    each = same.where(F.col(at_lo) < F.col(at_hi)).select(*keys, F.explode(F.sequence(F.col(at_lo), F.col(at_hi) - 1)).alias(name), "__w")
    return each.groupBy(*keys, name).agg(F.sum("__w").alias("weight"))


def filled_runs(histogram: DataFrame, keys: list[str], at: str = "at", tolerance: int = 0) -> DataFrame:
    """Runs of covered pixels with holes of at most ``tolerance``: first, last, weight. The run-length form of close and open."""
    by = Window.partitionBy(*keys).orderBy(at)
    new = F.coalesce((F.col(at) - F.lag(at).over(by) > tolerance + 1).cast("int"), F.lit(0))
    runs = histogram.withColumn("__new", new).withColumn("run_id", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    return runs.groupBy(*keys, "run_id").agg(F.min(at).alias("first"), F.max(at).alias("last"), F.sum("weight").cast("long").alias("weight"))


def box_runs(boxes: DataFrame, keys: list[str], lo: str, hi: str, weight: Column, tolerance: int = 0) -> DataFrame:
    """``filled_runs`` of the ``coverage_histogram`` of boxes, from the boxes: the rows do not depend on their size in pixels.

    A run of pixels is an island of boxes, and its pixels' weights sum to the boxes' weights times extents.
    """
    tall = boxes.where(F.col(lo) < F.col(hi)).withColumn("__w", weight.cast("long") * (F.col(hi) - F.col(lo)))
    runs = islands(tall, keys, lo, hi, [], -(tolerance + 1), "run_id")
    return runs.groupBy(*keys, "run_id").agg(F.min(lo).alias("first"), (F.max(hi) - 1).alias("last"), F.sum("__w").cast("long").alias("weight"))


def blank_bands(boxes: DataFrame, keys: list[str], lo: str, hi: str, min_gap: int) -> DataFrame:
    """Bands that no box touches, and the regions that they part: region_id, first, last. A band parts only if it is wide enough."""
    grouped = islands(boxes, keys, lo, hi, [], -(min_gap + 1), "region_id")
    return grouped.groupBy(*keys, "region_id").agg(F.min(lo).alias("first"), F.max(hi).alias("last"), F.count(F.lit(1)).alias("n"))
