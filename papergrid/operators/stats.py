"""Statistics of boxes: character size, line distance, medians, spacing and coherence of grids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import idiv


def histogram(rows: DataFrame, keys: list[str], value: str | Column, name: str = "value") -> DataFrame:
    return rows.groupBy(*keys, (F.col(value) if isinstance(value, str) else value).alias(name)).agg(F.count(F.lit(1)).alias("n"))


def mode(rows: DataFrame, keys: list[str], value: str, first: str | None = None) -> DataFrame:
    """The most frequent value; of equals the smallest, or with ``first`` the one whose smallest ordinal comes first. Counts are summed before they are dealt."""
    counts = rows.groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(first or value).alias("__first"))
    best = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("__first")).alias("f"), F.col(value).alias("v"))).alias("b"))
    return best.select(*keys, F.col("b.v").alias("mode"), F.col("b.n").alias("n"))


def char_width(rows: DataFrame, keys: list[str], width: str) -> DataFrame:
    """The usual character width in thousandths: the mode if 1.5 times it exceeds the mean, else the mean."""
    counts = histogram(rows, keys, width, "w")
    agg = counts.groupBy(*keys).agg(F.max(F.struct("n", (-F.col("w")).alias("f"))).alias("b"), F.sum(F.col("w") * F.col("n")).alias("total"), F.sum("n").alias("boxes"))
    m = -F.col("b.f")
    return agg.select(*keys, m.cast("int").alias("mode_width"), "boxes", F.when(m * 3 * F.col("boxes") > F.col("total") * 2, m.cast("long") * 1000).otherwise(idiv(F.col("total") * 1000, F.col("boxes"))).alias("char_milli"))


def average_char_width(rows: DataFrame, keys: list[str], width: Column, chars: Column, default: int = 10) -> DataFrame:
    """Summed width over summed characters, in thousandths; ``default`` without characters."""
    agg = rows.groupBy(*keys).agg(F.sum(width).alias("w"), F.sum(chars).alias("c"))
    return agg.select(*keys, F.coalesce(idiv(F.col("w") * 1000, F.nullif(F.col("c"), F.lit(0))), F.lit(default * 1000)).cast("long").alias("char_milli"))


def row_separations(boxes: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """Per box, twice the distance of its middle to the nearest lower one that overlaps it.

    The overlap is that of x and **height**, which results depend on. The first box of
    a key is left out, as a source and as a partner, for the same reason.
    """
    by = Window.partitionBy(*keys).orderBy(ordinal)
    known = boxes.withColumn("__k", F.row_number().over(by)).where("__k > 1").select(*keys, ordinal, "x1", (F.col("x1") + F.col("y2") - F.col("y1")).alias("xh"), (F.col("y1") + F.col("y2")).alias("mid2"))
    other = known.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("x1").alias("ox1"), F.col("xh").alias("oxh"), F.col("mid2").alias("omid2"))
    lower = known.join(other, [F.col(k) == F.col(f"__{k}") for k in keys] + [(F.least("xh", "oxh") > F.greatest("x1", "ox1")) & (F.col("omid2") > F.col("mid2"))])
    return lower.groupBy(*keys, ordinal).agg((F.min("omid2") - F.first("mid2")).cast("int").alias("sep2"))


def line_separation(boxes: DataFrame, keys: list[str], ordinal: str) -> DataFrame:
    """The usual distance of lines: the most frequent odd number at or above each distance; the first seen of equals."""
    seps = row_separations(boxes, keys, ordinal).withColumn("sep", (idiv(F.col("sep2"), 4) * 2 + 1).cast("int"))
    return mode(seps, keys, "sep", ordinal).select(*keys, F.col("mode").alias("line_sep"), "n")


def grid_coherence(cells: DataFrame, keys: list[str], row: str, col: str) -> DataFrame:
    """Per grid: its upper-middle row distance and its median column width (doubled, an integer)."""
    rows = cells.groupBy(*keys, row).agg(F.min("y1").alias("top"))
    steps = rows.withColumn("d", F.lead("top").over(Window.partitionBy(*keys).orderBy(row)) - F.col("top")).where("d is not null")
    middle = steps.groupBy(*keys).agg(F.sort_array(F.collect_list("d")).alias("ds")).select(*[F.col(k).alias(f"__{k}") for k in keys], F.element_at("ds", (F.size("ds") / 2).cast("int") + 1).cast("int").alias("row_step"))
    widths = cells.groupBy(*keys, col).agg((F.min("x2") - F.max("x1")).alias("w"))
    median = widths.groupBy(*keys).agg((F.median("w") * 2).cast("int").alias("col_width2"))
    return median.join(middle, [F.col(k) == F.col(f"__{k}") for k in keys], "left").select(*keys, "row_step", "col_width2")
