"""Joins of boxes with boxes and lines: every one is an equi-join on the key, with the overlap as its condition."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, apart, box, iou_over, text_inside


def prefixed(df: DataFrame, p: str) -> DataFrame:
    return df.select(*[F.col(c).alias(p + c) for c in df.columns])


def _same(keys: list[str], a: str, b: str) -> list[Column]:
    return [F.col(a + k) == F.col(b + k) for k in keys]


def overlap_join(left: DataFrame, right: DataFrame, keys: list[str], condition: Callable[[Box, Box], Column], how: str = "inner", also: Column | None = None) -> DataFrame:
    """Columns ``a_...`` and ``b_...`` of rows whose keys agree and whose boxes meet the condition."""
    on = [*_same(keys, "a_", "b_"), condition(box("a_"), box("b_"))]
    return prefixed(left, "a_").join(prefixed(right, "b_"), on + ([also] if also is not None else []), how)


def iou_pairs(objects: DataFrame, keys: list[str], ident: str, threshold: float = 0.8) -> DataFrame:
    """Pairs of a page whose intersection over union passes the threshold, each once."""
    cols = [*keys, ident, "x1", "y1", "x2", "y2"]
    return overlap_join(objects.select(cols), objects.select(cols), keys, lambda a, b: iou_over(a, b, threshold), also=F.col(f"a_{ident}") < F.col(f"b_{ident}"))


def with_any(left: DataFrame, right: DataFrame, keys: list[str], condition: Callable[[Box, Box], Column], negate: bool = False) -> DataFrame:
    """Rows of ``left`` that meet any row of ``right`` (or none): a semi-join or an anti-join."""
    r = prefixed(right, "b_")
    return left.join(r, [F.col(k) == F.col(f"b_{k}") for k in keys] + [condition(box(), box("b_"))], "left_anti" if negate else "left_semi")


def line_crosses_text(line: Box, text: Box, delta: int = 4) -> Column:
    """A level or upright line passes through a text box, by more than ``delta``; a slanted one always does."""
    level = (line.y1 > text.y1 + delta) & (line.y1 < text.y2 - delta) & (line.x1 < text.x2) & (line.x2 > text.x1)
    upright = (line.x1 > text.x1 + delta) & (line.x1 < text.x2 - delta) & (line.y1 < text.y2) & (line.y2 > text.y1)
    return F.when(line.y1 == line.y2, level).when(line.x1 == line.x2, upright).otherwise(F.lit(True))


def crosses(v: Box, h: Box, slack: int = 2) -> Column:
    """An upright line meets a level one."""
    return (v.x1 >= h.x1 - slack) & (v.x1 <= h.x2 + slack) & (h.y1 >= v.y1 - slack) & (h.y1 <= v.y2 + slack)


def edge_arrays(boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Per key the sorted distinct edges of its boxes: ``__xs``, ``__ys``; keys are named ``__key``."""
    edges = lambda a: F.sort_array(F.array_union(F.collect_set(f"{a}1"), F.collect_set(f"{a}2"))).alias(f"__{a}s")
    return boxes.groupBy(*[F.col(k).alias(f"__{k}") for k in keys]).agg(edges("x"), edges("y"))


def _on(keys: list[str]) -> list:
    return [F.col(k) == F.col(f"__{k}") for k in keys]


def spread(boxes: DataFrame, edges: DataFrame, keys: list[str], across: bool = True) -> DataFrame:
    """A row per strip of y (``__r``) and, with ``across``, of x (``__c``) that a box covers. Its edges are edges of the strips."""
    strips_of = lambda es, a, b: F.when(F.col(a) < F.col(b), F.sequence(F.array_position(es, F.col(a)).cast("int") - 1, F.array_position(es, F.col(b)).cast("int") - 2)).otherwise(F.array().cast("array<int>"))
    met = boxes.join(edges, _on(keys)).select(*boxes.columns, F.explode(strips_of("__ys", "y1", "y2")).alias("__r"), "__xs")
    return met.select(*boxes.columns, "__r", F.explode(strips_of("__xs", "x1", "x2")).alias("__c")) if across else met.drop("__xs")


def place_text(texts: DataFrame, cells: DataFrame, keys: list[str], text_id: str, share: float = 0.8, also: tuple[str, ...] = ()) -> DataFrame:
    """Each text box with the first cell, by row and column, that holds it: columns of ``texts``, row_id, col_id and the cell's columns ``also``.

    A cell that holds over half of a text box has its middle, so the two meet in the
    strips of the cells' edges: an equi-join on key and strip numbers.
    """
    once = cells.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.min(F.struct("row_id", "col_id", *also)).alias("at"))
    edges = edge_arrays(once, keys)
    mid = lambda es, a, b: F.size(F.filter(es, lambda e: e * 2 <= F.col(a) + F.col(b))) - 1
    found = texts.join(edges, [F.col(k) == F.col(f"__{k}") for k in keys]).select(*texts.columns, mid("__ys", "y1", "y2").alias("__tr"), mid("__xs", "x1", "x2").alias("__tc"))
    met = found.join(prefixed(spread(once, edges, keys), "b_"), [*[F.col(k) == F.col(f"b_{k}") for k in keys], F.col("__tr") == F.col("b___r"), F.col("__tc") == F.col("b___c"), text_inside(box(), box("b_"), share)])
    first = Window.partitionBy(*keys, text_id).orderBy("b_at")
    return met.withColumn("__n", F.row_number().over(first)).where("__n = 1").select(*texts.columns, *[F.col(f"b_at.{c}").alias(c) for c in ("row_id", "col_id", *also)])


def joined_text(placed: DataFrame, keys: list[str], text_id: str) -> DataFrame:
    """A cell's text: its boxes by line and left edge, parted by a space where they are apart or on another line."""
    by = [*keys, "row_id", "col_id"]
    w = Window.partitionBy(*by).orderBy("y1", "x1", text_id)
    prev = Box(F.lag("x1").over(w), F.lag("y1").over(w), F.lag("x2").over(w), F.lag("y2").over(w))
    space = apart(prev, box()) | (prev.y2 < F.col("y1"))
    parts = placed.withColumn("__part", F.concat(F.when(prev.x1.isNotNull() & space, F.lit(" ")).otherwise(F.lit("")), "text")).withColumn("__n", F.row_number().over(w))
    whole = parts.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("__n", "__part"))).alias("p"))
    return whole.select(*by, F.array_join(F.transform("p", lambda x: x["__part"]), "").alias("content"), F.size("p").alias("n_texts"))
