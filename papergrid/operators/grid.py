"""From ruled lines to tables: cells, tables of touching cells, grids with merged cells, spans."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import idiv, x_overlap, y_overlap
from ..shared import materialised
from . import tabular
from .batched import map_batches
from .grouped import map_groups
from .overlap import overlap_join, prefixed


def _drawn(lines: DataFrame, keys: list[str]) -> DataFrame:
    known = lines.where("x1 + y1 + x2 + y2 is not null and orient in ('h', 'v')")
    return known.select(*keys, (F.col("orient") == "h").alias("level"), (F.col("orient") == "v").alias("upright"), "x1", "y1", "x2", "y2")


def _placed(cells: DataFrame, keys: list[str]) -> DataFrame:
    return cells.where("x1 + y1 + x2 + y2 is not null").select(*keys, "cell_id", "x1", "y1", "x2", "y2")


CELL, SLOT = "cell_id int, x1 int, y1 int, x2 int, y2 int", "row_id int, col_id int, x1 int, y1 int, x2 int, y2 int"
SPAN = "row_id int, col_id int, rowspan int, colspan int, x1 int, y1 int, x2 int, y2 int"


def cells_from_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Cells between level lines that lie under each other, cut at the upright lines that span them; ``cell_id`` from 0 in the order of band and left edge.

    Of bands with equal sides and top the lowest bottom line counts, then of equal
    sides and bottom the highest top, so only neighbouring lines make a band.
    """
    return map_batches(_drawn(lines, keys), keys, tabular.cells, CELL)


def grid_from_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``to_grid`` of ``cells_from_lines``, without dealing the cells."""
    return map_batches(_drawn(lines, keys), keys, tabular.then(tabular.cells, tabular.slots), SLOT)


def spans_from_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """``spans`` of ``grid_from_lines``, without dealing the slots."""
    return map_batches(_drawn(lines, keys), keys, tabular.then(tabular.cells, tabular.slots, tabular.spans), SPAN)


def _with_texts(lines: DataFrame, texts: DataFrame, keys: list[str], text_id: str) -> DataFrame:
    t = texts.where("x1 + y1 + x2 + y2 is not null").select(*keys, F.lit(False).alias("level"), F.lit(False).alias("upright"), "x1", "y1", "x2", "y2", F.lit(True).alias("is_text"), F.col(text_id).cast("long").alias("id"), "text")
    return _drawn(lines, keys).select("*", F.lit(False).alias("is_text"), F.lit(0).cast("long").alias("id"), F.lit(None).cast("string").alias("text")).unionByName(t)


def placed_from_lines(lines: DataFrame, texts: DataFrame, keys: list[str], text_id: str) -> DataFrame:
    """``overlap.place_text`` in ``grid_from_lines``: text_id, row_id, col_id. Lines and texts are dealt once."""
    kind = dict(texts.dtypes)[text_id]
    return map_batches(_with_texts(lines, texts, keys, text_id).drop("text"), keys, tabular.placed, f"id {kind}, row_id int, col_id int").withColumnRenamed("id", text_id)


def filled_from_lines(lines: DataFrame, texts: DataFrame, keys: list[str], text_id: str) -> DataFrame:
    """``spans_from_lines`` with ``content``, the ``overlap.joined_text`` of each cell. Lines and texts are dealt once."""
    return map_batches(_with_texts(lines, texts, keys, text_id), keys, tabular.contents, f"{SPAN}, content string")


def drop_covered(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Smallest first; a cell is kept if some of its area (right of and below 0) is covered by no kept one.

    An area that a dropped cell covers is covered by kept ones too, so a cell is kept
    exactly if it is the first of those that cover some slot between neighbouring edges.
    """
    return map_batches(_placed(cells, keys), keys, tabular.uncovered, CELL)


def adjacent(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Pairs of cells (a_cell_id < b_cell_id) that share an edge, within 5 % of the smaller (5 pixels at most), along more than 5 pixels."""
    cols = [*keys, "cell_id", "x1", "y1", "x2", "y2"]

    def touch(a, b):
        dist = lambda p, q, r, s: F.least(F.abs(p - r), F.abs(p - s), F.abs(q - r), F.abs(q - s))
        least = lambda p, q: F.least(F.lit(5), idiv(F.least(p, q), 20))
        side = (y_overlap(a, b) > 5) & (dist(a.x1, a.x2, b.x1, b.x2) <= least(a.x2 - a.x1, b.x2 - b.x1))
        stack = (x_overlap(a, b) > 5) & (dist(a.y1, a.y2, b.y1, b.y2) <= least(a.y2 - a.y1, b.y2 - b.y1))
        return side | stack

    met = overlap_join(cells.select(cols), cells.select(cols), keys, touch, also=F.col("a_cell_id") < F.col("b_cell_id"))
    return met.select(*[F.col(f"a_{k}").alias(k) for k in keys], "a_cell_id", "b_cell_id")


def _components(pairs: list[tuple]) -> list[tuple]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    return [(x, find(x)) for x in sorted(root)]


def components(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: each cell that has a neighbour, and the smallest cell of its table. Lone cells are in none."""
    return map_groups(pairs.select(*keys, "a_cell_id", "b_cell_id"), keys, [], _components, "cell_id int, component int")


def snapped_cells(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Cells with their edges at the nearest delimiter: the rounded mean of edges closer than 2 % of the table, 10 pixels at most. Empty ones go."""
    return map_batches(_placed(cells, keys), keys, tabular.snapped, CELL)


def to_grid(cells: DataFrame, keys: list[str]) -> DataFrame:
    """A slot per row and column strip: row_id, col_id, and the box that fills it (x1, y1, x2, y2).

    The smallest cell that covers the slot fills it (slots lie between neighbouring edges, so a cell covers all or none of one); without one, a box of no
    width at the nearest edge of the row's cells; in a row without cells the slot itself.
    """
    return map_batches(_placed(cells, keys), keys, tabular.slots, SLOT)


def spans(grid: DataFrame, keys: list[str], literal: bool = False) -> DataFrame:
    """Slots of one box as one cell: where it starts, rowspan, colspan. ``literal`` counts every repeat in a later row as a row."""
    agg = grid.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.min("row_id").alias("row_id"), F.min("col_id").alias("col_id"), (F.max("row_id") - F.min("row_id") + 1).alias("rowspan"), (F.max("col_id") - F.min("col_id") + 1).alias("colspan"))
    if literal:
        agg = agg.withColumn("rowspan", F.col("colspan") * (F.col("rowspan") - 1) + 1)
    return agg.select(*keys, "row_id", "col_id", "rowspan", "colspan", "x1", "y1", "x2", "y2")


def drop_empty(grid: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """The grid without rows and columns in which no text box lies wholly; rows and columns keep their order and are numbered anew."""
    t = prefixed(texts.select(*keys, "x1", "y1", "x2", "y2"), "t_")
    inside = (F.col("x1") <= F.col("t_x1")) & (F.col("y1") <= F.col("t_y1")) & (F.col("x2") >= F.col("t_x2")) & (F.col("y2") >= F.col("t_y2"))
    full = grid.join(t, [F.col(k) == F.col(f"t_{k}") for k in keys] + [inside], "left_semi")
    left = grid.join(full.select(*keys, "row_id").distinct(), [*keys, "row_id"], "left_semi").join(full.select(*keys, "col_id").distinct(), [*keys, "col_id"], "left_semi")
    again = lambda c: (F.dense_rank().over(Window.partitionBy(*keys).orderBy(c)) - 1).cast("int")
    return left.select(*keys, again("row_id").alias("row_id"), again("col_id").alias("col_id"), "x1", "y1", "x2", "y2")


def edge_lines(lines: DataFrame, keys: list[str], slack: int = 4) -> DataFrame:
    """Lines within ``slack`` of a table's outermost line, by side."""
    by = Window.partitionBy(*keys, "orient")
    sides = [("top", "h", F.col("y1") - F.min("y1").over(by)), ("bottom", "h", F.max("y1").over(by) - F.col("y1")), ("left", "v", F.col("x1") - F.min("x1").over(by)), ("right", "v", F.max("x1").over(by) - F.col("x1"))]
    each = lines.withColumn("__sides", F.filter(F.array(*[F.when((F.col("orient") == o) & (d <= slack), F.lit(s)) for s, o, d in sides]), lambda s: s.isNotNull()))
    return each.select(*keys, F.explode("__sides").alias("side"), "x1", "y1", "x2", "y2")


def cell_edges(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Per distinct coordinate the span of the cell edges on it: orient, coord, first, last."""
    e = lambda o, at, a, b: F.struct(F.lit(o).alias("orient"), F.col(at).alias("at"), F.col(a).alias("a"), F.col(b).alias("b"))
    each = cells.select(*keys, F.explode(F.array(e("h", "y1", "x1", "x2"), e("h", "y2", "x1", "x2"), e("v", "x1", "y1", "y2"), e("v", "x2", "y1", "y2"))).alias("e"))
    return each.groupBy(*keys, F.col("e.orient").alias("orient"), F.col("e.at").alias("coord")).agg(F.min("e.a").alias("first"), F.max("e.b").alias("last"))


def merge_consecutive(tables: DataFrame, keys: list[str], contours: DataFrame | None = None) -> DataFrame:
    """Tables of a page (table_ord, x1, y1, x2, y2, n_cols, v_lines: sorted array) with ``merged_id``: a table goes on with the one above if
    no contour lies between, the columns are as many, and their upright lines differ by 2 pixels at most."""
    by = Window.partitionBy(*keys).orderBy("y1", "table_ord")
    prev = {c: F.lag(c).over(by) for c in ("x1", "y2", "x2", "n_cols", "v_lines")}
    t = tables.withColumns({f"p_{c}": v for c, v in prev.items()})
    close = F.forall(F.arrays_zip(F.slice("p_v_lines", F.lit(1), F.least(F.size("p_v_lines"), F.size("v_lines"))).alias("a"), F.slice("v_lines", F.lit(1), F.least(F.size("p_v_lines"), F.size("v_lines"))).alias("b")), lambda p: F.abs(p["a"] - p["b"]) <= 2)
    goes_on = F.coalesce((F.col("p_n_cols") == F.col("n_cols")) & close, F.lit(False))
    if contours is not None:
        c = prefixed(contours.select(*keys, "x1", "y1", "x2", "y2"), "c_")
        between = (F.col("c_y1") >= F.col("p_y2")) & (F.col("c_y2") <= F.col("y1")) & (F.col("c_x2") >= F.least("p_x1", "x1")) & (F.col("c_x1") <= F.greatest("p_x2", "x2"))
        parted = t.join(c, [F.col(k) == F.col(f"c_{k}") for k in keys] + [between], "left_semi").select(*keys, "table_ord", F.lit(True).alias("parted"))
        t = t.join(parted, [*keys, "table_ord"], "left")
        goes_on = goes_on & F.col("parted").isNull()
    t = t.withColumn("__new", (~goes_on).cast("int"))
    return t.withColumn("merged_id", (F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).select(*tables.columns, "merged_id")


def table_from_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """All steps: cells, without covered ones, those of the largest table of touching cells of each key, edges snapped, as a grid."""
    cells = materialised(map_batches(_drawn(lines, keys), keys, tabular.then(tabular.cells, tabular.uncovered), CELL), "cells")
    parts = components(adjacent(cells, keys), keys)
    met = cells.join(parts, [*keys, "cell_id"]).withColumnRenamed("component", "table_ord")
    by = [*keys, "table_ord"]
    return map_batches(_placed(met, by), by, tabular.then(tabular.snapped, tabular.slots), SLOT)


def implicit_lines(grid: DataFrame, whitespace: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Upright lines in the middle of blank columns that have no cell edge in them: x1, y1, x2, y2."""
    wide = whitespace.where((F.col("x2") - F.col("x1")) >= least)
    edges = prefixed(grid.select(*keys, F.explode(F.array("x1", "x2")).alias("e")).distinct(), "g_")
    bare = wide.join(edges, [F.col(k) == F.col(f"g_{k}") for k in keys] + [F.col("g_e").between(F.col("x1"), F.col("x2"))], "left_anti")
    mid = idiv(F.col("x1") + F.col("x2"), 2).cast("int")
    return bare.select(*keys, mid.alias("x1"), "y1", mid.alias("x2"), "y2")
