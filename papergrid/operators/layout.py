"""Detected layout objects: suppression, containment, reading order, joining of detector results."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import BAND_OVERLAP, area, box, box_of, clip_window, contained, contains, iou_over, text_inside
from ..functions.labels import ARTIFACT_LABELS, FOOT_LABELS, HEAD_LABELS, canonical
from ..functions.text import picture
from .gaps import gap_scan, islands
from .overlap import overlap_join, prefixed

_FIELDS = ("obj_id", "label", "confidence_pct", "x1", "y1", "x2", "y2")


def _page_arrays(objects: DataFrame, keys: list[str], *order) -> DataFrame:
    """A page's objects in order, as one array. A page's objects are few; pages are many."""
    item = F.struct(*order, *[c for c in _FIELDS])
    return objects.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("__objs"))


def _exploded(pages: DataFrame, keys: list[str]) -> DataFrame:
    return pages.select(*keys, F.posexplode("__objs").alias("pos", "o")).select(*keys, "pos", *[F.col(f"o.{c}").alias(c) for c in _FIELDS])


def suppress(objects: DataFrame, keys: list[str], threshold: float = 0.8) -> DataFrame:
    """Non-maximum suppression in input order. A table that holds a table of more confidence goes; then an object meets the first kept
    one that it overlaps by more than the threshold, and replaces it (at the end) if it has more confidence, else goes. ``pos`` is the new order."""
    known = objects.withColumn("__canon", canonical(F.col("label")))
    tables = known.where("__canon = 'Table'").select(*keys, "obj_id", "confidence_pct", "x1", "y1", "x2", "y2")
    inner = tables.select(*[F.col(c).alias(f"b_{c}") for c in tables.columns])
    worse = (F.col("__canon") == "Table") & (F.col("obj_id") != F.col("b_obj_id")) & (F.col("b_confidence_pct") > F.col("confidence_pct"))
    left = known.join(inner, [F.col(k) == F.col(f"b_{k}") for k in keys] + [worse & contains(box(), box("b_"))], "left_anti")
    pages = _page_arrays(left, keys)
    none = F.filter("__objs", lambda _: F.lit(False))

    def step(kept, o):
        hit = F.filter(kept, lambda k: iou_over(box_of(k), box_of(o), threshold))
        first = F.element_at(hit, 1)
        replaced = F.concat(F.filter(kept, lambda k: k["obj_id"] != first["obj_id"]), F.array(o))
        return F.when(F.size(hit) == 0, F.concat(kept, F.array(o))).when(o["confidence_pct"] > first["confidence_pct"], replaced).otherwise(kept)

    return _exploded(pages.withColumn("__objs", F.aggregate("__objs", none, step)), keys)


def drop_contained(objects: DataFrame, keys: list[str]) -> DataFrame:
    """Largest first; an object inside a kept one goes, but for a table whose first holder is none."""
    pages = _page_arrays(objects, keys, (-area(box())).alias("__area"), F.col("obj_id").alias("__ord"))
    none = F.filter("__objs", lambda _: F.lit(False))

    def step(kept, o):
        hit = F.filter(kept, lambda k: contained(box_of(o), box_of(k)))
        stays = (F.size(hit) == 0) | ((canonical(F.element_at(hit, 1)["label"]) != "Table") & (canonical(o["label"]) == "Table"))
        return F.when(stays, F.concat(kept, F.array(o))).otherwise(kept)

    return _exploded(pages.withColumn("__objs", F.aggregate("__objs", none, step)), keys)


def column_bands(body: DataFrame, keys: list[str], order: str = "obj_id", min_gap: int = 5) -> DataFrame:
    """``body`` with ``band_id`` and ``band_column``: bands of boxes that overlap in y; a band goes on with the one above
    if both, and the two together, have equally many gaps of x. The gaps of a band part its columns."""
    lined = islands(body, keys, "y1", "y2", [order], BAND_OVERLAP, "__b")
    count = lambda rows, by, name: gap_scan(rows, [*keys, by], "x1", "x2", min_gap).groupBy(*keys, by).agg(F.count(F.lit(1)).alias(name))
    two = lined.withColumn("__b", F.explode(F.array("__b", F.col("__b") + 1)))  # under each band's number: it and the one above
    each = lined.select(*keys, "__b").distinct().join(count(lined, "__b", "__own"), [*keys, "__b"], "left").join(count(two, "__b", "__both"), [*keys, "__b"], "left")
    by = Window.partitionBy(*keys).orderBy("__b")
    goes_on = F.coalesce((F.col("__own") == F.lag("__own").over(by)) & (F.col("__own") == F.col("__both")), F.lit(False))
    named = each.withColumn("__new", (~goes_on).cast("int")).withColumn("band_id", (F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int")).select(*keys, "__b", "band_id")
    banded = lined.join(named, [*keys, "__b"]).drop("__b")
    found = gap_scan(banded, [*keys, "band_id"], "x1", "x2", min_gap).groupBy(*[F.col(k).alias(f"__{k}") for k in keys], F.col("band_id").alias("__band")).agg(F.collect_list("centre").alias("__at"))
    met = banded.join(found, [F.col(k) == F.col(f"__{k}") for k in keys] + [F.col("band_id") == F.col("__band")], "left")
    return met.select(*body.columns, "band_id", F.coalesce(F.size(F.filter("__at", lambda g: g < F.col("x1"))), F.lit(0)).alias("band_column"))


def reading_order(objects: DataFrame, keys: list[str], min_gap: int = 30) -> DataFrame:
    """Heads by right edge, the body column by column from the top, feet by right edge; artifacts are left out. ``reading_pos`` counts from 0.

    A body object is in the first column whose gap lies right of it; those left of none
    come last. On a page that no gap parts from top to bottom, the body goes band by band
    and in each band column by column.
    """
    section = F.when(F.col("label").isin(*HEAD_LABELS), 0).when(F.col("label").isin(*FOOT_LABELS), 2).otherwise(1)
    shown = objects.where(~F.col("label").isin(*ARTIFACT_LABELS)).withColumn("__sec", section)
    gaps = gap_scan(shown.where("__sec = 1"), keys, "x1", "x2", min_gap)
    columns = gaps.groupBy(*keys).agg(F.sort_array(F.collect_list("centre")).alias("__gaps")).select(*[F.col(k).alias(f"__{k}") for k in keys], "__gaps")
    met = shown.join(columns, [F.col(k) == F.col(f"__{k}") for k in keys], "left")
    right = F.filter("__gaps", lambda g: g > F.col("x2"))
    column = F.when((F.col("__sec") == 1) & F.col("__gaps").isNotNull(), F.size("__gaps") - F.size(right)).otherwise(0)
    met = met.withColumn("column_id", column.cast("int"))
    whole = (F.col("__sec") == 1) & F.col("__gaps").isNull()
    bands = column_bands(met.where(whole).select(*objects.columns, "__sec", "column_id"), keys)
    placed = met.where(~whole).select(*objects.columns, "__sec", "column_id", F.lit(0).alias("band_id"), F.lit(0).alias("band_column")).unionByName(bands)
    by = Window.partitionBy(*keys).orderBy("__sec", "column_id", "band_id", "band_column", F.when(F.col("__sec") == 1, F.col("y1")).otherwise(F.col("x2")), "obj_id")
    return placed.withColumn("reading_pos", F.row_number().over(by) - 1).select(*objects.columns, F.col("__sec").alias("section"), "column_id", "band_id", "band_column", "reading_pos")


def table_pages(pages: DataFrame, objects: DataFrame, keys: list[str]) -> DataFrame:
    """Pages that hold a table: a semi-join."""
    return pages.join(objects.where(F.lower("label") == "table").select(*keys), keys, "left_semi")


def attach_cells(blocks: DataFrame, tables: DataFrame, keys: list[str], block_order: str, table_order: str) -> DataFrame:
    """The k-th table block of a page with the k-th table result."""
    b = blocks.where(F.lower("label") == "table").withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(block_order)))
    t = tables.withColumn("k", F.row_number().over(Window.partitionBy(*keys).orderBy(table_order)))
    return b.join(t.select(*keys, "k", *[c for c in t.columns if c not in (*keys, "k")]), [*keys, "k"], "left")


def elements_in_objects(objects: DataFrame, elements: DataFrame, keys: list[str], share: float = 0.7) -> DataFrame:
    """Elements with every object that holds enough of them."""
    return overlap_join(elements, objects, keys, lambda e, o: text_inside(e, o, share))


def text_elements(objects: DataFrame) -> DataFrame:
    """Objects that hold text: all but pictures, charts, formulas and unknown ones."""
    return objects.where(~canonical(F.col("label")).isin("Picture", "Chart", "isolate_formula", "Unknown"))


def picture_chunks(objects: DataFrame, elements: DataFrame, keys: list[str], page_width: int, page_height: int, folder: str, share: float = 0.7) -> DataFrame:
    """Objects that are shown as pictures, because they are ones or because no element lies in them: their clip window and Markdown."""
    inside = prefixed(elements.select(*keys, "obj_id", "x1", "y1", "x2", "y2"), "b_")
    bare = objects.join(inside, [F.col(k) == F.col(f"b_{k}") for k in keys] + [text_inside(box("b_"), box(), share) & (F.col("b_obj_id") != F.col("obj_id"))], "left_anti")
    shown = objects.where(canonical(F.col("label")) == "Picture").unionByName(bare.where(~canonical(F.col("label")).isin("Picture", "Unknown")))
    w = clip_window(box(), page_width, page_height)
    url = F.concat(F.lit(folder + "/"), *[F.concat(F.col(k).cast("string"), F.lit("-")) for k in keys], F.col("obj_id").cast("string"), F.lit(".png"))
    return shown.select(*keys, "obj_id", *[c.alias(n) for c, n in zip(w, w._fields)], F.concat(picture(url, F.lit("")), F.lit("\n\n")).alias("md"))
