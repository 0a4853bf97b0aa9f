"""Blank space around elements of a segment (a page, or a part of one): blanks, areas between full-width blanks, chains of areas, row delimiters, text columns.

Elements and bounds are tables with the same keys; everything is windows and
equi-joins on them. Blanks are half-open boxes: from one element's end to the next
one's start.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import idiv
from ..shared import materialised
from . import tabular
from .batched import Groups, map_batches
from .gaps import islands, merged_spans
from .overlap import prefixed, with_any

_BOX = ("x1", "y1", "x2", "y2")


def _same(keys: list[str], p: str) -> list[Column]:
    return [F.col(k) == F.col(f"{p}{k}") for k in keys]


def hull(boxes: DataFrame, keys: list[str], margin: int = 0) -> DataFrame:
    """Per key the box around its boxes, ``margin`` wider on each side."""
    return boxes.groupBy(*keys).agg((F.min("x1") - margin).alias("x1"), (F.min("y1") - margin).alias("y1"), (F.max("x2") + margin).alias("x2"), (F.max("y2") + margin).alias("y2"))


def blanks(elements: DataFrame, bounds: DataFrame, keys: list[str], least_width: float, least_height: float | Column, share: float, level: bool = False) -> DataFrame:
    """Upright blanks (or level ones, with axes exchanged) of a segment: in each strip between neighbouring edges of elements and bounds,
    the gaps between elements of at least ``least_height`` and ``share`` of the elements' extent; equal ones of touching strips are one.
    ``least_height`` may be a column of ``bounds``."""
    return map_batches(_bound(elements, bounds, keys, least_height), keys, lambda g: tabular.blanks(g, least_width, share, level), SPACE)


SPACE = "x1 int, y1 int, x2 int, y2 int"


def _bound(elements: DataFrame, bounds: DataFrame, keys: list[str], least_height: float | Column) -> DataFrame:
    """Elements with the box of their bounds and the least height. Heights are integers, so a fraction counts as the next one."""
    least = F.ceil(least_height if isinstance(least_height, Column) else F.lit(least_height)).cast("long").alias("least")
    b = bounds.select(*[F.col(k).alias(f"b_{k}") for k in keys], least, *[F.col(c).alias(f"b_{c}") for c in _BOX])
    known = elements.where("x1 + y1 + x2 + y2 is not null")
    return known.join(b, _same(keys, "b_")).select(*keys, *_BOX, "least", *[f"b_{c}" for c in _BOX])


def column_blanks(elements: DataFrame, bounds: DataFrame, keys: list[str], char: int, least_height: int | Column, share: float) -> DataFrame:
    """The blanks of a segment that may part columns: a character wide, the tallest of neighbours, those without an element between as one."""

    def work(g: Groups) -> Groups:
        return tabular.apart(tabular.tallest(tabular.blanks(g, char, share)), g)

    return map_batches(_bound(elements, bounds, keys, least_height), keys, work, SPACE)


def areas(elements: DataFrame, bounds: DataFrame, keys: list[str], char: int, line_sep: int) -> DataFrame:
    """``elements`` with ``area_id`` (from 0, downwards) and its box: parts of a segment between full-width blanks of half a line distance, a character wider than all elements (inside the segment)."""
    parted = islands(elements, keys, "y1", "y2", [], -(line_sep // 2) + 1, "area_id")
    by, whole = Window.partitionBy(*keys, "area_id"), Window.partitionBy(*keys)
    b = prefixed(bounds.select(*keys, *_BOX), "b_")
    met = parted.join(b, _same(keys, "b_"))
    return met.select(*elements.columns, "area_id", F.greatest(F.min("x1").over(whole) - char, F.lit(0)).alias("ax1"), F.min("y1").over(by).alias("ay1"), F.least(F.max("x2").over(whole) + char, F.col("b_x2")).alias("ax2"), F.max("y2").over(by).alias("ay2"))


def area_blanks(parted: DataFrame, keys: list[str], char: int, line_sep: int, share: float = 0.66) -> DataFrame:
    """Of areas (elements with their area's box): the blanks that part columns, and the margins left and right of all elements; areas without an inner blank have none.

    A blank goes if a tenth of it lies in a margin, or if it neither reaches the area's
    top or bottom nor two thirds of the height of the tallest inner one. Columns: keys,
    area_id, box, top and bottom (whether it reaches them).
    """
    own = parted.where("x1 + y1 + x2 + y2 is not null").select(*keys, "area_id", *_BOX, *[f"a{c}" for c in _BOX])
    return map_batches(own, [*keys, "area_id"], lambda g: tabular.parting(g, char, line_sep, share), f"{SPACE}, top boolean, bottom boolean")


def area_chains(parted: DataFrame, spaces: DataFrame, keys: list[str], char: int, line_sep: int) -> DataFrame:
    """Areas with ``segment_id``: an area goes on with the one above if it is at most 2.5 line distances below it and enough of the inner blanks at the seam meet one of the other's.

    Of the blanks that reach the seam (touching ones as one), the side that has more
    counts (the upper of equals): the share of its inner ones that meet exactly one of
    the other side by half a character must be all with fewer than four on a side, two
    thirds at less than a line distance, else four fifths. Chains of at most three blanks in every area are left out.
    """
    by = [*keys, "area_id"]
    a = parted.groupBy(*by).agg(F.first("ay1").alias("y1"), F.first("ay2").alias("y2")).join(spaces.groupBy(*by).agg(F.count(F.lit(1)).alias("n_blanks")), by)
    order = Window.partitionBy(*keys).orderBy("area_id")
    a = a.withColumn("gap", F.when(F.lag("area_id").over(order) == F.col("area_id") - 1, F.col("y1") - F.lag("y2").over(order)))
    seam = lambda side, shift: merged_spans(spaces.where(side), by, "x1", "x2", touching=False).select(*keys, (F.col("area_id") + shift).alias("area_id"), "first", "last")
    ranked = lambda s: s.withColumns({"n": F.row_number().over(Window.partitionBy(*by).orderBy("first")), "all": F.count(F.lit(1)).over(Window.partitionBy(*by))})
    up, down = ranked(seam("bottom", 1)), ranked(seam("top", 0))
    sizes = up.groupBy(*by).agg(F.first("all").alias("ups")).join(down.groupBy(*by).agg(F.first("all").alias("downs")), by)

    def share(one: DataFrame, other: DataFrame) -> DataFrame:
        inner = one.where("n > 1 and n < all")
        o = other.select(*[F.col(k).alias(f"o_{k}") for k in by], F.col("first").alias("of"), F.col("last").alias("ol"))
        meets = (F.least("last", "ol") - F.greatest("first", "of")) * 2 >= char
        each = inner.join(o, _same(by, "o_") + [meets], "left").groupBy(*by, "n").agg(F.count("of").alias("m"))
        return each.groupBy(*by).agg(F.count_if(F.col("m") == 1).alias("fit"), F.count(F.lit(1)).alias("of"))

    from_up, from_down = (share(x, y).select(*by, F.col("fit").alias(f"{n}_fit"), F.col("of").alias(f"{n}_of")) for n, x, y in (("u", up, down), ("d", down, up)))
    told = a.join(sizes, by, "left").join(from_up, by, "left").join(from_down, by, "left")
    fit, of = (F.when(F.col("ups") >= F.col("downs"), F.col(f"u_{c}")).otherwise(F.col(f"d_{c}")) for c in ("fit", "of"))
    least = F.when(F.least("ups", "downs") < 4, 100).when(F.col("gap") < line_sep, 66).otherwise(80)
    goes_on = F.coalesce((F.col("gap") * 2 <= 5 * line_sep) & (fit * 100 >= of * least), F.lit(False))
    chained = told.withColumn("__new", (~goes_on).cast("int")).withColumn("segment_id", (F.sum("__new").over(order.rowsBetween(Window.unboundedPreceding, 0)) - 1).cast("int"))
    return chained.withColumn("__most", F.max("n_blanks").over(Window.partitionBy(*keys, "segment_id"))).where("__most > 3").select(*by, "y1", "y2", "n_blanks", "segment_id")


def row_delimiters(elements: DataFrame, bounds: DataFrame, keys: list[str], share: float = 0.66, least: int = 3) -> DataFrame:
    """Level delimiters of a column group: the middles of its level blanks (``share`` of the elements' width, half as tall as the lower middle full one if there are
    three, not beside a wider one), and the elements' top and bottom. None for a key with fewer than ``least``. A delimiter that isn't full is drawn on, left and right, to the next element in its way (or the end)."""
    b = bounds.select(*keys, *_BOX)
    found = materialised(blanks(elements, b, keys, 0, 1, share, level=True), "level-blanks")
    tall, wide = F.col("y2") - F.col("y1"), F.col("x2") - F.col("x1")
    whole = Window.partitionBy(*keys)
    full = found.withColumn("__w", F.max(wide).over(whole)).where(wide == F.col("__w")).groupBy(*[F.col(k).alias(f"f_{k}") for k in keys]).agg(F.sort_array(F.collect_list(tall)).alias("ts"))
    usual = F.when(F.size("ts") >= 3, F.element_at("ts", F.floor((F.size("ts") + 1) / 2).cast("int"))).otherwise(F.lit(2))
    tall_enough = found.join(full, _same(keys, "f_"), "left").where(tall * 2 >= usual).select(*keys, *_BOX)
    beside = lambda p, q: ((p.y1 == q.y1) | (p.y1 == q.y2) | (p.y2 == q.y1) | (p.y2 == q.y2)) & (p.x2 - p.x1 < q.x2 - q.x1)
    kept = with_any(tall_enough, tall_enough, keys, beside, negate=True).join(prefixed(b, "b_"), _same(keys, "b_")).where("y1 <> b_y1 and y2 <> b_y2")
    y = idiv(F.col("y1") + F.col("y2"), 2).cast("int")
    ends = hull(elements, keys).select(*keys, F.explode(F.array(F.struct("x1", F.col("y1").alias("y"), "x2"), F.struct("x1", F.col("y2").alias("y"), "x2"))).alias("e")).select(*keys, "e.*")
    every = kept.select(*keys, "x1", y.alias("y"), "x2").unionByName(ends).distinct()
    every = every.withColumns({"__lo": F.min("x1").over(whole), "__hi": F.max("x2").over(whole), "__n": F.count(F.lit(1)).over(whole)}).where(F.col("__n") >= least)
    every = materialised(every, "delimiters")
    short = (F.col("x1") > F.col("__lo")) | (F.col("x2") < F.col("__hi"))
    e = prefixed(elements.select(*keys, *_BOX), "e_")
    sixth = idiv(F.col("e_y2") - F.col("e_y1"), 6)
    met = every.where(short).join(e, _same(keys, "e_") + [(F.col("e_y1") + sixth < F.col("y")) & (F.col("y") < F.col("e_y2") - sixth)], "left")
    left = F.max(F.when(F.least("e_x2", "x1") > F.greatest("e_x1", "__lo"), F.col("e_x2")))
    right = F.min(F.when(F.least("e_x2", "__hi") > F.greatest("e_x1", "x2"), F.col("e_x1")))
    drawn = met.groupBy(*keys, "x1", "y", "x2", "__lo", "__hi").agg(left.alias("l"), right.alias("r"))
    drawn = drawn.select(*keys, F.greatest(F.coalesce("l", "__lo"), "__lo").alias("x1"), F.col("y").alias("y1"), F.least(F.coalesce("r", "__hi"), "__hi").alias("x2"), F.col("y").alias("y2"))
    return every.where(~short).select(*keys, "x1", F.col("y").alias("y1"), "x2", F.col("y").alias("y2")).unionByName(drawn)


def text_column_blanks(elements: DataFrame, bounds: DataFrame, lines: DataFrame, keys: list[str], char: int) -> DataFrame:
    """Upright blanks of half a segment's height that part its text columns: a character wide or at its side, cut at level lines over half their width
    (parts of half the segment's height stay), and of those without an element between two neighbours the tallest, of equals the widest."""
    b = prefixed(bounds.select(*keys, *_BOX), "b_")
    found = blanks(elements, bounds, keys, 0, 1, 0.5).join(b, _same(keys, "b_")).where((F.col("x2") - F.col("x1") >= char) | (F.col("x1") == F.col("b_x1")) | (F.col("x2") == F.col("b_x2")))
    l = lines.where("orient = 'h'").select(*[F.col(k).alias(f"l_{k}") for k in keys], F.col("x1").alias("l_x1"), F.col("x2").alias("l_x2"), F.col("y1").alias("l_y"))  # noqa: E741
    cut = found.join(l, _same(keys, "l_") + [(F.col("l_y") > F.col("y1")) & (F.col("l_y") < F.col("y2")) & ((F.least("x2", "l_x2") - F.greatest("x1", "l_x1")) * 2 >= F.col("x2") - F.col("x1"))], "left")
    at = cut.groupBy(*keys, *_BOX, "b_y1", "b_y2").agg(F.collect_set("l_y").alias("c"))
    ys = F.array_sort(F.concat(F.array("y1", "y2"), "c"))
    parts = at.select(*keys, "x1", "x2", "y1", "y2", "c", "b_y1", "b_y2", F.posexplode(F.slice(ys, F.lit(1), F.size(ys) - 1)).alias("i", "a"), ys.alias("ys")).withColumn("b", F.element_at("ys", F.col("i") + 2))
    parts = parts.where((F.size("c") == 0) | ((F.col("b") - F.col("a")) * 2 >= F.col("b_y2") - F.col("b_y1"))).select(*keys, "x1", F.col("a").alias("y1"), "x2", F.col("b").alias("y2"))
    by = Window.partitionBy(*keys).orderBy(F.col("x1") + F.col("x2"), "x1", "y1")
    n = parts.withColumns({"__n": F.row_number().over(by), "px2": F.lag("x2").over(by), "py1": F.lag("y1").over(by), "py2": F.lag("y2").over(by)})
    e = prefixed(elements.select(*keys, *_BOX), "e_")
    between = (F.col("e_x1") >= F.least("px2", "x1")) & (F.col("e_x2") <= F.greatest("px2", "x1")) & (F.col("e_y1") >= F.greatest("py1", "y1")) & (F.col("e_y2") <= F.least("py2", "y2"))
    parted = n.join(e, _same(keys, "e_") + [between], "left_semi").select(*keys, "__n", F.lit(1).alias("__new"))
    grouped = n.join(parted, [*keys, "__n"], "left").withColumn("__g", F.sum(F.coalesce("__new", F.lit(0))).over(Window.partitionBy(*keys).orderBy("__n").rowsBetween(Window.unboundedPreceding, 0)))
    best = grouped.groupBy(*keys, "__g").agg(F.max(F.struct((F.col("y2") - F.col("y1")).alias("h"), (F.col("x2") - F.col("x1")).alias("w"), "__n", *_BOX)).alias("b"))
    return best.select(*keys, *[F.col(f"b.{c}").alias(c) for c in _BOX])


def column_groups(spaces: DataFrame, bounds: DataFrame, keys: list[str]) -> DataFrame:
    """Blanks that begin (or end) at like heights, within 5 % of the taller, with those at the segment's sides, as groups that part three columns or two of like width (1.25).

    Columns: keys, side, group_id, box. Groups that another inner blank crosses by a fifth of its height are left out.
    """
    b = prefixed(bounds.select(*keys, *_BOX), "b_")
    met = spaces.join(b, _same(keys, "b_")).withColumn("__edge", (F.col("x1") == F.col("b_x1")) | (F.col("x2") == F.col("b_x2")) | (F.col("x1") == F.col("b_x2")) | (F.col("x2") == F.col("b_x1"))).select(*keys, *_BOX, "__edge")
    inner, edge = met.where("not __edge"), met.where("__edge")
    sides = inner.select(*keys, *_BOX, F.explode(F.array(F.struct(F.lit("top").alias("side"), F.col("y1").alias("at")), F.struct(F.lit("bottom").alias("side"), F.col("y2").alias("at")))).alias("s")).select(*keys, *_BOX, "s.*")
    by = Window.partitionBy(*keys, "side").orderBy("at", "x1")
    tall = F.col("y2") - F.col("y1")
    new = F.coalesce(((F.col("at") - F.lag("at").over(by)) * 20 > F.greatest(tall, F.lag(tall).over(by))).cast("int"), F.lit(0))
    grouped = sides.withColumn("__new", new).withColumn("group_id", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    names = grouped.select(*keys, "side", "group_id").distinct()
    every = grouped.select(*keys, "side", "group_id", *_BOX).unionByName(names.join(edge, keys).select(*keys, "side", "group_id", *_BOX))
    order = Window.partitionBy(*keys, "side", "group_id").orderBy(F.col("x1") + F.col("x2"), "x1", "y1")
    sized = every.withColumn("w", F.lead("x1").over(order) - F.col("x2")).groupBy(*keys, "side", "group_id").agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("hi"), F.min("w").alias("lo"), F.min("y1").alias("g1"), F.max("y2").alias("g2"))
    fine = sized.where(F.col("n").between(3, 4) & (F.col("hi") * 4 <= F.col("lo") * 5))
    other = prefixed(inner, "o_")
    crossed = fine.join(other, _same(keys, "o_") + [(F.least("o_y2", "g2") - F.greatest("o_y1", "g1")) * 5 > F.col("o_y2") - F.col("o_y1")]).select(*keys, "side", "group_id", *[F.col(f"o_{c}").alias(c) for c in _BOX])
    foreign = crossed.join(grouped, [*keys, "side", "group_id", *_BOX], "left_anti").select(*keys, "side", "group_id").distinct()
    return every.join(fine.join(foreign, [*keys, "side", "group_id"], "left_anti").select(*keys, "side", "group_id"), [*keys, "side", "group_id"], "left_semi")


def column_segments(groups: DataFrame, keys: list[str]) -> DataFrame:
    """Regions between neighbouring blanks of a group: from middle to middle, where both are."""
    by = Window.partitionBy(*keys, "side", "group_id").orderBy(F.col("x1") + F.col("x2"), "x1", "y1")
    mid = idiv(F.col("x1") + F.col("x2"), 2)
    nxt = groups.withColumns({"nx": F.lead(mid).over(by), "n1": F.lead("y1").over(by), "n2": F.lead("y2").over(by)}).where("nx is not null")
    return nxt.select(*keys, "side", "group_id", mid.cast("int").alias("x1"), F.greatest("y1", "n1").alias("y1"), F.col("nx").cast("int").alias("x2"), F.least("y2", "n2").alias("y2")).where("y2 > y1")
