"""A table's frame and the lines that end at it: outer edges, borders that text implies, uprights drawn to level lines, half-bordered tables, implied rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, box, idiv, intersection
from .gaps import gap_scan
from .lines import drop_duplicate_lines
from .overlap import line_crosses_text, prefixed, with_any

#: A line's end is at an edge within this distance; a text stands clear of an upright by this much.
END_SLACK, CLEAR = 4, 2
SIDES = (("left", "v", "x1"), ("right", "v", "x1"), ("top", "h", "y1"), ("bottom", "h", "y1"))


def _same(keys: list[str], p: str) -> list[Column]:
    return [F.col(k) == F.col(f"{p}{k}") for k in keys]


def swapped(rows: DataFrame) -> DataFrame:
    """Boxes or lines with their axes exchanged."""
    turn = {"x1": "y1", "y1": "x1", "x2": "y2", "y2": "x2"}
    kept = [F.when(F.col("orient") == "h", "v").when(F.col("orient") == "v", "h").otherwise(F.col("orient")).alias(c) if c == "orient" else F.col(turn.get(c, c)).alias(c) for c in rows.columns]
    return rows.select(*kept)


def drop_duplicate_uprights(lines: DataFrame, texts: DataFrame, keys: list[str], near: int = 50) -> DataFrame:
    """Of neighbouring upright lines within ``near`` pixels that no text parts, the shorter goes (of equals the right one)."""
    return swapped(drop_duplicate_lines(swapped(lines), swapped(texts.select(*keys, "x1", "y1", "x2", "y2")), keys, near))


def lines_in_boxes(lines: DataFrame, boxes: DataFrame, keys: list[str]) -> DataFrame:
    """Lines that lie wholly in some box of their key, such as a gap between cells."""
    return with_any(lines, boxes.select(*keys, "x1", "y1", "x2", "y2"), keys, lambda a, b: (b.x1 <= a.x1) & (a.x2 <= b.x2) & (b.y1 <= a.y1) & (a.y2 <= b.y2))


def frame_edges(lines: DataFrame, texts: DataFrame, frames: DataFrame, keys: list[str]) -> DataFrame:
    """Per key and side: ``ruled`` (its outermost line, null without any), ``edge`` and ``added``.

    The edge is the outermost line, or the frame's where a text's middle lies between
    the two, or where there is no line on that axis; then a border is added there.
    """
    v, h = F.col("orient") == "v", F.col("orient") == "h"
    outer = lines.groupBy(*keys).agg(F.min(F.when(v, F.col("x1"))).alias("r_left"), F.max(F.when(v, F.col("x1"))).alias("r_right"), F.min(F.when(h, F.col("y1"))).alias("r_top"), F.max(F.when(h, F.col("y1"))).alias("r_bottom"))
    known = frames.select(*keys, F.col("x1").alias("f_left"), F.col("x2").alias("f_right"), F.col("y1").alias("f_top"), F.col("y2").alias("f_bottom")).join(outer, keys, "left")
    t = texts.select(*[F.col(k).alias(f"t_{k}") for k in keys], (F.col("x1") + F.col("x2")).alias("mx"), (F.col("y1") + F.col("y2")).alias("my"))
    met = known.join(t, _same(keys, "t_"), "left")
    between = lambda m, s: F.coalesce((F.col(m) > F.least(f"r_{s}", f"f_{s}") * 2) & (F.col(m) < F.greatest(f"r_{s}", f"f_{s}") * 2), F.lit(False))
    names = [c for c in known.columns if c not in keys]
    flags = met.groupBy(*keys, *names).agg(*[F.bool_or(between("mx" if o == "v" else "my", s)).alias(f"b_{s}") for s, o, _ in SIDES])
    side = lambda s: F.struct(F.lit(s).alias("side"), F.col(f"r_{s}").alias("ruled"), F.when(F.col(f"r_{s}").isNull() | F.col(f"b_{s}"), F.col(f"f_{s}")).otherwise(F.col(f"r_{s}")).alias("edge"), (F.col(f"r_{s}").isNull() | F.col(f"b_{s}")).alias("added"))
    return flags.select(*keys, F.explode(F.array(*[side(s) for s, *_ in SIDES])).alias("e")).select(*keys, "e.side", "e.ruled", "e.edge", "e.added")


def frame_box(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The four edges of a key as one box."""
    at = lambda s, n: F.max(F.when(F.col("side") == s, F.col("edge"))).alias(n)
    return edges.groupBy(*keys).agg(at("left", "x1"), at("top", "y1"), at("right", "x2"), at("bottom", "y2"))


def added_borders(edges: DataFrame, keys: list[str]) -> DataFrame:
    """The borders that text beyond the ruled lines implies, from edge to edge."""
    b = prefixed(frame_box(edges, keys), "f_")
    met = edges.where("added").join(b, _same(keys, "f_"))
    upright = F.col("side").isin("left", "right")
    pick = lambda on_v, on_h: F.when(upright, on_v).otherwise(on_h)
    return met.select(*keys, "side", pick(F.lit("v"), F.lit("h")).alias("orient"), pick(F.col("edge"), F.col("f_x1")).alias("x1"), pick(F.col("f_y1"), F.col("edge")).alias("y1"), pick(F.col("edge"), F.col("f_x2")).alias("x2"), pick(F.col("f_y2"), F.col("edge")).alias("y2"))


def framed_lines(lines: DataFrame, texts: DataFrame, edges: DataFrame, keys: list[str]) -> DataFrame:
    """Lines whose ends at the outermost ruled line are drawn to the edge; to an added edge only where the longer line crosses no text."""
    wide = edges.groupBy(*[F.col(k).alias(f"e_{k}") for k in keys]).agg(*[F.max(F.when(F.col("side") == s, F.struct("ruled", "edge", "added"))).alias(s) for s, *_ in SIDES])
    own = lines.select(*keys, "orient", "x1", "y1", "x2", "y2").withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy("orient", "x1", "y1", "x2", "y2")))
    now = own.join(wide, _same(keys, "e_"), "left")
    t = prefixed(texts.select(*keys, "x1", "y1", "x2", "y2"), "t_")
    for side, orient, end in (("left", "h", "x1"), ("right", "h", "x2"), ("top", "v", "y1"), ("bottom", "v", "y2")):
        at = F.coalesce((F.col("orient") == orient) & (F.abs(F.col(end) - F.col(f"{side}.ruled")) < END_SLACK), F.lit(False))
        now = now.withColumn("__to", F.when(at, F.col(f"{side}.edge")).otherwise(F.col(end)))
        longer = box()._replace(**{end: F.col("__to")})
        barred = now.where(at & F.col(f"{side}.added")).join(t, _same(keys, "t_") + [line_crosses_text(longer, box("t_"), 0)], "left_semi").select(*keys, "__n", F.lit(True).alias("__bar"))
        now = now.join(barred, [*keys, "__n"], "left").withColumn(end, F.when(F.col("__bar").isNull(), F.col("__to")).otherwise(F.col(end))).drop("__bar", "__to")
    return now.select(*keys, "orient", "x1", "y1", "x2", "y2")


def drawn_uprights(lines: DataFrame, texts: DataFrame, keys: list[str], slack: int = END_SLACK) -> DataFrame:
    """Upright lines with each end at the farthest level line that is at it (within ``slack``), or that it reaches without crossing text and with a text box wholly between it and the upright before."""
    by = Window.partitionBy(*keys).orderBy("x1", "y1", "y2")
    v = lines.where("orient = 'v'").select(*keys, "x1", "y1", "x2", "y2").withColumn("__n", F.row_number().over(by)).withColumn("__left", F.lag("x1").over(by))
    h = lines.where("orient = 'h'").select(*[F.col(k).alias(f"h_{k}") for k in keys], F.col("y1").alias("h_y")).distinct()
    t = prefixed(texts.select(*keys, "x1", "y1", "x2", "y2"), "t_")
    out = v
    for end, best in (("y1", F.min), ("y2", F.max)):
        lo, hi = (F.col("h_y"), F.col("y1")) if end == "y1" else (F.col("y2"), F.col("h_y"))
        met = v.select(*keys, "__n", "__left", "x1", "y1", "y2").join(h, _same(keys, "h_"))
        at = met.where(F.abs(F.col("h_y") - F.col(end)) <= slack)
        way = met.where((lo < hi) & (F.col("__left") < F.col("x1")) & (F.abs(F.col("h_y") - F.col(end)) > slack))
        crossed = (F.col("t_x1") + slack < F.col("x1")) & (F.col("t_x2") - slack > F.col("x1")) & (F.col("t_y1") < hi) & (F.col("t_y2") > lo)
        inside = (F.col("t_x1") >= F.col("__left")) & (F.col("t_x2") <= F.col("x1")) & (F.col("t_y1") >= lo) & (F.col("t_y2") <= hi)
        way = way.join(t, _same(keys, "t_") + [crossed], "left_anti").join(t, _same(keys, "t_") + [inside], "left_semi")
        goal = at.select(*keys, "__n", "h_y").unionByName(way.select(*keys, "__n", "h_y")).groupBy(*keys, "__n").agg(best("h_y").alias(f"to_{end}"))
        out = out.join(goal, [*keys, "__n"], "left")
    return out.select(*keys, "x1", F.coalesce("to_y1", "y1").alias("y1"), "x2", F.coalesce("to_y2", "y2").alias("y2"))


def stretched_uprights(lines: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Upright lines drawn both ways: to the last level line before the nearest text in their way (without one, half the text's height off it), else to the outermost level line."""
    v = lines.where("orient = 'v'").select(*keys, "x1", "y1", "x2", "y2").distinct()
    h = lines.where("orient = 'h'").select(*[F.col(k).alias(f"h_{k}") for k in keys], F.col("y1").alias("h_y")).distinct()
    reach = h.groupBy(*[f"h_{k}" for k in keys]).agg(F.min("h_y").alias("top"), F.max("h_y").alias("bottom"))
    t = prefixed(texts.select(*keys, "x1", "y1", "x2", "y2"), "t_")
    across = (F.col("t_x1") + CLEAR <= F.col("x1")) & (F.col("t_x2") - CLEAR >= F.col("x1"))
    id_ = [*keys, "x1", "y1", "x2", "y2"]
    below, above = across & (F.col("t_y1") > F.col("y1")), across & (F.col("t_y2") < F.col("y2"))
    near = v.join(t, _same(keys, "t_") + [below | above], "left").groupBy(*id_).agg(F.min(F.when(below, F.struct("t_y1", "t_y2"))).alias("b"), F.max(F.when(above, F.struct("t_y2", "t_y1"))).alias("a"))
    met = near.join(h, _same(keys, "h_"), "left")
    stop = met.groupBy(*id_, "a", "b").agg(F.max(F.when((F.col("h_y") <= F.col("b.t_y1")) & (F.col("h_y") >= F.col("y2")), F.col("h_y"))).alias("hb"), F.min(F.when((F.col("h_y") >= F.col("a.t_y2")) & (F.col("h_y") <= F.col("y1")), F.col("h_y"))).alias("ha"))
    whole = stop.join(reach, _same(keys, "h_"), "left")
    half = lambda e: idiv(F.abs(F.col(f"{e}.t_y2") - F.col(f"{e}.t_y1")), 2)
    y2 = F.when(F.col("y2") < F.col("bottom"), F.when(F.col("b").isNull(), F.col("bottom")).otherwise(F.coalesce("hb", F.col("b.t_y1") - half("b")))).otherwise(F.col("y2"))
    y1 = F.when(F.col("y1") > F.col("top"), F.when(F.col("a").isNull(), F.col("top")).otherwise(F.coalesce("ha", F.col("a.t_y2") + half("a")))).otherwise(F.col("y1"))
    return whole.select(*keys, "x1", y1.cast("int").alias("y1"), "x2", y2.cast("int").alias("y2"))


def cluster_lines(cells: DataFrame, lines: DataFrame, keys: list[str]) -> DataFrame:
    """Lines within 5 % of the table's size of some edge of its cells."""
    size = cells.groupBy(*[F.col(k).alias(f"s_{k}") for k in keys]).agg((F.max("x2") - F.min("x1")).alias("w"), (F.max("y2") - F.min("y1")).alias("h"))
    edge = lambda o, a: F.struct(F.lit(o).alias("o"), F.col(a).alias("at"))
    edges = cells.select(*[F.col(k).alias(f"c_{k}") for k in keys], F.explode(F.array(edge("h", "y1"), edge("h", "y2"), edge("v", "x1"), edge("v", "x2"))).alias("e")).select(*[f"c_{k}" for k in keys], "e.o", "e.at").distinct()
    near = F.when(F.col("orient") == "h", F.abs(F.col("y1") - F.col("at")) * 20 <= F.col("h")).otherwise(F.abs(F.col("x1") - F.col("at")) * 20 <= F.col("w"))
    return lines.join(size, _same(keys, "s_")).join(edges, _same(keys, "c_") + [F.col("orient") == F.col("o"), near], "left_semi").select(lines.columns)


def cluster_bounds(cells: DataFrame, lines: DataFrame, keys: list[str], char: int) -> DataFrame:
    """A table's box where its lines may reach past its cells: a side goes to the lines' farthest end if the first and the last line of that axis end there
    (within 5 % of their extent) and it is over two characters from the cells."""
    own = cluster_lines(cells, lines, keys)
    box_ = cells.groupBy(*keys).agg(*[f(c).alias(f"c_{c}") for f, c in ((F.min, "x1"), (F.min, "y1"), (F.max, "x2"), (F.max, "y2"))])
    for orient, lo, hi, order in (("h", "x1", "x2", ("y1", "x1", "x2")), ("v", "y1", "y2", ("x1", "y1", "y2"))):
        some = own.where(F.col("orient") == orient)
        rank = F.struct(*order)
        agg = some.groupBy(*keys).agg(F.min(lo).alias(f"l_{lo}"), F.max(hi).alias(f"l_{hi}"), F.min_by(F.struct(lo, hi), rank).alias(f"first_{orient}"), F.max_by(F.struct(lo, hi), rank).alias(f"last_{orient}"))
        box_ = box_.join(agg, keys, "left")

    def side(end: str, orient: str, lo: str, hi: str, sign: int) -> Column:
        extent = F.col(f"l_{hi}") - F.col(f"l_{lo}")
        at = lambda which: (F.col(f"{which}_{orient}.{end}") - F.col(f"l_{end}")) * sign * 20 <= extent
        far = (F.col(f"c_{end}") - F.col(f"l_{end}")) * sign > 2 * char
        return F.when(at("first") & at("last") & far, F.col(f"l_{end}")).otherwise(F.col(f"c_{end}")).alias(end)

    return box_.select(*keys, side("x1", "h", "x1", "x2", 1), side("y1", "v", "y1", "y2", 1), side("x2", "h", "x1", "x2", -1), side("y2", "v", "y1", "y2", -1))


def semi_bordered_cells(cells: DataFrame, lines: DataFrame, keys: list[str], char: int, share: float = 0.5) -> DataFrame:
    """Cells that ruled lines imply in a table's outer strips, without those that its own cells (or larger new ones) cover by ``share`` of the smaller."""
    own, bounds = cluster_lines(cells, lines, keys), cluster_bounds(cells, lines, keys, char)
    every = bounds.select(*keys, "x1", "y1", "x2", "y2").unionByName(cells.select(*keys, "x1", "y1", "x2", "y2"))
    edges = every.groupBy(*keys).agg(F.sort_array(F.array_union(F.collect_set("x1"), F.collect_set("x2"))).alias("xs"), F.sort_array(F.array_union(F.collect_set("y1"), F.collect_set("y2"))).alias("ys"))
    strips = edges.join(bounds, keys)
    at = lambda es, i: F.element_at(es, i)
    strip = lambda orient, a, b, lo, hi: F.struct(F.lit(orient).alias("o"), a.alias("a"), b.alias("b"), F.col(lo).alias("lo"), F.col(hi).alias("hi"))
    each = strips.where((F.size("xs") > 1) & (F.size("ys") > 1)).select(*keys, F.explode(F.array(strip("h", at("xs", 1), at("xs", 2), "y1", "y2"), strip("h", at("xs", -2), at("xs", -1), "y1", "y2"), strip("v", at("ys", 1), at("ys", 2), "x1", "x2"), strip("v", at("ys", -2), at("ys", -1), "x1", "x2"))).alias("s")).select(*keys, "s.*").distinct()
    l = own.select(*[F.col(k).alias(f"l_{k}") for k in keys], "orient", F.when(F.col("orient") == "h", F.col("x1")).otherwise(F.col("y1")).alias("p"), F.when(F.col("orient") == "h", F.col("x2")).otherwise(F.col("y2")).alias("q"), F.when(F.col("orient") == "h", F.col("y1")).otherwise(F.col("x1")).alias("cut"))  # noqa: E741
    spans = (F.least("q", "b") - F.greatest("p", "a")) * 10 >= (F.col("b") - F.col("a")) * 9
    cuts = each.join(l, _same(keys, "l_") + [F.col("o") == F.col("orient"), spans]).select(*keys, "o", "a", "b", "cut")
    ends = each.select(*keys, "o", "a", "b", F.explode(F.array("lo", "hi")).alias("cut"))
    following = F.lead("cut").over(Window.partitionBy(*keys, "o", "a", "b").orderBy("cut"))
    parts = cuts.unionByName(ends).distinct().withColumn("to", following).where("to > cut and b > a")
    pick = lambda on_h, on_v: F.when(F.col("o") == "h", F.col(on_h)).otherwise(F.col(on_v))
    new = parts.select(*keys, pick("a", "cut").alias("x1"), pick("cut", "a").alias("y1"), pick("b", "to").alias("x2"), pick("to", "b").alias("y2")).distinct()
    covered = lambda a, b: intersection(a, b) >= F.lit(share) * F.least(area(a), area(b))
    free = with_any(new, cells.select(*keys, "x1", "y1", "x2", "y2"), keys, covered, negate=True)
    other = lambda a, b: covered(a, b) & (area(a) <= area(b)) & ~((a.x1 == b.x1) & (a.y1 == b.y1) & (a.x2 == b.x2) & (a.y2 == b.y2))
    return with_any(free, free, keys, other, negate=True)


def implicit_rows(texts: DataFrame, lines: DataFrame, tables: DataFrame, keys: list[str]) -> DataFrame:
    """Level lines across a table in the middle of each blank band that its text leaves and no level line is in: of bands half as tall as the lower middle one or more (of three or more)."""
    bands = gap_scan(texts, keys, "y1", "y2", 1).select(*keys, "first", "last", (F.col("last") - F.col("first") + 1).alias("tall"))
    usual = bands.groupBy(*[F.col(k).alias(f"u_{k}") for k in keys]).agg(F.sort_array(F.collect_list("tall")).alias("ts"))
    least = F.when(F.size("ts") >= 3, F.element_at("ts", F.floor((F.size("ts") + 1) / 2).cast("int"))).otherwise(F.lit(0))
    tall = bands.join(usual, _same(keys, "u_")).where(F.col("tall") * 2 >= least)
    h = lines.where("orient = 'h'").select(*[F.col(k).alias(f"h_{k}") for k in keys], F.col("y1").alias("h_y"))
    bare = tall.join(h, _same(keys, "h_") + [F.col("h_y").between(F.col("first") - 1, F.col("last") + 1)], "left_anti")
    t = prefixed(tables.select(*keys, "x1", "x2"), "t_")
    y = idiv(F.col("first") + F.col("last"), 2).cast("int")
    return bare.join(t, _same(keys, "t_")).select(*keys, F.lit("h").alias("orient"), F.col("t_x1").alias("x1"), y.alias("y1"), F.col("t_x2").alias("x2"), y.alias("y2"))
