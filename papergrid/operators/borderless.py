"""Tables without ruled lines, and lines that text implies: columns, rows, outer cells, whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import area, box, box_of, intersection
from ..shared import materialised
from .gaps import gap_scan, islands
from .grid import grid_from_lines
from .lines import row_separators
from .overlap import prefixed
from .stats import grid_coherence


def dedup_whitespace(spaces: DataFrame, keys: list[str], elements: DataFrame | None = None) -> DataFrame:
    """Of upright blanks that share an edge and a stretch of y, with no element between, the taller stays; equally tall ones become one."""
    by = Window.partitionBy(*keys).orderBy("x1", "y1", "x2", "y2")
    n = spaces.withColumn("__n", F.row_number().over(by))
    a, b = box("a_"), box("b_")
    meet = ((a.x2 == b.x1) | (b.x2 == a.x1)) & (F.least(a.y2, b.y2) > F.greatest(a.y1, b.y1))
    pairs = prefixed(n, "a_").join(prefixed(n, "b_"), [F.col(f"a_{k}") == F.col(f"b_{k}") for k in keys] + [meet & (F.col("a___n") != F.col("b___n"))])
    if elements is not None:
        e = prefixed(elements.select(*keys, "x1", "y1", "x2", "y2"), "e_")
        between = (F.col("e_x1") < F.greatest(a.x2, b.x2)) & (F.col("e_x2") > F.least(a.x1, b.x1)) & (F.col("e_y1") < F.least(a.y2, b.y2)) & (F.col("e_y2") > F.greatest(a.y1, b.y1))
        pairs = pairs.join(e, [F.col(f"a_{k}") == F.col(f"e_{k}") for k in keys] + [between], "left_anti")
    ha, hb = a.y2 - a.y1, b.y2 - b.y1
    gone = pairs.where((ha < hb) | ((ha == hb) & (F.col("a___n") > F.col("b___n")))).select(*[F.col(f"a_{k}").alias(k) for k in keys], F.col("a___n").alias("__n")).distinct()
    twins = pairs.where((ha == hb) & (F.col("a___n") < F.col("b___n"))).groupBy(*[F.col(f"a_{k}").alias(k) for k in keys], F.col("a___n").alias("__n")).agg(F.min("b_x1").alias("tx1"), F.max("b_x2").alias("tx2"))
    left = n.join(gone, [*keys, "__n"], "left_anti").join(twins, [*keys, "__n"], "left")
    return left.select(*keys, F.least("x1", F.coalesce("tx1", "x1")).alias("x1"), "y1", F.greatest("x2", F.coalesce("tx2", "x2")).alias("x2"), "y2")


def dedup_tables(tables: DataFrame, keys: list[str], ident: str, share: float = 0.1) -> DataFrame:
    """Largest first; a table goes if it and a kept one cover ``share`` of either. ``pos`` counts the kept ones."""
    item = F.struct((-area(box())).alias("a"), F.col(ident).alias("i"), "x1", "y1", "x2", "y2")
    pages = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("ts"))

    def step(kept, t):
        hit = F.exists(kept, lambda k: (intersection(box_of(k), box_of(t)) >= F.lit(share) * area(box_of(t))) | (intersection(box_of(k), box_of(t)) >= F.lit(share) * area(box_of(k))))
        return F.when(hit, kept).otherwise(F.concat(kept, F.array(t)))

    kept = pages.withColumn("ts", F.aggregate("ts", F.filter("ts", lambda _: F.lit(False)), step))
    return kept.select(*keys, F.posexplode("ts").alias("pos", "t")).select(*keys, "pos", F.col("t.i").alias(ident), "t.x1", "t.y1", "t.x2", "t.y2")


def merge_positions(ruled: DataFrame, detected: DataFrame, texts: DataFrame, keys: list[str], least: int = 4) -> DataFrame:
    """Positions of columns: the upright lines' (x1, y1, y2), and where these are fewer than the detected ones, of those each that is
    ``least`` or more from a line beside it, with a text box wholly between the two. ``ruled`` tells which."""
    lines = ruled.groupBy(*keys, F.col("x1").alias("position")).agg(F.min_by("y1", F.struct("y1", "y2")).alias("y1"), F.min_by("y2", F.struct("y1", "y2")).alias("y2"))
    found = detected.select(*keys, "position").distinct().join(lines.select(*keys, "position"), [*keys, "position"], "left_anti")
    count = lambda df, name: df.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))
    more = count(detected.select(*keys, "position").distinct(), "__d").join(count(lines, "__r"), keys, "left").where("__d > coalesce(__r, 0)").select(*keys)
    every = lines.withColumn("ruled", F.lit(True)).unionByName(found.join(more, keys, "left_semi").select(*keys, "position", F.lit(None).cast("int").alias("y1"), F.lit(None).cast("int").alias("y2"), F.lit(False).alias("ruled")))
    by = Window.partitionBy(*keys).orderBy("position")
    own = F.when(F.col("ruled"), F.struct("position", "y1", "y2"))
    beside = every.withColumns({"__l": F.lag(own).over(by), "__n": F.lead(own).over(by)})
    t = prefixed(texts.select(*keys, "x1", "y1", "x2", "y2"), "t_")
    met = beside.where("not ruled").join(t, [F.col(k) == F.col(f"t_{k}") for k in keys], "left")
    between = lambda line, a, b: F.bool_or((F.col("t_x1") >= a) & (F.col("t_x2") <= b) & (F.col("t_y1") >= F.col(f"{line}.y1")) & (F.col("t_y2") <= F.col(f"{line}.y2")))
    told = met.groupBy(*keys, "position", "__l", "__n").agg(between("__l", F.col("__l.position"), F.col("position")).alias("a"), between("__n", F.col("position"), F.col("__n.position")).alias("b"))
    fine = lambda line, has: F.col(line).isNull() | ((F.abs(F.col(f"{line}.position") - F.col("position")) >= least) & F.coalesce(has, F.lit(False)))
    kept = told.where(fine("__l", F.col("a")) & fine("__n", F.col("b")))
    return lines.select(*keys, "position", F.lit(True).alias("ruled")).unionByName(kept.select(*keys, "position", F.lit(False).alias("ruled")))


def implied_lines(texts: DataFrame, keys: list[str], order: list[str], min_gap: int, margin: int = 4) -> DataFrame:
    """The ruled lines that text alone implies: an outer box ``margin`` around it, a line in each gap of x that all of it leaves, and between its lines."""
    b = texts.groupBy(*keys).agg(F.min("x1").alias("l"), F.min("y1").alias("t"), F.max("x2").alias("r"), F.max("y2").alias("m"))
    b = b.select(*keys, (F.col("l") - margin).alias("l"), (F.col("t") - margin).alias("t"), (F.col("r") + margin).alias("r"), (F.col("m") + margin).alias("m"))
    line = lambda o, x1, y1, x2, y2: F.struct(F.lit(o).alias("orient"), *[(F.col(c) if isinstance(c, str) else c).alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"))])
    outer = b.select(*keys, F.explode(F.array(line("h", "l", "t", "r", "t"), line("h", "l", "m", "r", "m"), line("v", "l", "t", "l", "m"), line("v", "r", "t", "r", "m"))).alias("e")).select(*keys, "e.*")
    cols = gap_scan(texts, keys, "x1", "x2", min_gap).join(b, keys).select(*keys, F.lit("v").alias("orient"), F.col("centre").alias("x1"), F.col("t").alias("y1"), F.col("centre").alias("x2"), F.col("m").alias("y2"))
    rows = row_separators(texts, keys, order).join(b, keys).select(*keys, F.lit("h").alias("orient"), F.col("l").alias("x1"), F.col("y").alias("y1"), F.col("r").alias("x2"), F.col("y").alias("y2"))
    return outer.unionByName(cols).unionByName(rows)


def borderless_grid(texts: DataFrame, keys: list[str], order: list[str], min_gap: int, char_width: int, line_sep: int, least_cols: int = 3, least_rows: int = 2) -> DataFrame:
    """A grid from text alone: kept with enough columns and rows, a row distance of a third of the line distance, and columns three characters wide (in the middle)."""
    g = materialised(grid_from_lines(implied_lines(texts, keys, order, min_gap), keys), "implied-grid")
    size = g.groupBy(*keys).agg((F.max("row_id") + 1).alias("rows"), (F.max("col_id") + 1).alias("cols"))
    fine = grid_coherence(g, keys, "row_id", "col_id").join(size, keys)
    fine = fine.where((F.col("rows") >= least_rows) & (F.col("cols") >= least_cols) & (F.col("row_step") * 3 >= line_sep) & (F.col("col_width2") >= 6 * char_width))
    return g.join(fine.select(*keys), keys, "left_semi")


def coherent_rows(grid: DataFrame, texts: DataFrame, keys: list[str], least: int = 2) -> DataFrame:
    """The grid between its first and last row in which at least ``least`` slots hold half of some text; grids without such a row go."""
    t = prefixed(texts.select(*keys, "x1", "y1", "x2", "y2"), "t_")
    half = intersection(box("t_"), box()) * 2 >= area(box("t_"))
    hits = grid.where("x2 > x1").join(t, [F.col(k) == F.col(f"t_{k}") for k in keys] + [half], "left_semi").groupBy(*keys, "row_id").agg(F.countDistinct("col_id").alias("n")).where(F.col("n") >= least)
    span = hits.groupBy(*keys).agg(F.min("row_id").alias("lo"), F.max("row_id").alias("hi"))
    left = grid.join(span, keys).where("row_id between lo and hi")
    return left.select(*keys, (F.col("row_id") - F.col("lo")).alias("row_id"), "col_id", "x1", "y1", "x2", "y2")


def outer_cells(cells: DataFrame, lines: DataFrame, keys: list[str], share: float = 0.9) -> DataFrame:
    """Cells that level lines imply left and right of a table: strips between neighbouring lines that reach past it by 5 % of its width or more."""
    b = cells.groupBy(*keys).agg(F.min("x1").alias("cl"), F.max("x2").alias("cr"), F.min("y1").alias("ct"), F.max("y2").alias("cb"))
    h = lines.where("orient = 'h'").join(b, keys).where((F.col("y1") >= F.col("ct") - 5) & (F.col("y1") <= F.col("cb") + 5))
    out = []
    for reach, inner, name in ((F.col("x1"), F.col("cl"), "left"), (F.col("x2"), F.col("cr"), "right")):
        past = (inner - reach if name == "left" else reach - inner) * 20 >= F.col("cr") - F.col("cl")
        own = h.where(past).withColumn("edge", (F.max(reach) if name == "left" else F.min(reach)).over(Window.partitionBy(*keys)))
        nxt = F.lead("y1").over(Window.partitionBy(*keys).orderBy("y1"))
        strip = own.withColumn("below", nxt).where("below is not null and below > y1")
        x1, x2 = (F.col("edge"), inner) if name == "left" else (inner, F.col("edge"))
        out.append(strip.select(*keys, F.lit(name).alias("side"), x1.alias("x1"), "y1", x2.alias("x2"), F.col("below").alias("y2")).where("x2 > x1"))
    return out[0].unionByName(out[1])


def snap_uprights(lines: DataFrame, texts: DataFrame, keys: list[str], near: int = 12) -> DataFrame:
    """Upright lines with both ends drawn to the nearest level line within ``near`` that crosses their x, unless the way there crosses text."""
    by = Window.partitionBy(*keys).orderBy("x1", "y1", "y2")
    v = lines.where("orient = 'v'").select(*keys, "x1", "y1", "x2", "y2").withColumn("__n", F.row_number().over(by))
    h = prefixed(lines.where("orient = 'h'").select(*keys, "x1", "y1", "x2"), "h_")
    at = (F.col("h_x1") <= F.col("x1") + 2) & (F.col("h_x2") >= F.col("x1") - 2)
    met = v.join(h, [F.col(k) == F.col(f"h_{k}") for k in keys] + [at & ((F.abs(F.col("h_y1") - F.col("y1")) <= near) | (F.abs(F.col("h_y1") - F.col("y2")) <= near))], "left")
    best = lambda end: F.min(F.when(F.abs(F.col("h_y1") - F.col(end)) <= near, F.struct(F.abs(F.col("h_y1") - F.col(end)).alias("f"), F.col("h_y1").alias("y"))))["y"]
    ends = met.groupBy(*keys, "__n", "x1", "y1", "x2", "y2").agg(best("y1").alias("top"), best("y2").alias("bottom"))
    t = prefixed(texts.select(*keys, "x1", "y1", "x2", "y2"), "t_")
    for end, goal in (("y1", "top"), ("y2", "bottom")):
        way = (F.col("t_x1") < F.col("x1")) & (F.col("t_x2") > F.col("x1")) & (F.col("t_y1") < F.greatest(end, goal)) & (F.col("t_y2") > F.least(end, goal))
        barred = ends.join(t, [F.col(k) == F.col(f"t_{k}") for k in keys] + [way], "left_semi").select(*keys, "__n", F.lit(True).alias(f"bar_{goal}"))
        ends = ends.join(barred, [*keys, "__n"], "left")
    pick = lambda end, goal: F.when(F.col(f"bar_{goal}").isNull(), F.coalesce(goal, end)).otherwise(F.col(end)).alias(end)
    return ends.select(*keys, "x1", pick("y1", "top"), "x2", pick("y2", "bottom"))


def split_regions(boxes: DataFrame, keys: list[str], gap_x: int, gap_y: int, least_width: int, least_height: int) -> DataFrame:
    """Table regions of a picture: bands parted by blank rows of over ``gap_y``, each parted by blank columns of over ``gap_x``; none for a key with a part that is too small."""
    bands = islands(boxes, keys, "y1", "y2", [], -(gap_y + 1), "band_id")
    parts = islands(bands, [*keys, "band_id"], "x1", "x2", [], -(gap_x + 1), "part_id")
    regions = parts.groupBy(*keys, "band_id", "part_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"))
    small = regions.where((F.col("x2") - F.col("x1") < least_width) | (F.col("y2") - F.col("y1") < least_height)).select(*keys).distinct()
    return regions.join(small, keys, "left_anti")


def dispatch(bordered: DataFrame, borderless: DataFrame, keys: list[str]) -> DataFrame:
    """Bordered tables; where a key has none, the borderless ones. ``borderless`` tells which."""
    none = borderless.join(bordered.select(*keys).distinct(), keys, "left_anti")
    return bordered.withColumn("borderless", F.lit(False)).unionByName(none.withColumn("borderless", F.lit(True)))


def column_sections(gaps: DataFrame, keys: list[str], least: int = 3, most: int = 4, ratio: float = 1.25) -> DataFrame:
    """Keys whose blanks part them into columns of text: between ``least`` and ``most`` blanks, and columns of like width."""
    by = Window.partitionBy(*keys).orderBy("centre")
    w = gaps.withColumn("w", F.lead("centre").over(by) - F.col("centre"))
    agg = w.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.max("w").alias("hi"), F.min("w").alias("lo"))
    return agg.where(F.col("n").between(least, most) & (F.col("hi") <= F.lit(ratio) * F.col("lo"))).select(*keys, "n")
