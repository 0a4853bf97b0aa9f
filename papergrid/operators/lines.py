"""Ruled lines and text: noise, duplicates, and where rows and columns are implied by text boxes."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import Box, box, idiv, point_in
from .gaps import gap_scan, islands
from .overlap import crosses, line_crosses_text, prefixed, with_any


def drop_lines_in_text(lines: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Without lines whose both ends lie in one text box."""
    return with_any(lines, texts, keys, lambda a, b: point_in(a.x1, a.y1, b) & point_in(a.x2, a.y2, b), negate=True)


def drop_lines_through_text(lines: DataFrame, texts: DataFrame, keys: list[str], delta: int = 4) -> DataFrame:
    return with_any(lines, texts, keys, lambda a, b: line_crosses_text(a, b, delta), negate=True)


def connected_uprights(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Upright lines that meet any level one: a semi-join."""
    v, h = lines.where("orient = 'v'"), lines.where("orient = 'h'")
    return with_any(v, h.select(*keys, "x1", "y1", "x2", "y2"), keys, lambda a, b: crosses(a, b))


def remove_noise(lines: DataFrame, texts: DataFrame, keys: list[str], least: int) -> DataFrame:
    """Lines of at least ``least`` pixels that neither lie in a text box nor cross one; of equal lines one."""
    long = lines.where((F.col("x2") - F.col("x1") >= least) | (F.col("y2") - F.col("y1") >= least)).dropDuplicates([*keys, "orient", "x1", "y1", "x2", "y2"])
    return drop_lines_through_text(drop_lines_in_text(long, texts, keys), texts, keys)


def drop_duplicate_lines(lines: DataFrame, texts: DataFrame, keys: list[str], near: int = 50) -> DataFrame:
    """Of neighbouring level lines within ``near`` pixels that no text parts, the shorter goes (of equals the lower)."""
    by = Window.partitionBy(*keys).orderBy("y1", "x1", "x2")
    numbered = lines.withColumn("__n", F.row_number().over(by))
    nxt = {c: F.lead(c).over(by) for c in ("x1", "y1", "x2")}
    pairs = numbered.select(*keys, "__n", "x1", "y1", "x2", nxt["x1"].alias("nx1"), nxt["y1"].alias("ny1"), nxt["x2"].alias("nx2")).where(F.col("ny1").isNotNull() & (F.col("ny1") - F.col("y1") <= near))
    t = prefixed(texts.select(*keys, "x1", "y1", "x2", "y2"), "t_")
    parted = (F.col("t_y1") >= F.col("y1")) & (F.col("t_y2") <= F.col("ny1")) & (F.col("t_x1") < F.greatest("x2", "nx2")) & (F.col("t_x2") > F.least("x1", "nx1"))
    double = pairs.join(t, [F.col(k) == F.col(f"t_{k}") for k in keys] + [parted], "left_anti")
    shorter = F.when((F.col("nx2") - F.col("nx1")) > (F.col("x2") - F.col("x1")), F.col("__n")).otherwise(F.col("__n") + 1)
    gone = double.select(*keys, shorter.alias("__n")).distinct()
    return numbered.join(gone, [*keys, "__n"], "left_anti").select(lines.columns)


def text_lines(texts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Text boxes with their line: islands of overlapping y."""
    return islands(texts, keys, "y1", "y2", order, 0, "line_id")


def band_lines(texts: DataFrame, keys: list[str], order: list[str], gap: int = 2) -> DataFrame:
    """Text boxes with their line, where a box also goes on with the line that it starts at most ``gap`` below."""
    return islands(texts, keys, "y1", "y2", order, -(gap + 1), "line_id")


def row_separators(texts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The middle between each text line and the next: y."""
    lined = text_lines(texts, keys, order).groupBy(*keys, "line_id").agg(F.min("y1").alias("top"), F.max("y2").alias("bottom"))
    below = F.lead("top").over(Window.partitionBy(*keys).orderBy("line_id"))
    return lined.withColumn("below", below).where("below is not null").select(*keys, "line_id", idiv(F.col("bottom") + F.col("below"), 2).cast("int").alias("y"))


def inferred_rows(texts: DataFrame, lines: DataFrame, keys: list[str], order: list[str], gap: int = 2) -> DataFrame:
    """Row separators between text lines that have no ruled line (within ``gap``) between them yet."""
    lined = text_lines(texts, keys, order).groupBy(*keys, "line_id").agg(F.min("y1").alias("top"), F.max("y2").alias("bottom"), F.min("x1").alias("left"), F.max("x2").alias("right"))
    below = F.lead("top").over(Window.partitionBy(*keys).orderBy("line_id"))
    pairs = lined.withColumn("below", below).where("below is not null")
    ruled = prefixed(lines.where("orient = 'h'").select(*keys, "y1"), "h_")
    bare = pairs.join(ruled, [F.col(k) == F.col(f"h_{k}") for k in keys] + [F.col("h_y1").between(F.col("bottom") - gap, F.col("below") + gap)], "left_anti")
    y = idiv(F.col("bottom") + F.col("below"), 2).cast("int")
    return bare.select(*keys, F.lit("h").alias("orient"), F.col("left").alias("x1"), y.alias("y1"), F.col("right").alias("x2"), y.alias("y2"))


def wrap_lines(texts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Text lines with only one box whose text starts small: the line above goes on in them."""
    lined = text_lines(texts, keys, order)
    agg = lined.groupBy(*keys, "line_id").agg(F.count(F.lit(1)).alias("n"), F.min_by("text", F.struct("x1", "y1")).alias("first"))
    return agg.where((F.col("n") == 1) & F.rlike("first", F.lit("^[a-z]")) & (F.col("line_id") > 0)).select(*keys, "line_id")


def extend_uprights(lines: DataFrame, texts: DataFrame, keys: list[str]) -> DataFrame:
    """Upright lines drawn down to the nearest text box or level line below them (their own end without one)."""
    v = lines.where("orient = 'v'").select(*keys, "x1", "y1", "x2", "y2")
    stops = texts.select(*keys, "x1", "y1", "x2").unionByName(lines.where("orient = 'h'").select(*keys, "x1", "y1", "x2"))
    s = prefixed(stops, "s_")
    met = v.join(s, [F.col(k) == F.col(f"s_{k}") for k in keys] + [(F.col("s_x1") <= F.col("x1")) & (F.col("s_x2") >= F.col("x1")) & (F.col("s_y1") >= F.col("y2"))], "left")
    return met.groupBy(*keys, "x1", "y1", "x2", "y2").agg(F.coalesce(F.min("s_y1"), F.first("y2")).alias("end")).select(*keys, "x1", "y1", "x2", F.col("end").alias("y2"))


def align_left(lines: DataFrame, keys: list[str], slack: int = 10) -> DataFrame:
    """Level lines whose left end is within ``slack`` of the table's leftmost one begin there."""
    edge = F.min("x1").over(Window.partitionBy(*keys))
    return lines.withColumn("x1", F.when((F.col("orient") == "h") & (F.col("x1") - edge <= slack), edge).otherwise(F.col("x1")))


def align_right(lines: DataFrame, keys: list[str], slack: int = 10) -> DataFrame:
    edge = F.max("x2").over(Window.partitionBy(*keys))
    return lines.withColumn("x2", F.when((F.col("orient") == "h") & (edge - F.col("x2") <= slack), edge).otherwise(F.col("x2")))


def align_top(lines: DataFrame, keys: list[str], slack: int = 10) -> DataFrame:
    edge = F.min("y1").over(Window.partitionBy(*keys))
    return lines.withColumn("y1", F.when((F.col("orient") == "v") & (F.col("y1") - edge <= slack), edge).otherwise(F.col("y1")))


def align_bottom(lines: DataFrame, keys: list[str], slack: int = 10) -> DataFrame:
    edge = F.max("y2").over(Window.partitionBy(*keys))
    return lines.withColumn("y2", F.when((F.col("orient") == "v") & (edge - F.col("y2") <= slack), edge).otherwise(F.col("y2")))


def column_count(texts: DataFrame, keys: list[str], min_gap: int) -> DataFrame:
    """Columns of a key: gaps that all of its text leaves free, and one."""
    gaps = gap_scan(texts, keys, "x1", "x2", min_gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("g"))
    return texts.select(*keys).distinct().join(gaps, keys, "left").select(*keys, (F.coalesce("g", F.lit(0)) + 1).cast("int").alias("n_cols"))


def outer_box(b: Box, by: int) -> Box:
    return Box(b.x1 - by, b.y1 - by, b.x2 + by, b.y2 + by)


def inside_table(texts: DataFrame, tables: DataFrame, keys: list[str], slack: int = 0) -> DataFrame:
    """Text boxes that lie in a table of their page."""
    return with_any(texts, tables, keys, lambda t, b: (b.x1 - slack <= t.x1) & (b.y1 - slack <= t.y1) & (b.x2 + slack >= t.x2) & (b.y2 + slack >= t.y2))


def enclosing_box(texts: DataFrame, keys: list[str]) -> DataFrame:
    b = box()
    return texts.groupBy(*keys).agg(F.min(b.x1).alias("x1"), F.min(b.y1).alias("y1"), F.max(b.x2).alias("x2"), F.max(b.y2).alias("y2"))
