"""Findings of round 3: rows and memory that grew with something else than the input."""

import base64
import random

import numpy as np
from pyspark.sql import functions as F

from papergrid.functions import geometry as G
from papergrid.functions import text as X
from papergrid.operators import batched, gaps, glyphs, grid, overlap, raster, text, whitespace
from papergrid.shared import materialised
from papergrid.sources import derive as D


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_runs_of_boxes_are_those_of_their_pixels(spark):
    boxes = [(k, 0, y, 1 + (y * 7 + k) % 11, y + h) for k in range(4) for y, h in ((0, 3), (3, 2), (10, 4), (11, 1), (15, 0), (20, 5), (26, 1), (40 + k, 9))]
    df = spark.createDataFrame(boxes, "k long, x1 int, y1 int, x2 int, y2 int")
    for tolerance in (0, 1, 5):
        plain = gaps.filled_runs(gaps.coverage_histogram(df, ["k"], "y1", "y2", F.col("x2") - F.col("x1")), ["k"], "at", tolerance)
        assert rows(gaps.box_runs(df, ["k"], "y1", "y2", F.col("x2") - F.col("x1"), tolerance)) == rows(plain)


def test_runs_do_not_grow_with_pixels(spark):
    df = spark.createDataFrame([(1, 0, 0, 2, 2_000_000_000)], "k long, x1 int, y1 int, x2 int, y2 int")
    assert rows(gaps.box_runs(df, ["k"], "y1", "y2", F.col("x2") - F.col("x1"), 5)) == [(1, 0, 0, 1_999_999_999, 4_000_000_000)]


def test_data_uri_of_long_content(spark):
    df = spark.createDataFrame([(bytearray(range(200)), "a.png")], "c binary, p string").select(X.data_uri(F.col("c"), F.col("p")).alias("u"), F.col("c"))
    r = df.select("u", X.from_data_uri(F.col("u")).alias("back"), "c").first()
    assert r.u == "data:image/png;base64," + base64.b64encode(bytes(range(200))).decode() and r.back == r.c


def test_tables_that_compress_well_are_not_broadcast(spark):
    """1.2 million equal boxes are a file of some KB, so Spark would send them to the driver."""
    a = materialised(spark.range(1_200_000, numPartitions=4).selectExpr("id % 3 as k", "1 as x"), "wide")
    plan = spark.range(3).withColumnRenamed("id", "k").join(a, "k")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan


def test_line_items_are_dealt_in_bounded_parts(spark, tmp_path):
    spark.range(1_000_000, numPartitions=2).selectExpr("id div 4 as l_orderkey").write.parquet(str(tmp_path / "lineitem.parquet"))
    assert D.rule_lines(spark, str(tmp_path)).rdd.getNumPartitions() == 7  # of 150,000 line items at most, however well they compress


def test_structure_text_deals_once(spark):
    nodes = spark.createDataFrame([(1, 0, 3, "TR", None), (1, 1, 2, "TD", None), (1, 2, 2, "P", "a"), (1, 3, 3, "TH", None), (2, 0, 2, "TD", None), (2, 1, 1, "P", "x"), (2, 2, 2, "LI", "y"), (2, 3, 3, "P", "out")], "page_id long, seq int, last int, type string, text string")
    got = text.structure_text(nodes, ["page_id"])
    assert rows(got) == [(1, 1, "a\n"), (1, 3, ""), (2, 0, "x\ny\n")]
    assert got._jdf.queryExecution().executedPlan().toString().split("== Initial")[0].count("Exchange hashpartitioning") == 1


def test_texts_in_the_grid_of_lines_are_those_of_the_joins(spark):
    """Irregular tables: lines missing, texts over edges, outside, of no size, null, two to a cell."""
    rng = random.Random(3)
    lines, texts = [], []
    for k in range(60):
        ys, xs = sorted(rng.sample(range(0, 400, 10), rng.randint(2, 6))), sorted(rng.sample(range(0, 400, 10), rng.randint(2, 5)))
        lines += [(k, "h", rng.choice([0, 0, xs[0]]), y, rng.choice([400, 400, xs[-1]]), y) for y in ys] + [(k, "v", x, rng.choice([ys[0], ys[0], ys[len(ys) // 2]]), x, ys[-1]) for x in xs]
        texts += [(k, i, x := rng.randint(-20, 390), y := rng.randint(-20, 390), x + rng.randint(0, 40), y + rng.randint(0, 12), rng.choice(["a", "bc", None])) for i in range(25)]
    lined, text_ = spark.createDataFrame(lines, "k long, orient string, x1 int, y1 int, x2 int, y2 int"), spark.createDataFrame(texts, "k long, box_id int, x1 int, y1 int, x2 int, y2 int, text string")
    slots = grid.grid_from_lines(lined, ["k"]).cache()
    assert rows(slots) == rows(grid.to_grid(grid.cells_from_lines(lined, ["k"]), ["k"]))
    assert rows(grid.placed_from_lines(lined, text_, ["k"], "box_id")) == rows(overlap.place_text(text_, slots, ["k"], "box_id").select("k", "box_id", "row_id", "col_id"))
    spans = grid.spans(slots, ["k"])
    assert rows(grid.spans_from_lines(lined, ["k"])) == rows(spans)
    put = overlap.joined_text(overlap.place_text(text_, spans, ["k"], "box_id"), ["k"], "box_id").drop("n_texts")
    want = spans.join(put, ["k", "row_id", "col_id"], "left").select("k", "row_id", "col_id", "rowspan", "colspan", "x1", "y1", "x2", "y2", F.coalesce("content", F.lit("")))
    assert rows(grid.filled_from_lines(lined, text_, ["k"], "box_id")) == rows(want)


def test_groups_over_many_batches(spark):
    """Groups that are larger than a batch, of one row, and of null and two keys; none is parted."""
    sizes = {("a", 1): 130_000, ("a", 2): 1, (None, 1): 70_000, ("b", 0): 3, ("b", 1): 25_000}
    df = spark.createDataFrame([(*k, n) for k, n in sizes.items()], "a string, b int, n int").withColumn("v", F.explode(F.sequence(F.lit(1), F.col("n")))).drop("n")

    def ends(g):
        n = np.bincount(g.gid)
        return batched.Groups(np.arange(len(n)), {"n": n, "top": np.maximum.reduceat(g["v"], np.cumsum(n) - n)})

    got = {(r.a, r.b): (r.n, r.top) for r in batched.map_batches(df, ["a", "b"], ends, "n int, top int").collect()}
    assert got == {k: (n, n) for k, n in sizes.items()}


def test_straight_lines_are_those_of_row_by_row(spark):
    rng = np.random.default_rng(5)
    for w, h, least in ((90, 40, 20), (33, 70, 9), (1, 1, 3), (60, 5, 30)):
        mask = rng.random((h, w)) < 0.9
        mask[::7] = True
        want = []
        for orient, m in (("h", mask), ("v", mask.T)):
            kept = np.array([raster.open_runs(raster.close_runs(raster.open_runs(r, max(1, least // 3)), max(3, least // 6)), least) for r in m])
            for x1, y1, x2, y2, _ in raster.components(kept):
                y = (y1 + y2 - 1) // 2
                want.append((orient, x1, y, x2, y) if orient == "h" else (orient, y, x1, y, x2))
        assert raster.straight_lines(mask, least) == sorted(want)


def test_pages_of_few_bytes_are_still_dealt(spark):
    pages = raster.rasterise(spark.range(64).selectExpr("id as k", "0 as x1", "0 as y1", "9 as x2", "9 as y2"), ["k"])
    plan = pages._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "REPARTITION_BY_COL" not in plan  # by column Spark joins partitions by their bytes


def test_dotted_lines_drop_as_the_join_does(spark):
    rng = random.Random(9)
    parts = [(k, i, x := rng.randint(0, 200), y := rng.choice([5, 6, 40, rng.randint(0, 90)]), x + rng.choice([2, 6, 14]), y + rng.choice([2, 3, 9])) for k in range(30) for i in range(40)]
    df = spark.createDataFrame(parts, "k long, glyph_id int, x1 int, y1 int, x2 int, y2 int").cache()
    dots = glyphs.dotted_lines(df, ["k"]).select("k", "x1", "y1", "x2", "y2")
    want = overlap.with_any(df, dots, ["k"], lambda a, b: G.intersection(a, b) * 4 >= G.area(a), negate=True)
    assert dots.count() and rows(glyphs.drop_dotted(df, ["k"])) == rows(want)


def test_areas_and_blanks_deal_once(spark):
    texts = spark.createDataFrame([(1, 0, 0, 30, 16), (1, 80, 0, 120, 16), (1, 0, 40, 30, 56), (1, 80, 40, 120, 56)], "k long, x1 int, y1 int, x2 int, y2 int").repartition(3, "k")
    parted = whitespace.areas(texts, whitespace.hull(texts, ["k"], 10), ["k"], 8, 60)
    got = whitespace.area_blanks(parted, ["k"], 8, 40)
    assert (1, 0, 30, 0, 80, 56, True, True) in rows(got)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(k") == plan.count("REPARTITION_BY_NUM")


def test_least_height_may_be_a_fraction(spark):
    e = spark.createDataFrame([(1, 0, 0, 30, 10), (1, 0, 20, 30, 30)], "k long, x1 int, y1 int, x2 int, y2 int")
    assert len(rows(whitespace.blanks(e, whitespace.hull(e, ["k"]), ["k"], 1, 9.5, 0.1))) == 1 and not rows(whitespace.blanks(e, whitespace.hull(e, ["k"]), ["k"], 1, 10.5, 0.1))
