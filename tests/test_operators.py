"""Operators on hand-made boxes, and against plain restatements on random ones."""

import random

import pytest
from pyspark.sql import functions as F

from papergrid.functions import geometry as G
from papergrid.functions import labels as L
from papergrid.functions import text as X
from papergrid.operators import gaps, grid, layout, lines, overlap, render, stats, text

K = ["k"]


def boxes(spark, rows, extra="id int"):
    return spark.createDataFrame(rows, f"k int, {extra}, x1 int, y1 int, x2 int, y2 int")


def rand_boxes(seed, n, keys=6):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        x, y = rng.randint(-20, 200), rng.randint(-20, 200)
        out.append((rng.randrange(keys), i, x, y, x + rng.randint(0, 60), y + rng.randint(0, 40)))
    return out


def test_gap_scan(spark):
    rows = rand_boxes(1, 60, 20)
    want = set()
    for k in {r[0] for r in rows}:
        mine = sorted((r[2], r[4]) for r in rows if r[0] == k)
        reach = mine[0][1]
        for lo, hi in mine[1:]:
            if lo - 1 - reach >= 5:
                want.add((k, reach + 1, lo - 1, int((reach + lo) / 2)))
            reach = max(reach, hi)
    got = gaps.gap_scan(boxes(spark, rows), K, "x1", "x2", 5).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_gap_scan_edges(spark):
    df = boxes(spark, [(1, 0, 0, 0, 10, 1), (1, 1, 11, 0, 20, 1), (2, 0, 5, 0, 6, 1), (3, 0, 0, 0, 4, 1), (3, 1, 0, 0, 4, 1)])
    assert gaps.gap_scan(df, K, "x1", "x2", 1).count() == 0  # touching, single, equal
    assert [tuple(r) for r in gaps.gap_scan(df.where("k = 2"), K, "x1", "x2", 1, F.lit(0)).collect()] == [(2, 0, 4, 2)]
    assert gaps.gap_scan(df.limit(0), K, "x1", "x2", 1).count() == 0


@pytest.mark.parametrize("overlap_by", [0, 2, -3])
def test_islands(spark, overlap_by):
    rows = rand_boxes(2, 80)
    got = {r.id: r.group_id for r in gaps.islands(boxes(spark, rows), K, "y1", "y2", ["id"], overlap_by).collect()}
    for k in {r[0] for r in rows}:
        reach, group = None, -1
        for _, i, _, y1, _, y2 in sorted((r for r in rows if r[0] == k), key=lambda r: (r[3], r[5], r[1])):
            if reach is None or reach - y1 <= overlap_by:
                group += 1
            reach = y2 if reach is None else max(reach, y2)
            assert got[i] == group


def test_close_values_round_half_even(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (1, 10), (1, 13), (1, 30), (2, 5)], "k int, v int")
    got = {(r.k, r.group_id): (r.low, r.high, r.delimiter) for r in gaps.close_value_groups(df, K, "v", 4).collect()}
    assert got == {(1, 0): (0, 1, 0), (1, 1): (10, 13, 12), (1, 2): (30, 30, 30), (2, 0): (5, 5, 5)}


def test_whitespace_sweep_merges_strips(spark):
    df = boxes(spark, [(1, 0, 0, 0, 50, 10), (1, 1, 50, 0, 100, 10), (1, 2, 0, 60, 100, 70)])
    assert [tuple(r) for r in gaps.whitespace_sweep(df, K, 20).collect()] == [(1, 0, 11, 100, 59)]


def test_runs(spark):
    df = boxes(spark, [(1, 0, 0, 0, 5, 3), (1, 1, 0, 5, 5, 6), (1, 2, 2, 20, 9, 21), (1, 3, 0, 30, 5, 30)])
    h = gaps.coverage_histogram(df, K, "y1", "y2", F.col("x2") - F.col("x1"))
    assert {r["at"]: r.weight for r in h.collect()} == {0: 5, 1: 5, 2: 5, 5: 5, 20: 7}
    assert [(r.first, r.last, r.weight) for r in gaps.filled_runs(h, K, "at", 2).orderBy("first").collect()] == [(0, 5, 20), (20, 20, 7)]


def test_geometry(spark):
    row = spark.createDataFrame([(0, 0, 10, 10, 5, 5, 15, 15, 0, 0, 0, 0)], "a_x1 int, a_y1 int, a_x2 int, a_y2 int, b_x1 int, b_y1 int, b_x2 int, b_y2 int, z_x1 int, z_y1 int, z_x2 int, z_y2 int")
    a, b, z = (G.box(p) for p in ("a_", "b_", "z_"))
    got = row.select(
        G.intersection(a, b).alias("i"), G.iou_over(a, b, 0.1).alias("iou"), G.iou_over(a, a, 1.0).alias("strict"), G.iou_over(z, z).alias("none"), G.contained(z, a).alias("zero"), G.contained(b, a).alias("no"), G.text_inside(z, a).alias("point"),
        G.idiv(F.lit(-7), 2).alias("div"), G.half_even(F.lit(2.5)).alias("even"), G.half_even(F.lit(3.5)).alias("even2"), G.half_up(F.lit(2.5)).alias("up"), G.centre_distance_squared(a, b).alias("d4"), G.apart(a, b).alias("apart"),
    ).first()
    assert got.asDict() == {"i": 25, "iou": True, "strict": False, "none": False, "zero": True, "no": False, "point": False, "div": -3, "even": 2, "even2": 4, "up": 3, "d4": 200, "apart": True}


def test_snapped_line(spark):
    df = spark.createDataFrame([(100, 4, 0, 0), (0, 0, 3, 90), (0, 0, 50, 50)], "x1 int, y1 int, x2 int, y2 int")
    b = G.snapped(G.box())
    assert [tuple(r) for r in df.select(*b).collect()] == [(0, 2, 100, 2), (2, 0, 2, 90), (0, 0, 50, 50)]


def test_labels(spark):
    df = spark.createDataFrame([("TABLE",), ("Doc_Title",), ("page_number",), (None,), ("Figure",), ("aside_text",)], "l string")
    got = [tuple(r) for r in df.select(L.canonical(F.col("l")), L.heading_level(L.canonical(F.col("l")))).collect()]
    assert got == [("Table", None), ("Title", 1), ("Unknown", None), ("Unknown", None), ("Picture", None), ("Text", None)]


def test_text_rules(spark):
    df = spark.createDataFrame([("End. ",), ("全角．",), ("no-",), ("1. item",), ("• b",), ("a) c",), ("word",), ("",)], "t string")
    got = [tuple(r) for r in df.select(X.ends_paragraph(F.col("t")), X.list_tag(F.col("t")), X.is_ordered_tag(F.col("t"))).collect()]
    assert got == [(True, None, False), (True, None, False), (False, None, False), (False, "1.", True), (False, "•", False), (False, "a)", True), (False, None, False), (False, None, False)]
    esc = df.limit(1).select(X.escape_markdown(F.lit("\\a*b_c`d!e#f+g-h~i.")), X.heading(9), X.picture(F.lit("u"), F.lit("a")), X.media_type(F.lit("X.PNG")), X.media_type(F.lit("x")), X.list_prefix(F.lit(True), F.lit("2."), 2), X.list_prefix(F.lit(False), F.lit("2."))).first()
    assert tuple(esc) == ("\\\\a\\*b\\_c\\`d\\!e\\#f\\+g\\-h\\~i.", "###### ", "![a](u)", "image/png", "image/jpeg", "  2. ", "- ")


def test_text_goes_to_the_first_cell(spark):
    cells = spark.createDataFrame([(1, 0, 0, 0, 0, 50, 20), (1, 0, 1, 40, 0, 100, 20), (1, 1, 0, 0, 20, 100, 40)], "k int, row_id int, col_id int, x1 int, y1 int, x2 int, y2 int")
    texts = spark.createDataFrame([(1, 0, 41, 2, 49, 10, "both"), (1, 1, 60, 2, 70, 10, "right"), (1, 2, 75, 2, 80, 10, "more"), (1, 3, 200, 2, 210, 10, "out"), (1, 4, 10, 18, 20, 38, "low"), (1, 5, 71, 2, 74, 10, "near")], "k int, id int, x1 int, y1 int, x2 int, y2 int, text string")
    placed = overlap.place_text(texts, cells, K, "id")
    assert {r.id: (r.row_id, r.col_id) for r in placed.collect()} == {0: (0, 0), 1: (0, 1), 2: (0, 1), 4: (1, 0), 5: (0, 1)}
    got = {(r.row_id, r.col_id): r.content for r in overlap.joined_text(placed, K, "id").collect()}
    assert got == {(0, 0): "both", (0, 1): "rightnearmore", (1, 0): "low"}


def test_covered_cells(spark):
    rows = [(1, 0, 0, 0, 10, 10), (1, 1, 10, 0, 20, 10), (1, 2, 0, 0, 20, 10), (1, 3, 0, 0, 20, 20), (1, 4, 5, 5, 5, 9), (2, 0, -5, -5, 5, 5)]
    got = grid.drop_covered(boxes(spark, rows, "cell_id int"), K).collect()
    assert {(r.k, r.cell_id) for r in got} == {(1, 0), (1, 1), (1, 3), (2, 0)}


def plain_covered(rows):
    kept, free = [], {(x, y) for x in range(0, 300) for y in range(0, 300)}
    for r in sorted(rows, key=lambda r: ((r[4] - r[2]) * (r[5] - r[3]), r[1])):
        px = {(x, y) for x in range(max(0, r[2]), r[4]) for y in range(max(0, r[3]), r[5])}
        if px & free:
            kept.append(r[1])
            free -= px
    return sorted(kept)


def test_covered_cells_like_pixels(spark):
    rows = rand_boxes(9, 40, 1)
    assert sorted(r.cell_id for r in grid.drop_covered(boxes(spark, rows, "cell_id int"), K).collect()) == plain_covered(rows)


def test_components_leave_lone_cells(spark):
    rows = [(1, 0, 0, 0, 50, 20), (1, 1, 50, 0, 100, 20), (1, 2, 300, 300, 350, 320), (1, 3, 0, 20, 50, 40)]
    pairs = grid.adjacent(boxes(spark, rows, "cell_id int"), K)
    assert {(r.a_cell_id, r.b_cell_id) for r in pairs.collect()} == {(0, 1), (0, 3)}
    assert {r.cell_id: r.component for r in grid.components(pairs, K).collect()} == {0: 0, 1: 0, 3: 0}


def lines_of(k, cells):
    out = set()
    for x1, y1, x2, y2 in cells:
        out |= {("h", x1, y1, x2, y1), ("h", x1, y2, x2, y2), ("v", x1, y1, x1, y2), ("v", x2, y1, x2, y2)}
    merged = []
    for o in "hv":
        a, b = (1, 3) if o == "h" else (2, 4)
        at = 2 if o == "h" else 1
        for c in sorted({x[at] for x in out if x[0] == o}):
            run = None
            for lo, hi in sorted((x[a], x[b]) for x in out if x[0] == o and x[at] == c):
                if run and lo <= run[1]:
                    run[1] = max(run[1], hi)
                else:
                    run = [lo, hi]
                    merged.append((o, c, run))
    return [(k, o, r[0], c, r[1], c) if o == "h" else (k, o, c, r[0], c, r[1]) for o, c, r in merged]


def test_round_trip_with_merged_cells(spark):
    """Cells to ruled lines and back: a head over two columns and a side over two rows."""
    cells = [(0, 0, 100, 30), (100, 0, 300, 30), (0, 30, 100, 90), (100, 30, 200, 60), (200, 30, 300, 60), (100, 60, 200, 90), (200, 60, 300, 90)]
    df = spark.createDataFrame(lines_of(1, cells), "k int, orient string, x1 int, y1 int, x2 int, y2 int")
    g = grid.table_from_lines(df, K)
    slots = {(r.row_id, r.col_id): (r.x1, r.y1, r.x2, r.y2) for r in g.collect()}
    assert len(slots) == 9 and set(slots.values()) == set(cells)
    assert slots[0, 1] == slots[0, 2] == (100, 0, 300, 30) and slots[1, 0] == slots[2, 0] == (0, 30, 100, 90)
    s = {(r.x1, r.y1): (r.rowspan, r.colspan) for r in grid.spans(g, [*K, "table_ord"]).collect()}
    assert s[100, 0] == (1, 2) and s[0, 30] == (2, 1) and len(s) == 7


def test_spans_literal(spark):
    g = spark.createDataFrame([(1, r, c, 0, 0, 20, 20) for r in range(2) for c in range(3)], "k int, row_id int, col_id int, x1 int, y1 int, x2 int, y2 int")
    assert [(r.rowspan, r.colspan) for r in grid.spans(g, K).collect()] == [(2, 3)]
    assert [(r.rowspan, r.colspan) for r in grid.spans(g, K, literal=True).collect()] == [(4, 3)]


def test_grid_without_a_cell(spark):
    g = grid.to_grid(boxes(spark, [(1, 0, 0, 0, 10, 10), (1, 1, 20, 0, 30, 10), (1, 2, 0, 10, 30, 20)], "cell_id int"), K)
    slots = {(r.row_id, r.col_id): (r.x1, r.y1, r.x2, r.y2) for r in g.collect()}
    assert slots[0, 1] == (10, 0, 10, 10) and slots[1, 1] == (0, 10, 30, 20)


def test_suppression_order(spark):
    rows = [(1, 0, "text", 50, 0, 0, 100, 100), (1, 1, "text", 60, 1, 1, 101, 101), (1, 2, "text", 40, 2, 2, 102, 102), (1, 3, "table", 10, 0, 0, 500, 500), (1, 4, "table", 20, 10, 10, 400, 400), (1, 5, "Figure", None, 900, 900, 950, 950)]
    df = spark.createDataFrame(rows, "k int, obj_id int, label string, confidence_pct int, x1 int, y1 int, x2 int, y2 int")
    assert [r.obj_id for r in layout.suppress(df, K).orderBy("pos").collect()] == [1, 4, 5]
    assert [r.obj_id for r in layout.drop_contained(df, K).orderBy("pos").collect()] == [3, 5]


def test_containment_keeps_a_table_in_text(spark):
    rows = [(1, 0, "text", 1, 0, 0, 100, 100), (1, 1, "table", 1, 10, 10, 50, 50), (1, 2, "text", 1, 11, 11, 40, 40)]
    df = spark.createDataFrame(rows, "k int, obj_id int, label string, confidence_pct int, x1 int, y1 int, x2 int, y2 int")
    assert [r.obj_id for r in layout.drop_contained(df, K).orderBy("pos").collect()] == [0, 1]


def test_reading_order(spark):
    rows = [(1, 0, "footer", 0, 900, 100, 950), (1, 1, "text", 300, 50, 400, 100), (1, 2, "text", 0, 200, 100, 300), (1, 3, "text", 0, 50, 100, 100), (1, 4, "header", 0, 0, 80, 20), (1, 5, "abandon", 0, 0, 10, 10), (1, 6, "text", 50, 400, 90, 420)]
    df = spark.createDataFrame(rows, "k int, obj_id int, label string, x1 int, y1 int, x2 int, y2 int")
    assert [r.obj_id for r in layout.reading_order(df, K).orderBy("reading_pos").collect()] == [4, 3, 2, 6, 1, 0]


def test_modes(spark):
    df = spark.createDataFrame([(1, 5, 3), (1, 7, 1), (1, 7, 4), (1, 5, 2), (1, 9, 0)], "k int, v int, o int")
    assert [(r.mode, r.n) for r in stats.mode(df, K, "v").collect()] == [(5, 2)]
    assert [(r.mode, r.n) for r in stats.mode(df, K, "v", "o").collect()] == [(7, 2)]
    assert [r.char_milli for r in stats.average_char_width(df, K, F.lit(0), F.lit(0)).collect()] == [10_000]


def test_kv_table(spark):
    rows = [(1, 0, 0, 40, 16, "name"), (1, 0, 200, 260, 16, "value"), (1, 20, 0, 50, 36, "alone"), (1, 40, 230, 260, 56, "right"), (2, 0, 0, 300, 16, "no gap"), (3, 0, 0, 10, 16, "a"), (3, 0, 50, 60, 16, "b"), (3, 0, 100, 110, 16, "c")]
    df = spark.createDataFrame(rows, "k int, y1 int, x1 int, x2 int, y2 int, text string")
    got = {(r.k, r.line_id): (r.key_text, r.value_text) for r in text.key_value_tables(df, K, ["x1"], 20).collect()}
    assert got == {(1, 0): ("name", "value"), (1, 1): ("alone", ""), (1, 2): ("", "right")}


def test_paragraphs(spark):
    rows = [(1, 0, 0, "It"), (1, 0, 1, "goes"), (1, 1, 0, "on-"), (1, 1, 1, "wards."), (1, 2, 0, "- x"), (2, 0, 0, "None")]
    words = spark.createDataFrame(rows, "k int, line int, w int, t string")
    got = [tuple(r) for r in text.fold_paragraphs(text.line_texts(words, K, "line", "w", "t"), K, "line").orderBy("k", "para_id").collect()]
    assert got == [(1, 0, 2, "It goes on-wards.\n\n", None), (1, 1, 1, "- x \n\n", "-"), (2, 0, 1, "None \n\n", None)]


def test_nested_structure(spark):
    rows = [(1, 0, "Table", ""), (1, 1, "THead", ""), (1, 2, "TH", "a"), (1, 3, "TR", ""), (1, 4, "TD", "b"), (1, 5, "TD", "c"), (1, 6, "Table", ""), (1, 7, "TR", ""), (1, 8, "TD", "d")]
    got = [tuple(r) for r in text.tagged_tables(spark.createDataFrame(rows, "k int, seq int, type string, text string"), K).orderBy("table_ord", "row_id", "col_id").collect()]
    assert got == [(1, 0, 0, 0, "a"), (1, 0, 1, 0, "b"), (1, 0, 1, 1, "c"), (1, 1, 0, 0, "d")]


def test_rendering(spark):
    rows = [(1, 0, 0, "h1", 2, 1), (1, 0, 1, "h2", 1, 2), (1, 1, 1, "a\nb", 1, 1), (1, 1, 2, "", 1, 1)]
    df = spark.createDataFrame(rows, "k int, row_id int, col_id int, content string, rowspan int, colspan int")
    assert render.html(df, K, True).first().html == '<table><thead><tr><th rowspan="2">h1</th><th colspan="2">h2</th></tr><tr><th>a\nb</th><th></th></tr></thead></table>'
    assert render.html(df, K, True, key_value=True).first().html.startswith("<table><tr><td")
    assert render.markdown(df, K, F.lit("T")).first().markdown == "# T\n\n | h1 | h2 | \n | --- | --- | \n | a<br />b |  | \n"
    page = render.html_page(spark.createDataFrame([(1, 1, "<b>", 3), (1, 0, "<a>", 3)], "k int, o int, html string, p int"), K, "o", "p").first().html
    assert page == '<html><head><meta charset="utf-8"><meta pageNo="3"></head><body><a><b></body></html>'


def test_line_noise(spark):
    ls = spark.createDataFrame([(1, "h", 0, 10, 100, 10), (1, "h", 0, 10, 100, 10), (1, "h", 0, 50, 100, 50), (1, "h", 0, 90, 8, 90), (1, "v", 20, 0, 20, 100), (1, "v", 300, 0, 300, 100)], "k int, orient string, x1 int, y1 int, x2 int, y2 int")
    texts = boxes(spark, [(1, 0, 30, 40, 60, 60)])
    assert {(r.orient, r.x1, r.y1) for r in lines.remove_noise(ls, texts, K, 20).collect()} == {("h", 0, 10), ("v", 20, 0), ("v", 300, 0)}
    assert [r.x1 for r in lines.connected_uprights(ls, K).collect()] == [20]
    assert lines.drop_duplicate_lines(ls.where("orient = 'h'"), texts, K, 5).count() == 3
