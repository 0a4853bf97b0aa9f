"""Every operator as a query over the derived tables: name -> (spark, sf_dir) -> DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as G
from ..functions import labels as L
from ..functions import text as X
from ..operators import borderless, borders, gaps, glyphs, grid, layout, lines, overlap, raster, render, stats, text, whitespace
from ..shared import materialised
from ..sources import derive as D

DOC, PAGE, TABLE = ["doc_id"], ["page_id"], ["table_id"]


def column_gaps(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.gap_scan(D.word_boxes(spark, sf), DOC, "x1", "x2", 6)


def column_positions(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.column_positions(D.layout_objects(spark, sf), PAGE, "x1", "x2", 30)


def text_line_groups(spark: SparkSession, sf: str) -> DataFrame:
    return lines.text_lines(D.layout_objects(spark, sf), PAGE, ["obj_id"]).select("page_id", "obj_id", "line_id")


def band_line_groups(spark: SparkSession, sf: str) -> DataFrame:
    return lines.band_lines(D.layout_objects(spark, sf), PAGE, ["obj_id"]).select("page_id", "obj_id", "line_id")


def y_band_split(spark: SparkSession, sf: str) -> DataFrame:
    banded = gaps.islands(D.layout_objects(spark, sf), PAGE, "y1", "y2", ["obj_id"], G.BAND_OVERLAP, "band_id")
    return banded.groupBy("page_id", "band_id").agg(F.min("y1").alias("top"), F.max("y2").alias("bottom"), F.count(F.lit(1)).alias("n"))


def blank_bands(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.blank_bands(D.layout_objects(spark, sf), PAGE, "y1", "y2", 14)


def merged_spans(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.merged_spans(D.layout_objects(spark, sf), PAGE, "x1", "x2")


def close_value_groups(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.close_value_groups(D.layout_objects(spark, sf), PAGE, "x1", 10)


def whitespace_sweep(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.whitespace_sweep(D.layout_objects(spark, sf), PAGE, 50)


def row_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.coverage_histogram(D.words(spark, sf).select("doc_id", (F.col("line_no") * 20).alias("y1"), (F.col("line_no") * 20 + 16).alias("y2"), "word"), DOC, "y1", "y2", F.length("word") * 8, "y")


def filled_runs(spark: SparkSession, sf: str) -> DataFrame:
    return gaps.box_runs(D.layout_objects(spark, sf), PAGE, "y1", "y2", F.col("x2") - F.col("x1"), 5)


def char_width_mode(spark: SparkSession, sf: str) -> DataFrame:
    return stats.char_width(D.words(spark, sf).withColumn("w", F.length("word") * 8), DOC, "w")


def average_char_width(spark: SparkSession, sf: str) -> DataFrame:
    return stats.average_char_width(D.kv_boxes(spark, sf), ["conv_id"], F.col("x2") - F.col("x1"), F.length("text"))


def width_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return stats.histogram(D.layout_objects(spark, sf), ["label"], F.col("x2") - F.col("x1"), "width")


def median_box(spark: SparkSession, sf: str) -> DataFrame:
    return D.layout_objects(spark, sf).groupBy("label").agg((F.median(F.col("x2") - F.col("x1")) * 2).cast("long").alias("width2"), (F.median(F.col("y2") - F.col("y1")) * 2).cast("long").alias("height2"))


def line_sep_mode(spark: SparkSession, sf: str) -> DataFrame:
    return stats.line_separation(D.layout_objects(spark, sf), PAGE, "obj_id")


def iou_pairs(spark: SparkSession, sf: str) -> DataFrame:
    p = overlap.iou_pairs(D.layout_objects(spark, sf), PAGE, "obj_id")
    return p.select(F.col("a_page_id").alias("page_id"), "a_obj_id", "b_obj_id")


def box_overlap_join(spark: SparkSession, sf: str) -> DataFrame:
    """Elements of each table object: any object of which 70 % lies in it."""
    o = D.layout_objects(spark, sf)
    met = layout.elements_in_objects(o.where("label = 'table'"), o.where("label <> 'table'"), PAGE, G.CHUNK_TEXT_OVERLAP)
    return met.select(F.col("a_page_id").alias("page_id"), F.col("a_obj_id").alias("element_id"), F.col("b_obj_id").alias("object_id"))


def label_normalize(spark: SparkSession, sf: str) -> DataFrame:
    o = D.layout_objects(spark, sf)
    return o.select("page_id", "obj_id", L.canonical(F.col("label")).alias("canonical"), L.heading_level(L.canonical(F.col("label"))).alias("level"))


def table_pages(spark: SparkSession, sf: str) -> DataFrame:
    o = D.layout_objects(spark, sf)
    return layout.table_pages(D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("page_id"), F.col("o_orderstatus").alias("status")), o, PAGE)


def padded_boxes(spark: SparkSession, sf: str) -> DataFrame:
    b = G.padded_detection(G.box(), F.col("label"))
    return D.layout_objects(spark, sf).select("page_id", "obj_id", *[c.alias(n) for c, n in zip(b, b._fields)])


def points_to_pixels(spark: SparkSession, sf: str) -> DataFrame:
    b = G.to_pixels(F.col("x1"), F.lit(1200) - F.col("y2"), F.col("x2"), F.lit(1200) - F.col("y1"), F.lit(1200), 144)
    return D.layout_objects(spark, sf).select("page_id", "obj_id", *[c.alias(n) for c, n in zip(b, b._fields)])


def clip_windows(spark: SparkSession, sf: str) -> DataFrame:
    b = G.clip_window(G.box(), 800, 1000)
    return D.layout_objects(spark, sf).select("page_id", "obj_id", *[c.alias(n) for c, n in zip(b, b._fields)])


def nms(spark: SparkSession, sf: str) -> DataFrame:
    return layout.suppress(D.layout_objects(spark, sf), PAGE).select("page_id", "pos", "obj_id", "confidence_pct")


def containment_filter(spark: SparkSession, sf: str) -> DataFrame:
    return layout.drop_contained(D.layout_objects(spark, sf), PAGE).select("page_id", "pos", "obj_id")


def reading_order(spark: SparkSession, sf: str) -> DataFrame:
    return layout.reading_order(D.layout_objects(spark, sf), PAGE).select("page_id", "obj_id", "section", "column_id", "band_id", "band_column", "reading_pos")


def attach_cells(spark: SparkSession, sf: str) -> DataFrame:
    o = D.layout_objects(spark, sf)
    t = D.cell_text(spark, sf).groupBy(F.col("table_id").alias("page_id"), F.col("y1").alias("top")).agg(F.count(F.lit(1)).alias("n_cells"))
    return layout.attach_cells(o, t, PAGE, "obj_id", "top").select("page_id", "obj_id", "k", "top", "n_cells")


def column_count(spark: SparkSession, sf: str) -> DataFrame:
    return lines.column_count(D.cell_text(spark, sf), TABLE, 20)


def _cells(spark: SparkSession, sf: str) -> DataFrame:
    return grid.cells_from_lines(D.rule_lines(spark, sf), TABLE)


def _dealt(spark: SparkSession, sf: str, rows: DataFrame) -> DataFrame:
    """Rows by table that a Python step made, dealt again as the line items are."""
    return D.dealt(spark, sf, rows, "table_id")


def _grid(spark: SparkSession, sf: str) -> DataFrame:
    return grid.grid_from_lines(D.rule_lines(spark, sf), TABLE)


def _filled(spark: SparkSession, sf: str) -> DataFrame:
    """Cells of every table with spans and text."""
    return _dealt(spark, sf, grid.filled_from_lines(D.rule_lines(spark, sf), D.cell_text(spark, sf), TABLE, "box_id"))


def cells_from_lines(spark: SparkSession, sf: str) -> DataFrame:
    return _cells(spark, sf)


def cell_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return grid.drop_covered(D.rough_cells(spark, sf), TABLE)


def cell_adjacency(spark: SparkSession, sf: str) -> DataFrame:
    return grid.adjacent(_dealt(spark, sf, _cells(spark, sf)), TABLE)


def table_components(spark: SparkSession, sf: str) -> DataFrame:
    """Rough cells: an order of over four lines has two tables."""
    return grid.components(grid.adjacent(D.rough_cells(spark, sf), TABLE), TABLE)


def snapped_cells(spark: SparkSession, sf: str) -> DataFrame:
    return grid.snapped_cells(D.rough_cells(spark, sf), TABLE)


def grid_pivot(spark: SparkSession, sf: str) -> DataFrame:
    return _grid(spark, sf)


def grid_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """The grid where every fifth cell is missing: slots that no cell covers."""
    return grid.to_grid(_dealt(spark, sf, _cells(spark, sf).where("cell_id % 5 <> 2")), TABLE)


def span_compress(spark: SparkSession, sf: str) -> DataFrame:
    return grid.spans_from_lines(D.rule_lines(spark, sf), TABLE)


def text_to_cell(spark: SparkSession, sf: str) -> DataFrame:
    return grid.placed_from_lines(D.rule_lines(spark, sf), D.cell_text(spark, sf), TABLE, "box_id")


def cell_contents(spark: SparkSession, sf: str) -> DataFrame:
    return grid.filled_from_lines(D.rule_lines(spark, sf), D.cell_text(spark, sf), TABLE, "box_id").select("table_id", "row_id", "col_id", "rowspan", "colspan", "content")


def empty_row_col_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Every fourth row has no text."""
    return grid.drop_empty(_dealt(spark, sf, _grid(spark, sf)), D.cell_text(spark, sf).where("floor(box_id / 3) % 4 <> 1"), TABLE)


def row_coherency(spark: SparkSession, sf: str) -> DataFrame:
    return stats.grid_coherence(_dealt(spark, sf, _grid(spark, sf)), TABLE, "row_id", "col_id")


def table_markdown(spark: SparkSession, sf: str) -> DataFrame:
    return render.markdown(_filled(spark, sf), TABLE)


def table_html(spark: SparkSession, sf: str) -> DataFrame:
    return render.html(_filled(spark, sf), TABLE, first_row_head=True)


def table_json(spark: SparkSession, sf: str) -> DataFrame:
    """Written as JSON and read again."""
    return render.from_json_tables(render.json_tables(_filled(spark, sf), TABLE), TABLE).select("table_id", "row_id", "item", "content", "rowspan", "colspan")


def table_dump(spark: SparkSession, sf: str) -> DataFrame:
    return render.dump(_dealt(spark, sf, _grid(spark, sf)), TABLE)


def edge_lines(spark: SparkSession, sf: str) -> DataFrame:
    return grid.edge_lines(D.rule_lines(spark, sf), TABLE)


def cell_edges(spark: SparkSession, sf: str) -> DataFrame:
    return grid.cell_edges(_dealt(spark, sf, _cells(spark, sf)), TABLE)


def noise_line_drop(spark: SparkSession, sf: str) -> DataFrame:
    return lines.remove_noise(D.rule_lines(spark, sf), D.cell_text(spark, sf), TABLE, 50)


def upright_line_semi(spark: SparkSession, sf: str) -> DataFrame:
    return lines.connected_uprights(D.stray_lines(spark, sf), TABLE)


def dup_line_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Ruled lines and their copies 3 pixels lower."""
    h = D.rule_lines(spark, sf).where("orient = 'h'")
    both = h.unionByName(h.select("table_id", "orient", F.lit(5).alias("x1"), (F.col("y1") + 3).alias("y1"), "x2", (F.col("y2") + 3).alias("y2")))
    return lines.drop_duplicate_lines(both, D.cell_text(spark, sf), TABLE, 10)


def row_separators(spark: SparkSession, sf: str) -> DataFrame:
    return lines.row_separators(D.cell_text(spark, sf), TABLE, ["box_id"])


def inferred_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Rows that text implies where every other ruled line is missing."""
    some = D.rule_lines(spark, sf).where("orient = 'v' or y1 % 80 = 0")
    return lines.inferred_rows(D.cell_text(spark, sf), some, TABLE, ["box_id"])


def extended_uprights(spark: SparkSession, sf: str) -> DataFrame:
    short = D.rule_lines(spark, sf).withColumn("y2", F.when(F.col("orient") == "v", F.col("y2") - 15).otherwise(F.col("y2")))
    return lines.extend_uprights(short, D.cell_text(spark, sf), TABLE)


def aligned_borders(spark: SparkSession, sf: str) -> DataFrame:
    moved = D.rule_lines(spark, sf).withColumn("x1", F.when(F.col("orient") == "h", F.col("y1") % 12).otherwise(F.col("x1")))
    return lines.align_bottom(lines.align_top(lines.align_right(lines.align_left(moved, TABLE), TABLE), TABLE), TABLE)


def implicit_columns(spark: SparkSession, sf: str) -> DataFrame:
    """Lines in blank columns between the texts of a table, where no cell edge is."""
    g = gaps.gap_scan(D.cell_text(spark, sf), TABLE, "x1", "x2", 20).select("table_id", F.col("first").alias("x1"), F.lit(0).alias("y1"), F.col("last").alias("x2"), F.lit(40).alias("y2"))
    only_outer = _dealt(spark, sf, _grid(spark, sf).where("col_id = 0"))
    return grid.implicit_lines(only_outer, g, TABLE, 20)


def consecutive_merge(spark: SparkSession, sf: str) -> DataFrame:
    """Tables of an order's customer's page, one below the other: those of three lines have columns of their own."""
    n = D.read(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count(F.lit(1)).cast("int").alias("n"))
    o = D.read(spark, sf, "orders").select(F.col("o_custkey").alias("page_id"), F.col("o_orderkey").alias("table_ord")).join(n, F.col("table_ord") == F.col("l_orderkey"))
    below = Window.partitionBy("page_id").orderBy("table_ord").rowsBetween(Window.unboundedPreceding, -1)
    y1 = F.coalesce(F.sum(F.col("n") * 40 + 20).over(below), F.lit(0)).cast("int")
    three = F.col("n") == 3
    t = o.withColumn("y1", y1).select("page_id", "table_ord", F.lit(0).alias("x1"), "y1", F.lit(400).alias("x2"), (F.col("y1") + F.col("n") * 40).alias("y2"), F.when(three, 2).otherwise(3).alias("n_cols"), F.when(three, F.array(F.lit(0), F.lit(200), F.lit(400))).otherwise(F.array(F.lit(0), F.lit(100), F.lit(250), F.lit(400))).alias("v_lines"))
    contours = t.where("table_ord % 5 = 0").select("page_id", F.lit(10).alias("x1"), (F.col("y2") + 2).alias("y1"), F.lit(50).alias("x2"), (F.col("y2") + 12).alias("y2"))
    return grid.merge_consecutive(t, PAGE, contours).select("page_id", "table_ord", "y1", "merged_id")


def kv_table(spark: SparkSession, sf: str) -> DataFrame:
    return text.key_value_tables(D.kv_boxes(spark, sf), ["conv_id"], ["part"], 20)


def tagged_tree_tables(spark: SparkSession, sf: str) -> DataFrame:
    return text.tagged_tables(D.tagged_tree(spark, sf), PAGE)


def html_blocks(spark: SparkSession, sf: str) -> DataFrame:
    return D.html_blocks(spark, sf)


def doc_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Web pages' blocks as Markdown documents."""
    return text.document_markdown(D.html_blocks(spark, sf), PAGE, "block_ord")


def line_texts(spark: SparkSession, sf: str) -> DataFrame:
    return text.line_texts(D.words(spark, sf), DOC, "line_no", "word_no", "word")


def paragraph_fold(spark: SparkSession, sf: str) -> DataFrame:
    return text.fold_paragraphs(text.line_texts(D.words(spark, sf), DOC, "line_no", "word_no", "word"), DOC, "line_no")


def list_tag_detect(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as list items: their number, a letter or a bullet before the text."""
    t = D.read(spark, sf, "conversations")
    tag = F.when(F.col("turn") % 3 == 0, F.concat((F.col("turn") + 1).cast("string"), F.lit(". "))).when(F.col("turn") % 3 == 1, F.lit("• ")).otherwise(F.lit(""))
    item = F.concat(tag, "text")
    return t.select("conv_id", "turn", X.list_tag(item).alias("list_tag"), X.is_ordered_tag(item).alias("ordered"), X.ends_paragraph(item).alias("ends"), X.begins_paragraph(item).alias("begins"))


def md_escape(spark: SparkSession, sf: str) -> DataFrame:
    return D.read(spark, sf, "conversations").select("conv_id", "turn", X.escape_markdown(F.col("text")).alias("escaped"))


def media_types(spark: SparkSession, sf: str) -> DataFrame:
    ext = F.element_at(F.array(*[F.lit(x) for x in (".PNG", ".jpg", ".webp", ".pdf", "")]), (F.col("page_id") % 5 + 1).cast("int"))
    p = D.read(spark, sf, "pages").select("page_id", F.concat(F.lit("img/"), F.col("page_id").cast("string"), ext).alias("path"), F.encode("url", "utf-8").alias("content"))
    uri = X.data_uri(F.col("content"), F.col("path"))
    return p.select("page_id", X.media_type(F.col("path")).alias("media_type"), uri.alias("uri"), F.decode(X.from_data_uri(uri), "utf-8").alias("back"))


def chunk_render(spark: SparkSession, sf: str) -> DataFrame:
    """Every layout label's rendering, over the objects of all pages."""
    o = D.layout_objects(spark, sf)
    return o.select("page_id", "obj_id", text.render_chunk(L.canonical(F.col("label")), F.concat(F.lit("obj #"), F.col("obj_id").cast("string"))).alias("md"))


def line_geometry(spark: SparkSession, sf: str) -> DataFrame:
    b = G.box()
    return D.rule_lines(spark, sf).groupBy("table_id").agg(F.count_if(G.is_horizontal(b)).alias("level"), F.count_if(G.is_vertical(b)).alias("upright"), F.sum(G.line_length(b)).cast("long").alias("length"))


QUERIES = {
    f.__name__: f
    for f in (
        column_gaps, column_positions, text_line_groups, band_line_groups, y_band_split, blank_bands, merged_spans, close_value_groups, whitespace_sweep, row_histogram,
        filled_runs, char_width_mode, average_char_width, width_histogram, median_box, line_sep_mode, iou_pairs, box_overlap_join, label_normalize, table_pages, padded_boxes,
        points_to_pixels, clip_windows, nms, containment_filter, reading_order, attach_cells, column_count, cells_from_lines, cell_dedup, cell_adjacency, table_components,
        snapped_cells, grid_pivot, grid_gaps, span_compress, text_to_cell, cell_contents, empty_row_col_drop, row_coherency, table_markdown, table_html, table_json, table_dump, edge_lines,
        cell_edges, noise_line_drop, upright_line_semi, dup_line_drop, row_separators, inferred_rows, extended_uprights, aligned_borders, implicit_columns, consecutive_merge,
        kv_table, tagged_tree_tables, html_blocks, doc_markdown, line_texts, paragraph_fold, list_tag_detect, md_escape, media_types, chunk_render, line_geometry,
    )
}


def borderless_table(spark: SparkSession, sf: str) -> DataFrame:
    return borderless.borderless_grid(D.cell_text(spark, sf), TABLE, ["box_id"], 20, 8, 40)


def implied_lines(spark: SparkSession, sf: str) -> DataFrame:
    return borderless.implied_lines(D.cell_text(spark, sf), TABLE, ["box_id"], 20)


def table_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return borderless.dedup_tables(D.layout_objects(spark, sf), PAGE, "obj_id").select("page_id", "pos", "obj_id")


def split_regions(spark: SparkSession, sf: str) -> DataFrame:
    return borderless.split_regions(D.layout_objects(spark, sf), PAGE, 14, 14, 72, 36)


def merged_positions(spark: SparkSession, sf: str) -> DataFrame:
    """The upright ruled line between the last two columns (in every third table also that right of the table), and the gaps of text."""
    ruled = D.rule_lines(spark, sf).where("orient = 'v' and (x1 = 250 or x1 = 400 and table_id % 3 = 1)")
    found = gaps.gap_scan(D.cell_text(spark, sf), TABLE, "x1", "x2", 20).select("table_id", F.col("centre").alias("position"))
    return borderless.merge_positions(ruled, found, D.cell_text(spark, sf), TABLE)


def snapped_uprights(spark: SparkSession, sf: str) -> DataFrame:
    """Upright lines that were drawn 9 pixels short and 7 pixels over."""
    moved = D.rule_lines(spark, sf).withColumn("y1", F.when(F.col("orient") == "v", F.col("y1") + 9).otherwise(F.col("y1"))).withColumn("y2", F.when(F.col("orient") == "v", F.col("y2") + 7).otherwise(F.col("y2")))
    return borderless.snap_uprights(moved, D.cell_text(spark, sf), TABLE)


def outer_cells(spark: SparkSession, sf: str) -> DataFrame:
    """Cells that level lines imply on both sides of a table whose own cells are the middle column."""
    inner = _dealt(spark, sf, _cells(spark, sf).where("x1 >= 100 and x2 <= 250"))
    return borderless.outer_cells(inner, D.rule_lines(spark, sf), TABLE)


def whitespace_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return borderless.dedup_whitespace(gaps.whitespace_sweep(D.layout_objects(spark, sf), PAGE, 120), PAGE, D.layout_objects(spark, sf))


def coherent_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Every third row has one text only."""
    return borderless.coherent_rows(_dealt(spark, sf, _grid(spark, sf)), D.cell_text(spark, sf).where("floor(box_id / 3) % 3 <> 0 or box_id % 3 = 0"), TABLE)


def raster_components(spark: SparkSession, sf: str) -> DataFrame:
    """Boxes drawn as pixels and found again."""
    return raster.page_components(raster.rasterise(D.kv_boxes(spark, sf), ["conv_id"]), ["conv_id"], 128)


def raster_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Rules under every turn, drawn as pixels and found again."""
    ruled = D.kv_boxes(spark, sf).where("part = 'key'").select("conv_id", F.lit(5).alias("x1"), (F.col("y1") + 18).alias("y1"), F.lit(400).alias("x2"), (F.col("y1") + 19).alias("y2"))
    return raster.page_lines(raster.rasterise(ruled, ["conv_id"]), ["conv_id"], 60)


QUERIES |= {
    f.__name__: f
    for f in (borderless_table, implied_lines, table_dedup, split_regions, merged_positions, snapped_uprights, outer_cells, whitespace_dedup, coherent_rows, raster_components, raster_lines)
}


def _half_framed(spark: SparkSession, sf: str) -> DataFrame:
    """Ruled lines without a table's left and top ones; in even tables level lines begin two pixels right of the first upright, in every fifth the second one is in a row of text."""
    left = F.when((F.col("orient") == "h") & (F.col("table_id") % 2 == 0), 102).otherwise(F.col("x1"))
    low = lambda c: F.when((F.col("orient") == "h") & (F.col("table_id") % 5 == 0) & (F.col("y1") == 40), 60).otherwise(F.col(c))
    some = D.rule_lines(spark, sf).where("(orient = 'v' and x1 > 0) or (orient = 'h' and y1 > 0)")
    return some.select("table_id", "orient", left.alias("x1"), low("y1").alias("y1"), "x2", low("y2").alias("y2"))


def _frames(spark: SparkSession, sf: str) -> DataFrame:
    """A detector's box of each table: five pixels around it."""
    return D.rule_lines(spark, sf).groupBy("table_id").agg((F.min("x1") - 5).alias("x1"), (F.min("y1") - 5).alias("y1"), (F.max("x2") + 5).alias("x2"), (F.max("y2") + 5).alias("y2"))


def dup_upright_drop(spark: SparkSession, sf: str) -> DataFrame:
    """Upright lines and their copies: four pixels beside them, and thirty, with text between some."""
    v = D.rule_lines(spark, sf).where("orient = 'v'")
    copy = v.select("table_id", "orient", (F.col("x1") + F.when(F.col("table_id") % 2 == 0, 4).otherwise(30)).alias("x1"), "y1", (F.col("x1") + F.when(F.col("table_id") % 2 == 0, 4).otherwise(30)).alias("x2"), F.col("y2"))
    return borders.drop_duplicate_uprights(v.unionByName(copy), D.cell_text(spark, sf), TABLE, 40)


def lines_in_gaps(spark: SparkSession, sf: str) -> DataFrame:
    """Upright lines that lie in the blanks between columns of text."""
    g = gaps.gap_scan(D.cell_text(spark, sf), TABLE, "x1", "x2", 20)
    tall = D.cell_text(spark, sf).groupBy("table_id").agg((F.min("y1") - 20).alias("y1"), (F.max("y2") + 20).alias("y2"))
    return borders.lines_in_boxes(D.stray_lines(spark, sf), g.join(tall, TABLE).select("table_id", F.col("first").alias("x1"), "y1", F.col("last").alias("x2"), "y2"), TABLE)


def frame_edges(spark: SparkSession, sf: str) -> DataFrame:
    return borders.frame_edges(_half_framed(spark, sf), D.cell_text(spark, sf), _frames(spark, sf), TABLE)


def added_borders(spark: SparkSession, sf: str) -> DataFrame:
    return borders.added_borders(materialised(frame_edges(spark, sf), "edges"), TABLE)


def framed_lines(spark: SparkSession, sf: str) -> DataFrame:
    return borders.framed_lines(_half_framed(spark, sf), D.cell_text(spark, sf), materialised(frame_edges(spark, sf), "edges"), TABLE)


def _short_uprights(spark: SparkSession, sf: str) -> DataFrame:
    """Ruled lines whose inner uprights end early (after the first row in even tables, three pixels early in others); in every fifth table one passes a column of text."""
    inner = (F.col("orient") == "v") & F.col("x1").isin(100, 250)
    x = lambda c: F.when(inner & (F.col("table_id") % 5 == 0) & (F.col("x1") == 100), 116).otherwise(F.col(c))
    y2 = F.when(inner, F.when(F.col("table_id") % 2 == 0, F.least(F.lit(40), F.col("y2"))).otherwise(F.col("y2") - 3)).otherwise(F.col("y2"))
    return D.rule_lines(spark, sf).select("table_id", "orient", x("x1").alias("x1"), "y1", x("x2").alias("x2"), y2.alias("y2")).where("y2 > y1 or orient = 'h'")


def drawn_uprights(spark: SparkSession, sf: str) -> DataFrame:
    return borders.drawn_uprights(_short_uprights(spark, sf), D.cell_text(spark, sf), TABLE)


def stretched_uprights(spark: SparkSession, sf: str) -> DataFrame:
    return borders.stretched_uprights(_short_uprights(spark, sf), D.cell_text(spark, sf), TABLE)


def cluster_lines(spark: SparkSession, sf: str) -> DataFrame:
    return borders.cluster_lines(_dealt(spark, sf, _cells(spark, sf).where("x1 >= 100 and x2 <= 250")), D.stray_lines(spark, sf), TABLE)


def cluster_bounds(spark: SparkSession, sf: str) -> DataFrame:
    return borders.cluster_bounds(_dealt(spark, sf, _cells(spark, sf).where("x1 >= 100 and x2 <= 250")), D.rule_lines(spark, sf), TABLE, 8)


def semi_bordered_cells(spark: SparkSession, sf: str) -> DataFrame:
    """New cells around the middle column of each table."""
    return borders.semi_bordered_cells(_dealt(spark, sf, _cells(spark, sf).where("x1 >= 100 and x2 <= 250")), D.rule_lines(spark, sf), TABLE, 8)


def _some_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Ruled lines without every other level one inside a table."""
    return D.rule_lines(spark, sf).withColumn("__m", F.max("y2").over(Window.partitionBy("table_id"))).where("orient = 'v' or y1 % 80 = 0 or y1 = __m").drop("__m")


def implicit_rows(spark: SparkSession, sf: str) -> DataFrame:
    return borders.implicit_rows(D.cell_text(spark, sf), _some_lines(spark, sf), _frames(spark, sf), TABLE)


def implicit_grid(spark: SparkSession, sf: str) -> DataFrame:
    """A table drawn again with the rows that its text implies."""
    lines_ = _some_lines(spark, sf)
    tables = lines_.groupBy("table_id").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"))
    return grid.grid_from_lines(lines_.unionByName(borders.implicit_rows(D.cell_text(spark, sf), lines_, tables, TABLE)), TABLE)


QUERIES |= {
    f.__name__: f
    for f in (
        dup_upright_drop, lines_in_gaps, frame_edges, added_borders, framed_lines, drawn_uprights, stretched_uprights, cluster_lines, cluster_bounds, semi_bordered_cells, implicit_rows,
        implicit_grid,
    )
}


def structure_text(spark: SparkSession, sf: str) -> DataFrame:
    return text.structure_text(D.structure_tree(spark, sf), PAGE)


def element_join(spark: SparkSession, sf: str) -> DataFrame:
    """Turns as elements, two to a line; every third has a number, every third a bullet."""
    t = D.read(spark, sf, "conversations")
    tag = F.when(F.col("turn") % 3 == 0, F.concat((F.col("turn") + 1).cast("string"), F.lit(". "))).when(F.col("turn") % 3 == 1, F.lit("• ")).otherwise(F.lit(""))
    return text.joined_elements(t.select("conv_id", "turn", F.floor(F.col("turn") / 2).alias("line"), F.concat(tag, F.coalesce("text", F.lit(""))).alias("text")), ["conv_id"], "turn", "line")


def text_elements(spark: SparkSession, sf: str) -> DataFrame:
    return layout.text_elements(D.layout_objects(spark, sf)).select("page_id", "obj_id", "x1", "y1", "x2", "y2")


def picture_chunks(spark: SparkSession, sf: str) -> DataFrame:
    o = D.layout_objects(spark, sf)
    return layout.picture_chunks(o, layout.text_elements(o), PAGE, 800, 1000, "img")


def page_html(spark: SparkSession, sf: str) -> DataFrame:
    """A customer's tables as one document, with captions: by the top of their first cell, which comes from the order's key."""
    own = D.read(spark, sf, "orders").select(F.col("o_orderkey").alias("table_id"), F.col("o_custkey").alias("page_id"), F.concat(F.lit("Order "), F.col("o_orderstatus")).alias("title"))
    cells = materialised(_filled(spark, sf).join(own, "table_id").withColumn("y1", (F.col("y1") + F.col("table_id") % 7 * 1000).cast("int")), "page-cells")
    tables = render.html(cells, ["page_id", "table_id"], title="title").join(render.table_order(cells, PAGE, "table_id"), ["page_id", "table_id"])
    return render.html_page(tables.withColumn("page_no", F.lit(1)), PAGE, "table_pos", "page_no")


QUERIES |= {f.__name__: f for f in (structure_text, element_join, text_elements, picture_chunks, page_html)}


def _page(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Text boxes and bounds of each page."""
    e = D.page_texts(spark, sf)
    return e, whitespace.hull(e, TABLE, 10)


def upright_blanks(spark: SparkSession, sf: str) -> DataFrame:
    return whitespace.blanks(*_page(spark, sf), TABLE, 8, 20, 0.25)


def level_blanks(spark: SparkSession, sf: str) -> DataFrame:
    return whitespace.blanks(*_page(spark, sf), TABLE, 1, 1, 0.66, level=True)


def column_blanks(spark: SparkSession, sf: str) -> DataFrame:
    return whitespace.column_blanks(*_page(spark, sf), TABLE, 8, 20, 0.25)


def _areas(spark: SparkSession, sf: str) -> DataFrame:
    return _dealt(spark, sf, materialised(whitespace.areas(*_page(spark, sf), TABLE, 8, 60), "areas"))


def page_areas(spark: SparkSession, sf: str) -> DataFrame:
    """Parts of a page between blanks of 30 pixels or more over its whole width."""
    return _areas(spark, sf).groupBy("table_id", "area_id").agg(*[F.first(f"a{c}").alias(c) for c in ("x1", "y1", "x2", "y2")], F.count(F.lit(1)).alias("n"))


def area_blanks(spark: SparkSession, sf: str) -> DataFrame:
    return whitespace.area_blanks(whitespace.areas(*_page(spark, sf), TABLE, 8, 60), TABLE, 8, 40)


def area_chains(spark: SparkSession, sf: str) -> DataFrame:
    parted = _areas(spark, sf)
    return whitespace.area_chains(parted, materialised(whitespace.area_blanks(parted, TABLE, 8, 40), "area-blanks"), TABLE, 8, 40)


def row_delimiters(spark: SparkSession, sf: str) -> DataFrame:
    return whitespace.row_delimiters(*_page(spark, sf), TABLE)


def _column_blanks(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    e = D.column_texts(spark, sf)
    bounds = whitespace.hull(e, TABLE, 10)
    ruled = bounds.where("table_id % 5 = 0").select("table_id", F.lit("h").alias("orient"), F.lit(140).alias("x1"), F.lit(5).alias("y1"), F.lit(260).alias("x2"), F.lit(5).alias("y2"))
    return whitespace.text_column_blanks(e, bounds, ruled, TABLE, 8), bounds


def text_column_blanks(spark: SparkSession, sf: str) -> DataFrame:
    """Blanks between text columns; in every fifth page a level line cuts the one in the middle."""
    return _column_blanks(spark, sf)[0]


def column_groups(spark: SparkSession, sf: str) -> DataFrame:
    found, bounds = _column_blanks(spark, sf)
    return whitespace.column_groups(_dealt(spark, sf, materialised(found, "text-columns")), bounds, TABLE)


def column_segments(spark: SparkSession, sf: str) -> DataFrame:
    return whitespace.column_segments(column_groups(spark, sf), TABLE)


QUERIES |= {f.__name__: f for f in (upright_blanks, level_blanks, column_blanks, page_areas, area_blanks, area_chains, row_delimiters, text_column_blanks, column_groups, column_segments)}


def element_boxes(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.element_boxes(D.glyphs(spark, sf), 12).select("table_id", "glyph_id")


def noise_drop(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.drop_noise(D.glyphs(spark, sf), TABLE).select("table_id", "glyph_id")


def dotted_lines(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.dotted_lines(D.glyphs(spark, sf), TABLE)


def dotted_drop(spark: SparkSession, sf: str) -> DataFrame:
    return glyphs.drop_dotted(D.glyphs(spark, sf).select("table_id", "glyph_id", "x1", "y1", "x2", "y2"), TABLE).select("table_id", "glyph_id")


def near_pieces(spark: SparkSession, sf: str) -> DataFrame:
    g = D.glyphs(spark, sf)
    return glyphs.near_pieces(g.where("kind = 'char' and x1 < 200"), g.where("kind <> 'char'"), TABLE, "glyph_id", 8).select("table_id", "glyph_id")


def refit_boxes(spark: SparkSession, sf: str) -> DataFrame:
    """Text boxes as their characters make them."""
    return glyphs.refit(D.cell_text(spark, sf), D.glyphs(spark, sf).where("kind = 'char'"), TABLE, "box_id")


QUERIES |= {f.__name__: f for f in (element_boxes, noise_drop, dotted_lines, dotted_drop, near_pieces, refit_boxes)}
