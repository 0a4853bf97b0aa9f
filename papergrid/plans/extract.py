"""The three entries as plans: ruled lines and text to filled tables; structure trees to tables; layout objects and text to a document."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.labels import canonical
from ..operators import borderless, grid, layout, lines, overlap, render, text, whitespace
from ..shared import materialised


def borderless_tables(texts: DataFrame, keys: list[str], min_gap: int, char_width: int, line_sep: int) -> DataFrame:
    """Tables of a page without ruled lines: its text is parted by full-width blanks, areas with like columns are chained to segments, and each segment is read as a grid.

    ``texts`` has text_id and a box. Columns: keys, table_ord (the segment), row_id, col_id, x1, y1, x2, y2.
    """
    parted = materialised(whitespace.areas(texts.select(*keys, "text_id", "x1", "y1", "x2", "y2"), whitespace.hull(texts, keys, char_width), keys, char_width, line_sep), "areas")
    spaces = materialised(whitespace.area_blanks(parted, keys, char_width, line_sep), "area-blanks")
    chains = whitespace.area_chains(parted, spaces, keys, char_width, line_sep).select(*keys, "area_id", F.col("segment_id").alias("table_ord"))
    by = [*keys, "table_ord"]
    own = materialised(parted.join(chains, [*keys, "area_id"]).select(*by, "text_id", "x1", "y1", "x2", "y2"), "segments")
    return borderless.borderless_grid(own, by, ["text_id"], min_gap, char_width, line_sep)


def filled_tables(lined: DataFrame, texts: DataFrame, keys: list[str], min_gap: int = 20, char_width: int = 8, line_sep: int = 20, least_line: int = 20, allow_borderless: bool = True) -> DataFrame:
    """Tables of each key with spans and text: from ruled lines where there are any, else from text alone.

    ``texts`` has text_id, x1, y1, x2, y2, text. Columns: keys, table_ord, borderless,
    row_id, col_id, rowspan, colspan, x1, y1, x2, y2, content.
    """
    by = [*keys, "table_ord"]
    clean = materialised(lines.remove_noise(lined, texts, keys, least_line), "lines")
    slots = grid.table_from_lines(clean, keys)
    if allow_borderless:
        bare = borderless_tables(texts, keys, min_gap, char_width, line_sep)
        slots = borderless.dispatch(slots, bare.select(slots.columns), keys)
    else:
        slots = slots.withColumn("borderless", F.lit(False))
    slots = materialised(slots, "slots")
    kinds = slots.select(*by, "borderless").distinct()
    cells = materialised(grid.spans(slots, by), "spans")
    inside = overlap.place_text(texts.select(*keys, "text_id", "x1", "y1", "x2", "y2", "text"), cells.select(*by, "row_id", "col_id", "x1", "y1", "x2", "y2"), keys, "text_id", also=("table_ord",))
    contents = overlap.joined_text(inside, by, "text_id").select(*by, "row_id", "col_id", "content")
    return cells.join(contents, [*by, "row_id", "col_id"], "left").withColumn("content", F.coalesce("content", F.lit(""))).join(kinds, by)


def tables_as_html(lined: DataFrame, texts: DataFrame, keys: list[str], first_row_head: bool = True) -> DataFrame:
    """A page's tables as one HTML document each."""
    tables = render.html(filled_tables(lined, texts, keys), [*keys, "table_ord"], first_row_head)
    return render.html_page(tables.withColumn("page_no", F.lit(1)), keys, "table_ord", "page_no")


def structure_tables(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Tables of a tagged document: cells without place, as Markdown."""
    return render.markdown(text.tagged_tables(nodes, keys).withColumnRenamed("text", "content"), [*keys, "table_ord"])


def document(objects: DataFrame, words: DataFrame, page_keys: list[str], doc_keys: list[str], page_order: str, min_gap: int = 30) -> DataFrame:
    """Markdown of each document: objects suppressed and ordered, each with its words' paragraphs, pages in order.

    ``objects`` has obj_id, label, confidence_pct and a box; ``words`` has line_no, word_no, text and a box.
    """
    kept = layout.drop_contained(layout.suppress(objects, page_keys).drop("pos"), page_keys)
    ordered = materialised(layout.reading_order(materialised(kept.drop("pos"), "kept"), page_keys, min_gap), "ordered")
    met = layout.elements_in_objects(ordered.select(*page_keys, "obj_id", "x1", "y1", "x2", "y2"), words, page_keys)
    inner = met.select(*[F.col(f"a_{k}").alias(k) for k in page_keys], F.col("b_obj_id").alias("obj_id"), F.col("a_line_no").alias("line_no"), F.col("a_word_no").alias("word_no"), F.col("a_text").alias("text"))
    folded = text.fold_paragraphs(text.line_texts(inner, [*page_keys, "obj_id"], "line_no", "word_no", "text"), [*page_keys, "obj_id"], "line_no")
    parts = folded.groupBy(*page_keys, "obj_id").agg(F.array_sort(F.collect_list(F.struct("para_id", "text"))).alias("p"))
    chunks = ordered.join(parts.select(*page_keys, "obj_id", F.regexp_replace(F.array_join(F.transform("p", lambda x: x["text"]), ""), "\\s+$", "").alias("text")), [*page_keys, "obj_id"])
    chunks = chunks.where(canonical(F.col("label")) != "Unknown").withColumn("chunk_order", F.struct(page_order, "reading_pos"))
    return text.document_markdown(chunks.withColumn("label", canonical(F.col("label"))), doc_keys, "chunk_order")
