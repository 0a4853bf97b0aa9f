"""Text of boxes: lines, paragraphs, list items, key-value tables, tagged structure, rendering of chunks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import canonical, heading_level
from ..functions.text import DASHES, ends_paragraph, ends_with_space, escape_markdown, heading, list_tag
from .gaps import gap_scan, islands


def line_texts(words: DataFrame, keys: list[str], line: str, word: str, text: str) -> DataFrame:
    """A line's words in order; a space goes between two unless one ends or the other begins with a dash or white space."""
    w = Window.partitionBy(*keys, line).orderBy(word)
    bare = F.rlike(F.lag(text).over(w), F.lit(f"[{DASHES}\\s]$")) | F.rlike(F.col(text), F.lit(f"^[{DASHES}\\s]"))
    part = F.concat(F.when(F.lag(text).over(w).isNull() | bare, F.lit("")).otherwise(F.lit(" ")), text)
    parts = words.select(*keys, line, F.struct(F.col(word).alias("o"), part.alias("p")).alias("s"))
    return parts.groupBy(*keys, line).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["p"]), "").alias("line_text"))


def fold_paragraphs(lines: DataFrame, keys: list[str], line: str, text: str = "line_text") -> DataFrame:
    """Paragraphs: lines up to one that ends in a period, or to one that begins a list item. Without its period a paragraph ends in a space and the blank line.
    One of white space alone is a line break."""
    by = Window.partitionBy(*keys).orderBy(line)
    tagged = lines.withColumn("__end", ends_paragraph(F.col(text))).withColumn("__tag", list_tag(F.col(text)).isNotNull())
    new = (F.coalesce(F.lag("__end").over(by), F.lit(False)) | (F.col("__tag") & F.lag(text).over(by).isNotNull())).cast("int")
    grouped = tagged.withColumn("__new", new).withColumn("para_id", F.sum("__new").over(by.rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    agg = grouped.groupBy(*keys, "para_id").agg(F.array_sort(F.collect_list(F.struct(F.col(line).alias("o"), F.col(text).alias("t")))).alias("ls"), F.max("__end").alias("ended"))
    own = F.array_join(F.transform("ls", lambda x: x["t"]), " ")
    whole = F.when(F.rlike(own, F.lit("^\\s*$")), F.lit("\n")).otherwise(F.concat(own, F.when(F.col("ended"), F.lit("\n\n")).otherwise(F.lit(" \n\n"))))
    return agg.select(*keys, "para_id", F.size("ls").alias("n_lines"), whole.alias("text"), list_tag(F.element_at("ls", 1)["t"]).alias("list_tag"))


def joined_elements(elements: DataFrame, keys: list[str], order: str, baseline: str, bullets: bool = False) -> DataFrame:
    """Text of elements in order: one that begins a list item on another line than the one before goes on a line of its own after ``- ``
    (without its tag, unless ``bullets``); others get a space before them on another line, where none is yet."""
    by = Window.partitionBy(*keys).orderBy(order)
    before = F.lag("text").over(by)
    other_line = before.isNotNull() & (F.lag(baseline).over(by) != F.col(baseline))
    begins = list_tag(F.col("text")).isNotNull() & (before.isNull() | other_line)
    bare = F.col("text") if bullets else F.regexp_replace("text", "^[ \\t]*[^ \\t]+", "")
    part = F.when(begins, F.concat(F.lit("\n\n- "), bare)).when(other_line & ~ends_with_space(before), F.concat(F.lit(" "), "text")).otherwise(F.col("text"))
    parts = elements.select(*keys, F.struct(F.col(order).alias("o"), part.alias("p")).alias("s"))
    return parts.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list("s")), lambda x: x["p"]), "").alias("text"))


def appended(buffer: Column, text: Column, space: bool = False, line: bool = False) -> Column:
    """``text`` behind ``buffer``, after a space or a line break if asked for and if there is anything before it."""
    between = F.lit("\n" if line else " " if space else "")
    return F.when(F.coalesce(buffer, F.lit("")) == "", text).otherwise(F.concat(buffer, between, text))


def structure_text(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Of nodes in pre-order (seq, last: the last node under it, type, text): each cell's text, that of all nodes under it; after a paragraph or list item that isn't the first thing comes a line break."""
    so_far = Window.partitionBy(*keys).orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    cell = F.upper("type").isin("TH", "TD")
    owner = nodes.withColumn("__c", F.last(F.when(cell, F.struct("seq", "last")), ignorenulls=True).over(so_far))
    none = F.array().cast("array<struct<at:int,t:string>>")
    close = F.when(F.upper("type").isin("P", "LI"), F.array(F.struct((F.col("last") * 2 + 1).cast("int").alias("at"), F.lit("\n").alias("t")))).otherwise(none)
    own = F.when(F.col("seq") <= F.col("__c.last"), F.concat(F.array(F.struct((F.col("seq") * 2).cast("int").alias("at"), F.coalesce("text", F.lit("")).alias("t"))), close)).otherwise(none)
    mark = F.array(F.struct((F.col("seq") * 2).cast("int").alias("at"), F.lit("").alias("t")))  # a cell's own, so one without nodes is there too
    events = owner.select(*keys, F.when(cell, F.col("seq")).otherwise(F.col("__c.seq")).alias("seq"), F.explode(F.when(cell, mark).otherwise(own)).alias("e"))
    return events.groupBy(*keys, "seq").agg(F.regexp_replace(F.array_join(F.transform(F.array_sort(F.collect_list("e")), lambda x: x["t"]), ""), "^\n+", "").alias("text"))


def key_value_tables(boxes: DataFrame, keys: list[str], order: list[str], min_gap: int) -> DataFrame:
    """Rows of a key-value table: line_id, key and value boxes' bounds and texts.

    A key qualifies if all its text leaves at most one gap of x free, no line has more
    than one, and some line has one. A line without a gap is a key, or a value if it
    reaches the right eighth but not the left one.
    """
    lined = islands(boxes, keys, "y1", "y2", order, 0, "line_id")
    whole = gap_scan(boxes, keys, "x1", "x2", min_gap).groupBy(*keys).agg(F.count(F.lit(1)).alias("g"))
    gaps = gap_scan(lined, [*keys, "line_id"], "x1", "x2", min_gap)
    per_line = gaps.groupBy(*keys, "line_id").agg(F.count(F.lit(1)).alias("n"), F.min("centre").alias("split"))
    fits = per_line.groupBy(*keys).agg(F.max("n").alias("m")).where("m = 1").join(whole, keys, "left").where("coalesce(g, 0) <= 1").select(*keys)
    page = boxes.groupBy(*keys).agg(F.min("x1").alias("left"), F.max("x2").alias("right"))
    rows = lined.join(fits, keys, "left_semi").join(per_line.select(*keys, "line_id", "split"), [*keys, "line_id"], "left").join(page, keys)
    is_key = F.when(F.col("split").isNotNull(), F.col("x1") < F.col("split")).otherwise(~((F.col("x1") - F.col("left") >= (F.col("right") - F.col("left")) / 8) & (F.col("right") - F.col("x2") < (F.col("right") - F.col("left")) / 8)))
    side = rows.withColumn("__key", is_key)
    ordered = lambda on: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(on, F.struct("x1", "text")))), lambda x: x["text"]), " ")
    return side.groupBy(*keys, "line_id").agg(F.min("y1").alias("y1"), F.max("y2").alias("y2"), F.first("split").cast("int").alias("split"), ordered(F.col("__key")).alias("key_text"), ordered(~F.col("__key")).alias("value_text"))


def tagged_tables(nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Nodes of a structure tree in pre-order (seq, type, text) to cells: table_ord, row_id, col_id, text."""
    by = Window.partitionBy(*keys).orderBy("seq")
    so_far = by.rowsBetween(Window.unboundedPreceding, 0)
    kind = lambda *names: F.sum(F.col("type").isin(*names).cast("int")).over(so_far).cast("int")
    known = nodes.withColumn("table_ord", kind("Table") - 1).withColumn("__row", kind("TR", "THead"))
    cells = known.where(F.col("type").isin("TH", "TD"))
    col = F.row_number().over(Window.partitionBy(*keys, "table_ord", "__row").orderBy("seq")) - 1
    row = F.dense_rank().over(Window.partitionBy(*keys, "table_ord").orderBy("__row")) - 1
    return cells.select(*keys, "table_ord", row.cast("int").alias("row_id"), col.cast("int").alias("col_id"), "text")


def render_chunk(label: Column, text: Column, escape: bool = True) -> Column:
    """Markdown of a chunk by its canonical label; unknown ones and artifacts give null."""
    body = escape_markdown(text) if escape else text
    level = heading_level(label)
    return (
        F.when(label.isin("Unknown", "abandon", "number"), F.lit(None).cast("string"))
        .when(level.isNotNull(), F.concat(heading(level), body, F.lit("\n\n")))
        .when(label == "List-item", F.concat(F.lit("- "), body, F.lit("\n")))
        .when(label == "Table", F.concat(text, F.lit("\n\n")))
        .otherwise(F.concat(body, F.lit("\n\n")))
    )


def document_markdown(chunks: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Chunks (label, text) of a document in order, one line break after each; empty chunks are left out."""
    md = render_chunk(canonical(F.col("label")), F.col("text"))
    shown = chunks.where(F.trim("text") != "").withColumn("md", md).where("md is not null")
    agg = shown.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "md"))).alias("parts"))
    return agg.select(*keys, F.size("parts").alias("n_chunks"), F.array_join(F.transform("parts", lambda p: F.concat(p["md"], F.lit("\n"))), "").alias("markdown"))
