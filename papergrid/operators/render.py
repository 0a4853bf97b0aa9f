"""Tables as Markdown, HTML, JSON and the canonical dump; all of it string expressions over a table's cells in order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import line_breaks_to_html


def _rows(cells: DataFrame, keys: list[str], fields: list[str]) -> DataFrame:
    """Per table an array of rows, each an array of cells, both in order."""
    row = cells.groupBy(*keys, "row_id").agg(F.array_sort(F.collect_list(F.struct("col_id", *fields))).alias("cells"))
    return row.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("row_id", "cells"))).alias("rows"))


def _joined(array: Column, f, by: str = "") -> Column:
    return F.array_join(F.transform(array, f), by)


def markdown(cells: DataFrame, keys: list[str], title: Column | None = None) -> DataFrame:
    """``# title`` (or ``##``), the first row as head, a rule, the other rows. Spans are not shown."""
    line = lambda r: F.concat(F.lit(" | "), _joined(r["cells"], lambda c: line_breaks_to_html(F.coalesce(c["content"], F.lit(""))), " | "), F.lit(" | \n"))
    rule = F.concat(F.lit(" | "), _joined(F.element_at("rows", 1)["cells"], lambda _: F.lit("---"), " | "), F.lit(" | \n"))
    head = F.lit("##\n") if title is None else F.when(F.coalesce(title, F.lit("")) != "", F.concat(F.lit("# "), title, F.lit("\n\n"))).otherwise(F.lit("##\n"))
    table = _rows(cells, keys, ["content"])
    return table.select(*keys, F.concat(head, line(F.element_at("rows", 1)), rule, _joined(F.slice("rows", F.lit(2), F.size("rows")), line)).alias("markdown"))


def html(cells: DataFrame, keys: list[str], first_row_head: bool = False, key_value: bool = False, title: str | None = None) -> DataFrame:
    """``<table>`` with spans, and with the column ``title`` (constant in a table) as its caption where it isn't empty. The head holds as many rows as its first spanning cell; it is left out if these exceed two, for a single row, or for key-value tables."""
    table = _rows(cells, keys, ["content", "rowspan", "colspan"])
    caption = F.lit("")
    if title:
        table = table.join(cells.groupBy(*keys).agg(F.max(title).alias("__title")), keys)
        caption = F.when(F.coalesce("__title", F.lit("")) != "", F.concat(F.lit("<caption>"), "__title", F.lit("</caption>"))).otherwise(caption)
    spanning = F.filter(F.element_at("rows", 1)["cells"], lambda c: c["rowspan"] > 1)
    head = F.when(F.size(spanning) > 0, F.element_at(spanning, 1)["rowspan"]).otherwise(1)
    table = table.withColumn("__head", F.when(F.lit(first_row_head and not key_value) & (head <= 2) & (F.size("rows") > 1), head).otherwise(0))

    def cell(tag):
        def made(c):
            kind = F.when(c["rowspan"] > F.col("__head"), F.lit("td")).otherwise(F.lit("th")) if tag == "th" else F.lit("td")
            attr = F.concat(F.when(c["rowspan"] > 1, F.concat(F.lit(' rowspan="'), c["rowspan"].cast("string"), F.lit('"'))).otherwise(F.lit("")), F.when(c["colspan"] > 1, F.concat(F.lit(' colspan="'), c["colspan"].cast("string"), F.lit('"'))).otherwise(F.lit("")))
            return F.concat(F.lit("<"), kind, attr, F.lit(">"), F.coalesce(c["content"], F.lit("")), F.lit("</"), kind, F.lit(">"))

        return made

    rows = lambda a, tag: _joined(a, lambda r: F.concat(F.lit("<tr>"), _joined(r["cells"], cell(tag)), F.lit("</tr>")))
    heads = F.when(F.col("__head") > 0, F.concat(F.lit("<thead>"), rows(F.slice("rows", F.lit(1), F.col("__head")), "th"), F.lit("</thead>"))).otherwise(F.lit(""))
    body = rows(F.slice("rows", F.col("__head") + 1, F.size("rows")), "td")
    return table.select(*keys, F.concat(F.lit("<table>"), caption, heads, body, F.lit("</table>")).alias("html"))


def table_order(cells: DataFrame, keys: list[str], table: str) -> DataFrame:
    """A page's tables by the top of their first cell; those without cells last. Columns: keys, the table, table_pos."""
    tops = cells.groupBy(*keys, table).agg(F.min_by("y1", F.struct("row_id", "col_id")).alias("top"))
    by = Window.partitionBy(*keys).orderBy(F.col("top").asc_nulls_last(), table)
    return tops.select(*keys, table, (F.row_number().over(by) - 1).alias("table_pos"))


def html_page(tables: DataFrame, keys: list[str], order: str, page_no: str) -> DataFrame:
    """A page's tables (html) in order, as a document with charset and page number."""
    agg = tables.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(order, "html"))).alias("t"), F.first(page_no).alias("p"))
    head = F.concat(F.lit('<html><head><meta charset="utf-8"><meta pageNo="'), F.col("p").cast("string"), F.lit('"></head><body>'))
    return agg.select(*keys, F.concat(head, _joined(F.col("t"), lambda x: x["html"]), F.lit("</body></html>")).alias("html"))


def json_tables(cells: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of cells with box, text and spans."""
    fields = ["x1", "y1", "x2", "y2", "content", "rowspan", "colspan"]
    table = _rows(cells, keys, fields)
    nested = F.transform("rows", lambda r: F.struct(F.transform(r["cells"], lambda c: F.struct(*[c[f].alias(f) for f in fields])).alias("items")))
    return table.select(*keys, F.to_json(F.struct(nested.alias("items"))).alias("json"))


JSON_SCHEMA = "items array<struct<items:array<struct<x1:int,y1:int,x2:int,y2:int,content:string,rowspan:int,colspan:int>>>>"


def from_json_tables(tables: DataFrame, keys: list[str]) -> DataFrame:
    """The cells again: row_id (its place), box, text, spans."""
    rows = tables.select(*keys, F.posexplode(F.from_json("json", JSON_SCHEMA)["items"]).alias("row_id", "r"))
    return rows.select(*keys, "row_id", F.posexplode("r.items").alias("item", "c")).select(*keys, "row_id", "item", "c.*")


def dump(grid: DataFrame, keys: list[str], title: str = "Untitled", borderless: bool = False) -> DataFrame:
    """The canonical text of a table: its size and every slot's box."""
    table = _rows(grid, keys, ["x1", "y1", "x2", "y2"])
    cell = lambda r: lambda c: F.concat(F.lit("    Cell["), r["row_id"].cast("string"), F.lit(","), c["col_id"].cast("string"), F.lit("] - X1: "), c["x1"].cast("string"), F.lit(", Y1: "), c["y1"].cast("string"), F.lit(", X2: "), c["x2"].cast("string"), F.lit(", Y2: "), c["y2"].cast("string"), F.lit("\n"))
    row = lambda r: F.concat(F.lit("  Row "), (r["row_id"] + 1).cast("string"), F.lit(":\n"), _joined(r["cells"], cell(r)))
    head = F.concat(F.lit(f"Table Title: {title}\nNumber of Rows: "), F.size("rows").cast("string"), F.lit("\nNumber of Columns: "), F.size(F.element_at("rows", 1)["cells"]).cast("string"), F.lit(f"\nBorderless: {borderless}\nRows:\n"))
    return table.select(*keys, F.concat(head, _joined(F.col("rows"), row)).alias("dump"))


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One document per line break of the file set, as the text sink writes it."""
    df.select(F.col(column).alias("value")).write.text(path, lineSep="\n")
