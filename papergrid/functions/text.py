"""Scalar text rules: periods, dashes, list tags, Markdown pieces, media types."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Characters that end a paragraph; characters after or before which no space is put.
PERIODS = ".。．｡"
DASHES = "-‐‑‒–—―−﹣－"
# File extensions and media types; others are JPEG.
MEDIA_TYPES = {".png": "image/png", ".jpg": "image/jpeg", ".jpeg": "image/jpeg", ".gif": "image/gif", ".bmp": "image/bmp", ".webp": "image/webp", ".tiff": "image/tiff", ".svg": "image/svg+xml"}
#: Our own rule for list items: a bullet, or a number or single letter with a period or bracket, before a space or the end.
BULLET, TAG = "^[ \\t]*[•●○▪■◦‣·*–-]([ \\t]|$)", "^[ \\t]*([0-9]{1,3}|[A-Za-z])[.)]([ \\t]|$)"


def ends_paragraph(text: Column) -> Column:
    return F.rlike(text, F.lit(f"[{PERIODS}]\\s*$"))


def is_period(c: Column) -> Column:
    return c.isin(*PERIODS)


def is_dash(c: Column) -> Column:
    return c.isin(*DASHES)


def begins_paragraph(text: Column) -> Column:
    """Starts with a capital letter, a digit or a list tag."""
    return F.rlike(F.ltrim(text), F.lit("^[A-Z0-9]")) | is_bullet(text) | is_ordered_tag(text)


def is_bullet(text: Column) -> Column:
    return F.rlike(text, F.lit(BULLET))


def is_ordered_tag(text: Column) -> Column:
    return F.rlike(text, F.lit(TAG))


def list_tag(text: Column) -> Column:
    """The tag without spaces around it; null if the text begins no list item."""
    return F.when(is_bullet(text) | is_ordered_tag(text), F.regexp_extract(text, "^[ \\t]*([^ \\t]+)", 1))


def ends_with_space(text: Column) -> Column:
    return F.rlike(text, F.lit("[ \\n]$"))


def escape_markdown(text: Column) -> Column:
    return F.regexp_replace(text, "([\\\\`*_~#+\\-!])", "\\\\$1")


def heading(level: Column | int) -> Column:
    n = F.lit(level) if isinstance(level, int) else level
    return F.concat(F.repeat(F.lit("#"), F.least(F.greatest(n, F.lit(1)), F.lit(6)).cast("int")), F.lit(" "))


def list_prefix(ordered: Column, tag: Column, level: Column | int = 1) -> Column:
    """``- `` or the ordered tag, two spaces deeper for each level after the first."""
    n = F.lit(level) if isinstance(level, int) else level
    return F.concat(F.repeat(F.lit("  "), F.greatest(n - 1, F.lit(0)).cast("int")), F.when(ordered & tag.isNotNull(), F.concat(tag, F.lit(" "))).otherwise(F.lit("- ")))


def picture(url: Column, alt: Column) -> Column:
    return F.concat(F.lit("!["), alt, F.lit("]("), url, F.lit(")"))


def media_type(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, "(\\.[^./\\\\]*)$", 1))
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in MEDIA_TYPES.items() for x in kv]), ext), F.lit("image/jpeg"))


def data_uri(content: Column, path: Column) -> Column:
    """Spark's base64 breaks lines after 76 characters; a data URI has none."""
    return F.concat(F.lit("data:"), media_type(path), F.lit(";base64,"), F.translate(F.base64(content), "\r\n", ""))


def from_data_uri(uri: Column) -> Column:
    return F.unbase64(F.substring_index(uri, ",", -1))


def line_breaks_to_html(text: Column) -> Column:
    return F.replace(text, F.lit("\n"), F.lit("<br />"))
