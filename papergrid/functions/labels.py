"""Layout labels: three detectors' vocabularies and the names that the rest works with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# A detector's label, compared without regard to case, and its canonical name. Any other is "Unknown".
CANONICAL = {
    "caption": "Caption",
    "footnote": "Footnote",
    "formula": "Formula",
    "list-item": "List-item",
    "page-footer": "Page-footer",
    "footer": "Page-footer",
    "page-header": "Page-header",
    "header": "Page-header",
    "picture": "Picture",
    "figure": "Picture",
    "image": "Picture",
    "figure_caption": "Caption",
    "figure_title": "Caption",
    "formula_caption": "Caption",
    "table_caption": "Caption",
    "section-header": "Section-header",
    "paragraph_title": "Section-header",
    "table": "Table",
    "table_footnote": "table_footnote",
    "text": "Text",
    "plain text": "Text",
    "abstract": "Text",
    "content": "Text",
    "aside_text": "Text",
    "number": "number",
    "title": "Title",
    "doc_title": "Title",
    "abandon": "abandon",
    "isolate_formula": "isolate_formula",
    "chart": "Chart",
}
# Labels (case as written) that go to the head of a page, to its foot, or out of the reading order.
HEAD_LABELS = ("Page-header", "header")
FOOT_LABELS = ("Page-footer", "footer")
ARTIFACT_LABELS = ("abandon", "Footnote", "number", "page_number")
# Heading level of a rendered block.
HEADING_LEVEL = {"Title": 1, "Section-header": 2, "Page-header": 3, "Caption": 4, "table_footnote": 5}


def canonical(label: Column) -> Column:
    pairs = [F.lit(x) for kv in CANONICAL.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), F.lower(F.coalesce(label, F.lit("")))), F.lit("Unknown"))


def is_table(label: Column) -> Column:
    return F.lower(label) == "table"


def heading_level(canonical_label: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in HEADING_LEVEL.items() for x in kv]), canonical_label)
