"""Boxes, lines and blocks that are derived from the test tables, whole tables and whole texts. All values are integers or strings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import half_even
from ..ship import map_arrow

LABELS = ("doc_title", "text", "paragraph_title", "table", "header", "footer", "Figure", "table_caption", "abandon", "seal")


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row per word: line_no, word_no. Split in the scan; texts are not dealt anew."""
    docs = read(spark, sf_dir, "documents")
    lines = docs.select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.select("doc_id", "line_no", F.posexplode(F.split("line", " ", -1)).alias("word_no", "word")).where("word <> ''")


def word_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box per word: eight pixels a character, twenty a line. Where a word begins is summed along its line, in the scan: no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, text in zip(batch.column(0), batch.column(1).to_pylist()):
                lines, at, word, x, wide = [], [], [], [], []
                for line_no, line in enumerate((text or "").split("\n")):
                    x1 = 0
                    for word_no, w in enumerate(line.split(" ")):
                        if w:
                            lines.append(line_no)
                            at.append(word_no)
                            word.append(w)
                            x.append(x1)
                            wide.append(8 * len(w))
                        x1 += 8 * (len(w) + 1)
                line, x1 = np.array(lines, np.int32), np.array(x, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array([i.as_py()] * len(at), batch.column(0).type), *(pa.array(c, pa.int32()) for c in (line, np.array(at, np.int32), x1, 20 * line, x1 + np.array(wide, np.int32), 20 * line + 16)), pa.array(word, pa.string())], names=["doc_id", "line_no", "word_no", "x1", "y1", "x2", "y2", "word"])

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    ints = [T.StructField(c, T.IntegerType()) for c in ("line_no", "word_no", "x1", "y1", "x2", "y2")]
    return map_arrow(docs, run, T.StructType([docs.schema["doc_id"], *ints, T.StructField("word", T.StringType())]))


#: Line items in a partition. Their boxes are alike, so partitions of some MB of compressed bytes, as Spark joins them, would hold millions.
PER_PART = 150_000
_parts: dict[tuple[str, str], int] = {}


def parts(spark: SparkSession, sf_dir: str) -> int:
    """Partitions of what is derived from line items: so many that each stays small."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _parts:
        _parts[key] = -(-read(spark, sf_dir, "lineitem").count() // PER_PART)
    return max(_parts[key], int(spark.conf.get("spark.sql.shuffle.partitions")))


def dealt(spark: SparkSession, sf_dir: str, rows: DataFrame, key: str) -> DataFrame:
    """Rows by key, in as many partitions as line items: joins of such tables deal nothing anew, and broadcast nothing."""
    return rows.repartition(parts(spark, sf_dir), key).hint("merge")


def numbered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items with ``ord``, their place in the order; partitioned by order."""
    by = Window.partitionBy("l_orderkey").orderBy("l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice")
    items = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_extendedprice", "l_quantity", "l_returnflag", "l_discount")
    return dealt(spark, sf_dir, items, "l_orderkey").select("l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_discount", F.row_number().over(by).alias("ord"))


def rule_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled lines of a table per order; every third table has a head cell over two columns."""
    n = dealt(spark, sf_dir, read(spark, sf_dir, "lineitem").select("l_orderkey"), "l_orderkey").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.count(F.lit(1)).cast("int").alias("n"))
    line = lambda o, x1, y1, x2, y2: F.struct(F.lit(o).alias("orient"), F.lit(x1).alias("x1"), y1.alias("y1"), F.lit(x2).alias("x2"), y2.alias("y2"))
    level = F.transform(F.sequence(F.lit(0), F.col("n")), lambda k: line("h", 0, k * 40, 400, k * 40))
    head = F.when(F.col("table_id") % 3 == 0, 40).otherwise(0)
    upright = F.array(*[line("v", x, head if x == 250 else F.lit(0), x, F.col("n") * 40) for x in (0, 100, 250, 400)])
    return n.select("table_id", F.explode(F.concat(level, upright)).alias("l")).select("table_id", "l.*")


def stray_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ruled lines, and in every other table an upright one right of all level ones and a level one above all upright ones."""
    lines = rule_lines(spark, sf_dir)
    n = lines.where("orient = 'v' and x1 = 0 and table_id % 2 = 0")
    over = n.select("table_id", F.lit("v").alias("orient"), F.lit(450).alias("x1"), "y1", F.lit(450).alias("x2"), "y2")
    return lines.unionByName(over).unionByName(n.select("table_id", F.lit("h").alias("orient"), F.lit(30).alias("x1"), F.lit(-60).alias("y1"), F.lit(90).alias("x2"), F.lit(-60).alias("y2")))


def rough_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells as a detector gives them: edges up to three pixels off, rows from the fifth on a hundred pixels lower, and over every fourth row a cell that the others cover."""
    rows = numbered_lines(spark, sf_dir)
    off = lambda c, k: ((F.col(c) + k) % 7 - 3).cast("int")
    top = (F.col("ord") - 1) * 40 + F.when(F.col("ord") > 4, 100).otherwise(0)
    cell = lambda k, left, right, a, b, c, d: F.struct(F.lit(k).alias("k"), (F.lit(left) + a).alias("x1"), (top + b).alias("y1"), (F.lit(right) + c).alias("x2"), (top + 40 + d).alias("y2"))
    p, q = (lambda k: off("l_partkey", k)), (lambda k: off("l_suppkey", k))
    own = [cell(0, 0, 100, p(0), q(0), p(1), q(1)), cell(1, 100, 250, p(1), q(2), p(2), q(3)), cell(2, 250, 400, p(2), q(4), p(3), q(5))]
    over = cell(3, 4, 396, F.lit(0), F.lit(4), F.lit(0), F.lit(-4))
    each = rows.select(F.col("l_orderkey").alias("table_id"), "ord", F.explode(F.when(F.col("ord") % 4 == 1, F.array(*own, over)).otherwise(F.array(*own))).alias("c"))
    return each.select("table_id", (F.col("ord") * 4 + F.col("c.k")).alias("cell_id"), "c.x1", "c.y1", "c.x2", "c.y2")


def cell_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three text boxes per line item."""
    rows = numbered_lines(spark, sf_dir)
    parts = F.array(
        F.struct(F.lit(10).alias("x"), F.col("l_partkey").cast("string").alias("t")),
        F.struct(F.lit(110).alias("x"), F.col("l_quantity").cast("int").cast("string").alias("t")),
        F.struct(F.lit(260).alias("x"), F.col("l_returnflag").alias("t")),
    )
    each = rows.select(F.col("l_orderkey").alias("table_id"), "ord", F.posexplode(parts).alias("k", "p"))
    y = (F.col("ord") - 1) * 40 + 10
    return each.select("table_id", ((F.col("ord") - 1) * 3 + F.col("k")).alias("box_id"), F.col("p.x").alias("x1"), y.alias("y1"), (F.col("p.x") + F.length("p.t") * 8).alias("x2"), (y + 16).alias("y2"), F.col("p.t").alias("text"))


def layout_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detected objects of a page per order; every other one has a near copy with another confidence."""
    rows = numbered_lines(spark, sf_dir)
    x, y = (F.col("l_partkey") * 37) % 700, (F.col("l_suppkey") * 53) % 900
    label = F.element_at(F.array(*map(F.lit, LABELS)), (F.col("l_partkey") % 10 + 1).cast("int"))
    base = rows.select(
        F.col("l_orderkey").alias("page_id"), (F.col("ord") * 2).alias("obj_id"), label.alias("label"), half_even(F.col("l_discount") * 100).alias("confidence_pct"),
        x.cast("int").alias("x1"), y.cast("int").alias("y1"), (x + 60 + F.col("l_partkey") % 200).cast("int").alias("x2"), (y + 30 + F.col("l_suppkey") % 150).cast("int").alias("y2"),
    )
    moved = F.struct((F.col("obj_id") + 1).alias("obj_id"), ((F.col("confidence_pct") * 7 + 3) % 100).alias("confidence_pct"), *[(F.col(c) + d).alias(c) for c, d in (("x1", 2), ("y1", 1), ("x2", 2), ("y2", 1))])
    own = F.struct("obj_id", "confidence_pct", "x1", "y1", "x2", "y2")
    return base.select("page_id", "label", F.explode(F.when(F.col("obj_id") % 4 == 0, F.array(own, moved)).otherwise(F.array(own))).alias("o")).select("page_id", "o.obj_id", "label", "o.confidence_pct", "o.x1", "o.y1", "o.x2", "o.y2")


def kv_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A key box (the role) and a value box (the text) per turn."""
    t = read(spark, sf_dir, "conversations")
    parts = F.array(F.struct(F.lit("key").alias("part"), F.lit(0).alias("x1"), F.col("role").alias("text")), F.struct(F.lit("value").alias("part"), F.lit(200).alias("x1"), F.col("text").alias("text")))
    y = (F.col("turn") * 20).cast("int")
    return t.select("conv_id", F.col("turn").cast("int").alias("turn"), y.alias("y1"), F.explode(parts).alias("p")).select("conv_id", "turn", "p.part", "p.x1", "y1", (F.col("p.x1") + F.length("p.text") * 8).alias("x2"), (F.col("y1") + 16).alias("y2"), "p.text")


def tagged_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's structure in pre-order: a table, its rows, their cells."""
    rows = numbered_lines(spark, sf_dir)
    node = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.cast("string").alias("text"))
    cells = F.array(node("TR", F.lit("")), node("TD", F.col("l_partkey")), node("TD", F.col("l_quantity").cast("int")), node("TD", F.col("l_returnflag")))
    inner = rows.select(F.col("l_orderkey").alias("page_id"), "ord", F.posexplode(cells).alias("k", "n")).select("page_id", ((F.col("ord") - 1) * 4 + F.col("k") + 1).alias("seq"), "n.type", "n.text")
    head = rows.where("ord = 1").select(F.col("l_orderkey").alias("page_id"), F.lit(0).alias("seq"), F.lit("Table").alias("type"), F.lit("").alias("text"))
    return head.unionByName(inner)


def structure_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with text below the cells: in a paragraph in the first, in two of a list in the second, in a span in the third; ``last`` is the last node under each."""
    rows = numbered_lines(spark, sf_dir)
    node = lambda k, last, kind, text=None: F.struct(F.lit(k).alias("k"), F.lit(last).alias("last"), F.lit(kind).alias("type"), (F.lit(None) if text is None else text).cast("string").alias("text"))
    cells = F.array(
        node(1, 12, "TR"), node(2, 4, "TH"), node(3, 4, "P"), node(4, 4, "Span", F.col("l_partkey")), node(5, 9, "TD"), node(6, 7, "LI", F.lit("a ")), node(7, 7, "Span", F.col("l_suppkey")), node(8, 9, "LI"), node(9, 9, "Span", F.col("l_quantity").cast("int")),
        node(10, 11, "TD"), node(11, 11, "Span", F.col("l_returnflag")), node(12, 12, "TD"),
    )
    at = (F.col("ord") - 1) * 12
    return rows.select(F.col("l_orderkey").alias("page_id"), "ord", F.explode(cells).alias("n")).select("page_id", (at + F.col("n.k")).alias("seq"), (at + F.col("n.last")).alias("last"), "n.type", "n.text")


def page_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes of a page per order: its table, in even ones under a title over its whole width, in every third with a note below, rows from the fifth on further down, and in every fourth without the middle column from the fourth row on."""
    t = cell_text(spark, sf_dir)
    row = F.floor(F.col("box_id") / 3)
    down = F.when(row > 4, 60).otherwise(0)
    own = t.where("table_id % 4 <> 0 or box_id % 3 <> 1 or box_id < 9").select("table_id", "box_id", "x1", (F.col("y1") + down).cast("int").alias("y1"), "x2", (F.col("y2") + down).cast("int").alias("y2"))
    ends = t.groupBy("table_id").agg(F.max("y2").alias("y"))
    box_ = lambda i, x1, y1, x2, y2: F.struct(F.lit(i).alias("box_id"), F.lit(x1).alias("x1"), y1.alias("y1"), F.lit(x2).alias("x2"), y2.alias("y2"))
    title = F.when(F.col("table_id") % 2 == 0, F.array(box_(-1, 5, F.lit(-60), 330, F.lit(-40)))).otherwise(F.array().cast("array<struct<box_id:int,x1:int,y1:int,x2:int,y2:int>>"))
    note = F.when(F.col("table_id") % 3 == 0, F.array(box_(-2, 5, F.col("y") + 90, 300, F.col("y") + 110))).otherwise(F.array().cast("array<struct<box_id:int,x1:int,y1:int,x2:int,y2:int>>"))
    return own.unionByName(ends.select("table_id", F.explode(F.concat(title, note)).alias("b")).select("table_id", "b.*"))


def column_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text boxes of a page per order in two columns, the right one wider in every third; in even ones a box over both on top."""
    rows = numbered_lines(spark, sf_dir)
    y = ((F.col("ord") - 1) * 30).cast("int")
    box_ = lambda k, x1, y1, x2, y2: F.struct(F.lit(k).alias("k"), x1.alias("x1"), y1.cast("int").alias("y1"), x2.cast("int").alias("x2"), y2.cast("int").alias("y2"))
    two = [box_(0, F.lit(0), y, F.lit(150), y + 20), box_(1, F.lit(200), y, F.lit(350) + F.when(F.col("l_orderkey") % 3 == 0, 60).otherwise(0), y + 20)]
    top = box_(2, F.lit(20), F.lit(-50), F.lit(330), F.lit(-30))
    each = rows.select(F.col("l_orderkey").alias("table_id"), "ord", F.explode(F.when((F.col("ord") == 1) & (F.col("l_orderkey") % 2 == 0), F.array(*two, top)).otherwise(F.array(*two))).alias("b"))
    return each.select("table_id", (F.col("ord") * 3 + F.col("b.k")).alias("box_id"), "b.x1", "b.y1", "b.x2", "b.y2")


def glyphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of a page per order: its texts' characters, a speck beside every other, in every third page eight dashes in a row above, in every fifth six upright ones at the side."""
    t = cell_text(spark, sf_dir)
    code = F.ascii(F.col("c"))
    chars = t.select("table_id", "box_id", "x1", "y1", F.posexplode(F.split("text", "")).alias("i", "c"))
    at, w, h = F.col("x1") + F.col("i") * 8, code % 3 + 5, code % 4 + 11
    one = lambda kind, k, x, y, wide, tall, ink: F.struct(F.lit(kind).alias("kind"), k.alias("glyph_id"), x.cast("int").alias("x1"), y.cast("int").alias("y1"), (x + wide).cast("int").alias("x2"), (y + tall).cast("int").alias("y2"), ink.cast("int").alias("area"))
    n = (F.col("box_id") * 100 + F.col("i") * 2).cast("int")
    own, speck = one("char", n, at, F.col("y1"), w, h, w * h - code % 7), one("speck", n + 1, at + w + 1, F.col("y1") + 9, F.lit(1), F.lit(2), F.lit(2))
    letters = chars.select("table_id", F.explode(F.when(F.col("i") % 2 == 0, F.array(own, speck)).otherwise(F.array(own))).alias("g")).select("table_id", "g.*")
    k = F.col("k")
    pages = t.select("table_id").distinct()
    row = pages.where("table_id % 3 = 0").select("table_id", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select("table_id", one("dash", -k - 1, k * 20, F.lit(-20) + k % 2, F.lit(14), F.lit(3), F.lit(42)).alias("g"))
    col = pages.where("table_id % 5 = 0").select("table_id", F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k")).select("table_id", one("dash", -k - 21, F.lit(-30), k * 12, F.lit(2), F.lit(9), F.lit(18)).alias("g"))
    return letters.unionByName(row.select("table_id", "g.*")).unionByName(col.select("table_id", "g.*"))


#: Tags of page blocks and the labels that they stand for.
BLOCK_LABELS = {"h1": "doc_title", "p": "text", "li": "List-item", "footer": "footer", "nav": "header"}


def html_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocks of the web pages in order: script, style and comments go, white space is made single, inner tags are dropped."""
    html = F.coalesce("html", F.lit(""))
    for pattern in ("(?is)<script.*?</script>", "(?is)<style.*?</style>", "(?s)<!--.*?-->"):
        html = F.regexp_replace(html, pattern, " ")
    html = F.regexp_replace(html, "(?i)<(/?)(h1|p|li|footer|nav)( [^>]*)?>", "\u0001$1$2\u0002")  # marks that no other tag rule touches
    html = F.regexp_replace(F.regexp_replace(html, "<[^>]*>", " "), "[\\x20\t\r\n]+", " ")
    found = F.regexp_extract_all(html, F.lit("(\u0001[A-Za-z0-9]+\u0002[^\u0001]*)"), F.lit(1))
    each = read(spark, sf_dir, "pages").select("page_id", F.posexplode(found).alias("block_ord", "block"))
    tag = F.lower(F.regexp_extract("block", "^\u0001([A-Za-z0-9]+)", 1))
    text = F.trim(F.regexp_replace("block", "^\u0001[A-Za-z0-9]+\u0002", ""))
    return each.select("page_id", "block_ord", tag.alias("tag"), F.element_at(F.create_map(*[F.lit(x) for kv in BLOCK_LABELS.items() for x in kv]), tag).alias("label"), text.alias("text"))
