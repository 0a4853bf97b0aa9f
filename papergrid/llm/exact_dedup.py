"""Exact dedup by progressive refinement: length, then a prefix's hash, then the hash of the whole text, which only survivors of both get.

Which lengths, and which pairs of length and prefix, occur more than once is kept
in bitmaps (eight bits a key, 128 MB at most), so deciding whether a
row survives needs no shuffle of texts. A bitmap lets some rows through that have
no equal; the whole-text hash then tells. Everything that is shuffled is an id, a
number or a hash; hot groups are counted before they are shuffled.

Texts are equal when identical; null counts as empty. Of equal texts the row with
the largest id stays (a null id is smaller than any other); of rows that repeat
both id and text, one stays. Columns other than id and text are left aside by
``find_groups`` and kept by ``drop_copies``. An empty table gives none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from .common import Bitmap, bitmap_of, load, marked_by, packed, stored, text_or_empty, unpacked, without

PREFIX = 256


def _size() -> Column:
    return F.octet_length("__text").cast("long").alias("__n")


def _prefix() -> Column:
    return F.xxhash64(F.substring("__text", 1, PREFIX)).alias("__p")


def _survivors(docs: DataFrame, id_col: str, text_col: str) -> Bitmap:
    """The bitmap of the pairs of length and prefix hash that occur more than once."""
    slim = stored(docs.select(text_or_empty(text_col).alias("__text")).select(_size(), _prefix()), "exact-slim")
    lengths = stored(slim.groupBy("__n").count().where("count > 1"), "exact-lengths")
    left = marked_by(slim, F.xxhash64("__n"), bitmap_of(lengths, F.xxhash64("__n"), lengths.count()), "__ok").where("__ok")
    pairs = stored(left.groupBy("__n", "__p").count().where("count > 1"), "exact-pairs")
    bitmap = bitmap_of(pairs, F.xxhash64("__n", "__p"), pairs.count())
    return bitmap._replace(rows=stored(bitmap.rows, "exact-bitmap"))


def _groups(rows: DataFrame) -> DataFrame:
    """Of (__id, __sha) rows: a row for each hash that several have, with its largest id, its size and the times that this id repeats."""
    each = rows.groupBy("__sha", "__id").agg(F.count(F.lit(1)).alias("c"))
    top = each.groupBy("__sha").agg(F.max(F.struct("__id", "c")).alias("top"), F.sum("c").alias("group_size"))
    return top.where("group_size > 1").select("__sha", F.col("top.__id").alias("keep_id"), F.col("top.c").alias("repeats"), "group_size")


def find_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hash_all: bool = False) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, sha (binary; null where no full hash was needed, unless ``hash_all``)."""
    bitmap = _survivors(docs, id_col, text_col)
    base = docs.select(F.col(id_col).alias("__id"), text_or_empty(text_col).alias("__text")).select("__id", "__text", _size(), _prefix())
    marked = marked_by(base, F.xxhash64("__n", "__p"), bitmap, "__ok")
    sha = F.unhex(F.sha2(F.col("__text").cast("binary"), 256))
    rows = stored(marked.select("__id", "__ok", (sha if hash_all else F.when(F.col("__ok"), sha)).alias("__sha")), "exact-rows")
    groups = stored(_groups(rows.where("__ok")), "exact-groups")
    alone = rows.where("not __ok").select(F.col("__id").alias("doc_id"), F.col("__id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("__sha").alias("sha"))
    met = rows.where("__ok").join(groups, "__sha", "left")
    size, keep = F.coalesce("group_size", F.lit(1)).cast("long"), F.when(F.col("group_size").isNull(), F.col("__id")).otherwise(F.col("keep_id"))
    met = met.select(F.col("__id").alias("doc_id"), keep.alias("keep_id"), size.alias("group_size"), F.coalesce("repeats", F.lit(1)).alias("repeats"), F.col("__sha").alias("sha"))
    met = met.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("keep_id")))
    plain = ["doc_id", "keep_id", "group_size", "kept", "sha"]
    if not groups.where("repeats > 1").isEmpty():  # rows that repeat id and text: the first of them stays
        twice = met.where("kept and repeats > 1").withColumn("kept", F.row_number().over(Window.partitionBy("sha", "doc_id").orderBy("group_size")) == 1)
        met = met.where("not (kept and repeats > 1)").select(plain).unionByName(twice.select(plain))
    return alone.select(plain).unionByName(met.select(plain))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` without the rows whose text another kept row has. Only texts that go (and those that share their bits) are shuffled, by hash and id."""
    bitmap = _survivors(docs, id_col, text_col)
    base = packed(docs).withColumn("__id", F.col(f"__row.{id_col}")).withColumn("__text", text_or_empty(f"__row.{text_col}")).withColumn("__n", _size()).withColumn("__p", _prefix())
    marked = marked_by(base, F.xxhash64("__n", "__p"), bitmap, "__ok")
    sha = F.unhex(F.sha2(F.col("__text").cast("binary"), 256))
    met = marked.where("__ok").withColumn("__sha", sha).select("__row", "__id", "__sha")
    hashes = stored(met.select("__id", "__sha"), "exact-rows")
    each = hashes.groupBy("__sha", "__id").agg(F.count(F.lit(1)).alias("c"))
    keep = each.groupBy("__sha").agg(F.max(F.struct("__id", "c")).alias("top")).select(F.col("__sha").alias("__ksha"), F.col("top.__id").alias("__kid"))
    told = each.join(keep, F.col("__sha") == F.col("__ksha")).select(F.col("__sha").alias("__gsha"), F.col("__id").alias("__gid"), (~F.col("__id").eqNullSafe(F.col("__kid"))).alias("__drop"), "c")
    gone = stored(told.where("__drop or c > 1").select("__gsha", "__gid", "__drop"), "exact-gone")
    kept = without(met, gone, ["__sha", "__id"], ["__gsha", "__gid"], not gone.where("not __drop").isEmpty())
    return unpacked(marked.where("not __ok").select("__row")).unionByName(kept)


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_groups(load(spark, sf_dir, "documents"), hash_all=True)
    return found.select("doc_id", "keep_id", "group_size", "kept", F.lower(F.hex("sha")).alias("text_sha256"))


QUERIES = {"op6_exact_dedup": op6_exact_dedup}
ORACLES = {
    "op6_exact_dedup": """
    SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size,
           doc_id = max(doc_id) OVER w AS kept, sha256(coalesce(text, '')) AS text_sha256
    FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))"""
}
