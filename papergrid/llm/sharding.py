"""Sharding by proportional stratified interleaving.

Within each source, rows get a rank in a seeded order; sorted by fractional rank
``(rank + 1/2) / rows of the source``, every stretch of the sequence holds all
sources in proportion, so cutting it into equal stretches gives shards that match
the mixture. Counts of shards differ by one at most (the law ``rows``).

No task sorts a source or the whole: ranks are made of a count of all rows in
earlier buckets and a rank within a bucket. Within a source, buckets are stretches
of the order's hash, as many as give about ``BUCKET_ROWS`` rows to one; in the
sequence, buckets are stretches of the fractional rank, which is evenly spread.
Only ids and numbers are shuffled, never a text.

Null texts have no bytes; a null source is a source. Rows that repeat an id are
ordered by checksum and size; where these are equal too, the rows are alike. An
empty table gives none. Columns with clashing names are left aside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import as_binary, load, stored

SEED, SHARDS = 11, 8
BUCKET_ROWS = 2048
MAX_BUCKETS = 1 << 20


def _ranked(rows: DataFrame, within: list[str], bucket: str, order: list[str | Column], name: str) -> DataFrame:
    """``rows`` with ``name``: the row's rank from 0, in buckets in turn and in ``order`` inside them."""
    counts = rows.groupBy(*within, bucket).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*within).orderBy(bucket).rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    counts = counts.select(*[F.col(c).alias(f"__k{i}") for i, c in enumerate([*within, bucket])], "__before")
    inside = rows.withColumn("__at", F.row_number().over(Window.partitionBy(*within, bucket).orderBy(*order)))
    same = [F.col(c) == F.col(f"__k{i}") for i, c in enumerate([*within, bucket])]
    met = inside.join(counts, same)
    return met.withColumn(name, F.col("__before") + F.col("__at") - 1).select(*rows.columns, name)


def shard_rows(docs: DataFrame, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """One row per document: doc_id, source, size, text_crc32, position (in the sequence, from 0), shard, slot."""
    raw = as_binary(text_col)
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = stored(rows.withColumn("key", key).withColumn("stratum", F.when(F.col("source").isNull(), "").otherwise(F.concat(F.lit("="), "source"))), "shard-rows")
    total = rows.count()
    buckets = 1 << max(6, min(MAX_BUCKETS, total // BUCKET_ROWS).bit_length())
    hashed = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    rows = rows.withColumn("bucket", F.floor(hashed * buckets / (1 << 32)))
    sizes = rows.groupBy("stratum").agg(F.count(F.lit(1)).alias("in_source")).withColumnRenamed("stratum", "__stratum")
    ranked = _ranked(rows, ["stratum"], "bucket", ["key", "doc_id", "text_crc32", "size"], "rank")
    ranked = ranked.join(sizes, F.col("stratum") == F.col("__stratum")).drop("__stratum")
    spread = stored(ranked.withColumn("fraction", (F.col("rank") * 2 + 1) / (F.col("in_source") * 2)).withColumn("stretch", F.least(F.floor(F.col("fraction") * buckets), F.lit(buckets - 1))), "shard-fractions")
    placed = _ranked(spread.withColumn("all", F.lit(0)), ["all"], "stretch", ["fraction", "stratum"], "position")
    # shard s holds the positions from s * total div shards on
    shard = F.least(F.expr(f"cast((position * {shards} + {shards - 1}) div {max(1, total)} as int)"), F.lit(shards - 1))
    start = F.expr(f"shard * {total} div {shards}")
    placed = placed.withColumn("shard", shard)
    placed = placed.withColumn("shard", F.when(F.col("position") < start, F.col("shard") - 1).otherwise(F.col("shard")))
    return placed.withColumn("slot", F.col("position") - start).select("doc_id", "source", "size", "text_crc32", "position", "shard", "slot")


def write_shards(docs: DataFrame, path: str, shards: int = SHARDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> None:
    """``docs`` as Parquet, a folder ``to_shard=<n>`` per shard, rows by ``to_slot`` (columns of these names in ``docs`` are left aside).

    Rows meet their places by id, text's checksum and size, source, and their number among rows that are alike in these, so null and repeated ids keep all their rows.
    """
    by = ["doc_id", "source", "size", "text_crc32"]
    placed = shard_rows(docs, shards, seed, id_col, text_col, source_col)
    twin = lambda order: F.row_number().over(Window.partitionBy(*by).orderBy(order))
    placed = stored(placed.withColumn("__k", twin("position")).select(*[F.col(c).alias(f"__p_{c}") for c in by], F.col("__k").alias("__p_k"), F.col("shard").alias("to_shard"), F.col("slot").alias("to_slot")), "shard-places")
    raw = as_binary(f"__row.{text_col}")
    kept = [c for c in docs.columns if c not in ("to_shard", "to_slot")]
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in kept]).alias("__row")).select("__row", F.col(f"__row.{id_col}").alias("doc_id"), F.col(f"__row.{source_col}").cast("string").alias("source"), (F.octet_length(raw) + 1).cast("long").alias("size"), F.crc32(raw).alias("text_crc32"))
    rows = rows.withColumn("__k", twin(F.lit(0)))
    met = rows.join(placed, [F.col(c).eqNullSafe(F.col(f"__p_{c}")) for c in by] + [F.col("__k") == F.col("__p_k")]).select("__row.*", "to_shard", "to_slot")
    met.repartitionByRange("to_shard", "to_slot").sortWithinPartitions("to_shard", "to_slot").write.partitionBy("to_shard").parquet(path)


def op10_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = shard_rows(load(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op10_sharding": op10_sharding}
ORACLES = {}
