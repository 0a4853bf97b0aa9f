"""What the operators share: the shared scratch folder, and tables written there."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The six ASCII white-space characters that part words: space and U+0009 to U+000D.
WORD = "[^\\x20\\x09-\\x0D]+"


def shared_root(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Only where it is unset (tests), a temporary one."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="papergrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


#: Tables that this process wrote and has not deleted.
_made: dict[str, None] = {}


def stored(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet in the shared folder and read again: lineage ends here, and a lost executor costs nothing done before.

    The application's tables go when it ends; ``passing`` deletes those of a step as soon as its result is stored.
    """
    spark = df.sparkSession
    own = f"{shared_root(spark)}/papergrid/{spark.sparkContext.applicationId}"
    path = f"{own}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made[path] = None
    fs, at = _file(spark, own)
    fs.deleteOnExit(at)
    out = spark.read.schema(df.schema).parquet(path)
    out._papergrid_path = path
    return out


def _file(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def drop_stored(df: DataFrame) -> None:
    """Deletes what ``stored`` wrote, once nothing reads it any more."""
    _drop(df.sparkSession, df._papergrid_path)


def _drop(spark: SparkSession, path: str) -> None:
    fs, at = _file(spark, path)
    fs.delete(at, True)
    _made.pop(path, None)


def passing(spark: SparkSession, step: Callable[[], DataFrame], tag: str) -> DataFrame:
    """``step``'s result, stored; the tables that the step wrote on the way are deleted."""
    before = set(_made)
    out = stored(step(), tag)
    for path in [p for p in _made if p not in before and p != out._papergrid_path]:
        _drop(spark, path)
    return out


def load(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def packed(df: DataFrame) -> DataFrame:
    """``df`` with all its columns in one, ``__row``, so that none can clash with a working column."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("__row"))


def unpacked(df: DataFrame) -> DataFrame:
    return df.select("__row.*")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def as_binary(name: str = "text") -> Column:
    """A text's UTF-8 bytes; null counts as empty."""
    return F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")


#: A bitmap has 2**bits bits in rows of 4 KB: eight for each key that it may hold, from 128 KB up to 128 MB (the bound of what is broadcast, reached at 134 million
#: keys; with more, more of the other rows pass it and meet the exact step behind it).
LEAST_BITS, MOST_BITS, _ROW = 20, 30, 32_768


class Bitmap(NamedTuple):
    rows: DataFrame
    bits: int


def bitmap_of(rows: DataFrame, key: Column, most: int) -> Bitmap:
    """The bits of the rows' keys (hashes), of which there are at most ``most``. Keys that aren't among them may share a bit, so a set bit only says maybe."""
    bits = min(MOST_BITS, max(LEAST_BITS, (most * 8).bit_length()))
    slot = F.pmod(key, F.lit(1 << bits))
    return Bitmap(rows.select(slot.alias("s")).groupBy((F.col("s") / _ROW).cast("int").alias("__bm_row")).agg(F.bitmap_construct_agg((F.col("s") % _ROW).cast("long")).alias("__bm")), bits)


def marked_by(rows: DataFrame, key: Column, bitmap: Bitmap, name: str) -> DataFrame:
    """``rows`` with a boolean that is true where the key's bit is set. No shuffle: the bitmap is broadcast."""
    byte = F.conv(F.hex(F.substring("__bm", (F.col("__bm_slot") % _ROW / 8).cast("int") + F.lit(1), F.lit(1))), 16, 10).cast("int")
    bit = F.call_function("shiftright", byte, (F.col("__bm_slot") % 8).cast("int")).bitwiseAND(1) == 1
    rows = rows.withColumn("__bm_slot", F.pmod(key, F.lit(1 << bitmap.bits))).withColumn("__bm_row", (F.col("__bm_slot") / _ROW).cast("int"))
    return rows.join(F.broadcast(bitmap.rows), "__bm_row", "left").withColumn(name, F.coalesce(bit, F.lit(False))).drop("__bm_slot", "__bm_row", "__bm")


def without(rows: DataFrame, gone: DataFrame, own: list[str], theirs: list[str], any_twice: bool) -> DataFrame:
    """``rows`` (with ``__row``) without those in ``gone`` where ``__drop`` holds; of rows that repeat one where it doesn't, the first stays.

    A bitmap of what goes lets all other rows pass where they are; only those that it marks are shuffled. ``gone`` is a stored table.
    """
    marked = marked_by(rows, F.xxhash64(*own), bitmap_of(gone, F.xxhash64(*theirs), gone.count()), "__maybe")
    same = [F.col(a).eqNullSafe(F.col(b)) for a, b in zip(own, theirs)]
    maybe = marked.where("__maybe")
    out = marked.where("not __maybe").select("__row").unionByName(maybe.join(gone, same, "left_anti").select("__row"))
    if any_twice:
        out = out.unionByName(maybe.join(gone.where("not __drop"), same).dropDuplicates(own).select("__row"))
    return unpacked(out)
