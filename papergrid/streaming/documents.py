"""New documents as a stream: each file is decoded once, its boxes become tables, results are appended."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.pages import decoded

FILE_SCHEMA = "path string, modificationTime timestamp, length long, content binary"


def new_files(spark: SparkSession, path: str, pattern: str = "*", per_trigger: int = 1000) -> DataFrame:
    return spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", per_trigger).load(path)


def process_stream(files: DataFrame, decode: Callable[[str, bytes], list[tuple]], schema: str, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each batch's decoded rows through ``work`` (any batch operator, keyed by ``path``) to a folder per batch, which a repeated batch overwrites."""

    def batch(df: DataFrame, number: int) -> None:
        work(decoded(df, decode, schema)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = files.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime="30 seconds")).start()
