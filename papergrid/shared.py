"""Intermediate tables in the folder that all executors share, where a plan would otherwise repeat a long branch."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only in local mode, where it may be unset, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="papergrid-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def materialised(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet and read again: later uses share it, and lineage ends here. The application's tables are deleted when it ends.
    It is never broadcast: boxes compress so well that the files' size says little about that of the rows."""
    spark = df.sparkSession
    own = f"{shared_folder(spark)}/papergrid/{spark.sparkContext.applicationId}"
    path = f"{own}/{tag}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark._jvm.org.apache.hadoop.fs.Path(own)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path).hint("merge")
