"""Python stages: the package travels to the executors with the job, so a cluster needs no installed copy of it."""

from __future__ import annotations

import tempfile
import zipfile
from collections.abc import Callable
from pathlib import Path

from pyspark import SparkContext
from pyspark.sql import DataFrame


def ship_package(sc: SparkContext) -> None:
    """Adds this package to the job's Python files, once for each Spark context."""
    if getattr(sc, "_papergrid_shipped", False):
        return
    here = Path(__file__).parent
    to = Path(tempfile.mkdtemp(prefix="papergrid-")) / "papergrid.zip"
    with zipfile.ZipFile(to, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(here.rglob("*.py")):
            z.write(p, p.relative_to(here.parent))
    sc.addPyFile(str(to))
    sc._papergrid_shipped = True


def map_arrow(df: DataFrame, f: Callable, schema) -> DataFrame:
    """``df.mapInArrow``, with the package at hand on the executors."""
    ship_package(df.sparkSession.sparkContext)
    return df.mapInArrow(f, schema)
