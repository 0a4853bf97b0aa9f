"""Sequential work on groups, where each step depends on the one before: groups stream past in sorted Arrow batches, one at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..ship import map_arrow


def map_groups(df: DataFrame, keys: list[str], order: list[str], work: Callable[[list[tuple]], Iterable[tuple]], schema: str | StructType) -> DataFrame:
    """``work(rows in order)`` gets and gives rows without their keys; the result has the keys first."""
    out = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = StructType([*(df.schema[k] for k in keys), *out.fields])
    arrow, k = to_arrow_schema(full), len(keys)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, done = None, [], []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*done)) or [()] * len(arrow)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:k] != key:
                    if held:
                        done += [(*key, *r) for r in work(held)]
                        held = []
                        if len(done) > 20_000:
                            yield flush()
                    key = row[:k]
                held.append(row[k:])
        if held:
            done += [(*key, *r) for r in work(held)]
        yield flush()

    spark = df.sparkSession  # a fixed number: by their bytes Spark would join the partitions of small rows with long work into one
    most = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    dealt = df.repartition(most, *keys).sortWithinPartitions(*keys, *order)
    return map_arrow(dealt.select(*keys, *[c for c in df.columns if c not in keys]), run, full)
