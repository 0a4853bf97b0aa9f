"""Work on many groups at once: whole groups stream past in Arrow batches, and numpy works on a batch of them, without a loop over groups.

Rows are clustered and sorted by a window on the keys, so a table that is dealt by
them already isn't dealt anew. What is held is a batch, or one group if that is larger.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..ship import map_arrow

#: Rows that are worked on at once, and pairs of rows.
ROWS, PAIRS = 60_000, 2_000_000


class Groups(NamedTuple):
    """Rows of whole groups: ``gid`` (from 0, rising) and columns by name: integers and booleans in numpy, others in Arrow."""

    gid: np.ndarray
    cols: dict[str, np.ndarray]

    def __getitem__(self, name: str) -> np.ndarray:
        return self.cols[name]

    def at(self, index: np.ndarray) -> Groups:
        return Groups(self.gid[index], {k: v[index] if isinstance(v, np.ndarray) else v.take(pa.array(index)) for k, v in self.cols.items()})


Work = Callable[[Groups], Groups]


def map_batches(df: DataFrame, keys: list[str], work: Work, schema: str | StructType, order: list[str] | None = None) -> DataFrame:
    """``work`` gets and gives whole groups; the result has the keys first. Columns must be free of nulls, keys need not."""
    out = _parse_datatype_string(schema) if isinstance(schema, str) else schema
    full = StructType([*(df.schema[k] for k in keys), *out.fields])
    arrow, names, k = to_arrow_schema(full), [c for c in df.columns if c not in keys], len(keys)
    ranked = df.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy(*(order or keys))).alias("__n"), *names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done(rows: pa.Table) -> Iterator[pa.RecordBatch]:
            rows = rows.combine_chunks()
            first = rows.column(k).to_numpy() == 1
            whole = lambda c: c.combine_chunks() if pa.types.is_string(c.type) else c.to_numpy() if pa.types.is_boolean(c.type) else c.to_numpy().astype(np.int64)
            g = work(Groups(np.cumsum(first) - 1, {n: whole(rows.column(k + 1 + i)) for i, n in enumerate(names)}))
            own = rows.select(range(k)).take(pa.array(np.flatnonzero(first)[g.gid]))
            cols = [*own.columns, *(pa.array(c, f.type) if isinstance(c := g[f.name], np.ndarray) else c for f in list(arrow)[k:])]
            yield from pa.Table.from_arrays(cols, schema=arrow).combine_chunks().to_batches(ROWS)

        held, n = [], 0
        for batch in batches:
            starts = np.flatnonzero(batch.column(k).to_numpy(zero_copy_only=False) == 1)
            if n >= ROWS and len(starts):
                yield from done(pa.Table.from_batches([*held, batch.slice(0, starts[-1])]))
                held, n = [batch.slice(starts[-1])], batch.num_rows - starts[-1]
            else:
                held.append(batch)
                n += batch.num_rows
        if n:
            yield from done(pa.Table.from_batches(held))

    return map_arrow(ranked, run, full)


def expanded(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each index as often as ``counts`` says, and which of its repeats a place is."""
    i = np.repeat(np.arange(len(counts)), counts)
    return i, np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts)


def pairs(a: np.ndarray, b: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Indexes of all pairs of equal group (both rising), at most about ``PAIRS`` at once."""
    lo, hi = np.searchsorted(b, a, "left"), np.searchsorted(b, a, "right")
    total = np.cumsum(hi - lo)
    at = 0
    while at < len(a):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        i, k = expanded((hi - lo)[at:to])
        yield i + at, lo[at:to][i] + k
        at = to


def changed(*cols: np.ndarray) -> np.ndarray:
    """Which rows differ from the one before."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in cols])
    return new


def split(g: Groups, size: np.ndarray) -> Iterator[Groups]:
    """The groups in parts whose sizes (by gid) sum to about ``PAIRS``."""
    total, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + PAIRS, "right")))
        yield g.at(np.arange(*np.searchsorted(g.gid, (at, to))))
        at = to


def joined(parts: list[Groups]) -> Groups:
    return Groups(np.concatenate([p.gid for p in parts]), {k: np.concatenate([p[k] for p in parts]) for k in parts[0].cols})


class Edges(NamedTuple):
    """The sorted distinct values of each group: group, value, and where each group's begin (one more at the end)."""

    gid: np.ndarray
    value: np.ndarray
    start: np.ndarray

    def place(self, gid: np.ndarray, value: np.ndarray) -> np.ndarray:
        """Of values that are there: their place in the group."""
        low = self.value.min() if len(self.value) else 0
        span = (self.value.max() - low + 1) if len(self.value) else 1
        flat = self.gid * span + (self.value - low)
        return np.searchsorted(flat, gid * span + (value - low)) - self.start[gid]

    def strip(self, gid: np.ndarray, twice: np.ndarray) -> np.ndarray:
        """The last edge of the group that is at most half of ``twice``; -1 for none."""
        if not len(self.value):
            return np.full(len(gid), -1)
        low = self.value.min()
        span = 2 * (self.value.max() - low) + 3
        flat = self.gid * span + 2 * (self.value - low) + 1
        return np.searchsorted(flat, gid * span + np.clip(twice - 2 * low, -1, span - 2) + 1, "right") - self.start[gid] - 1


def edges(gid: np.ndarray, *values: np.ndarray) -> Edges:
    g, v = np.tile(gid, len(values)), np.concatenate(values).astype(np.int64)
    order = np.lexsort((v, g))
    g, v = g[order], v[order]
    new = changed(g, v)
    g, v = g[new], v[new]
    return Edges(g, v, np.searchsorted(g, np.arange((g[-1] if len(g) else -1) + 2)))
