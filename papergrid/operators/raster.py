"""Pixels: thresholds, straight lines, components, run-length smoothing. Pages are rows; a page's pixels are one binary value, row by row, deflated where that is shorter
(its length tells), so that a batch of pages stays small.

Spark deals the pages, numpy works on one page at a time. What can be said in runs
of covered pixels also exists as window operators (``gaps.coverage_histogram`` and
``gaps.filled_runs``).
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType, _parse_datatype_string

from ..ship import map_arrow


def window_sums(a: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sum over the window of ``size`` around each pixel, cut at the borders, and the window's area."""
    h, w = a.shape
    s = np.zeros((h + 1, w + 1))
    s[1:, 1:] = a.cumsum(0).cumsum(1)
    r = size // 2
    y0, y1 = np.clip(np.arange(h) - r, 0, h), np.clip(np.arange(h) + r + 1, 0, h)
    x0, x1 = np.clip(np.arange(w) - r, 0, w), np.clip(np.arange(w) + r + 1, 0, w)
    return s[np.ix_(y1, x1)] - s[np.ix_(y0, x1)] - s[np.ix_(y1, x0)] + s[np.ix_(y0, x0)], np.outer(y1 - y0, x1 - x0)


def ink(gray: np.ndarray, size: int = 11, k: float = 0.2, spread: float = 128.0) -> np.ndarray:
    """Dark pixels by a local threshold: mean * (1 + k * (deviation / spread - 1)). A page that is mostly dark is turned round first."""
    gray = gray.astype(float)
    if gray.size and gray.mean() <= 127:
        gray = 255 - gray
    total, n = window_sums(gray, size)
    squares, _ = window_sums(gray * gray, size)
    mean = total / n
    deviation = np.sqrt(np.maximum(squares / n - mean * mean, 0))
    return gray < mean * (1 + k * (deviation / spread - 1))


def runs(row: np.ndarray) -> np.ndarray:
    """Starts and ends (behind) of the true stretches."""
    edge = np.flatnonzero(np.diff(np.concatenate(([0], row.astype(np.int8), [0]))))
    return edge.reshape(-1, 2)


def close_runs(row: np.ndarray, gap: int) -> np.ndarray:
    """The row with holes of at most ``gap`` between true stretches filled."""
    out, r = row.copy(), runs(row)
    for (_, a), (b, _) in zip(r, r[1:]):
        if b - a <= gap:
            out[a:b] = True
    return out


def open_runs(row: np.ndarray, least: int) -> np.ndarray:
    """The row without true stretches shorter than ``least``."""
    out = row.copy()
    for a, b in runs(row):
        if b - a < least:
            out[a:b] = False
    return out


def flat_runs(mask: np.ndarray, gap: int) -> np.ndarray:
    """The runs of all rows, one behind the other with ``gap`` false pixels after each."""
    return runs(np.pad(mask, ((0, 0), (0, gap))).ravel())


def components(mask: np.ndarray) -> list[tuple[int, int, int, int, int]]:
    """Boxes and pixel counts of 8-connected components: x1, y1, x2, y2, area; by run-lengths and union-find."""
    root: list[int] = []
    stats: list[list[int]] = []

    def find(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    wide = mask.shape[1] + 1  # a row's runs end before the next row
    row = flat_runs(mask, 1)
    line, row = row[:, 0] // wide, row - row[:, :1] // wide * wide
    above: list[tuple[int, int, int]] = []
    for y, at in zip(line[(new := np.flatnonzero(np.diff(line, prepend=-2)))].tolist(), np.split(row, new[1:])):
        if not above or y != stats[above[0][2]][1] + 1:
            above = []
        here, j = [], 0
        for a, b in at.tolist():
            n = len(root)
            root.append(n)
            stats.append([a, y, b, y + 1, b - a])
            while j < len(above) and above[j][1] < a:
                j += 1
            k = j
            while k < len(above) and above[k][0] <= b:
                p, q = find(above[k][2]), find(n)
                if p != q:
                    p, q = min(p, q), max(p, q)
                    root[q] = p
                k += 1
            here.append((a, b, n))
        above = here
    merged: dict[int, list[int]] = {}
    for i, s in enumerate(stats):
        m = merged.get(find(i))
        merged[find(i)] = s if m is None else [min(m[0], s[0]), min(m[1], s[1]), max(m[2], s[2]), max(m[3], s[3]), m[4] + s[4]]
    return [tuple(m) for m in merged.values()]


def straight_lines(mask: np.ndarray, least: int) -> list[tuple[str, int, int, int, int]]:
    """Level and upright lines of at least ``least`` pixels: short marks go, small holes close; a line's place is its middle row (column)."""
    found = []
    for orient, m in (("h", mask), ("v", mask.T)):
        hole = max(3, least // 6)
        r = flat_runs(m, hole + 1) if m.size else np.zeros((0, 2), int)
        r = r[r[:, 1] - r[:, 0] >= max(1, least // 3)]
        new = np.flatnonzero(np.append(True, r[1:, 0] - r[:-1, 1] > hole)) if len(r) else []
        r = np.array([(r[i, 0], r[j, 1]) for i, j in zip(new, np.append(new[1:], len(r)) - 1)]).reshape(-1, 2).astype(int)
        r = r[r[:, 1] - r[:, 0] >= least]
        if not len(r):
            continue
        edge = np.zeros((m.shape[1] + hole + 1) * m.shape[0] + 1, np.int8)
        edge[r[:, 0]], edge[r[:, 1]] = 1, -1
        kept = edge.cumsum(dtype=np.int8)[:-1].reshape(m.shape[0], -1)[:, : m.shape[1]] > 0
        for x1, y1, x2, y2, _ in components(kept):
            y = (y1 + y2 - 1) // 2
            found.append((orient, x1, y, x2, y) if orient == "h" else (orient, y, x1, y, x2))
    return sorted(found)


def smooth(mask: np.ndarray, gap: int) -> np.ndarray:
    """Run-length smoothing along rows: holes of at most ``gap`` between runs of like height are filled. Heights are those of the runs' components."""
    boxes = components(mask)
    tall = np.zeros(mask.shape, np.int32)
    for x1, y1, x2, y2, _ in boxes:
        part = tall[y1:y2, x1:x2]
        part[mask[y1:y2, x1:x2]] = y2 - y1
    out = mask.copy()
    for y in range(mask.shape[0]):
        r = runs(mask[y])
        for (_, a), (b, _) in zip(r, r[1:]):
            p, q = tall[y, a - 1], tall[y, b]
            if b - a <= gap and max(p, q) <= 3 * min(p, q):
                out[y, a:b] = True
    return out


def text_components(boxes: list[tuple[int, int, int, int, int]]) -> list[tuple[int, int, int, int, int]]:
    """Components like characters: not too slender, not too empty, and of usual size (a fifth to five times the median) or like a dash."""
    fit = [b for b in boxes if max(b[2] - b[0], b[3] - b[1]) <= 5 * min(b[2] - b[0], b[3] - b[1]) and b[4] > 0.08 * (b[2] - b[0]) * (b[3] - b[1])]
    if not fit:
        return []
    usual = float(np.median([b[2] - b[0] for b in fit]) * np.median([b[3] - b[1] for b in fit]))
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])
    dash = lambda b: b[4] >= 0.9 * size(b) and (b[2] - b[0]) >= 2 * (b[3] - b[1])
    return [b for b in fit if usual / 5 <= size(b) <= usual * 5 or dash(b)]


def mask_of(boxes: list[tuple[int, int, int, int]], width: int, height: int) -> np.ndarray:
    out = np.zeros((height, width), bool)
    for x1, y1, x2, y2 in boxes:
        out[max(0, y1) : y2, max(0, x1) : x2] = True
    return out


def clip(gray: np.ndarray, x1: int, y1: int, x2: int, y2: int, keep_size: bool = False) -> np.ndarray:
    """The part inside the box; with ``keep_size`` the whole page, white outside it."""
    h, w = gray.shape
    x1, y1, x2, y2 = max(0, x1), max(0, y1), min(w, x2), min(h, y2)
    if not keep_size:
        return gray[y1:y2, x1:x2]
    out = np.full_like(gray, 255)
    out[y1:y2, x1:x2] = gray[y1:y2, x1:x2]
    return out


def packed(gray: np.ndarray) -> bytes:
    raw = gray.tobytes()
    small = zlib.compress(raw, 1)
    return small if len(small) < len(raw) else raw


def unpacked(raw: bytes, height: int, width: int) -> np.ndarray:
    return np.frombuffer(raw if len(raw) == width * height else zlib.decompress(raw), np.uint8).reshape(height, width)


def rasterise(boxes: DataFrame, keys: list[str], width: int | None = None, height: int | None = None) -> DataFrame:
    """Pages (keys, width, height, pixels) with dark boxes on white; where no size is given, each as large as its boxes reach. Boxes without a place are left aside."""
    from .grouped import map_groups

    def work(rows):
        own = [b for b in rows if None not in b]
        w = width or max([1, *(b[2] for b in own)])
        h = height or max([1, *(b[3] for b in own)])
        return [(w, h, packed(np.where(mask_of(own, w, h), 0, 255).astype(np.uint8)))]

    return map_groups(boxes.select(*keys, "x1", "y1", "x2", "y2"), keys, ["y1", "x1"], work, "width int, height int, pixels binary")


def map_pages(pages: DataFrame, keys: list[str], work: Callable[[np.ndarray], list[tuple]], schema: str) -> DataFrame:
    """``work`` on each page's gray pixels (height, width); its rows with the page's keys."""
    out = _parse_datatype_string(schema)
    full = StructType([*(pages.schema[k] for k in keys), *out.fields])
    arrow = to_arrow_schema(full)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []

        def flush() -> pa.RecordBatch:
            cols = list(zip(*held)) or [()] * len(arrow)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, arrow)], schema=arrow)

        for batch in batches:
            for i in range(batch.num_rows):
                *key, w, h, raw = (c[i].as_py() for c in batch.columns)
                held += [(*key, *r) for r in work(unpacked(raw, h, w))]
                if len(held) > 20_000:
                    yield flush()
        yield flush()

    return map_arrow(pages.select(*keys, "width", "height", "pixels"), run, full)


def page_components(pages: DataFrame, keys: list[str], below: int | None = None) -> DataFrame:
    """Components of each page's ink: by the local threshold, or of pixels darker than ``below``."""
    return map_pages(pages, keys, lambda g: components(ink(g) if below is None else g < below), "x1 int, y1 int, x2 int, y2 int, area int")


def page_lines(pages: DataFrame, keys: list[str], least: int) -> DataFrame:
    return map_pages(pages, keys, lambda g: straight_lines(g < 128, least), "orient string, x1 int, y1 int, x2 int, y2 int")


def gray_of_images(images: DataFrame) -> DataFrame:
    """Rows of Spark's image source as pages: origin, width, height, pixels (luma of blue, green, red)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o, h, w, n, raw in zip(*(c.to_pylist() for c in batch.columns)):
                a = np.frombuffer(raw, np.uint8).reshape(h, w, n).astype(float)
                g = a[..., 0] if n == 1 else a[..., 0] * 0.114 + a[..., 1] * 0.587 + a[..., 2] * 0.299
                yield pa.RecordBatch.from_arrays([pa.array([o]), pa.array([w], pa.int32()), pa.array([h], pa.int32()), pa.array([packed(np.rint(g).astype(np.uint8))], pa.binary())], names=["origin", "width", "height", "pixels"])

    i = images.select(F.col("image.origin").alias("origin"), F.col("image.height").alias("h"), F.col("image.width").alias("w"), F.col("image.nChannels").alias("n"), F.col("image.data").alias("d"))
    return map_arrow(i, run, "origin string, width int, height int, pixels binary")
