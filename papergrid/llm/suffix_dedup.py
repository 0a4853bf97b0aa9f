"""Suffix dedup: bytes covered by a string of ``WINDOW`` bytes that also starts elsewhere, by longest previous factors.

A factor is a string of at least ``FACTOR`` bytes that also starts at another
position. Equal strings of ``FACTOR`` bytes have equal smallest ``GRAM``-byte grams at
equal places, so every position is filed under the place of that gram, in blocks of
``BLOCK`` neighbouring positions counted from it. A block's core (the bytes common to
its strings) and its span (all bytes that its strings of ``WINDOW`` bytes have) are
hashed. A core that occurs once has no factor; blocks of equal span repeat as a
whole, and one of them stands for all. Only blocks whose core is shared and whose
span is their own, those at the edge of a repeated passage, are compared.

These are brought together by core and put in suffix order by what follows the core.
What precedes it parts them, byte by byte to the left, into classes that have an equal
beginning; in each class the array of longest previous factors comes from the previous
and next smaller positions in suffix order. A factor of ``WINDOW`` bytes makes its
string go. With ``keep_first`` only earlier positions count (the first copy stays),
without it later ones too (no copy stays). Factors that reach ``FACTOR`` but not
``WINDOW`` bytes are told (``n_repeated``) and stay.

Cores and spans are counted with partial sums before anything is joined, so a
passage that very many documents share is one row of a table, and the rows of the most
frequent ones are met by broadcasting those (at most ``HOT`` of them). A core whose edge
blocks exceed ``MAX_GROUP`` bytes is never gathered: classes of equal strings are
counted by hash there. Documents are hashed where they are; only those that have an
edge block, or a factor, are shuffled.

Ids are integers (or cast to long). Null texts count as empty. Very long texts are
worked on in stretches of ``STRETCH`` positions. A row's place is its id, its text's
checksum and the byte; rows that repeat id and text are copies of each other, but with
``keep_first`` they are one row (both keep the same bytes). A null id sorts first.
Columns with clashing names are left aside, an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import map_arrow
from .common import as_binary, bitmap_of, load, marked_by, stored

WINDOW, FACTOR, GRAM, BLOCK = 400, 256, 32, 128
STRETCH = 1 << 20
#: Bytes of a core's edge blocks that one task may hold, and rows of a table that are broadcast: those of over ``1 / HOT`` of all blocks.
MAX_GROUP, HOT = 16 << 20, 1000
NULL_ID = -(1 << 63)
_M = 0x9E3779B97F4A7C15
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        _powers[:] = [np.multiply.accumulate(np.concatenate((np.ones(1, np.uint64), np.full(size, np.uint64(m))))) for m in (_M, pow(_M, -1, 1 << 64))]
    return _powers


def _anchors(raw: np.ndarray, window: int, gram: int) -> np.ndarray:
    """For each window of a stretch: where its smallest gram starts (the first of equals)."""
    n = len(raw)
    up, down = _power_tables(n + 1)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * up[:n])))
    g = (sums[gram:] - sums[:-gram]) * down[: n - gram + 1]
    g ^= g >> np.uint64(29)
    g *= np.uint64(0xBF58476D1CE4E5B9)
    g ^= g >> np.uint64(32)
    least, have, want = (g << np.uint64(24)) | np.arange(len(g), dtype=np.uint64), 1, window - gram + 1
    while have < want:
        step = min(have, want - have)
        least = np.minimum(least[:-step], least[step:])
        have += step
    return (least & np.uint64((1 << 24) - 1)).astype(np.int64)


def block_starts(raw: bytes, window: int = WINDOW, gram: int = GRAM, block: int = BLOCK, stretch: int = STRETCH) -> np.ndarray:
    """The first positions of the blocks that hold the text's windows; a block may begin before the text or end behind it."""
    whole, found = np.frombuffer(raw, np.uint8), []
    for at in range(0, len(raw) - window + 1, stretch):
        part = whole[at : at + stretch + window - 1]
        anchor = _anchors(part, window, gram)
        back = anchor - np.arange(len(anchor))
        found.append(np.unique(anchor - (back // block * block + block - 1)) + at)
    return np.unique(np.concatenate(found)) if found else np.array([], np.int64)


def _hash(x: bytes) -> int:
    import xxhash

    h = xxhash.xxh3_64_intdigest(x)
    return h - (1 << 64) if h >> 63 else h


def _small(batches: Iterator[pa.RecordBatch], rows: int = 128) -> Iterator[pa.RecordBatch]:
    """Some documents at a time: what a step makes of them is held at once."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


BLOCKS = "core long, span long, id long, c long, s int, n int"


def blocks_of(docs: DataFrame, window: int = WINDOW, factor: int = FACTOR, gram: int = GRAM, block: int = BLOCK) -> DataFrame:
    """Of (id, c, raw): a row per block; ``n`` is the text's length. Spans that the text's ends cut are told apart by where."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(rows: list) -> pa.RecordBatch:
            cols = list(zip(*rows)) or [()] * 6
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, [pa.int64()] * 4 + [pa.int32()] * 2)], names=["core", "span", "id", "c", "s", "n"])

        rows = []
        for batch in _small(batches):
            for id_, c, raw in zip(*(x.to_pylist() for x in batch.columns)):
                for s in block_starts(raw, factor, gram, block).tolist():
                    e = s + block - 1
                    span = raw[s : e + window] if s >= 0 else raw[: e + window] + b"%d" % s
                    rows.append((_hash(raw[e : s + factor]), _hash(span), id_, c, s, len(raw)))
                if len(rows) > 20_000:
                    yield out(rows)
                    rows = []
        yield out(rows)

    return map_arrow(docs.select("id", "c", "raw"), run, BLOCKS)


def _met(left: DataFrame, right: DataFrame, on: list[str], weight: str, most: int, how: str = "inner") -> DataFrame:
    """A join whose frequent keys (weight over ``most``, so few of them) are broadcast: no key's rows are gathered in one task for them."""
    hot, rest = F.broadcast(right.where(F.col(weight) > most)), right.where(F.col(weight) <= most)
    cold = left.join(F.broadcast(hot.select(*on)), on, "left_anti").join(rest, on, how)
    return cold if how == "left_anti" else left.join(hot, on, how).unionByName(cold)


def _cut(docs: DataFrame, wanted: DataFrame, window: int, block: int) -> DataFrame:
    """The bytes of the wanted blocks (core, id, c, s): from documents that have any, joined by id and checksum."""
    lists = stored(wanted.groupBy("id", "c").agg(F.collect_list(F.struct("core", "s")).alias("wanted")), "suffix-wanted")
    some = marked_by(docs, F.xxhash64("id", "c"), bitmap_of(lists, F.xxhash64("id", "c"), lists.count()), "__ok").where("__ok").drop("__ok")
    rows = some.join(lists, ["id", "c"]).select("id", "c", "raw", "wanted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary())
        for batch in _small(batches):
            out = []
            for id_, c, raw, wanted in zip(*(x.to_pylist() for x in batch.columns)):
                out += [(w["core"], id_, c, w["s"], raw[max(0, w["s"]) : w["s"] + block - 1 + window]) for w in wanted]
            cols = list(zip(*out)) or [()] * 5
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds)], names=["core", "id", "c", "s", "span"])

    return map_arrow(rows, run, "core long, id long, c long, s int, span binary")


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    a, b = a[:n], b[:n]
    return n if a == b else n - ((int.from_bytes(a, "big") ^ int.from_bytes(b, "big")).bit_length() + 7) // 8


def previous_factors(order: list[int], lcp: list[int]) -> list[int]:
    """Of positions in suffix order and the common prefixes of neighbours: by place, the longest factor that starts at a smaller position (-1: none).

    It is the longer of those with the previous and the next smaller position, which a
    stack of rising positions gives with the least common prefix on the way.
    """
    best, stack = [-1] * len(order), []
    for place, at in enumerate(order):
        way = lcp[place - 1] if place else -1
        while stack and order[stack[-1][0]] > at:
            larger, below = stack.pop()
            best[larger] = max(best[larger], way)
            way = min(way, below)
        if stack:
            best[place] = way
        stack.append((place, way))
    return best


def factors(entries: list[tuple], window: int, factor: int, block: int, keep_first: bool) -> list[tuple[int, int, int, int, bool]]:
    """Of edge blocks of equal core (id, c, s, span): (id, c, first, last, whether of ``window`` bytes) of the bytes that factors cover."""
    entries = sorted(entries, key=lambda e: e[:3])
    if keep_first:
        entries = [e for i, e in enumerate(entries) if not i or e[:3] != entries[i - 1][:3]]
    core, ends, left, right = factor - block + 1, [], [], []
    for _, _, s, span in entries:
        at = s + block - 1 - max(0, s)
        ends.append(s + block - 1)
        left.append(span[:at][::-1])
        right.append(span[at + core :])
    found: dict[tuple[int, bool], list[tuple[int, int]]] = {}
    todo = [(sorted(range(len(entries)), key=right.__getitem__), 0)]
    while todo:
        order, k = todo.pop()
        alike = common_prefix(min(left[i] for i in order), max(left[i] for i in order))
        lcp = [common_prefix(right[i], right[j]) for i, j in zip(order, order[1:])]
        best = previous_factors(order, lcp)
        if not keep_first:
            best = [max(pair) for pair in zip(best, previous_factors([-i for i in order], lcp))]
        for i, n in zip(order, best):
            for least, whole in ((factor, False), (window, True)):
                short = max(k, least - core - n)
                if n >= 0 and short <= alike:
                    found.setdefault((i, whole), []).append((ends[i] - alike, ends[i] - short + least))
        parts: dict[int, list[int]] = {}
        for i in order:
            if len(left[i]) > alike:
                parts.setdefault(left[i][alike], []).append(i)
        todo += [(part, alike + 1) for part in parts.values() if len(part) > 1]
    return [(*entries[i][:2], a, b, whole) for (i, whole), pairs in found.items() for a, b in merged(pairs)]


SPANS = "id long, c long, first int, last int, whole boolean"


def _spans(rows: list) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * 5
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.bool_()))], names=["id", "c", "first", "last", "whole"])


def _compared(cut: DataFrame, window: int, factor: int, block: int, keep_first: bool) -> DataFrame:
    """Bytes that factors cover in edge blocks, core by core in sorted batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        core, held = None, []
        for batch in batches:
            found = []
            for row in zip(*(x.to_pylist() for x in batch.columns)):
                if row[0] != core:
                    if len(held) > 1:
                        found += factors(held, window, factor, block, keep_first)
                    core, held = row[0], []
                held.append(row[1:])
            yield _spans(found)
        yield _spans(factors(held, window, factor, block, keep_first) if len(held) > 1 else [])

    rows = cut.repartition("core").sortWithinPartitions("core").select("core", "id", "c", "s", "span")
    return map_arrow(rows, run, SPANS)


def _counted(cut: DataFrame, window: int, factor: int, block: int, keep_first: bool) -> DataFrame:
    """The same for cores with very many edge blocks: classes of equal strings of both lengths are counted by 128-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for core, id_, c, s, span in zip(*(x.to_pylist() for x in batch.columns)):
                base = max(0, s)
                at = [(p, size) for size in (factor, window) for p in range(base, min(s + block, base + len(span) - size + 1))]
                hashes = [xxhash.xxh3_128_digest(span[p - base : p - base + size] + (p - s).to_bytes(2, "big")) for p, size in at]
                yield pa.RecordBatch.from_arrays([pa.array([core] * len(at), pa.int64()), pa.array(hashes, pa.binary()), pa.array([id_] * len(at), pa.int64()), pa.array([c] * len(at), pa.int64()), pa.array([p for p, _ in at], pa.int32()), pa.array([z for _, z in at], pa.int32())], names=["core", "h", "id", "c", "at", "size"])

    rows = stored(map_arrow(cut.select("core", "id", "c", "s", "span"), run, "core long, h binary, id long, c long, at int, size int"), "suffix-windows")
    if keep_first:
        rows = rows.distinct()
    classes = stored(rows.groupBy("core", "h").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "c", "at")).alias("head")).where("copies > 1"), "suffix-strings")
    met = _met(rows, classes, ["core", "h"], "copies", rows.count() // HOT)
    if keep_first:
        met = met.where(F.struct("id", "c", "at") != F.col("head"))
    return met.select("id", "c", F.col("at").alias("first"), (F.col("at") + F.col("size")).alias("last"), (F.col("size") == window).alias("whole"))


def repeats_of(docs: DataFrame, window: int = WINDOW, keep_first: bool = True, factor: int | None = None, gram: int = GRAM, block: int = BLOCK, max_group: int = MAX_GROUP) -> DataFrame:
    """Of (id, c, raw): stretches of bytes (id, c, first, last, whole) that factors cover, ``whole`` where they reach ``window``; they may overlap."""
    factor = min(window, FACTOR) if factor is None else factor
    blocks = stored(blocks_of(docs.where(F.octet_length("raw") >= factor), window, factor, gram, block), "suffix-blocks")
    if keep_first:
        blocks = blocks.distinct()
    most = blocks.count() // HOT
    shared = stored(blocks.groupBy("core").agg(F.count(F.lit(1)).alias("blocks")).where("blocks > 1"), "suffix-cores")
    met = stored(_met(blocks, shared, ["core"], "blocks", most).drop("blocks"), "suffix-shared")
    classes = stored(met.groupBy("core", "span").agg(F.count(F.lit(1)).alias("copies"), F.min(F.struct("id", "c", "s")).alias("head")).where("copies > 1"), "suffix-classes")
    same = _met(met, classes, ["core", "span"], "copies", most)
    if keep_first:
        same = same.where(F.struct("id", "c", "s") != F.col("head"))
    first, last = F.greatest("s", F.lit(0)), F.col("s") + (block - 1)
    reaches = F.col("n") - window >= first
    end = F.least("n", last + F.when(reaches, window).otherwise(factor))
    spans = same.select("id", "c", first.alias("first"), end.cast("int").alias("last"), reaches.alias("whole"))
    edges = stored(_met(met, classes.drop("head"), ["core", "span"], "copies", most, "left_anti").select("core", "id", "c", "s"), "suffix-edges")
    heads = classes.select("core", "head.*").join(edges.select("core").distinct(), "core", "left_semi")
    cut = stored(_cut(docs, edges.unionByName(heads), window, block), "suffix-cut")
    big = stored(cut.groupBy("core").agg(F.sum(F.octet_length("span").cast("long")).alias("bytes")).where(F.col("bytes") > max_group), "suffix-big")
    if big.isEmpty():
        spans = spans.unionByName(_compared(cut, window, factor, block, keep_first))
    else:
        total = cut.agg(F.sum(F.octet_length("span").cast("long"))).first()[0]
        usual, hot = _met(cut, big, ["core"], "bytes", total // HOT, "left_anti"), _met(cut, big, ["core"], "bytes", total // HOT).drop("bytes")
        spans = spans.unionByName(_compared(usual, window, factor, block, keep_first)).unionByName(_counted(hot, window, factor, block, keep_first))
    return stored(spans, "suffix-spans")


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs of the union."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, keep_first: bool = True, **sizes: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, spans (what goes: start and end), kept (binary: what stays), n_repeated (bytes that factors of any length cover)."""
    base = docs.select(F.col(id_col).alias("doc_id"), as_binary(text_col).alias("raw")).withColumn("id", F.coalesce(F.col("doc_id").cast("long"), F.lit(NULL_ID))).withColumn("c", F.crc32("raw"))
    spans = repeats_of(base.select("id", "c", "raw"), window, keep_first, **sizes)
    lists = stored(spans.groupBy("id", "c").agg(F.collect_set(F.struct("first", "last", "whole")).alias("spans")), "suffix-lists")
    known = marked_by(base, F.xxhash64("id", "c"), bitmap_of(lists, F.xxhash64("id", "c"), lists.count()), "__ok")
    touched = known.where("__ok").join(lists, ["id", "c"], "left").select("doc_id", "raw", "spans")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("first", pa.int32()), ("last", pa.int32())]))
        for batch in _small(batches):
            ns, lost, kept, told = [], [], [], []
            for raw, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                runs, at, parts = merged([(x["first"], x["last"]) for x in spans or () if x["whole"]]), 0, []
                for a, b in runs:
                    parts.append(raw[at:a])
                    at = b
                ns.append(len(raw))
                lost.append([{"first": a, "last": b} for a, b in runs])
                kept.append(b"".join([*parts, raw[at:]]))
                told.append(sum(b - a for a, b in merged([(x["first"], x["last"]) for x in spans or ()])))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ns, pa.int64()), pa.array(lost, kind), pa.array(kept, pa.binary()), pa.array(told, pa.int64())], names=["doc_id", "n_bytes", "spans", "kept", "n_repeated"])

    spans_type = T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("last", T.IntegerType())]))
    schema = T.StructType([base.schema["doc_id"], T.StructField("n_bytes", T.LongType()), T.StructField("spans", spans_type), T.StructField("kept", T.BinaryType()), T.StructField("n_repeated", T.LongType())])
    plain = known.where("not __ok").select("doc_id", F.octet_length("raw").cast("long").alias("n_bytes"), F.array().cast(spans_type).alias("spans"), F.col("raw").alias("kept"), F.lit(0).cast("long").alias("n_repeated"))
    return plain.unionByName(map_arrow(touched, run, schema))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(load(spark, sf_dir, "documents"), keep_first=False)
    return found.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), "n_repeated")


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES = {}
