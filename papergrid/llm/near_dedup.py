"""Near dedup by word shingles: texts link where the Jaccard similarity of their five-word shingles is 0.8 or more.

The index is that of ``simhash``, over longer fingerprints: postings filed under bytes by
position, hits of a pair summed over them, pairs kept from a least count on, verified.
A text's fingerprint has a byte for each of ``BANDS * ROWS`` MinHashes, for SimHash bits
at similarity 0.8 differ so often (15 %) that three equal bytes are rare (2 %). A posting
stands for the ``ROWS`` bytes of a band; a pair of similarity 0.8 is in fewer than
``HITS`` of the 30 bands together with probability 0.00003. In postings of over ``MOST_MET``
texts pairs aren't written: fingerprints that agree in ``LEAST`` of their bytes are hung
together there; for a pair of similarity 0.8 fewer agree about once in 10**8. Neither
step decides a link: they only say which texts are brought together. What links is then
told from the fingerprints and the shingles of the whole texts, so every link is real.
Texts of one candidate component are compared in one place,
each with those that none has reached yet, so a group of near copies of one text
takes steps in proportion to its size, not to its pairs.

Texts of equal shingles are one node. Words are as in ``simhash``; texts with fewer than
five words are one shingle, texts without a word are equal. Ids, nulls, rows that
repeat and clashing columns are treated as there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..ship import map_arrow
from . import simhash
from .common import as_binary, bitmap_of, marked_by, stored
from .graph import components

WIDTH, SEED = 5, 42
#: Least similarity, as a fraction.
OF, PARTS = 4, 5
BANDS, ROWS = 30, 4
#: What postings stand for: the positions of a band.
PLACES = np.arange(BANDS * ROWS).reshape(BANDS, ROWS)
#: Postings that a pair shares at least.
HITS = 3
#: Agreeing bytes of 120 from which on fingerprints are hung together: similarity 0.6.
LEAST = 72
#: Shingles hashed at once.
PIECE = 2048

_RNG = np.random.default_rng(SEED)
_A = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingles(raw: bytes) -> np.ndarray:
    """The sorted distinct XXH64 hashes of a text's shingles."""
    import xxhash

    words = raw.lower().split()
    n, h = max(1, len(words) - WIDTH + 1) if words else 0, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((h(b" ".join(words[i : i + WIDTH]), SEED) for i in range(n)), np.uint64, n))


def signature(found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A byte per hash, and the key of each of its postings."""
    low = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(found), PIECE):
        np.minimum(low, (_A * found[None, at : at + PIECE] + _B).min(axis=1), out=low)
    sig = (low >> np.uint64(24)).astype(np.uint8)
    return sig, simhash.posting_keys(sig[None], PLACES)[0]


def _prints(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    import xxhash

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            node, sigs, keys = [], [], []
            for raw in batch.column(2).to_pylist():
                found = shingles(raw)
                sig, key = signature(found)
                node.append(xxhash.xxh64_intdigest(found.tobytes(), SEED))
                sigs.append(sig.tobytes())
                keys.append(key)
            bands = pa.array(keys, pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(np.array(node, np.uint64).view(np.int64)), pa.array(sigs, pa.binary()), bands], names=["doc_id", "h", "node", "sig", "bands"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(as_binary(text_col)).alias("h"), as_binary(text_col).alias("raw"))
    return map_arrow(rows, run, "doc_id long, h long, node long, sig binary, bands array<long>")


def _spread(n: int, near) -> np.ndarray:
    """For each of n members the first member that it reaches. ``near(i, left)`` tells which of ``left`` link with i."""
    root, left = np.arange(n), np.arange(n)
    while len(left):
        head, left = left[0], left[1:]
        front = [head]
        while front and len(left):
            hit = near(front.pop(), left)
            root[left[hit]] = head
            front.extend(left[hit].tolist())
            left = left[~hit]
    return root


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each value of the first column, of batches sorted by it."""
    held: list[tuple] = []
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[0][0] != row[0]:
                yield held
                held = []
            if not held or held[-1][1] != row[1]:  # a node that repeats counts once
                held.append(row)
    if held:
        yield held


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of long postings, sorted (key, node, sig) to links of the candidates."""
    for run in _runs(batches):
        if len(run) > 1:
            nodes = np.array([r[1] for r in run], np.int64)
            sigs = np.frombuffer(b"".join(r[2] for r in run), np.uint8).reshape(len(run), -1)
            root = _spread(len(run), lambda i, left: (sigs[left] == sigs[i]).sum(axis=1) >= LEAST)
            far = root != np.arange(len(run))
            yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[root[far]])], names=["u", "v"])


def linked(sets: list[np.ndarray], sigs: np.ndarray) -> np.ndarray:
    """For each set the first one that it reaches by links of similarity 0.8 or more."""
    sizes = np.array([len(s) for s in sets])

    def near(i: int, left: np.ndarray) -> np.ndarray:
        n = sizes[left]
        out = (PARTS * np.minimum(n, sizes[i]) >= OF * np.maximum(n, sizes[i])) & ((sigs[left] == sigs[i]).sum(axis=1) >= LEAST)
        some = left[out]
        if len(some) and sizes[i]:
            every = np.concatenate([sets[j] for j in some])
            at = np.minimum(np.searchsorted(sets[i], every), sizes[i] - 1)
            both = np.add.reduceat((sets[i][at] == every).astype(np.int64), np.cumsum(sizes[some]) - sizes[some])
            out[out] = PARTS * both >= OF * (sizes[i] + sizes[some] - both)
        return out

    return _spread(len(sets), near)


def _shingled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [shingles(raw).tobytes() for raw in batch.column(3).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(own, pa.binary())], names=["root", "node", "sig", "s"])


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (candidate root, node, sig, shingles) to (node, root)."""
    for run in _runs(batches):
        nodes = np.array([r[1] for r in run], np.int64)
        root = linked([np.frombuffer(r[3], np.uint64) for r in run], np.frombuffer(b"".join(r[2] for r in run), np.uint8).reshape(len(run), -1))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[root])], names=["node", "root"])


def find_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, node, root): a hash of the text as it is, one of its shingles, and the smallest of those that it reaches."""
    prints = stored(_prints(docs, id_col, text_col), "near-prints")
    nodes = stored(prints.groupBy("node").agg(F.min("h").alias("h"), F.min("sig").alias("sig"), F.first("bands").alias("bands")), "near-nodes")
    posts = nodes.select(F.explode("bands").alias("k"), "node")
    often = stored(posts.groupBy("k").count().where("count > 1").select("k"), "near-often")
    shared = bitmap_of(often, F.col("k"), often.count())
    met = simhash.tallied(marked_by(posts, F.col("k"), shared, "__ok").where("__ok").select("k", "node"), HITS, simhash.MOST_MET, "near-met")
    links, hot = simhash.hung(met.where("v is not null")), met.where("v is null").select("u", "k")
    if not hot.isEmpty():
        runs = hot.join(nodes, F.col("u") == F.col("node")).select("k", "node", "sig").repartition("k").sortWithinPartitions("k", "node")
        links = links.unionByName(map_arrow(runs, _meet, "u long, v long"))
    near = stored(components(stored(links.distinct(), "near-links")), "near-candidates")
    told = stored(nodes.select(F.col("node").alias("__n"), F.col("h").alias("__h"), "sig").join(near, F.col("__n") == F.col("node")).select("__h", "node", "sig", "root"), "near-told")
    rows = marked_by(docs.select(F.xxhash64(as_binary(text_col)).alias("h"), as_binary(text_col).alias("raw")), F.col("h"), bitmap_of(told, F.col("__h"), told.count()), "__ok").where("__ok")
    texts = rows.join(told, F.col("h") == F.col("__h")).select("root", "node", "sig", "raw")
    sets = map_arrow(texts, _shingled, "root long, node long, sig binary, s binary").repartition("root").sortWithinPartitions("root", "node")
    roots = stored(map_arrow(sets, _verify, "node long, root long").where("node != root").select(F.col("node").alias("__n"), "root"), "near-roots")
    return prints.join(roots, F.col("node") == F.col("__n"), "left").select("doc_id", "h", "node", F.coalesce("root", "node").alias("root"))


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id."""
    return simhash.drop_near_copies(docs, id_col, text_col, find_components)
