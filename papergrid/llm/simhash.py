"""SimHash near-dedup: an inverted index over the bytes of fingerprints by position, with count filtering.

A text's fingerprint has a bit set where over half of its shingles' hashes have it.
Fingerprints link at ``MAX_BITS`` = 4 or fewer differing bits. Those touch at most
4 of the 8 bytes, so linked fingerprints share at least 4 bytes at equal positions.
Postings are filed under bytes by position, the hits of each pair are summed over
all postings, pairs whose sum tells 4 shared bytes are kept and verified by their
differing bits.

Postings of one byte hold 1/256 of all fingerprints, and the pairs that meet grow
with the square of the input. So a posting stands for three bytes at three
positions and holds 1/16,777,216 of unrelated fingerprints. All 56 triples of
positions are filed: a pair that shares m bytes has as many hits as there are
triples of m, so 4 or more bytes are 4 or more hits, and 3 bytes are one.

Only distinct fingerprints are indexed (copies are one node). Postings are read as
sorted runs, some rows at a time. A run of over ``MOST_MET`` fingerprints is split
by a further position, each of the other five in turn: one hit there is 4 shared
bytes, so its pairs need no sum, are verified where they meet and hung on the
smallest, and a run of n gives at most n - 1 links. Pairs that share 4 bytes can't
be split further. What is still over ``MAX_RUN`` isn't compared pair by pair: all
its fingerprints go to a second index, by every value within 2 bits of them. Two of
them link exactly when they share such a value, each value's members are hung on
the smallest, and that is linear in the run. Components come from the links as a table.

Null texts count as empty, and texts without a word have the fingerprint zero,
which links like any other. A null id never is a component's id unless all of its
ids are null. Rows that repeat are linked alike. Columns with clashing names are
left aside by ``find_components`` and kept by ``drop_near_copies``. An empty table
gives none. Very long texts are hashed in pieces of bounded size.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import map_arrow
from .common import as_binary, load, packed, stored, without
from .graph import components

SEED, WIDTH, MAX_BITS = 42, 4, 4
#: Longest posting whose pairs are written as hits. A member of a posting of n is in (n - 1) / 2 of them on average, and makes five rows when it is split.
MOST_MET = 11
#: Longest split posting that is compared pair by pair.
MAX_RUN = 2048
#: Verified pairs that a task holds before it hangs them.
MOST_LINKS = 1 << 20
#: Shingles hashed at once.
PIECE = 1 << 18
#: 20 triples of which any 4 positions hold one: positions 0 to 7 in three parts, triples within a part, and pairs of a part with one of the next.
_PARTS = ((0, 1, 2), (3, 4, 5), (6, 7))
TRIPLES = [*(p for p in _PARTS if len(p) == 3), *(tuple(sorted((*two, one))) for i, p in enumerate(_PARTS) for two in combinations(p, 2) for one in _PARTS[(i + 1) % 3])]
#: What postings stand for: these and all other triples of positions; split postings: all fours.
PLACES = np.array(TRIPLES + [t for t in combinations(range(8), 3) if t not in TRIPLES])
FOURS = np.array([*combinations(range(8), 4)])
#: Hits of a pair that shares the least number of bytes: the triples of 4 positions.
LEAST_HITS = 4
_SPLIT = np.array([[q for q, four in enumerate(FOURS) if set(t) <= set(four)] for t in PLACES])


def fingerprint(raw: bytes) -> int:
    """Of a text's UTF-8 bytes: A-Z lower-cased, words parted by the six ASCII spaces, shingles of four words (fewer: all), XXH64."""
    import xxhash

    words = raw.lower().split()
    if not words:
        return 0
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    joined, n = b" ".join(words), max(1, len(words) - WIDTH + 1)
    first, last = starts[:n], ends[min(WIDTH, len(words)) - 1 :]
    votes, h = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, n, PIECE):
        got = np.array([h(joined[a:b], SEED) for a, b in zip(first[at : at + PIECE].tolist(), last[at : at + PIECE].tolist())], np.uint64)
        bits = np.unpackbits(got.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
    return int(sum(1 << i for i in range(64) if 2 * votes[i] > n))


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, h, fp): a hash of the text as it is, and the fingerprint as a signed 64-bit integer."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = np.array([fingerprint(x) for x in batch.column(2).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(got.view(np.int64), pa.int64())], names=["doc_id", "h", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(as_binary(text_col)).alias("h"), as_binary(text_col).alias("raw"))
    return map_arrow(rows, run, "doc_id long, h long, fp long")


def _hung(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Links between values as a star for each of their components."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    u, v, root = at[: len(a)], at[len(a) :], np.arange(len(nodes))
    while True:
        low = np.minimum(root[u], root[v])
        new = root.copy()
        np.minimum.at(new, root[u], low)
        np.minimum.at(new, root[v], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    far = root != np.arange(len(nodes))
    return nodes[far], nodes[root[far]]


def _linked(fps: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Within each run: pairs at equal distance in it, verified."""
    ends = np.repeat(starts + sizes, sizes)
    at = np.arange(len(fps))[np.repeat(starts, sizes) + _within(sizes)] if len(starts) else np.array([], int)
    found_a, found_b, held, step = [], [], 0, 1
    while len(at):
        more = at + step < ends
        at, ends = at[more], ends[more]
        if not len(at):
            break
        a, b = fps[at], fps[at + step]
        kept = np.bitwise_count(a ^ b) <= MAX_BITS
        found_a.append(a[kept])
        found_b.append(b[kept])
        held += len(found_a[-1])
        if held > MOST_LINKS:  # pairs of near copies are not held: they are hung as they come
            u, v = _hung(np.concatenate(found_a), np.concatenate(found_b))
            found_a, found_b, held = [u], [v], 0
        step += 1
    return (np.concatenate(found_a), np.concatenate(found_b)) if found_a else (fps[:0], fps[:0])


def _within(sizes: np.ndarray) -> np.ndarray:
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def posting_keys(parts: np.ndarray, places: np.ndarray) -> np.ndarray:
    """For rows of bytes a key for each of ``places``: its number, and the bytes at its positions (six at most)."""
    keys = np.repeat(np.arange(len(places))[None], len(parts), axis=0)
    for at in places.T:
        keys = keys << 8 | parts[:, at]
    return keys


def _bytes_of(fps: np.ndarray) -> np.ndarray:
    return fps.view(np.uint8).reshape(-1, 8)


def _post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(posting_keys(_bytes_of(fps), PLACES).ravel()), pa.array(np.repeat(fps, len(PLACES)))], names=["k", "node"])


def _split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Members of long postings (node, k), filed under their posting's positions and each of the others."""
    for batch in batches:
        fps, k = (np.array(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (0, 1))
        fours = _SPLIT[k >> 24]
        keys = np.take_along_axis(posting_keys(_bytes_of(fps), FOURS), fours, axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(fps, fours.shape[1]))], names=["k", "node"])


def _postings(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Sorted postings (k, node) as (k, node, starts and sizes of those of 2 to ``most``, which rows are of a longer one)."""
    held_k, held_f = np.array([], np.int64), np.array([], np.int64)
    long_key = None

    def told(k: np.ndarray, f: np.ndarray) -> tuple:
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        sizes = np.diff(np.concatenate((first, [len(k)])))
        going_on = k[first] == long_key if long_key is not None else np.zeros(len(first), bool)
        short = (sizes > 1) & (sizes <= most) & ~going_on
        return k, f, first[short], sizes[short], np.repeat((sizes > most) | going_on, sizes)

    for batch in batches:
        held_k = np.concatenate((held_k, batch.column(0).to_numpy(zero_copy_only=False)))
        held_f = np.concatenate((held_f, batch.column(1).to_numpy(zero_copy_only=False)))
        if len(held_k) < (1 << 16):
            continue
        cut = np.searchsorted(held_k, held_k[-1])  # the last run may go on
        if cut:
            yield told(held_k[:cut], held_f[:cut])
            held_k, held_f = held_k[cut:], held_f[cut:]
        if len(held_k) > max(most, 1 << 16):  # a long run is passed on as it comes
            long_key = held_k[-1]
            yield told(held_k, held_f)
            held_k, held_f = held_k[:0], held_f[:0]
    if len(held_k):
        yield told(held_k, held_f)


def _hits(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[pa.RecordBatch]:
    """Sorted postings to the pairs that meet in them (u, v, null), and members of long ones (u, null, k)."""

    def out(u: list[np.ndarray], v: list[np.ndarray]) -> pa.RecordBatch:
        u, v = np.concatenate(u), np.concatenate(v)
        return pa.RecordBatch.from_arrays([pa.array(u), pa.array(v), pa.nulls(len(u), pa.int64())], names=["u", "v", "k"])

    for k, f, starts, sizes, long in _postings(batches, most):
        if long.any():
            yield pa.RecordBatch.from_arrays([pa.array(f[long]), pa.nulls(long.sum(), pa.int64()), pa.array(k[long])], names=["u", "v", "k"])
        at, ends = np.repeat(starts, sizes) + _within(sizes), np.repeat(starts + sizes, sizes)
        u, v, held, step = [], [], 0, 1
        while len(at):
            more = at + step < ends
            at, ends = at[more], ends[more]
            u.append(f[at])
            v.append(f[at + step])
            held, step = held + len(at), step + 1
            if held > PIECE:
                yield out(u, v)
                u, v, held = [], [], 0
        if held:
            yield out(u, v)


def tallied(posts: DataFrame, least: int, most: int, tag: str) -> DataFrame:
    """Of postings (k, node): (u, v, null, n) for each pair u < v that meets in ``least`` or more of those with at most ``most`` nodes,
    n being their number, and (u, null, k, 1) for each member of a longer one."""
    runs = posts.repartition("k").sortWithinPartitions("k", "node")
    hits = map_arrow(runs, lambda b: _hits(b, most), "u long, v long, k long")
    return stored(hits.groupBy("u", "v", "k").agg(F.count(F.lit(1)).alias("n")).where(F.col("v").isNull() | (F.col("n") >= least)), tag)


def _hang(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) to stars for their components, some at a time."""
    us, vs, held, last = [], [], 0, 0
    for batch in batches:
        us.append(batch.column(0).to_numpy(zero_copy_only=False))
        vs.append(batch.column(1).to_numpy(zero_copy_only=False))
        held += len(us[-1])
        if held > 2 * last + MOST_LINKS:
            u, v = _hung(np.concatenate(us), np.concatenate(vs))
            if len(u) > MOST_LINKS:
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])
                u, v = u[:0], v[:0]
            us, vs, held, last = [u], [v], len(u), len(u)
    if held:
        u, v = _hung(np.concatenate(us), np.concatenate(vs))
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def hung(links: DataFrame) -> DataFrame:
    """Links (u, v), fewer of them, that join what these join: what a task reads is hung on the smallest."""
    return map_arrow(links.select("u", "v"), _hang, "u long, v long")


def _compare(batches: Iterator[pa.RecordBatch], max_run: int) -> Iterator[pa.RecordBatch]:
    """Sorted split postings to links (u, v), and members of long runs (u, null)."""
    for _, f, starts, sizes, long in _postings(batches, max_run):
        a, b = _linked(f.view(np.uint64), starts, sizes)
        u, v = _hung(a.view(np.int64), b.view(np.int64)) if len(a) else (f[:0], f[:0])
        ends = np.concatenate((v, f[long]))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate((u, f[long]))), pa.array(ends, mask=np.arange(len(ends)) >= len(v))], names=["u", "v"])


def _near_values(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every value within 2 bits of each fingerprint."""
    bits = np.left_shift(np.uint64(1), np.arange(64, dtype=np.uint64))
    flips = np.concatenate(([np.uint64(0)], bits, [bits[i] | bits[j] for i, j in combinations(range(64), 2)])).astype(np.uint64)
    for batch in batches:
        fps = np.array(batch.column(0).to_numpy(zero_copy_only=False), np.int64)
        for at in range(0, len(fps), 256):
            some = fps[at : at + 256]
            values = (some.view(np.uint64)[:, None] ^ flips[None, :]).ravel().view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(values), pa.array(np.repeat(some, len(flips)))], names=["k", "fp"])


def _hang_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (value, fingerprint): each member of a run linked to the run's first."""
    key = head = None
    for batch in batches:
        k, f = (np.array(batch.column(i).to_numpy(zero_copy_only=False), np.int64) for i in (0, 1))
        if not len(k):
            continue
        first = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1])))
        heads = f[first].copy()
        if key is not None and k[0] == key:
            heads[0] = head
        heads_of = np.repeat(heads, np.diff(np.concatenate((first, [len(k)]))))
        key, head, far = k[-1], heads[-1], heads_of != f
        pairs = np.unique(np.stack((f[far], heads_of[far]), axis=1), axis=0)
        u, v = _hung(pairs[:, 0], pairs[:, 1]) if len(pairs) else (f[:0], f[:0])
        yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])


def links_between(nodes: DataFrame, max_run: int = MAX_RUN) -> DataFrame:
    """Of distinct fingerprints (fp): links (u, v) that join exactly those that reach each other."""
    met = tallied(map_arrow(nodes, _post, "k long, node long"), LEAST_HITS, min(max_run, MOST_MET), "simhash-met")
    links = hung(met.where("v is not null").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= MAX_BITS))
    hot = met.where("v is null").select("u", "k")
    if hot.isEmpty():
        return links
    fours = map_arrow(hot, _split, "k long, node long").distinct().repartition("k").sortWithinPartitions("k", "node")
    found = stored(map_arrow(fours, lambda b: _compare(b, max_run), "u long, v long"), "simhash-links")
    links, long = links.unionByName(found.where("v is not null")), found.where("v is null").select(F.col("u").alias("fp")).distinct()
    if not long.isEmpty():
        near = map_arrow(long, _near_values, "k long, fp long").repartition("k").sortWithinPartitions("k", "fp")
        links = links.unionByName(map_arrow(near, _hang_runs, "u long, v long"))
    return links


def find_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_run: int = MAX_RUN) -> DataFrame:
    """(doc_id, h, fp, root, component_id): the component's smallest fingerprint, and the smallest id in it."""
    prints = stored(fingerprints(docs, id_col, text_col), "simhash-prints")
    nodes = stored(prints.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-nodes")
    roots = components(links_between(nodes.select("fp"), max_run))
    placed = nodes.join(roots, nodes.fp == roots.node, "left").select("fp", F.coalesce("root", "fp").alias("root"), "first")
    ids = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    named = stored(placed.join(ids, "root").select(F.col("fp").alias("__fp"), "root", "component_id"), "simhash-named")
    return prints.join(named, F.col("fp") == F.col("__fp")).select("doc_id", "h", "fp", "root", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", find=find_components) -> DataFrame:
    """``docs`` with one row of each component that ``find`` gives: that of the smallest id (of rows that share it, the one whose text's hash is smallest)."""
    each = stored(find(docs, id_col, text_col).groupBy("root", "doc_id", "h").agg(F.count(F.lit(1)).alias("c")), "simhash-each")
    place = F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "h")
    keep = each.groupBy("root").agg(F.min(place).alias("k")).select(F.col("root").alias("__root"), "k")
    told = each.join(keep, F.col("root") == F.col("__root")).select(F.col("doc_id").alias("__gid"), F.col("h").alias("__gh"), (~place.eqNullSafe(F.col("k"))).alias("__drop"), "c")
    gone = stored(told.where("__drop or c > 1").select("__gid", "__gh", "__drop"), "simhash-gone")
    rows = packed(docs).withColumn("__id", F.col(f"__row.{id_col}").cast("long")).withColumn("__h", F.xxhash64(as_binary(f"__row.{text_col}")))
    return without(rows, gone, ["__id", "__h"], ["__gid", "__gh"], not gone.where("not __drop").isEmpty())


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_components(load(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


QUERIES = {"op5_simhash": op5_simhash}
ORACLES = {}
