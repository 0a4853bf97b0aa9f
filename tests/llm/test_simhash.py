import random
from itertools import combinations
from math import comb

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from papergrid.llm import simhash as S
from papergrid.llm.graph import components

from .helpers import corpus, docs_df, empty_df


def plain(text):
    w = (text or "").encode().lower().split()
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def reach(nodes, linked):
    root = {x: x for x in nodes}
    changed = True
    while changed:
        changed = False
        for a, b in combinations(sorted(nodes), 2):
            if linked(a, b) and root[a] != root[b]:
                low = min(root[a], root[b])
                for x in nodes:
                    if root[x] in (root[a], root[b]) and x in (a, b):
                        root[x] = low
                changed = True
    return root


def groups(pairs):
    out = {}
    for x, r in pairs:
        out.setdefault(r, set()).add(x)
    return sorted(map(sorted, out.values()))


def test_triples_cover():
    assert len(S.TRIPLES) == 20 and all(any(set(t) <= set(q) for t in S.TRIPLES) for q in combinations(range(8), 4))


def sharing(rng, m):
    """Two fingerprints that share exactly m bytes."""
    a = [rng.randrange(256) for _ in range(8)]
    same = rng.sample(range(8), m)
    return a, [x if i in same else x ^ rng.randrange(1, 256) for i, x in enumerate(a)]


def signed(parts):
    return int.from_bytes(bytes(parts), "little", signed=True)


def test_hits_tell_shared_bytes():
    rng = random.Random(6)
    for m in [*range(9)] * 5:
        keys = S.posting_keys(np.array(sharing(rng, m), np.uint8), S.PLACES)
        assert (keys[0] == keys[1]).sum() == comb(m, 3) and len(np.unique(keys)) == 2 * 56 - comb(m, 3)
    assert S.LEAST_HITS == comb(8 - S.MAX_BITS, 3)


def test_hits_are_summed_over_postings(spark):
    rng = random.Random(7)
    fps = [signed(x) for m in [*range(2, 8)] * 4 for x in sharing(rng, m)]
    fps += [signed([1, 2, 3, i, i + 50, i + 100, i + 150, i + 200]) for i in range(6)]  # six that share three bytes, in one posting
    posts = S.map_arrow(spark.createDataFrame([(f,) for f in fps], "fp long"), S._post, "k long, node long")

    def shared(a, b):
        return sum(x == y for x, y in zip(a.to_bytes(8, "little", signed=True), b.to_bytes(8, "little", signed=True)))

    pairs = {(a, b): comb(shared(a, b), 3) for a, b in combinations(sorted(fps), 2)}
    for least in (1, S.LEAST_HITS):
        got = S.tallied(posts, least, 256, "t").collect()
        assert sorted((r.u, r.v, r.n) for r in got) == sorted((a, b, n) for (a, b), n in pairs.items() if n >= least)
    got = S.tallied(posts, 1, 5, "t").collect()
    assert sorted(r.u for r in got if r.v is None) == sorted(fps[-6:]) and len({r.k for r in got if r.v is None}) == 1
    assert not any(r.u in fps[-6:] and r.v in fps[-6:] for r in got if r.v is not None)


def test_components_of_documents(spark):
    rows = corpus()
    fps = [plain(r[1]) for r in rows]
    root = reach(set(fps), lambda a, b: (a ^ b).bit_count() <= 4)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    want = sorted((r[0], f, least.get(root[f])) for r, f in zip(rows, fps) if r[0] is not None)
    got = S.find_components(docs_df(spark)).collect()
    assert len(got) == len(rows)
    assert sorted((r.doc_id, r.fp % (1 << 64), r.component_id) for r in got if r.doc_id is not None) == want


@pytest.mark.parametrize("max_run", [2048, 3])
def test_links_of_close_fingerprints(spark, max_run):
    rng = random.Random(3)
    fps = set()
    for _ in range(6):
        f = rng.getrandbits(64)
        for _ in range(14):
            fps.add(f)
            g = f
            for _ in range(rng.randint(1, 5)):
                g ^= 1 << rng.randrange(64)
            fps.add(g)
            f = rng.choice((f, g))
    fps |= {0, 15, (1 << 64) - 1, rng.getrandbits(64)}
    signed = [int(np.uint64(f).astype(np.int64)) for f in sorted(fps)]
    df = spark.createDataFrame([(f,) for f in signed], "fp long")
    links = S.links_between(df, max_run)
    assert all(((a ^ b) % (1 << 64)).bit_count() <= 64 for a, b in links.collect())
    roots = dict(components(links).collect())
    want = reach(set(signed), lambda a, b: ((a ^ b) % (1 << 64)).bit_count() <= 4)
    assert groups((x, roots.get(x, x)) for x in signed) == groups(want.items())


@pytest.mark.parametrize("max_run", [2048, 6])
def test_long_postings_are_split(spark, monkeypatch, max_run):
    monkeypatch.setattr(S, "MOST_MET", 2)
    rng = random.Random(9)
    fps = {rng.getrandbits(20) << 20 for _ in range(3)} | {rng.getrandbits(63) for _ in range(20)}
    for f in [*fps][:12]:
        fps |= {f ^ (1 << 8 * a) ^ (1 << 8 * b) ^ (1 << 8 * c) ^ (1 << 8 * d) for a, b, c, d in combinations(range(7), 4) if rng.random() < 0.3}  # four bits in four bytes
    links = S.links_between(spark.createDataFrame([(f,) for f in fps], "fp long"), max_run)
    roots = dict(components(links).collect())
    want = reach(fps, lambda a, b: (a ^ b).bit_count() <= 4)
    assert groups((x, roots.get(x, x)) for x in fps) == groups(want.items())


def test_runs_over_batches():
    k = np.repeat(np.arange(5), [3, 200_000, 1, 40, 2])
    f = np.arange(len(k))
    batches = [pa.RecordBatch.from_arrays([pa.array(k[i : i + 9000]), pa.array(f[i : i + 9000])], names=["k", "node"]) for i in range(0, len(k), 9000)]
    got = pa.Table.from_batches(S._hits(iter(batches), 40)).to_pylist()
    assert sorted((r["u"], r["v"]) for r in got if r["v"] is not None) == [p for key in (0, 3, 4) for p in combinations(f[k == key].tolist(), 2)]
    assert [r["u"] for r in got if r["v"] is None] == f[k == 1].tolist() and {r["k"] for r in got if r["v"] is None} == {1}


def test_long_runs_make_few_links(spark):
    base = 0x0123456789ABCDEF
    fps = [base] + [base ^ (1 << i) ^ (1 << j) for i, j in combinations(range(0, 40), 2)]
    links = S.links_between(spark.createDataFrame([(f,) for f in fps], "fp long"))
    assert links.count() < 30 * len(fps)
    assert len(set(r.root for r in components(links).collect())) == 1


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(300)] + [(1000, i) for i in range(1001, 1400)] + [(5000, 5000), (None, 7), (2, 1), (1, 2)]
    got = dict(components(spark.createDataFrame(edges, "u long, v long")).collect())
    assert got == {**{i: 0 for i in range(301)}, **{i: 1000 for i in range(1000, 1400)}}


def test_drop(spark):
    kept = S.drop_near_copies(docs_df(spark)).collect()
    found = S.find_components(docs_df(spark)).collect()
    assert len(kept) == len({r.root for r in found})
    assert {r.doc_id for r in kept} == {r.component_id for r in found}
    assert S.drop_near_copies(docs_df(spark)).columns == docs_df(spark).columns


def test_drop_where_ids_repeat(spark):
    df = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (1, "something else here now"), (2, "a b c d e f"), (None, "only here, without an id")], "doc_id long, text string")
    assert sorted(tuple(r) for r in S.drop_near_copies(df).where("doc_id is not null").collect()) == [(1, "a b c d e f"), (1, "something else here now")]
    assert S.drop_near_copies(df).count() == 3


def test_empty(spark):
    assert S.find_components(empty_df(spark)).count() == 0 == S.drop_near_copies(empty_df(spark)).count()
