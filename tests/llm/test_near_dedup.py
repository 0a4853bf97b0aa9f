from collections import Counter
from itertools import combinations

import corpus_pipeline as P
import pytest

from papergrid.llm import near_dedup as N

from .helpers import corpus, docs_df, empty_df, words
from .test_simhash import groups, reach


def plain(text):
    w = (text or "").encode().lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def similar(a, b):
    return 5 * len(a & b) >= 4 * len(a | b)


def test_pair_of_similarity_0_8_goes(spark):
    import random

    w = words(random.Random(8), 85).split()
    other = [*w[:40], "changed", *w[41:60], "again", *w[61:]]  # 71 of 91 shingles are shared: below
    near = [*w[:40], "changed", *w[41:42], "again", *w[43:]]  # 74 of 88: above
    assert not similar(plain(" ".join(w)), plain(" ".join(other))) and similar(plain(" ".join(w)), plain(" ".join(near)))
    for text, left in ((near, [3]), (other, [3, 9])):
        docs = spark.createDataFrame([(9, " ".join(w)), (3, " ".join(text))], "doc_id long, text string")
        assert sorted(r.doc_id for r in P.drop_near_copies(spark, docs, "").collect()) == left


def test_components_of_documents(spark):
    rows = corpus()
    root = reach(range(len(rows)), lambda a, b: similar(plain(rows[a][1]), plain(rows[b][1])))
    want = {}
    for i, r in enumerate(rows):
        want.setdefault(root[i], []).append((r[0] is None, r[0] or 0))
    got = {}
    for r in N.find_components(docs_df(spark)).collect():
        got.setdefault(r.root, []).append((r.doc_id is None, r.doc_id or 0))
    assert sorted(map(sorted, got.values())) == sorted(map(sorted, want.values()))
    kept = N.drop_near_copies(docs_df(spark))
    assert kept.count() == len(want) and kept.columns == docs_df(spark).columns


@pytest.mark.parametrize("n", [60])
def test_chain_and_group(n):
    import random

    import numpy as np

    rng = random.Random(4)
    base, texts = words(rng, 120).split(), []
    for i in range(n):  # each text has one more word changed: neighbours link, ends don't
        base = base.copy()
        base[(7 * i) % 120] = f"w{i}"
        texts.append(" ".join(base))
    texts += [words(rng, 100) for _ in range(5)]
    sets = [N.shingles(t.encode()) for t in texts]
    got = N.linked(sets, np.stack([N.signature(s)[0] for s in sets]))
    want = reach(range(len(texts)), lambda a, b: similar(plain(texts[a]), plain(texts[b])))
    assert groups(enumerate(got.tolist())) == groups(want.items())
    assert any(not similar(plain(texts[a]), plain(texts[b])) for a, b in combinations(range(n), 2))


def altered(rng, n, changes):
    """n texts: a base with some words changed, each another way."""
    base, texts = words(rng, 120).split(), []
    for i in range(n):
        t = base.copy()
        for at in rng.sample(range(120), changes):
            t[at] = f"w{i}x{at}"
        texts.append(" ".join(t))
    return texts


@pytest.mark.parametrize("most", [256, 4])
def test_pairs_meet_in_the_index_of_simhash(spark, monkeypatch, most):
    import random

    rng, told, tallied = random.Random(11), [], N.simhash.tallied
    monkeypatch.setattr(N.simhash, "MOST_MET", most)
    monkeypatch.setattr(N.simhash, "tallied", lambda posts, least, *more: told.append((posts, least, tallied(posts, least, *more))) or told[-1][2])
    texts = altered(rng, 12, 1) + altered(rng, 6, 4) + altered(rng, 5, 12) + [words(rng, 90) for _ in range(10)]
    kept = sorted(r.doc_id for r in P.drop_near_copies(spark, spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "").collect())
    root = reach(range(len(texts)), lambda a, b: similar(plain(texts[a]), plain(texts[b])))
    assert kept == sorted(set(root.values())) and 1 < len(kept) < len(texts)
    ((posts, least, met),) = told
    assert least == N.HITS > 1
    where = {}
    for r in posts.collect():
        where.setdefault(r.k, []).append(r.node)
    hits = Counter(pair for nodes in where.values() if len(nodes) <= most for pair in combinations(sorted(nodes), 2))
    rows = met.collect()
    assert {(r.u, r.v): r.n for r in rows if r.v is not None} == {pair: n for pair, n in hits.items() if n >= least}
    assert sorted((r.k, r.u) for r in rows if r.v is None) == sorted((k, x) for k, nodes in where.items() if len(nodes) > most for x in nodes)
    assert min(hits.values()) < least and any(r.v is None for r in rows) == (most == 4)


def test_empty(spark):
    assert N.find_components(empty_df(spark)).count() == 0 == N.drop_near_copies(empty_df(spark)).count()
