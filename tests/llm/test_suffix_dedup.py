import random
from collections import Counter

import pytest

from papergrid.llm import suffix_dedup as X

from .helpers import corpus, docs_df, empty_df, words


def plain(rows, n, keep_first):
    """(doc_id, text) rows to (doc_id, kept bytes); with keep_first, rows alike in both are one."""
    texts = [(i, (t or "").encode()) for i, t in rows]
    order = sorted(range(len(texts)), key=lambda k: (texts[k][0] is not None, texts[k][0] or 0, __import__("zlib").crc32(texts[k][1])))
    if keep_first:
        first, seen = {}, set()
        for k in order:
            for p in range(len(texts[k][1]) - n + 1):
                first.setdefault(texts[k][1][p : p + n], (texts[k], p))
    else:
        seen = Counter(t[p : p + n] for _, t in texts for p in range(len(t) - n + 1))
    out = []
    for row in texts:
        cut = bytearray(len(row[1]))
        for p in range(len(row[1]) - n + 1):
            w = row[1][p : p + n]
            if first[w] != (row, p) if keep_first else seen[w] > 1:
                cut[p : p + n] = b"\1" * n
        out.append((row[0], bytes(b for b, c in zip(row[1], cut) if not c)))
    return sorted(out, key=str)


def hard(seed):
    rng = random.Random(seed)
    shared = [words(rng, 40) for _ in range(3)]
    rows = [(i, words(rng, rng.randint(0, 12)) + " " + rng.choice(shared)[rng.randint(0, 40) :] + words(rng, rng.randint(0, 9))) for i in range(25)]
    rows += [(50, shared[0] + shared[0]), (51, "ab" * 400), (52, "ab" * 90 + "c"), (53, "z" * 700), (54, shared[1]), (54, shared[1]), (54, shared[2]), (None, shared[2]), (55, None), (56, "")]
    return rows


@pytest.mark.parametrize("keep_first", [False, True])
@pytest.mark.parametrize("sizes", [{}, {"max_group": 1}])
def test_short_windows(spark, keep_first, sizes):
    rows = hard(4)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = X.remove_repeats(df, window=60, keep_first=keep_first, factor=40, gram=8, block=16, **sizes).collect()
    assert sorted(((r.doc_id, bytes(r.kept)) for r in got), key=str) == plain(rows, 60, keep_first)
    assert all(r.n_bytes - len(r.kept) == sum(s["last"] - s["first"] for s in r.spans) for r in got)
    assert sorted(((r.doc_id, r.n_bytes - r.n_repeated) for r in got), key=str) == sorted(((i, len(k)) for i, k in plain(rows, 40, keep_first)), key=str)


def test_longest_previous_factors():
    rng = random.Random(2)
    for _ in range(300):
        text = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(1, 12))]
        order = sorted(range(len(text)), key=text.__getitem__)
        got = X.previous_factors(order, [X.common_prefix(text[i], text[j]) for i, j in zip(order, order[1:])])
        assert dict(zip(order, got)) == {i: max((X.common_prefix(text[i], text[j]) for j in range(i)), default=-1) for i in order}


def test_query(spark, tmp_path):
    rows = [r[:2] for r in corpus()]
    docs_df(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = X.op8_suffix_dedup(spark, str(tmp_path))
    assert got.columns[:5] == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    want = [(i, len((t or "").encode())) for i, t in rows]
    kept = plain(rows, X.WINDOW, False)
    sha = __import__("hashlib").sha256
    assert sorted((str(r.doc_id), r.kept_sha256) for r in got.collect()) == sorted((str(i), sha(k).hexdigest()) for i, k in kept)
    assert sorted((str(r.doc_id), r.n_bytes) for r in got.collect()) == sorted((str(i), n) for i, n in want)
    assert all((r.n_spans == 0) == (r.n_removed == 0) and r.n_repeated >= r.n_removed for r in got.collect())


@pytest.mark.parametrize("keep_first", [False, True])
def test_corpus(spark, keep_first):
    rows = [r[:2] for r in corpus()]
    got = X.remove_repeats(docs_df(spark), keep_first=keep_first).collect()
    assert sorted(((r.doc_id, bytes(r.kept)) for r in got), key=str) == plain(rows, X.WINDOW, keep_first)


def test_stretches():
    raw = words(random.Random(1), 900).encode()
    whole, parts = X.block_starts(raw), X.block_starts(raw, stretch=700)
    assert set(parts) == set(whole)


def test_empty(spark):
    assert X.remove_repeats(empty_df(spark)).count() == 0
