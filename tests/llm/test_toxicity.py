import random
import zlib

import numpy as np

from papergrid.llm import toxicity as X

from .helpers import corpus, docs_df, empty_df, words


def made(n=600, seed=1):
    """An insult is toxic only next to a group's name."""
    rng, rows = random.Random(seed), []
    for i in range(n):
        insult, group = rng.random() < 0.5, rng.random() < 0.5
        parts = words(rng, 12).split() + ["grumbler"] * insult + ["martians"] * group
        rng.shuffle(parts)
        rows.append((i, " ".join(parts), int(insult and group)))
    return rows


def test_learns_a_pair():
    rows = made()
    m = X.train([X.terms(t) for _, t, _ in rows[:400]], np.array([y for *_, y in rows[:400]], float), np.arange(400) % 4 == 0)
    score = lambda t: m.score(t)
    assert score("you grumbler martians") > max(score("you grumbler"), score("you martians"), score("you")) + 0.3
    held = rows[400:]
    assert np.mean([(m.score(t) >= X.THRESHOLD) == y for _, t, y in held]) > 0.95


def test_query(spark):
    rows = made(400)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t, _ in rows] + [(1000, None, "x", 0), (1001, "", "x", 0), (None, "a", None, None), (1002, "w " * 50_000, "x", 0)], "doc_id long, text string, score string, toxic int")
    labels = spark.createDataFrame([(i, 1, y) for i, _, y in rows] + [(None, 1, 1), (5, 1, None)], "doc_id long, quality int, toxic int")
    machine = X.fit(docs, labels)
    got = {r.doc_id: r.s for r in X.scored(docs, machine, ["doc_id"], score_col="s").collect()}
    assert len(got) == 404 and all(0 <= s <= 1 for s in got.values()) and got[1000] == got[1001]
    held = [(i, y) for i, _, y in rows if zlib.crc32(str(i).encode()) % 3 == 1]
    assert np.mean([(got[i] >= X.THRESHOLD) == y for i, y in held]) > 0.9
    kept = X.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(s < X.THRESHOLD for s in got.values())


def test_fit_equals_plain(spark, monkeypatch):
    """Spark's choice of slots, and the machine, against one that has all rows in memory; scores by the formula."""
    rows = made(300)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int")
    machine = X.fit(docs, labels)
    own = [(i, t, y) for i, t, y in rows if zlib.crc32(str(i).encode()) % 3 != 1]
    in_fold = {r.doc_id: r.f for r in docs.selectExpr("doc_id", f"pmod(xxhash64({X.SEED + 1}, doc_id), {X.FOLD}) = 0 as f").collect()}
    plain = X.train([X.terms(t) for _, t, _ in own], np.array([y for *_, y in own], float), np.array([in_fold[i] for i, *_ in own]))
    assert (machine.slots == plain.slots).all() and np.allclose(machine.w, plain.w) and np.allclose(machine.v, plain.v)
    for _, t, _ in rows[:20]:
        at = [machine.at[s] for s in X.terms(t).tolist() if s in machine.at]
        z = machine.w0 + sum(machine.w[i] for i in at) + X.scale(len(at)) * sum(float(machine.v[i] @ machine.v[j]) for k, i in enumerate(at) for j in at[:k])
        assert abs(machine.score(t) - 1 / (1 + np.exp(-z))) < 1e-9


def test_terms_that_tell_only_in_pairs():
    """A group's name that is as frequent in clean texts, among a vocabulary that tells nothing."""
    rng, rows = random.Random(3), []
    for _ in range(3000):
        insult, group = rng.random() < 0.3, rng.random() < 0.5
        toxic = insult and group
        name = group if insult else rng.random() < 0.5 * 0.3 / 0.7 * 0.7
        rows.append((" ".join([f"w{rng.randint(0, 9000)}" for _ in range(40)] + ["grumbler"] * insult + ["martians"] * name), int(toxic)))
    slots = set(X.choose_slots([X.terms(t) for t, _ in rows], np.array([y for _, y in rows], float)).tolist())
    assert X.terms_of("grumbler") <= slots and X.terms_of("martians") <= slots


def test_op3_contract(spark, tmp_path):
    rows = made(200)
    spark.createDataFrame([(i, t) for i, t, _ in rows] + [(900, None), (901, "")], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = X.op3_toxicity(spark, str(tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")]
    for r in got.collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == int(r.score >= 0.7) and 0 <= r.score <= 1


def test_held_out_labels_are_not_used(spark):
    rows = made(200)
    docs = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    a = X.fit(docs, spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, toxic int"))
    b = X.fit(docs, spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 3 == 1 else y) for i, _, y in rows], "doc_id long, toxic int"))
    assert (a.slots == b.slots).all() and (a.w == b.w).all() and a.w0 == b.w0


def test_no_labels_and_empty(spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = docs_df(spark)
    assert X.drop_toxic(docs, none).count() == len(corpus())
    assert X.drop_toxic(empty_df(spark), none).count() == 0
