import re
from collections import Counter

import pytest

from papergrid.llm import quality as Q

from .helpers import corpus, docs_df, empty_df


def plain(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    c = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if c[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_measures():
    for r in [*corpus(), (0, "a b c a b c x"), (0, "a a a a"), (0, "q\n\nq\n \n q\nq"), (0, "\x0b\x0c\x85\xa0 é")]:
        assert Q.measures((r[1] or "").encode()) == plain(r[1])


def test_bound():
    for k, n, level in ((0, 100, 0.05), (3, 50, 0.01), (10, 1000, 0.001)):
        p = Q.upper_bound(k, n, level)
        term, total = (1 - p) ** n, 0.0
        for i in range(k + 1):
            total += term
            term *= (n - i) / (i + 1) * p / (1 - p)
        assert total == pytest.approx(level, rel=1e-6)
    assert Q.upper_bound(0, 0, 0.1) == Q.upper_bound(5, 5, 0.1) == 1.0


def test_judging(spark):
    rows = Q.measured(docs_df(spark))
    got = Q.judged(rows, {"en": {"symbol_ratio": 0.01}}).collect()
    assert len(got) == len(corpus())
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and not r.rejected_by)
    assert sorted(tuple(r)[2:7] for r in got) == sorted(plain(r[1]) for r in corpus())
    assert Q.measured(empty_df(spark)).count() == 0


def test_fit_is_safe_and_useful(spark):
    good = " ".join(f"word{i}" for i in range(60))
    bad = " ".join(f"word{i}%%%" for i in range(60))
    docs = spark.createDataFrame([(i, good if i % 3 else bad, "en") for i in range(6000)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(6000)] + [(None, 1), (7, None)], "doc_id long, quality int")
    cutoffs = Q.fit(Q.measured(docs), labels)
    assert "symbol_ratio" in cutoffs["en"]
    kept = Q.judged(Q.measured(docs), cutoffs)
    assert kept.where("kept and doc_id % 3 = 0").count() == 0 == kept.where("not kept and doc_id % 3 > 0").count()
    assert Q.fit(Q.measured(docs), labels.limit(0)) == {}


NONE = tuple(len(c) for _, c in Q.RULES.values())


def vector(**hits):
    return tuple(hits.get(r, 0) for r in Q.RULES)


def counted(good, bad, held_good):
    return {("en", True, 1): good, ("en", True, 0): bad, ("en", False, 1): held_good}


def test_few_labels_reject_nothing():
    bad = {vector(symbol_ratio=7): 40}
    assert Q.choose(counted({}, bad, {vector(): 50})) == {}  # too few for the bound
    assert Q.choose(counted({}, bad, {vector(): 5000})) == {"en": {"symbol_ratio": 0.4}}  # the laxest of equals
    assert Q.choose(counted({}, {}, {vector(): 5000})) == {}  # nothing gained
    assert Q.choose(counted({vector(symbol_ratio=7): 41}, bad, {vector(): 5000})) == {}  # more good than bad
    assert Q.choose({}) == {}


def test_rules_share_the_bound():
    """Two rules that each reject 0.8 % of the good texts aren't both taken: together they pass 1 %."""
    bad = {vector(symbol_ratio=7): 400, vector(dup_line_ratio=6): 300}
    held = {vector(): 98_400, vector(symbol_ratio=7): 800, vector(dup_line_ratio=6): 800}
    assert Q.choose(counted({}, bad, held)) == {"en": {"symbol_ratio": 0.4}}
    assert Q.choose(counted({}, bad, {vector(): 100_000})) == {"en": {"symbol_ratio": 0.4, "dup_line_ratio": 0.7}}


def test_fit_against_plain(spark):
    """The counts, the ladder, the bound and the verdict of op9, from rows in memory."""
    import random

    rng, rows = random.Random(8), []
    for i in range(4000):
        bad = rng.random() < 0.3
        text = " ".join(f"w{rng.randint(0, 999)}o" + "%" * (bad and rng.random() < 0.5) for _ in range(rng.randint(40, 130)))
        rows.append((i, text + ("\nab\nab" * 30 if bad and rng.random() < 0.5 else ""), rng.choice(["en", "de", None]), int(not bad)))
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, q) for i, _, _, q in rows], "doc_id long, quality int")
    builds = {r.doc_id for r in docs.where(f"pmod(xxhash64({Q.SEED}, doc_id), {Q.FOLD}) = 0").select("doc_id").collect()}
    seen, counts = {}, {}
    for i, text, lang, q in rows:
        n, chars, symbols, dup, rep = plain(text)
        lines = len([x for x in text.split("\n") if x.strip()])
        value = {"symbol_ratio": symbols / max(chars, 1), "dup_line_ratio": dup / max(lines, 1), "repeat_ratio": rep / max(n, 1), "long_words": chars / max(n, 1), "short_words": chars / max(n, 1), "few_words": n}
        v = tuple(sum(value[r] > c if sign > 0 else value[r] < c for c in cut) for r, (sign, cut) in Q.RULES.items())
        stratum, failed = lang or "other", n < 50 or 100 * rep > 50 * n
        seen[i] = (stratum, v, failed)
        if not failed:
            d = counts.setdefault((stratum, i in builds, q), {})
            d[v] = d.get(v, 0) + 1
    want = Q.choose(counts, alpha=0.02)
    rows_of = Q.measured(docs)
    assert Q.fit(rows_of, labels, alpha=0.02) == want and set(want) == {"en", "de", "other"}
    kept = {i: not failed and not any(v[list(Q.RULES).index(r)] > Q.RULES[r][1].index(cut) for r, cut in want.get(s, {}).items()) for i, (s, v, failed) in seen.items()}
    assert {r.doc_id: r.kept for r in Q.judged(rows_of, want).collect()} == kept
    for stratum in want:
        good = [i for i, *_, q in rows if q and seen[i][0] == stratum and not seen[i][2]]
        assert sum(not kept[i] for i in good) <= 0.02 * len(good)


def test_op9_contract(spark, tmp_path):
    docs_df(spark).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    got = Q.op9_quality_rules(spark, str(tmp_path))
    assert got.dtypes[:8] == [("doc_id", "bigint"), *((c, "bigint") for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), ("base_failed", "boolean"), ("kept", "boolean")]
    assert sorted(tuple(r)[1:6] for r in got.collect()) == sorted(plain(r[1]) for r in corpus())
