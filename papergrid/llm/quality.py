"""Quality rules with risk-controlled thresholds.

Each rule rejects a text whose measure passes a cutoff. The labelled rows are parted
by a seeded hash of their id. On one third, per stratum (language), a ladder is built:
from no rejection at all, each step tightens one rule to the cutoff that newly rejects
most bad texts for the good ones (whose number weighs squared). On the other two thirds, the holdout, the steps are
tested in that order: the good texts that *any* rule of the step rejects are counted,
and the exact binomial (Clopper-Pearson) upper bound of their rate is taken at level
``DELTA`` divided by the number of strata (Bonferroni); the first step whose bound passes
``ALPHA`` ends the ladder (a fixed sequence, so its steps need no further correction).
The last step before it is the stratum's. So with probability ``1 - DELTA`` the rules
together falsely reject at most ``ALPHA`` of the good texts of every stratum. A step
can pass from ``ln(strata / DELTA) / ALPHA`` good holdout texts on (461 for five strata);
with fewer, the stratum has no cutoffs. Texts that fail the base rules are rejected by
them, whatever the labels, and count neither as good nor as bad.

A labelled row is reduced to the number of each rule's cutoffs that it passes; rows
that are alike in these are counted by Spark, and the driver gets a row per such
vector, whose number the rules bound. Languages outside ``STRATA`` (or null) are one stratum.
Null texts have no words and fail the base rules; so do empty ones. Very long texts
are measured whole. Rows that repeat are judged alike; labels that repeat or
contradict each other all count. Without labels no rule rejects. Columns with
clashing names are left aside; an empty table gives none.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..ship import map_arrow
from .common import as_binary, load, stored

STRATA = ("en", "de", "fr", "es")
#: Most false rejections in a stratum, by all its rules together, and the probability that any stratum has more.
ALPHA, DELTA = 0.01, 0.05
#: One labelled row of so many builds the ladders, the others test them.
FOLD, SEED = 3, 9
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SYMBOLS = b"#*$%&|<>"
#: Measure, and cutoffs from the one that rejects most on: a text is rejected above (or, by the sign -1, below) the cutoff.
RULES: dict[str, tuple[int, tuple[float, ...]]] = {
    "symbol_ratio": (1, (0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.4)),
    "dup_line_ratio": (1, (0.05, 0.1, 0.2, 0.3, 0.5, 0.7)),
    "repeat_ratio": (1, (0.05, 0.1, 0.2, 0.3, 0.4, 0.5)),
    "long_words": (1, (6.5, 7.0, 8.0, 10.0, 14.0, 20.0)),
    "short_words": (-1, (4.0, 3.5, 3.0, 2.5, 2.0)),
    "few_words": (-1, (120, 100, 80, 60)),
}


def measures(raw: bytes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a text's UTF-8 bytes."""
    words = raw.split()
    n = len(words)
    joined = np.frombuffer(b"".join(words), np.uint8)
    chars = len(joined) - int(np.count_nonzero((joined & 0xC0) == 0x80))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    lines = [x for x in raw.split(b"\n") if x.strip()]
    repeat = 0
    if n > 3:
        seen: dict[bytes, int] = {}
        ids = np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)
        v = len(seen)
        if v < 2_000_000:
            code = (ids[:-2] * v + ids[1:-1]) * v + ids[2:]
        else:
            pairs = np.unique(ids[:-1] * v + ids[1:], return_inverse=True)[1].astype(np.int64)
            code = pairs[:-1] * v + ids[2:]
        _, at, counts = np.unique(code, return_inverse=True, return_counts=True)
        hit = counts[at] > 1
        covered = np.zeros(n, bool)
        for k in range(3):
            covered[k : n - 2 + k] |= hit
        repeat = int(covered.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, stratum, the five counts, and n_lines (lines that have a word)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(2).to_pylist()
            got = np.array([(*measures(t), sum(1 for x in t.split(b"\n") if x.strip())) for t in texts], np.int64).reshape(-1, 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(got[:, k]) for k in range(6))], names=["doc_id", "stratum", *_COUNTS, "n_lines"])

    stratum = F.when(F.col(lang_col).isin(*STRATA), F.col(lang_col)).otherwise("other")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), stratum.cast("string").alias("stratum"), as_binary(text_col).alias("raw"))
    return map_arrow(rows, run, "doc_id long, stratum string, " + ", ".join(f"{c} long" for c in (*_COUNTS, "n_lines")))


def _value(rule: str) -> Column:
    share = lambda a, b: F.col(a) / F.greatest(F.col(b), F.lit(1))
    return {
        "symbol_ratio": share("n_symbols", "word_chars"),
        "dup_line_ratio": share("n_dup_lines", "n_lines"),
        "repeat_ratio": share("n_repeat_words", "n_words"),
        "long_words": share("word_chars", "n_words"),
        "short_words": share("word_chars", "n_words"),
        "few_words": F.col("n_words").cast("double"),
    }[rule]


def _rejects(rule: str, cutoff: float) -> Column:
    sign, _ = RULES[rule]
    return _value(rule) > F.lit(float(cutoff)) if sign > 0 else _value(rule) < F.lit(float(cutoff))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def upper_bound(k: int, n: int, level: float) -> float:
    """Clopper-Pearson: the largest rate at which k or fewer of n still have probability ``level``."""
    if n == 0 or k >= n:
        return 1.0

    def at_most(p: float) -> float:
        log_p, log_q = math.log(p), math.log1p(-p)
        logs = [math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * log_p + (n - i) * log_q for i in range(k + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = k / n, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if at_most(mid) > level else (low, mid)
    return high


Vector = tuple[int, ...]


def _hit(v: Vector, step: Vector) -> bool:
    return any(x > c for x, c in zip(v, step))


def ladder(good: dict[Vector, int], bad: dict[Vector, int]) -> list[Vector]:
    """Ever stricter steps, from the counts of texts by how many of each rule's cutoffs reject them.

    A step has the place of each rule's cutoff in ``RULES`` (0 rejects most, the number of cutoffs stands for none).
    """
    now, steps = tuple(len(c) for _, c in RULES.values()), []
    while True:
        good, bad = ({v: n for v, n in d.items() if not _hit(v, now)} for d in (good, bad))
        best = None
        for r in range(len(now)):
            for c in reversed(range(now[r])):  # from the laxest
                k, gain = (sum(n for v, n in d.items() if v[r] > c) for d in (good, bad))
                if gain > k and (best is None or (gain / (k + 1) ** 2, gain) > best[0]):
                    best = (gain / (k + 1) ** 2, gain), (*now[:r], c, *now[r + 1 :])
        if best is None:
            return steps
        now = best[1]
        steps.append(now)


def choose(counts: dict[tuple[str, bool, int], dict[Vector, int]], alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Per stratum its rules' cutoffs, from the counts by (stratum, whether they build the ladder, label); strata without a safe step are left out."""
    of = lambda *key: counts.get(key, {})
    strata, chosen = {s for s, *_ in counts}, {}
    for stratum in sorted(strata):
        held = of(stratum, False, 1)
        n, last = sum(held.values()), None
        for step in ladder(of(stratum, True, 1), of(stratum, True, 0)):
            if upper_bound(sum(x for v, x in held.items() if _hit(v, step)), n, delta / len(strata)) > alpha:
                break
            last = step
        if last:
            chosen[stratum] = {rule: float(cutoffs[c]) for (rule, (_, cutoffs)), c in zip(RULES.items(), last) if c < len(cutoffs)}
    return chosen


def fit(rows: DataFrame, labels: DataFrame, alpha: float = ALPHA, delta: float = DELTA) -> dict[str, dict[str, float]]:
    """Cutoffs from all labelled rows."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("__lid"), F.col("quality").cast("int").alias("__q"))
    met = rows.where(~base_failed()).join(known, F.col("doc_id") == F.col("__lid"))
    builds = F.pmod(F.xxhash64(F.lit(SEED), "__lid"), F.lit(FOLD)) == 0
    passed = [sum((_rejects(r, c).cast("int") for c in cutoffs), F.lit(0)).alias(f"r{i}") for i, (r, (_, cutoffs)) in enumerate(RULES.items())]
    counts: dict[tuple[str, bool, int], dict[Vector, int]] = {}
    for g in met.groupBy("stratum", builds.alias("builds"), "__q", *passed).agg(F.count(F.lit(1)).alias("n")).collect():
        counts.setdefault((g["stratum"], g["builds"], g["__q"]), {})[tuple(g[f"r{i}"] for i in range(len(RULES)))] = g["n"]
    return choose(counts, alpha, delta)


def judged(rows: DataFrame, cutoffs: dict[str, dict[str, float]]) -> DataFrame:
    """``rows`` with base_failed, the rules that reject, and kept."""
    hits = [F.when((F.col("stratum") == s) & _rejects(r, c), F.lit(r)) for s, rules in cutoffs.items() for r, c in rules.items()]
    found = F.filter(F.array(*hits), lambda x: x.isNotNull()) if hits else F.array().cast("array<string>")
    out = rows.withColumn("base_failed", base_failed()).withColumn("rejected_by", found)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("rejected_by") == 0))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = stored(measured(load(spark, sf_dir, "documents")), "quality")
    return judged(rows, fit(rows, load(spark, sf_dir, "labels"))).select("doc_id", *_COUNTS, "base_failed", "kept", F.array_join("rejected_by", ",").alias("rejected_by"))


QUERIES = {"op9_quality_rules": op9_quality_rules}
ORACLES = {}
