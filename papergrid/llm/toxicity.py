"""Toxicity by a factorization machine over hashed terms.

A text's terms are its lower-cased words and their first 4 and 5 letters, each
hashed to one of ``2**BITS`` slots and counted once. Besides a weight per slot, the
machine has a vector per slot, and the product of two vectors is the weight of the
pair: an insult next to a group's name can score what neither scores alone.

Training takes a bounded sample of the labelled rows (documented parameters
``SAMPLE_TOXIC`` and ``SAMPLE_CLEAN``: those of the smallest seeded hash of each
class), chosen from the label table before any text is read; their terms, not
their texts, go to the driver. Of the slots that ``MIN_DOCS`` sampled texts have, the
machine takes those whose toxic and clean shares are farther apart than chance makes
the farthest of so many (``sqrt(2 ln m)`` standard errors of m slots): in the whole
sample, or among the texts that have a slot which stands out as toxic, where terms
tell that say nothing alone. Their number follows the sample, there is no cap. How
strongly weights are held back and how long they are fitted is chosen on a fold of the
sampled rows (every ``FOLD``-th by a hash) by a machine that hasn't seen it; then all of them are fitted so. Scoring is one
pass over the documents with a model of bounded size. Label, language, source and id are never inputs of a score.

Null texts count as empty; an empty text has no terms and gets the score of the
machine's constant. Rows that repeat score alike. Labels that are null are left
aside; a document with contradicting labels is trained on with each. Without
labels of both classes every score is the share of toxic labels (0 without any).
Columns with clashing names are kept by ``drop_toxic``. An empty table gives none.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..ship import map_arrow
from .common import as_binary, load, packed, stored, unpacked

BITS, FACTORS, SEED = 31, 6, 3
SAMPLE_TOXIC, SAMPLE_CLEAN, MIN_DOCS = 4000, 8000, 4
#: The longest fit and how often it is judged, the rate, and the strengths that hold weights back.
ROUNDS, STEP, RATE, HOLDS = 240, 10, 0.1, (1e-4, 1e-3, 1e-2)
#: One row of so many is in the fold that chooses.
FOLD = 4
#: A missed toxic text counts as so many rejected clean ones.
TOXIC_WEIGHT = 4
#: Words that a worker remembers; bounds its memory.
CACHE_WORDS = 400_000
THRESHOLD = 0.7
_STRIP = ".,;:!?\"'()[]{}<>*#$%&|-_/\\"


def terms_of(word: str) -> set[int]:
    """The slots of a word and of its beginnings."""
    word = word.strip(_STRIP)
    parts = [word] * bool(word) + [word[:n] + "*" for n in (4, 5) if len(word) > n]
    return {zlib.crc32(p.encode()) & (1 << BITS) - 1 for p in parts}


def terms(text: str) -> np.ndarray:
    """The sorted slots of a text's terms."""
    return np.array(sorted(set().union(*map(terms_of, set(text.lower().split())))), np.int64)


class Machine:
    """Constant, and weights and vectors of the sorted slots; others count as zero."""

    def __init__(self, w0: float, slots: np.ndarray, w: np.ndarray, v: np.ndarray) -> None:
        self.w0, self.slots, self.w, self.v = w0, slots, w, v
        self.at = {s: i for i, s in enumerate(slots.tolist())}
        self.seen: dict[str, tuple[int, ...]] = {}

    def __reduce__(self):
        return Machine, (self.w0, self.slots, self.w, self.v)

    def score(self, text: str) -> float:
        found: set[int] = set()
        get, at = self.seen.get, self.at
        for word in set(text.lower().split()):
            known = get(word)
            if known is None:
                known = tuple(at[s] for s in terms_of(word) if s in at)
                if len(self.seen) >= CACHE_WORDS:
                    self.seen.clear()
                if len(word) < 64:
                    self.seen[word] = known
            if known:
                found.update(known)
        rows = np.array(sorted(found), np.int64)
        v = self.v[rows]
        z = self.w0 + self.w[rows].sum() + scale(len(rows)) * 0.5 * ((v.sum(axis=0) ** 2).sum() - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def scale(n):
    """Pairs weigh as in a text of 100 terms at most, whatever the length."""
    return 100 / np.maximum(n, 100)


def standing_out(toxic, all_, n_toxic: int, n: int):
    """How far the shares of toxic and clean texts that have a slot are apart, in standard errors; below zero if the clean share is larger."""
    p1, p0, p = toxic / n_toxic, (all_ - toxic) / (n - n_toxic), all_ / n
    return (p1 - p0) / (p * (1 - p) + 1e-9) ** 0.5 * (n_toxic * (n - n_toxic) / n) ** 0.5


def far_enough(slots: int) -> float:
    """What the farthest of so many slots that tell nothing reaches by chance."""
    return float(np.sqrt(2 * np.log(max(slots, 2))))


def choose_slots(rows: list[np.ndarray], labels: np.ndarray) -> np.ndarray:
    """The sorted slots that a machine for these rows has."""

    def chosen(rows: list[np.ndarray], labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        slots, cols = np.unique(np.concatenate([np.array([], np.int64), *rows]), return_inverse=True)
        if not 0 < labels.sum() < len(labels):
            return slots[:0], slots[:0]
        docs = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        all_, toxic = np.bincount(cols, minlength=len(slots)), np.bincount(cols, weights=labels[docs], minlength=len(slots))
        many = all_ >= MIN_DOCS
        far, least = standing_out(toxic, all_, labels.sum(), len(labels)), far_enough(many.sum())
        return slots[many & (abs(far) >= least)], slots[many & (far >= least)]

    first, signs = chosen(rows, labels)
    some = [i for i, r in enumerate(rows) if np.isin(r, signs).any()]
    return np.union1d(first, chosen([rows[i] for i in some], labels[some])[0])


def constant_machine(share: float) -> Machine:
    return Machine(float(np.log(share / (1 - share))) if 0 < share < 1 else (40.0 if share else -40.0), np.array([], np.int64), np.zeros(0), np.zeros((0, FACTORS)))


def _descend(kept: list[np.ndarray], labels: np.ndarray, n_slots: int, hold: float, rounds: int, seed: int, judge=None) -> list[np.ndarray]:
    """Full-batch Adam on the logistic loss. ``judge`` sees the parameters every ``STEP`` rounds."""
    share = float(labels.mean())
    sizes = np.array([len(k) for k in kept])
    cols, docs = np.concatenate(kept).astype(np.int32), np.repeat(np.arange(len(kept), dtype=np.int32), sizes)
    order = np.argsort(cols, kind="stable")
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1]))
    of_col = np.bincount(cols, minlength=n_slots)
    by_col, seen = np.concatenate(([0], np.cumsum(of_col)[:-1])), of_col > 0
    docs_by_col, full = docs[order], sizes > 0
    x, weights, labels = scale(sizes).astype(np.float32), np.where(labels == 1, TOXIC_WEIGHT, 1).astype(np.float32), labels.astype(np.float32)

    def of_docs(values: np.ndarray) -> np.ndarray:
        out = np.zeros((len(kept), *values.shape[1:]), values.dtype)
        if len(values):
            out[full] = np.add.reduceat(values, starts[full], axis=0)
        return out

    def of_cols(values: np.ndarray) -> np.ndarray:
        out = np.zeros((n_slots, *values.shape[1:]), values.dtype)
        if len(docs_by_col):
            out[seen] = np.add.reduceat(values[docs_by_col], by_col[seen], axis=0)
        return out

    rng = np.random.default_rng(seed)
    p = [np.array([np.log(share / (1 - share))], np.float32), np.zeros(n_slots, np.float32), rng.normal(0, 0.02, (n_slots, FACTORS)).astype(np.float32)]
    m, s = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    for t in range(1, rounds + 1):
        w0, w, v = p
        vs = v[cols]
        total = of_docs(vs)
        z = w0 + of_docs(w[cols]) + x * 0.5 * ((total**2).sum(axis=1) - of_docs((vs * vs).sum(axis=1)))
        g = weights * (1 / (1 + np.exp(-np.clip(z, -40, 40))) - labels) / len(labels)
        gx = g * x
        gw = of_cols(g)
        gv = of_cols(gx[:, None] * total) - v * of_cols(gx)[:, None]
        for i, grad in enumerate((np.array([g.sum()]), gw + hold * w / 10, gv + hold * v)):
            m[i] = 0.9 * m[i] + 0.1 * grad
            s[i] = 0.999 * s[i] + 0.001 * grad**2
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**t)) / (np.sqrt(s[i] / (1 - 0.999**t)) + 1e-8)
        if judge and t % STEP == 0:
            judge(t, p)
    return p


def _loss(p: list[np.ndarray], kept: list[np.ndarray], labels: np.ndarray) -> float:
    w0, w, v = p
    z = np.array([float(w0[0] + w[k].sum() + scale(len(k)) * 0.5 * ((v[k].sum(axis=0) ** 2).sum() - (v[k] ** 2).sum())) for k in kept])
    return float((np.where(labels == 1, TOXIC_WEIGHT, 1) * np.logaddexp(0, np.where(labels == 1, -z, z))).mean())


def settings(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, slots: np.ndarray, seed: int = SEED) -> tuple[float, int]:
    """How strongly to hold back and how long to fit: what a machine of these slots, fitted without the fold, loses least on the fold with."""
    if len(set(labels[fold])) < 2 or len(set(labels[~fold])) < 2 or not len(slots):
        return HOLDS[1], ROUNDS // 2
    kept = [_places(r, slots) for r in rows]
    own, other = [k for k, f in zip(kept, fold) if not f], [k for k, f in zip(kept, fold) if f]
    seen: list[tuple[float, int, int]] = []
    for i, hold in enumerate(HOLDS):
        _descend(own, labels[~fold], len(slots), hold, ROUNDS, seed, lambda t, p, i=i: seen.append((_loss(p, other, labels[fold]), t, i)))
    _, rounds, i = min(seen)
    return HOLDS[i], rounds


def _places(row: np.ndarray, slots: np.ndarray) -> np.ndarray:
    at = np.minimum(np.searchsorted(slots, row), len(slots) - 1)
    return at[slots[at] == row]


def train(rows: list[np.ndarray], labels: np.ndarray, fold: np.ndarray, slots: np.ndarray | None = None, own_slots: np.ndarray | None = None, seed: int = SEED) -> Machine:
    """A machine over the given slots (default: chosen from the rows; ``own_slots`` from those outside the fold); other slots are left aside."""
    share = float(labels.mean()) if len(labels) else 0.0
    if not 0 < share < 1:
        return constant_machine(share)
    if slots is None:
        slots, own_slots = choose_slots(rows, labels), choose_slots([r for r, f in zip(rows, fold) if not f], labels[~fold])
    if not len(slots):
        return constant_machine(share)
    p = _descend([_places(r, slots) for r in rows], labels, len(slots), *settings(rows, labels, fold, own_slots, seed), seed)
    return Machine(float(p[0][0]), slots, p[1].astype(float), p[2].astype(float))


def held_out(id_col: str = "doc_id"):
    """True for the third of the ids whose labels are never learnt from."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 3 == 1


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> Machine:
    """The sampled texts' terms are stored once; slots are counted and chosen by Spark, and the driver sees of each text only the chosen ones."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).select(F.col("doc_id").alias("__lid"), F.col("toxic").cast("int").alias("toxic")).distinct()
    order = [F.xxhash64(F.lit(SEED), F.col("__lid")), F.col("__lid")]
    some = known.where("toxic = 1").orderBy(*order).limit(SAMPLE_TOXIC).unionByName(known.where("toxic = 0").orderBy(*order).limit(SAMPLE_CLEAN))
    rows = docs.select(F.col(id_col).alias("__did"), as_binary(text_col).alias("raw")).join(F.broadcast(some), F.col("__did") == F.col("__lid")).select("__did", "toxic", "raw")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                part = batch.slice(at, 64)
                found = [terms(x.decode()).tolist() for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(found, pa.list_(pa.int32()))], names=["id", "toxic", "slots"])

    schema = T.StructType([T.StructField("id", rows.schema["__did"].dataType), T.StructField("toxic", T.IntegerType()), T.StructField("slots", T.ArrayType(T.IntegerType()))])
    in_fold = F.pmod(F.xxhash64(F.lit(SEED + 1), "id"), F.lit(FOLD)) == 0
    sample = stored(map_arrow(rows, run, schema).withColumn("fold", in_fold), "toxic-sample")
    slots, own = sampled_slots(sample), sampled_slots(sample.where("not fold"))
    model = sample.sparkSession.sparkContext.broadcast(np.union1d(slots, own))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _flat(batch.column(2))
            kept = np.isin(values, model.value)
            left = [np.unique(values[a:b][kept[a:b]]).tobytes() for a, b in zip(offsets, offsets[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(left, pa.binary()), batch.column(3)], names=["id", "toxic", "slots", "fold"])

    short = T.StructType([schema["id"], schema["toxic"], T.StructField("slots", T.BinaryType()), T.StructField("fold", T.BooleanType())])
    got = sorted((r["id"], r["toxic"], bytes(r["slots"]), r["fold"]) for r in map_arrow(sample, cut, short).collect())
    labels_of, fold = np.array([t for _, t, _, _ in got], float), np.array([f for *_, f in got], bool)
    return train([np.frombuffer(s, np.int32).astype(np.int64) for _, _, s, _ in got], labels_of, fold, slots, own)


def _flat(lists: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows' lists, and where each begins and ends."""
    return lists.values.to_numpy(zero_copy_only=False).astype(np.int32), lists.offsets.to_numpy()


def sampled_slots(sample: DataFrame) -> np.ndarray:
    """``choose_slots`` of the sample's rows, counted by Spark; the driver gets the chosen ones."""

    def chosen(rows: DataFrame) -> tuple[np.ndarray, np.ndarray]:
        n, n_toxic = rows.agg(F.count(F.lit(1)), F.coalesce(F.sum("toxic"), F.lit(0))).first()
        if not 0 < n_toxic < n:
            return np.array([], np.int64), np.array([], np.int64)
        counts = rows.select("toxic", F.explode("slots").alias("slot")).groupBy("slot").agg(F.sum("toxic").cast("double").alias("t"), F.count(F.lit(1)).cast("double").alias("a")).where(F.col("a") >= MIN_DOCS)
        counts = stored(counts, "toxic-counts")
        p1, p0, p = F.col("t") / n_toxic, (F.col("a") - F.col("t")) / (n - n_toxic), F.col("a") / n
        far = (p1 - p0) / F.sqrt(p * (1 - p) + 1e-9) * (n_toxic * (n - n_toxic) / n) ** 0.5
        got = counts.select("slot", far.alias("far")).where(F.abs("far") >= far_enough(counts.count())).collect()
        return np.array(sorted(r["slot"] for r in got), np.int64), np.array(sorted(r["slot"] for r in got if r["far"] > 0), np.int64)

    first, signs = chosen(sample)
    if not len(signs):
        return first
    model = sample.sparkSession.sparkContext.broadcast(signs)

    def signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values, offsets = _flat(batch.column(1))
            hits = np.concatenate(([0], np.cumsum(np.isin(values, model.value))))
            yield batch.filter(pa.array(hits[offsets[1:]] > hits[offsets[:-1]], pa.bool_()))

    return np.union1d(first, chosen(map_arrow(sample.select("toxic", "slots"), signed, "toxic int, slots array<int>"))[0])


def scored(docs: DataFrame, machine: Machine, keep: list[str], text_col: str = "text", score_col: str = "score") -> DataFrame:
    """The columns ``keep`` and the score."""
    model = docs.sparkSession.sparkContext.broadcast(machine)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = model.value.score
        for batch in batches:
            got = [score(x.decode()) for x in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(got, pa.float64())], names=[*batch.schema.names[:-1], score_col])

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(score_col, T.DoubleType())])
    return map_arrow(docs.select(*keep, as_binary(text_col).alias("__raw")), run, schema)


def drop_toxic(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` without the rows whose score reaches the threshold."""
    machine = fit(docs, labels, id_col, text_col)
    return unpacked(scored(packed(docs), machine, ["__row"], f"__row.{text_col}", "__score").where(F.col("__score") < threshold))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = load(spark, sf_dir, "documents"), load(spark, sf_dir, "labels")
    out = scored(docs, fit(docs, labels), ["doc_id"])
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
ORACLES = {}
