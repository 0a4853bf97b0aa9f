import re
import struct
from collections import Counter

import public_tokenizers
import tiktoken

import corpus_pipeline as P
from papergrid.llm import bpe, mixing, toxicity

from .helpers import DOCS, corpus
from .test_mixing import plain as plain_mix
from .test_mixing import tree_of
from .test_near_dedup import plain as plain_shingles
from .test_near_dedup import similar
from .test_simhash import reach
from .test_toxicity import made

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def written(spark, tmp_path):
    rows = [r[:5] for r in corpus()] + [(1000 + i, t, "en", "src1", len(t)) for i, t, _ in made(120)]
    spark.createDataFrame(rows, ", ".join(DOCS.split(", ")[:5])).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + i, 1, y) for i, _, y in made(120)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    return rows


def test_against_plain(spark, tmp_path):
    rows = written(spark, tmp_path)
    docs, labels = spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet"))
    machine = toxicity.fit(docs, labels)
    rows = [r for r in rows if machine.score(r[1] or "") < toxicity.THRESHOLD]
    best = {}
    for r in rows:
        old = best.get(r[1] or "")
        if old is None or (r[0] is not None, r[0] or 0) > (old[0] is not None, old[0] or 0):
            best[r[1] or ""] = r
    rows = list(best.values())
    sets = [plain_shingles(r[1]) for r in rows]
    root = reach(range(len(rows)), lambda a, b: similar(sets[a], sets[b]))
    groups = {}
    for i, r in enumerate(rows):
        groups.setdefault(root[i], []).append(r)
    rows = [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]
    by_text = {(r[0], r[1]): r for r in rows}
    mixed = plain_mix([((r[0], r[1]), r[0], tree_of(r), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) + 1) for r in rows], P.MIX["weights"], P.MIX["percent"], P.MIX["max_epochs"])
    tokens = bpe.read_ranks(bpe.default_vocabulary())
    encoder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    want = Counter()
    for key, _ in mixed:
        r = by_text[key]
        ids = encoder.encode_ordinary(r[1] or "")
        want[(r[0], r[2], r[3], r[4], struct.pack(f"<{len(ids)}I", *ids), len(ids))] += 1
    got = Counter((r.doc_id, r.lang, r.source, r.n_chars, bytes(r.ids), r.n_tokens) for r in P.run(spark, str(tmp_path)).collect())
    assert got == want


def test_stages_keep_columns(spark, tmp_path):
    written(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in P.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == COLUMNS, name
    assert len(P.STAGES) == 5 and P.ORACLE_SQL is None
    assert set(P.STAGES[-1][1](spark, docs, str(tmp_path)).columns) == {*COLUMNS, "ids", "n_tokens"} - {"text"}


def test_empty_documents(spark, tmp_path):
    written(spark, tmp_path)
    docs = spark.read.parquet(str(tmp_path / "documents.parquet")).limit(0)
    for _, stage in P.STAGES:
        docs = stage(spark, docs, str(tmp_path))
    assert docs.count() == 0


def test_domains():
    assert set(mixing.DOMAIN_WEIGHTS) == {f"d{i}" for i in range(mixing.DOMAINS)}
