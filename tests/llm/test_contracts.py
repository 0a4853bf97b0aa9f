"""The registered queries on small tables: their columns, types and rows. op1, op3, op8, op9 and op10 are in their own files."""

import hashlib
import re
import struct
from collections import Counter

import public_tokenizers
import tiktoken

from papergrid.llm import bpe, chat, common, exact_dedup, mixing, registry, simhash, suffix_dedup

from .helpers import corpus, docs_df
from .test_chat import TURNS
from .test_chat import want as wanted_chats
from .test_mixing import plain as plain_mix
from .test_mixing import tree_of
from .test_simhash import plain as plain_print
from .test_simhash import reach
from .test_suffix_dedup import plain as plain_suffix


def written(spark, tmp_path):
    docs_df(spark).write.parquet(str(tmp_path / "documents.parquet"))
    return str(tmp_path)


def test_ten_queries():
    assert sorted(int(re.match(r"op(\d+)_", q)[1]) for q in registry.queries()) == list(range(1, 11))


def test_op2(spark, tmp_path):
    got = mixing.op2_mix_sources(spark, written(spark, tmp_path))
    rows = [((i, r[1]), r[0], tree_of(r), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) + 1) for i, r in enumerate(corpus())]
    want = Counter((corpus()[i][0], e, *tree_of(corpus()[i])) for (i, _), e in plain_mix(rows, **{"weights": mixing.MIX["weights"], "percent": 100, "epochs": 2}))
    assert Counter((r.doc_id, r.epoch, r.domain, r.lang, r.source) for r in got.collect()) == want


def test_op4(spark, tmp_path):
    spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").write.parquet(str(tmp_path / "conversations.parquet"))
    got = chat.op4_chat_format(spark, str(tmp_path))
    assert got.dtypes == [("conv_id", "bigint"), ("n_turns", "bigint"), ("turns_sha256", "string"), ("loss_chars", "bigint"), ("loss_sha256", "string"), ("formatted_chars", "bigint")]
    rows = Counter(map(tuple, got.collect()))
    own = Counter((None if isinstance(c, tuple) else c, *w) for c, w in wanted_chats().items())
    assert not own - rows and [(r[0], r[1]) for r in rows - own] == [(-7, 2)]


def test_op5(spark, tmp_path):
    got = simhash.op5_simhash(spark, written(spark, tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("fingerprint", "string"), ("component_id", "bigint")]
    prints = [plain_print(r[1]) for r in corpus()]
    root, least = reach(set(prints), lambda a, b: (a ^ b).bit_count() <= 4), {}
    for r, f in zip(corpus(), prints):
        if r[0] is not None:
            least[root[f]] = min(r[0], least.get(root[f], r[0]))
    assert Counter(map(tuple, got.collect())) == Counter((r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(corpus(), prints))


def test_op6(spark, tmp_path):
    got = exact_dedup.op6_exact_dedup(spark, written(spark, tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("keep_id", "bigint"), ("group_size", "bigint"), ("kept", "boolean"), ("text_sha256", "string")]
    size, keep = Counter(r[1] or "" for r in corpus()), {}
    for r in corpus():
        if r[0] is not None:
            keep[r[1] or ""] = max(r[0], keep.get(r[1] or "", r[0]))
    want = Counter((r[0], keep.get(r[1] or ""), size[r[1] or ""], hashlib.sha256((r[1] or "").encode()).hexdigest()) for r in corpus())
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got.collect()) == want


def test_op7(spark, tmp_path):
    got = bpe.op7_byte_bpe(spark, written(spark, tmp_path))
    assert got.dtypes == [("doc_id", "bigint"), ("n_tokens", "bigint"), ("ids_sha256", "string"), ("decoded_sha256", "string")]
    ranks = {t: i for i, t in enumerate(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")))}
    known = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = Counter()
    for r in corpus():
        ids = known.encode_ordinary(r[1] or "")
        want[(r[0], len(ids), hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest(), hashlib.sha256((r[1] or "").encode()).hexdigest())] += 1
    assert Counter(map(tuple, got.collect())) == want


def test_full_bitmaps_change_no_result(spark, monkeypatch):
    """With so few bits that nearly all are set, every row goes to the exact step."""
    monkeypatch.setattr(common, "_ROW", 8)
    monkeypatch.setattr(common, "LEAST_BITS", 3)
    monkeypatch.setattr(common, "MOST_BITS", 3)
    kept = exact_dedup.drop_copies(docs_df(spark)).collect()
    assert sorted(r.text or "" for r in kept) == sorted({r[1] or "" for r in corpus()})
    got = suffix_dedup.remove_repeats(docs_df(spark), keep_first=False).collect()
    assert sorted(((r.doc_id, bytes(r.kept)) for r in got), key=str) == plain_suffix([r[:2] for r in corpus()], suffix_dedup.WINDOW, False)
