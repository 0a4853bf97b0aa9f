import hashlib
import zlib
from collections import Counter, defaultdict

from papergrid.llm import sharding as S

from .helpers import corpus, docs_df, empty_df


def plain(rows, shards, seed=S.SEED):
    by = defaultdict(list)
    for r in rows:
        raw = (r[1] or "").encode()
        key = hashlib.md5(f"{seed}:{'' if r[0] is None else r[0]}".encode()).hexdigest()
        by[r[3]].append((key, r[0] is not None, r[0] or 0, zlib.crc32(raw), len(raw) + 1))
    whole = []
    for source, mine in by.items():
        for k, x in enumerate(sorted(mine)):
            whole.append(((2 * k + 1) / (2 * len(mine)), "" if source is None else "=" + source, x))
    whole.sort()
    n = len(whole)
    starts = [s * n // shards for s in range(shards)] + [n]
    return Counter(
        (x[2] if x[1] else None, x[4], x[3], s, p - starts[s]) for s in range(shards) for p in range(starts[s], starts[s + 1]) for x in [whole[p][2]]
    )


def test_against_plain(spark):
    for shards in (8, 1, 3, 200):
        got = S.shard_rows(docs_df(spark), shards).select("doc_id", "size", "text_crc32", "shard", "slot").collect()
        assert Counter(map(tuple, got)) == plain(corpus(), shards)


def test_mixture_and_counts(spark):
    rows = [(i, "x", "big" if i % 3 else "small") for i in range(9000)]
    got = S.shard_rows(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    count = Counter(r.shard for r in got)
    assert max(count.values()) - min(count.values()) <= 1 and len(count) == 8
    for source, n in Counter(r[2] for r in rows).items():
        mine = Counter(r.shard for r in got if r.source == source)
        assert all(abs(mine[s] - n / 8) <= 2 for s in range(8))
    for s in range(8):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(count[s]))


def test_write(spark, tmp_path):
    docs = spark.createDataFrame([(i % 40 if i % 7 else None, f"t{i % 30}", f"s{i % 2}", "y", i) for i in range(100)], "doc_id long, text string, source string, slot string, shard int")
    S.write_shards(docs, str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert set(back.columns) == {*docs.columns, "to_shard", "to_slot"}
    assert Counter(r["to_shard"] for r in back.collect()) == Counter(r.shard for r in S.shard_rows(docs).collect())
    assert Counter(map(tuple, back.select(docs.columns).collect())) == Counter(map(tuple, docs.collect()))
    assert len({(r.to_shard, r.to_slot) for r in back.collect()}) == 100


def test_op10_contract(spark, tmp_path):
    docs_df(spark).write.parquet(str(tmp_path / "documents.parquet"))
    got = S.op10_sharding(spark, str(tmp_path))
    assert got.columns == ["doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"] and dict(got.dtypes)["slot"] == "bigint"
    rows = got.collect()
    assert Counter((r.doc_id, r["size"], r.text_crc32, r.shard, r.slot) for r in rows) == plain(corpus(), 8)
    assert {(r.law, r.grown_shard) for r in rows} == {("rows", None)}


def test_empty(spark):
    assert S.shard_rows(empty_df(spark)).count() == 0
