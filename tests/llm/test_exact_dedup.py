import hashlib
from collections import defaultdict

from papergrid.llm import exact_dedup as E

from .helpers import corpus, docs_df, empty_df


def test_groups(spark):
    rows = corpus()
    groups = defaultdict(list)
    for r in rows:
        groups[r[1] or ""].append(r[0])
    got = E.find_groups(docs_df(spark), hash_all=True).collect()
    assert len(got) == len(rows)
    seen = defaultdict(list)
    for r in got:
        seen[bytes(r.sha).hex()].append(r)
    for text, ids in groups.items():
        met = seen.pop(hashlib.sha256(text.encode()).hexdigest())
        keep = max((i for i in ids if i is not None), default=None)
        assert {(r.keep_id, r.group_size) for r in met} == {(keep, len(ids))}
        assert [r.doc_id for r in met if r.kept] == [keep]
    assert not seen


def test_full_hash_only_for_survivors(spark):
    got = {r.doc_id: r.sha for r in E.find_groups(spark.createDataFrame([(1, "a"), (2, "b" * 500), (3, "b" * 500), (4, "b" * 499)], "doc_id long, text string")).collect()}
    assert got[4] is None and got[2] == got[3] is not None


def test_drop_keeps_columns(spark):
    kept = E.drop_copies(docs_df(spark))
    assert kept.columns == docs_df(spark).columns
    texts = [r.text or "" for r in kept.collect()]
    assert len(texts) == len(set(texts)) and set(texts) == {r[1] or "" for r in corpus()}


def test_hidden_names(spark):
    df = spark.createDataFrame([(1, "a", "t", "n"), (2, "a", "t2", "n2")], "doc_id long, text string, __text string, __n string")
    assert [tuple(r) for r in E.drop_copies(df).collect()] == [(2, "a", "t2", "n2")]


def test_empty(spark):
    assert E.find_groups(empty_df(spark)).count() == 0 == E.drop_copies(empty_df(spark)).count()
