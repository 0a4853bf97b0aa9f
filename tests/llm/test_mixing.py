import hashlib
import re
from collections import defaultdict

from papergrid.llm import mixing as M

from .helpers import corpus, docs_df, empty_df


def fill(children, b):
    """children: name -> (cap, w); what each gets."""
    got, left = {}, sorted(children, key=lambda n: (children[n][0] / children[n][1], n))
    w = sum(x[1] for x in children.values())
    while left and children[left[0]][0] * w <= children[left[0]][1] * b:
        n = left.pop(0)
        got[n] = children[n][0]
        b, w = b - got[n], w - children[n][1]
    for n in left:
        got[n] = min(children[n][0], b * children[n][1] // w)
    return got


def plain(rows, weights, percent, epochs, seed=M.SEED):
    """rows: (row, id, tree, tokens)"""
    leaves = defaultdict(int)
    for _, _, tree, tok in rows:
        leaves[tree] += tok
    budget = {(): min(sum(leaves.values()) * percent // 100, sum(leaves.values()) * epochs)}
    for depth in range(3):
        for parent in {t[:depth] for t in leaves}:
            kids = defaultdict(int)
            for t, tok in leaves.items():
                if t[:depth] == parent:
                    kids[t[depth]] += tok * epochs
            for n, got in fill({n: (cap, max(1, weights[depth].get(n, 1))) for n, cap in kids.items()}, budget[parent]).items():
                budget[(*parent, n)] = got
    out = []
    for tree, total in leaves.items():
        whole, rest = divmod(budget[tree], total)
        key = lambda r: hashlib.md5(f"{seed}:{whole}:{'' if r[1] is None else r[1]}".encode()).hexdigest()
        mine = sorted((r for r in rows if r[2] == tree), key=key)
        so_far, last = 0, None
        for r in mine:
            if so_far < rest:
                last = key(r)
            so_far += r[3]
        for r in mine:
            out += [(r[0], e) for e in range(whole + (last is not None and key(r) <= last))]
    return sorted(out, key=str)


def tree_of(r):
    import zlib

    return f"d{zlib.crc32((r[3] or '').encode()) % M.DOMAINS}", r[2] or "", r[3] or ""


def test_against_plain(spark):
    rows = corpus()
    plain_rows = [((r[0], r[1], r[2], r[3]), r[0], tree_of(r), len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) + 1) for r in rows]
    for percent, epochs in ((100, 2), (80, 1), (30, 1), (300, 2), (1000, 3), (0, 1)):
        got = M.mix_rows(docs_df(spark), M.tree_of_documents(), [M.DOMAIN_WEIGHTS, M.LANG_WEIGHTS, {}], percent, epochs).collect()
        assert sorted((((r.doc_id, r.text, r.lang, r.source), r["__epoch"]) for r in got), key=str) == plain(plain_rows, [M.DOMAIN_WEIGHTS, M.LANG_WEIGHTS, {}], percent, epochs)


def test_siblings_take_a_shortage_first(spark):
    leaves = spark.createDataFrame([("a", "x", 10), ("a", "y", 1000), ("b", "z", 1000)], "d string, l string, tokens long")
    got = {(r.d, r.l): r.budget for r in M.budgets(leaves, ["d", "l"], [{"a": 1, "b": 1}, {"x": 1, "y": 1}], 50, 1).collect()}
    assert got == {("a", "x"): 10, ("a", "y"): 492, ("b", "z"): 502}


def test_columns_and_empty(spark):
    args = (M.tree_of_documents(), [M.DOMAIN_WEIGHTS, M.LANG_WEIGHTS, {}], 100, 1)
    assert M.mix_rows(docs_df(spark), *args).select(docs_df(spark).columns).count() > 0
    assert M.mix_rows(empty_df(spark), *args).count() == 0
