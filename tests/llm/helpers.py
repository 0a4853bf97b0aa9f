"""A small corpus with the awkward cases: nulls everywhere, empty and long texts, ties, repeated rows, clashing extra columns."""

import random

DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, ids string, score string, n string, shard string, epoch string, raw string"


def words(rng, n):
    return " ".join("".join(rng.choice("abcdeéßn") for _ in range(rng.randint(2, 8))) for _ in range(n))


def corpus(seed=5):
    rng = random.Random(seed)
    base = [words(rng, rng.randint(60, 160)) for _ in range(12)]
    texts = list(base)
    for t in base[:4]:
        w = t.split(" ")
        w[len(w) // 2] = "changed"
        texts += [t, " ".join(w)]
    passage = words(rng, 90)
    texts += [words(rng, 30) + "\n" + passage + "\n" + words(rng, 20) for _ in range(4)]
    texts += ["", None, "one", "one two", " \t\n", "a " * 300, words(rng, 6000), "x" * 3000, "Größe\n\nGröße\n# a | b\n", "Trash " + base[0]]
    rows = [(i * 7 % 101, t, rng.choice(["en", "de", None, "xx"]), rng.choice(["src0", "src1", None, "src0"])) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, base[1], "en", "src0"), (None, base[1], "en", "src0"), (None, None, None, None), (rows[3][0], "another text with the same id", "fr", "src1")]
    return [(*r, len(r[1] or ""), "k", "i", "s", "n", "h", "e", "r") for r in rows]


def docs_df(spark, rows=None):
    return spark.createDataFrame(corpus() if rows is None else rows, DOCS)


def empty_df(spark):
    return spark.createDataFrame([], DOCS)


def multiset(rows):
    from collections import Counter

    return Counter(map(tuple, rows))
