"""Mixing sources to target weights by hierarchical budgeting.

A token budget flows down a tree (domain, language, source): each node's budget is
shared among its children by weight, no child getting more than its leaves hold in
``max_epochs`` epochs; what a child can't take goes to its siblings, and since a
node never gets more than its own leaves hold, a shortage reaches an ancestor only
when all siblings are full. All of it is integer arithmetic.

Each leaf then takes a prefix of its tokens: whole epochs, and of the next epoch
the rows in the order of ``md5(seed:epoch:id)`` until the budget is reached (the
row that reaches it is taken). To find where the prefix ends, tokens are summed by
the first hex digits of that order, and rows are only sorted within the one bucket
where the budget ends, so no task holds a leaf. What a row contributes is then
told by two values of its leaf.

A row's tokens are its words plus one that ends the document. Null text counts as
empty; a null language or source counts as the empty one. Rows that repeat an id share
a place in the order and are taken together. A leaf without a weight gets 1 (its
weight is relative to its siblings); weights below 1 count as 1. Columns with
clashing names are kept by ``mix_rows``. An empty table gives none.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, load, stored, text_or_empty

SEED = 7
#: Hex digits of the order by which tokens are summed before any row is sorted.
DIGITS = 3
#: Leaves up to which the plan is broadcast; beyond it Spark chooses the join.
BROADCAST_LEAVES = 20_000
#: How ``op2_mix_sources`` and the pipeline part documents: three domains by the source's checksum.
DOMAINS = 3
DOMAIN_WEIGHTS = {"d0": 50, "d1": 30, "d2": 20}
LANG_WEIGHTS = {"en": 60, "de": 15, "fr": 15, "es": 10}


def n_tokens(text_col: str = "text") -> Column:
    return (F.regexp_count(text_or_empty(text_col), F.lit(WORD)) + 1).cast("long")


def tree_of_documents() -> list[Column]:
    domain = F.concat(F.lit("d"), F.pmod(F.crc32(F.coalesce(F.col("source"), F.lit("")).cast("binary")), F.lit(DOMAINS)).cast("string"))
    return [domain, F.coalesce(F.col("lang"), F.lit("")), F.coalesce(F.col("source"), F.lit(""))]


def _weight(weights: dict[str, int], name: str) -> Column:
    cases = reduce(lambda c, kv: c.when(F.col(name) == kv[0], F.lit(max(1, int(kv[1])))), weights.items(), F.when(F.lit(False), F.lit(1)))
    return F.coalesce(cases, F.lit(1)).cast("long")


def _share(children: DataFrame, parents: list[str], own: str) -> DataFrame:
    """Children (cap, w, and their parent's budget b) with what each gets: full where its share would pass its cap, the rest by weight."""
    by = Window.partitionBy(*parents) if parents else Window.partitionBy(F.lit(0))
    order = by.orderBy(F.col("cap").cast("double") / F.col("w"), own).rowsBetween(Window.unboundedPreceding, -1)
    big = lambda c: c.cast("decimal(38,0)")
    df = children.withColumn("before", F.coalesce(F.sum("cap").over(order), F.lit(0))).withColumn("w_left", F.sum("w").over(by) - F.coalesce(F.sum("w").over(order), F.lit(0)))
    df = df.withColumn("full", big(F.col("cap")) * big(F.col("w_left")) <= big(F.col("w")) * big(F.col("b") - F.col("before")))
    upto = by.orderBy(F.col("cap").cast("double") / F.col("w"), own).rowsBetween(Window.unboundedPreceding, 0)
    df = df.withColumn("full", F.min("full").over(upto))
    df = df.withColumn("b_left", F.col("b") - F.sum(F.when(F.col("full"), F.col("cap")).otherwise(0)).over(by)).withColumn("w_rest", F.sum(F.when(F.col("full"), F.lit(0)).otherwise(F.col("w"))).over(by))
    part = F.call_function("div", big(F.col("b_left")) * big(F.col("w")), big(F.greatest("w_rest", F.lit(1))))
    return df.withColumn("got", F.when(F.col("full"), F.col("cap")).otherwise(F.least(part, F.col("cap"))).cast("long")).drop("before", "w_left", "full", "b_left", "w_rest")


def budgets(leaves: DataFrame, names: list[str], weights: list[dict[str, int]], percent: int, max_epochs: int) -> DataFrame:
    """Of leaves (names, tokens): each leaf's budget. The whole budget is ``percent`` of all tokens."""
    level, out = leaves.withColumn("cap", F.col("tokens") * max_epochs), None
    for i, name in enumerate(names):
        parents, own = names[:i], names[: i + 1]
        nodes = level.groupBy(*own).agg(F.sum("cap").alias("cap")).withColumn("w", _weight(weights[i], name))
        if out is None:
            whole = leaves.agg(F.least(F.call_function("div", F.sum("tokens") * percent, F.lit(100)), F.sum("tokens") * max_epochs).alias("b"))
            nodes = nodes.join(F.broadcast(whole))  # one row
        else:
            nodes = nodes.join(out.select(*parents, F.col("got").alias("b")), parents)
        out = _share(nodes, parents, name).select(*own, "got")
    return leaves.join(out, names).select(*names, "tokens", F.col("got").alias("budget"))


def _key(epoch: Column, seed: int, id_col: str) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), epoch.cast("string"), F.lit(":"), F.coalesce(F.col(id_col).cast("string"), F.lit(""))).cast("binary"))


def _joined(rows: DataFrame, plan: DataFrame, names: list[str], small: bool) -> DataFrame:
    return rows.join(F.broadcast(plan) if small else plan, names)


def plan_of(docs: DataFrame, tree: list[Column], weights: list[dict[str, int]], percent: int, max_epochs: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, bool]:
    """Each leaf's whole epochs and the last place of its prefix (null: none of the next epoch); and whether there are few leaves."""
    names = [f"__t{i}" for i in range(len(tree))]
    slim = stored(docs.select(F.col(id_col).alias("__id"), *[c.alias(n) for c, n in zip(tree, names)], n_tokens(text_col).alias("__tok")), "mix-slim")
    leaves = slim.groupBy(*names).agg(F.sum("__tok").alias("tokens"))
    plan = stored(budgets(leaves, names, weights, percent, max_epochs).withColumn("whole", F.call_function("div", F.col("budget"), F.col("tokens"))).withColumn("rest", F.col("budget") % F.col("tokens")), "mix-plan")
    small = plan.count() <= BROADCAST_LEAVES
    at = _joined(slim, plan.where("rest > 0").select(*names, "whole", "rest"), names, small).withColumn("__key", _key(F.col("whole"), seed, "__id")).withColumn("__bucket", F.substring("__key", 1, DIGITS))
    buckets = at.groupBy(*names, "__bucket").agg(F.sum("__tok").alias("tok"), F.first("rest").alias("rest"))
    before = Window.partitionBy(*names).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    last = buckets.withColumn("before", F.coalesce(F.sum("tok").over(before), F.lit(0))).where("before < rest and before + tok >= rest").select(*names, "__bucket", "before")
    inside = at.join(F.broadcast(last) if small else last, [*names, "__bucket"])
    keys = inside.groupBy(*names, "__key").agg(F.sum("__tok").alias("tok"), F.first("rest").alias("rest"), F.first("before").alias("before"))
    run = Window.partitionBy(*names).orderBy("__key").rowsBetween(Window.unboundedPreceding, -1)
    ends = keys.withColumn("so_far", F.col("before") + F.coalesce(F.sum("tok").over(run), F.lit(0))).where("so_far < rest").groupBy(*names).agg(F.max("__key").alias("last_key"))
    return stored(plan.join(ends, names, "left"), "mix-ends"), small


def mix_rows(docs: DataFrame, tree: list[Column], weights: list[dict[str, int]], percent: int, max_epochs: int, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs``, each row once for every epoch that takes it, with ``__epoch`` (from 0) and the tree's parts ``__t0`` ... ."""
    names = [f"__t{i}" for i in range(len(tree))]
    plan, small = plan_of(docs, tree, weights, percent, max_epochs, seed, id_col, text_col)
    base = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row"), *[c.alias(n) for c, n in zip(tree, names)], F.col(id_col).alias("__id"))
    rows = _joined(base, plan.select(*names, "whole", "last_key"), names, small)
    part = F.coalesce(_key(F.col("whole"), seed, "__id") <= F.col("last_key"), F.lit(False)).cast("long")
    rows = rows.withColumn("__times", (F.col("whole") + part).cast("int")).where("__times > 0")
    return rows.select("__row.*", *names, F.explode(F.sequence(F.lit(0), F.col("__times") - 1)).alias("__epoch"))


MIX = {"weights": [DOMAIN_WEIGHTS, LANG_WEIGHTS, {}], "percent": 100, "max_epochs": 2}


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    rows = mix_rows(docs, tree_of_documents(), **MIX)
    return rows.select("doc_id", F.col("__epoch").alias("epoch"), F.col("__t0").alias("domain"), F.col("__t1").alias("lang"), F.col("__t2").alias("source"), n_tokens().alias("n_tokens"))


QUERIES = {"op2_mix_sources": op2_mix_sources}
ORACLES = {}
