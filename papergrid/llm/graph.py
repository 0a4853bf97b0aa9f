"""Connected components of a table of links, by rounds of large and small stars.

Each round hangs nodes on the smallest neighbour that they know, once above and
once below themselves; the links shrink to one star per component in a number of
rounds that grows with the logarithm of the longest chain. Links are tables
throughout (written to the shared folder each round); the driver sees two sums.
A round groups with partial sums, and joins a table that has one row per node, so
a node with very many links is split like any skewed join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, stored

MAX_ROUNDS = 60


def _star(links: DataFrame, large: bool) -> DataFrame:
    """Of links u > v: every neighbour above (large) or below (small) a node, and the node itself, hung on the smallest."""
    ends = links.select("u", "v")
    if large:
        ends = ends.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = ends.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("n"), F.least("u", "m").alias("m"))
    if large:
        out = ends.where("v > u").join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = ends.join(least, F.col("u") == F.col("n")).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("n").alias("u"), F.col("m").alias("v")))
    return out.where("u != v").distinct()


def components(links: DataFrame, a: str = "u", b: str = "v") -> DataFrame:
    """(node, root): for each node that has a link, the smallest node that it reaches. Nulls and links to oneself link nothing."""
    now = stored(links.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).where(f"{a} is not null and {b} is not null and u != v").distinct(), "cc")
    seen = None
    for _ in range(MAX_ROUNDS):
        nxt = stored(_star(_star(now, True), False), "cc")
        drop_stored(now)
        now = nxt
        told = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if told == seen:
            roots = now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
        seen = told
    raise RuntimeError(f"links did not settle in {MAX_ROUNDS} rounds")
