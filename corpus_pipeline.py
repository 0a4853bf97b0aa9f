"""A training corpus from raw documents: toxicity, exact copies, near copies, mixture, tokens.

Each stage is a function of (spark, docs, sf_dir) and gives what it keeps; all but
the last keep the columns of ``documents``. Every stage works on all rows that the
one before kept. ``run`` writes each stage's result to the shared folder and reads
it again, so a lost executor never reaches back over a stage; what a stage wrote on
the way, and its predecessor's result, are deleted then.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from papergrid.llm import bpe, exact_dedup, mixing, near_dedup, toxicity
from papergrid.llm.common import drop_stored, load, passing

#: The mixture: each row at most once, and this share of all tokens, by the weights of domains and languages.
MIX = {"weights": [mixing.DOMAIN_WEIGHTS, mixing.LANG_WEIGHTS, {}], "percent": 80, "max_epochs": 1}


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the factorization machine scores below its threshold."""
    return toxicity.drop_toxic(docs, load(spark, sf_dir, "labels"))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row with the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near copies (five-word shingles of similarity 0.8 or more), the row with the smallest id."""
    return near_dedup.drop_near_copies(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each leaf's token prefix."""
    return mixing.mix_rows(docs, mixing.tree_of_documents(), **MIX).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, packed, in place of the text. Columns of the documents named ``ids`` or ``n_tokens`` give way to them."""
    coded = bpe.encode(docs, keep=[c for c in docs.columns if c not in ("text", "ids", "n_tokens")])
    return coded.withColumn("n_tokens", F.floor(F.octet_length("ids") / 4).cast("long"))


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("near dedup", drop_near_copies),
    ("mixing", mix),
    ("encoding", encode),
]

#: A trained score has no SQL; tests hold the pipeline against a plain version of it.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        before, docs = docs, passing(spark, lambda stage=stage, docs=docs: stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
        if i:
            drop_stored(before)
    return docs
