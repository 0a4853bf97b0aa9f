"""The queries and SQL of this subpackage, for the entry module."""

from . import bpe, chat, exact_dedup, mixing, quality, sharding, simhash, suffix_dedup, toxicity, url_filter

MODULES = (url_filter, mixing, toxicity, chat, simhash, exact_dedup, bpe, suffix_dedup, quality, sharding)


def queries() -> dict:
    return {k: v for m in MODULES for k, v in m.QUERIES.items()}


def oracle_sql() -> dict:
    return {k: v for m in MODULES for k, v in m.ORACLES.items()}
