"""URL filters: rules indexed by their rarest literal token; a URL's tokens fetch candidates, and only those run regular expressions.

Every rule has a regular expression and the literal tokens (runs of ``[a-z0-9]``)
that any URL it matches must hold whole. One pass over the URLs counts in how many
of them each of those tokens occurs (a count per rule token, never per URL token),
and each rule is filed under its rarest one. The index is one constant of the plan (a list
of slots by the token's checksum, folded once, so a token is found in a step however
many rules there are), and judging is one projection over the scan: no join, no
shuffle, no Python. Host rules are compared as strings, only pattern rules run
expressions. The rules are a list of the driver; 100,000 are tested.

Null URLs, and URLs without ``://``, have an empty host and path; no host rule
fits them and the pattern rules see the text as it is (null: empty). Ties between
host rules of equal length go to ``block``. Repeated rows are judged alike.
Columns other than the id and the URL are left aside. An empty table gives none.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import load

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with ``path``; the longest fitting rule decides."""

    action: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path

    @property
    def tokens(self) -> list[str]:
        whole = self.host + self.path
        found = list(re.finditer("[a-z0-9]+", whole.lower()))
        return [m[0] for m in found if m.end() < len(whole)]  # the last may be the start of a longer token


@dataclass(frozen=True)
class PatternRule:
    """Fits where ``regex`` finds something in the lower-cased URL; ``tokens`` must then stand in it whole."""

    action: str
    name: str
    regex: str
    tokens: tuple[str, ...]


HOST_RULES = (
    HostRule("allow", "org", "/"),
    HostRule("block", "example.org", "/es/"),
    HostRule("block", "example.org", "/en/1"),
    HostRule("allow", "com", "/fr/"),
    HostRule("block", "com", "/de/"),
)
_IN_HOST = "://([^/?#]*[.])?"
PATTERN_RULES = (
    PatternRule("block", "ads host", _IN_HOST + "ads-[a-z]+[.]", ("ads",)),
    PatternRule("block", "track host", _IN_HOST + "track[.-]", ("track",)),
    PatternRule("block", "tracker host", _IN_HOST + "tracker[.-]", ("tracker",)),
    PatternRule("block", "adult host", _IN_HOST + "adult-[a-z0-9]+[.]", ("adult",)),
    PatternRule("block", "casino host", _IN_HOST + "casino-[a-z]+[.]", ("casino",)),
    PatternRule("block", "bets host", _IN_HOST + "free-bets[.]", ("free", "bets")),
    PatternRule("block", "pills host", _IN_HOST + "cheap-pills[.]", ("cheap", "pills")),
    PatternRule("block", "spam host", _IN_HOST + "spam-[a-z]+[.]", ("spam",)),
    PatternRule("block", "login page", "://[^/?#]*/([^?#]*/)?login([/?#.]|$)", ("login",)),
    PatternRule("block", "signin page", "://[^/?#]*/([^?#]*/)?signin([/?#.]|$)", ("signin",)),
    PatternRule("block", "cart page", "://[^/?#]*/([^?#]*/)?cart([/?#.]|$)", ("cart",)),
    PatternRule("block", "session link", "[?&]sessionid=", ("sessionid",)),
    PatternRule("allow", "policy page", "://[^/?#]*/([^?#]*/)?policy([/?#.]|$)", ("policy",)),
)


def _lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; path: then up to ``?`` or ``#``."""
    known = F.coalesce(url.cast("string"), F.lit(""))
    at = F.instr(known, "://")
    rest = F.when(at > 0, known.substr(at + F.lit(3), F.length(known))).otherwise(F.lit(""))
    return _lower(F.regexp_extract(rest, "^[^/?#]*", 0)), F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)


def url_tokens(url: Column) -> Column:
    return F.array_distinct(F.split(_lower(F.coalesce(url.cast("string"), F.lit(""))), "[^a-z0-9]+"))


def _slots(entries: dict[str, object], schema: str) -> Callable[[Column], Column]:
    """A constant table from tokens to values of the schema: a function that finds a token's values (an array of one or none)."""
    n = max(1, len(entries))
    table: list[list[dict]] = [[] for _ in range(n)]
    for token, value in entries.items():
        table[zlib.crc32(token.encode()) % n].append({"t": token, "v": value})
    constant = F.from_json(F.lit(json.dumps(table)), f"array<array<struct<t:string,v:{schema}>>>")
    return lambda t: F.transform(F.filter(F.element_at(constant, (F.crc32(t.cast("binary")) % n + 1).cast("int")), lambda e: e["t"] == t), lambda e: e["v"])


def token_counts(pages: DataFrame, url: str, tokens: list[str]) -> dict[str, int]:
    """In how many URLs each of the rules' tokens occurs: one row per rule token, whatever the number of URLs."""
    if not tokens:
        return {}
    known = _slots({t: True for t in tokens}, "boolean")
    rows = pages.select(F.explode(F.filter(url_tokens(F.col(url)), lambda t: F.size(known(t)) > 0)).alias("t")).groupBy("t").count().collect()
    return {r["t"]: r["count"] for r in rows}


def build_index(rules: list, counts: dict[str, int]) -> tuple[dict[str, list[int]], list[int]]:
    """Rule numbers by rarest token (ties: the longest, then the first by letters), and the rules without a token."""
    index: dict[str, list[int]] = {}
    always = []
    for i, rule in enumerate(rules):
        if rule.tokens:
            index.setdefault(min(rule.tokens, key=lambda t: (counts.get(t, 0), -len(t), t)), []).append(i)
        else:
            always.append(i)
    return index, always


_RULE = "struct<by_host:boolean,action:string,name:string,regex:string,host:string,path:string>"


def _row(rule: HostRule | PatternRule) -> dict:
    by_host = isinstance(rule, HostRule)
    return {"by_host": by_host, "action": rule.action, "name": rule.name, "regex": None if by_host else rule.regex, "host": rule.host if by_host else None, "path": rule.path if by_host else None}


def filter_urls(pages: DataFrame, host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, id_col: str = "page_id", url_col: str = "url", default: str = "allow") -> DataFrame:
    """One row per page: id, host, path, rule (the deciding host rule), pattern (the deciding pattern rule), n_candidates, verdict."""
    rules = [*host_rules, *pattern_rules]
    index, always = build_index(rules, token_counts(pages, url_col, sorted({t for r in rules for t in r.tokens})))
    found = _slots({t: [_row(rules[i]) for i in ids] for t, ids in index.items()}, f"array<{_RULE}>")
    unfiled = F.from_json(F.lit(json.dumps([_row(rules[i]) for i in always])), f"array<{_RULE}>")
    host, path = host_and_path(F.col(url_col))
    base = pages.select(F.col(id_col).alias("page_id"), host.alias("host"), path.alias("path"), _lower(F.coalesce(F.col(url_col).cast("string"), F.lit(""))).alias("seen"), url_tokens(F.col(url_col)).alias("tokens"))
    base = base.withColumn("candidates", F.concat(F.flatten(F.flatten(F.transform(F.filter("tokens", lambda t: t != ""), found))), unfiled))

    def fits(r: Column) -> Column:
        own = (F.col("host") == r["host"]) | F.endswith(F.col("host"), F.concat(F.lit("."), r["host"]))
        return F.when(r["by_host"], own & F.startswith(F.col("path"), r["path"])).otherwise(F.rlike(F.col("seen"), r["regex"]))

    base = base.withColumn("fits", F.filter("candidates", fits))
    best = F.element_at(F.array_sort(F.transform(F.filter("fits", lambda r: r["by_host"]), lambda r: F.struct((-F.length(r["name"])).alias("l"), (r["action"] != "block").alias("a"), r["name"].alias("name"), r["action"].alias("action")))), 1)
    pattern = F.element_at(F.array_sort(F.transform(F.filter("fits", lambda r: ~r["by_host"]), lambda r: F.struct((r["action"] != "allow").alias("a"), r["name"].alias("name"), r["action"].alias("action")))), 1)
    base = base.withColumn("best", F.when(F.size(F.filter("fits", lambda r: r["by_host"])) > 0, best)).withColumn("hit", F.when(F.size(F.filter("fits", lambda r: ~r["by_host"])) > 0, pattern))
    return base.select("page_id", "host", "path", F.col("best.name").alias("rule"), F.col("hit.name").alias("pattern"), F.size("candidates").alias("n_candidates"), F.coalesce(F.col("best.action"), F.col("hit.action"), F.lit(default)).alias("verdict"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_urls(load(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    fits = lambda r: f"((host = {quote(r.host)} OR ends_with(host, {quote('.' + r.host)})) AND starts_with(path, {quote(r.path)}))"
    rule = " ".join(f"WHEN {fits(r)} THEN {quote(r.name)}" for r in sorted(HOST_RULES, key=lambda r: (-len(r.name), r.action != "block")))
    verdict = " ".join(f"WHEN rule = {quote(r.name)} THEN {quote(r.action)}" for r in HOST_RULES)
    method = " ".join(f"WHEN regexp_matches(seen, {quote(r.regex)}) THEN {quote(r.action)}" for r in sorted(PATTERN_RULES, key=lambda r: r.action != "allow"))
    return f"""
    WITH u AS (
      SELECT page_id, translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1), '{UPPER}', '{LOWER}') AS host,
             regexp_extract(coalesce(url, ''), '://[^/?#]*([^?#]*)', 1) AS path, translate(coalesce(url, ''), '{UPPER}', '{LOWER}') AS seen
      FROM pages),
    r AS (SELECT *, CASE {rule} END AS rule FROM u)
    SELECT page_id, host, path, rule, CASE {verdict} {method} ELSE 'allow' END AS verdict FROM r"""


QUERIES = {"op1_url_filter": op1_url_filter}
ORACLES = {"op1_url_filter": _sql()}
