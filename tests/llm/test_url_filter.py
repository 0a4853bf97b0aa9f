import re

import duckdb

from papergrid.llm import url_filter as U

URLS = [
    (1, "http://A.Example.org/es/1"), (2, "https://example.org/en/15"), (3, "https://example.org/en/2"), (4, "http://x.com/fr/1?a"), (5, "http://x.com/de/"),
    (6, "http://x.com?de"), (7, None), (8, "no scheme"), (9, ""), (10, "http://example.organic/es/"), (11, "http://notexample.org/es/"), (12, "http://ads-track.example.net/en/1"),
    (13, "http://h.net/policy?sessionid=1"), (14, "http://h.net/a?sessionid=1"), (15, "ftp://x.org"), (16, "http://x.net/" + "long/" * 5000 + "cart"), (17, "http://a://b/c"), (None, "http://x.com/de/"), (5, "http://x.com/de/"),
    (18, "http://tracker.x.net/a\nb/login"), (19, "HTTP://CHEAP-PILLS.X.NET/"),
]


def brute(url):
    url = url or ""
    host = path = ""
    if "://" in url:
        m = re.match(r"([^/?#]*)([^?#]*)", url.split("://", 1)[1])
        host, path = m[1].translate(str.maketrans(U.UPPER, U.LOWER)), m[2]
    fit = [r for r in U.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = min(fit, key=lambda r: (-len(r.name), r.action != "block"), default=None)
    seen = url.translate(str.maketrans(U.UPPER, U.LOWER))
    hits = {r.action for r in U.PATTERN_RULES if re.search(r.regex, seen)}
    verdict = best.action if best else "allow" if "allow" in hits or "block" not in hits else "block"
    return host, path, best.name if best else None, verdict


def test_against_brute_force_and_sql(spark):
    df = spark.createDataFrame([(i, u, "x", "y") for i, u in URLS], "page_id long, url string, host string, verdict string")
    got = U.filter_urls(df).select("page_id", "host", "path", "rule", "verdict").collect()
    want = [(i, *brute(u)) for i, u in URLS]
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    con = duckdb.connect()
    con.execute("create table pages (page_id bigint, url varchar)")
    con.executemany("insert into pages values (?, ?)", URLS)
    assert sorted(con.sql(U.ORACLES["op1_url_filter"]).fetchall(), key=key) == sorted(want, key=key)


def test_only_candidates_run(spark):
    df = spark.createDataFrame([(1, "http://plain.net/a"), (2, "http://x.example.org/es/")], "page_id long, url string")
    got = {r.page_id: r.n_candidates for r in U.filter_urls(df).collect()}
    assert all(r.tokens for r in (*U.HOST_RULES, *U.PATTERN_RULES))
    assert got[1] == 0 < got[2] < len(U.HOST_RULES) + len(U.PATTERN_RULES)


def test_rarest_token():
    rule = U.HostRule("block", "example.org", "/es/")
    index, always = U.build_index([rule, U.PatternRule("block", "any", "a", ())], {"example": 9, "org": 5, "es": 2})
    assert index == {"es": [0]} and always == [1]
    assert U.HostRule("block", "example.org", "/en/1").tokens == ["example", "org", "en"]  # 1 may go on


def test_empty_table_and_no_rules(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert U.filter_urls(empty).count() == 0
    df = spark.createDataFrame([(1, "http://x.com/de/")], "page_id long, url string")
    assert [r.verdict for r in U.filter_urls(df, (), ()).collect()] == ["allow"]


def test_a_hundred_thousand_rules(spark):
    """They are found by their tokens; judging doesn't look at the others, and takes no longer than a few times the usual ones do."""
    import time

    many = [U.HostRule("block", f"site{i}.example{i % 7}.net", "/a/") for i in range(100_000)]
    df = spark.range(20_000).selectExpr("id as page_id", "concat('http://www.site', id * 11, '.example', (id * 11) % 7, '.net/a/b') as url")
    took = []
    for rules in (U.HOST_RULES, many):
        start = time.time()
        rows = U.filter_urls(df, rules, ()).collect()
        took.append(time.time() - start)
    assert all((r.verdict == "block") == (r.page_id * 11 < 100_000) and r.n_candidates <= 1 for r in rows)
    assert took[1] < 10 + 4 * took[0]


def test_op1_contract(spark, tmp_path):
    spark.createDataFrame(URLS, "page_id long, url string").write.parquet(str(tmp_path / "pages.parquet"))
    got = U.op1_url_filter(spark, str(tmp_path))
    assert got.dtypes == [("page_id", "bigint"), ("host", "string"), ("path", "string"), ("rule", "string"), ("verdict", "string")]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(str((i, *brute(u))) for i, u in URLS)
