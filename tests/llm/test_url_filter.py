import duckdb

from dosewise.llm import queries, url_filter


def brute(url):
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    for c in "?#":
        rest = rest.split(c, 1)[0]
    host, slash, path = rest.partition("/")
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    path = slash + path
    fits = [(len(h + p) + 1, len(h), f"{h}/{p}", v) for h, p, v in queries.URL_RULES if (host == h or host.endswith("." + h)) and path.startswith("/" + p)]
    _, _, rule, verdict = max(fits, default=(0, 0, None, "allow"))
    return host, path, rule, verdict


URLS = [
    None, "", "no scheme", "http://", "http://EXAMPLE.com/en/7", "http://www.example.com/en/72?x=://", "https://com/en/", "http://a.net/de/8", "http://example.net/de/8", "http://x.example.net/de/81#f", "ftp://b.org/es/",
    "http://b.org?/es/", "http://b.org#/es/", "http://xcom/en/", "http://.com/en/", "http://a..com/en/1", "http://é.com/en/Ü", "http://com./en/1", "x://y://com/en/1", "http://example.com/en/", "http://example.com/en", "http://example.com/EN/7", "http://user@example.com:80/en/7",
]


def test_query_equals_brute_force_and_sql(spark, tiny):
    pages = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{tiny}/pages.parquet").collect()}
    rows = queries.op2_url_filter(spark, tiny).collect()
    assert {r["page_id"]: tuple(r)[1:] for r in rows} == {k: brute(u) for k, u in pages.items()} and len(rows) == len(pages)
    duckdb.sql(f"CREATE OR REPLACE VIEW pages AS SELECT * FROM '{tiny}/pages.parquet'")
    assert sorted(map(tuple, rows)) == sorted(duckdb.sql(queries.OP2_SQL).fetchall())


def test_odd_urls_and_many_ranges(spark):
    urls = [(i, u, "x", "y") for i, u in enumerate(URLS * 3)] + [(1000 + i, f"http://h{i % 3}.example.com/en/{i % 10}", "x", "y") for i in range(600)] + [(None, URLS[4], None, None)] * 2
    pages = spark.createDataFrame(urls, "page_id long, url string, rule string, key string")
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    for ranges in (1, 7, 64):
        rows = url_filter.judge_urls(pages, rules, ranges=ranges).collect()
        assert len(rows) == len(urls)
        for r in rows:
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == brute(r["url"]), r


def test_empty(spark):
    rules = spark.createDataFrame(queries.URL_RULES, "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/en/")], "page_id long, url string")
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0
    assert url_filter.judge_urls(pages, rules.limit(0)).first()["verdict"] == "allow"


def test_rules_nest_and_clash(spark):
    rules = spark.createDataFrame([("a.com", "/x/", "allow"), ("a.com", "x/", "block"), ("A.com", "x/y", "allow"), ("com", None, "block"), (None, "x", "block")], "host string, path string, verdict string")
    pages = spark.createDataFrame([(1, "http://a.com/x/1"), (2, "http://a.com/x/y1"), (3, "http://b.com"), (4, "http://b.org/x")], "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in url_filter.judge_urls(pages, rules).collect()}
    assert found == {1: ("a.com/x/", "block"), 2: ("a.com/x/y", "allow"), 3: ("com/", "block"), 4: (None, "allow")}
