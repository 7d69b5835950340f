from __future__ import annotations

import duckdb

from eraframe.llm import queries, url_filter
from tests.conftest import SMALL

RULES = "host string, path string, verdict string"


def judge(url: str | None, rules):
    """Host, path, rule and verdict by trying every rule."""
    rest = url.split("://", 1)[1] if url and "://" in url else ""
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
    path = rest[cut:].split("?")[0].split("#")[0]
    best = max(
        (
            (len(h + p), len(h), v, h + p)
            for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ),
        default=None,
    )
    return (host, path, best[3], best[2]) if best else (host, path, None, "allow")


def check(spark, urls, rules):
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, host int")
    got = url_filter.judge_urls(pages, spark.createDataFrame(rules, RULES)).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: judge(u, rules) for i, u in enumerate(urls)}
    assert len(got) == len(urls)


def test_query_against_sql_and_rules(spark):
    rows = duckdb.sql(f"SELECT page_id, url FROM '{SMALL}/pages.parquet'").fetchall()
    got = queries.queries()["op6_url_filters"](spark, SMALL).collect()
    assert {r.page_id: tuple(r)[1:] for r in got} == {i: judge(u, queries.URL_RULES) for i, u in rows}
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS FROM '{SMALL}/pages.parquet'")
    wanted = con.sql(queries.oracle_sql()["op6_url_filters"]).fetchall()
    assert sorted(map(repr, wanted)) == sorted(repr(tuple(r)) for r in got)


def test_hard_urls_and_rules(spark):
    urls = [
        None, "", "nothing", "://", "http://", "http:///en/", "HTTP://WWW.Example.COM/en/x?y#z",
        "http://example.com/en", "http://example.com/en/", "http://notexample.com/en/",
        "http://a.b.example.com/en/q://z", "x://example.com?/en/", "x://example.com#/en/",
        "http://ÄÖ.com/ß", "http://com/", "http://.com/", "http://a..com/", "http://a.com./",
        "http://u@example.com:80/en/", "http://" + "a." * 2000 + "net/fr/" + "p/" * 5000,
        "http://example.net/fr/\n/x", "http://x.net/english/", "http://x.net/en", "dup://x.net/en",
        "dup://x.net/en",
    ]
    check(spark, urls, queries.URL_RULES)
    odd = [("net", "", "block"), ("x.net", "/en", "allow"), ("x.net", "/en", "block"), ("net", "/en/gl", "allow")]
    check(spark, urls, odd)


def test_no_rules_and_no_pages(spark):
    check(spark, ["http://a.com/"], [])
    rules = spark.createDataFrame(queries.URL_RULES + [(None, "/", "block")], RULES)
    none = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge_urls(none, rules).count() == 0
