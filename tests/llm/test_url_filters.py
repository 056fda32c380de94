import random

import pytest
from pyspark.sql import functions as F

from stockbook.llm import url_filters as U


def brute(url, rules):
    host = path = ""
    if url is not None and "://" in url:
        rest = url[url.index("://") + 3:]
        cut = min([rest.index(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if c.isascii() else c for c in rest[:cut])
        path = rest[cut:]
        path = path[:min([path.index(c) for c in "?#" if c in path], default=len(path))]
    best = None
    for verdict, h, p in rules:
        if host and (host == h or host.endswith("." + h)) and path.startswith(p):
            rank = (len(h + p), len(h), verdict == "block")
            if best is None or rank > best[0]:
                best = (rank, h + p, verdict)
    return (host, path, best[1], best[2]) if best else (host, path, None, "allow")


URLS = [None, "", "example.net/en/", "http://", "://", "http://EXAMPLE.NET/en/x", "https://m.Example.net/en", "http://net/",
        "http://net", "http://a.net?x=/", "http://b.net#/", "http://example.com/de/1?u=http://x.net/", "http://xexample.com/de/",
        "http://a.b.c.d.e.f.example.com/de/", "http://org/fr/", "http://ÄÖ.org/fr/é", "http://a..net/", "http://.net/",
        "http://user@h.net:80/", "http://x.org/FR/", "ftp://q://net/en/", "http://a.net/\nb", "http:///en/", "x" * 5000 + "://net/"]


def run(spark, urls, rules, **kw):
    pages = spark.createDataFrame([(i, u, 1, 2) for i, u in enumerate(urls)], "page_id int, url string, `ro w.` int, KEY int")
    table = spark.createDataFrame(rules, "verdict string, host string, path string")
    out = U.judge_urls(pages, table, **kw)
    assert out.columns == ["page_id", "url", "ro w.", "KEY", "host", "path", "rule", "verdict"]
    rows = sorted(out.collect(), key=lambda r: r["page_id"])
    assert [r["url"] for r in rows] == list(urls)
    return [(r["host"], r["path"], r["rule"], r["verdict"]) for r in rows]


def test_hard_urls(spark):
    assert run(spark, URLS + URLS, U.RULES) == [brute(u, U.RULES) for u in URLS + URLS]


@pytest.mark.parametrize("max_bits", [U.MAX_BITS, 256])
def test_random_urls_and_rules(spark, max_bits):
    rng = random.Random(4)
    part = lambda: rng.choice("abcde")
    hosts = [".".join(part() for _ in range(rng.randint(1, 4))) for _ in range(60)]
    paths = ["", "/", "/a", "/a/", "/ab", "/a/b/", "/é/"]
    rules = [(rng.choice(["block", "allow"]), rng.choice(hosts), rng.choice(paths)) for _ in range(80)]
    urls = [f"http://{rng.choice(hosts)}{rng.choice(paths)}{rng.choice(['', 'x', '?q', '#f/', 'b/c'])}" for _ in range(400)]
    assert run(spark, urls, rules, max_bits=max_bits) == [brute(u, rules) for u in urls]


def test_cascade_is_exact_over_its_keys(spark):
    listed = spark.range(300).select(F.col("id").cast("string").alias("key"))
    others = spark.range(100, 20_000).select(F.col("id").cast("string").alias("key"))
    cascade = U.build(listed, 300, others.union(others), 20_000)
    assert len(cascade.levels) >= 2
    assert sum(v.bits for v in cascade.levels) < 300 * 30
    both = listed.union(others).distinct()
    kept = cascade.attach(both, "f").where(cascade.lists(F.col("key"), "f"))
    assert sorted(int(r["key"]) for r in kept.collect()) == list(range(300))


def test_rules_that_fit_nothing_and_nothing(spark):
    bad = [("block", None, "/"), ("block", "", "/"), ("block", "net", "x"), ("block", "a/b", "/"), ("deny", "net", "/"),
           (None, "net", "/"), ("block", "net", "/?")]
    assert run(spark, URLS, bad) == [brute(u, []) for u in URLS]
    both = [("allow", "NET", "/"), ("block", "net", "/"), ("block", "com", None)]
    assert run(spark, ["http://x.net/", "http://a.com"], both) == [("x.net", "/", "net/", "block"), ("a.com", "", "com", "block")]
    none = spark.createDataFrame([], "page_id int, url string")
    table = spark.createDataFrame(U.RULES, "verdict string, host string, path string")
    assert U.judge_urls(none, table).count() == 0
    clash = spark.createDataFrame([(1, "http://a.net/", "h", 3)], "page_id int, url string, Host string, rule int")
    assert U.judge_urls(clash, table).collect()[0].asDict() == {
        "page_id": 1, "url": "http://a.net/", "host": "a.net", "path": "/", "rule": "net/", "verdict": "block"}
