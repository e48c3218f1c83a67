"""URL filters against a plain search through all rules."""

from __future__ import annotations

import random
import re

from marlstone.llm import url_filters as U
from marlstone.llm.queries import URL_RULES


def plain(url, rules, default="allow"):
    url = url or ""
    rest = url.split("://", 1)[1] if "://" in url else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h + p), len(h), v, h + p) for h, p, v in rules if h is not None and p is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, 0, default, None))
    return host, path, best[3], best[2]


def urls():
    rng = random.Random(5)
    hosts = ["example.org", "www.example.org", "EXAMPLE.Org", "org", "xorg", "a.b.com", "com", "com:80", "É.com", "", ".", "example.org.", "a..com", "notexample.org", "x" * 5000 + ".org", ".".join("abcdefgh" * 40) + ".com"]
    paths = ["", "/", "/es/", "/es", "/en/1", "/en/1234?x=/es/", "/en/2#/en/1", "/fr/x", "/de/", "/DE/", "?q=/fr/", "#/de/", "/es/" + "y" * 5000]
    made = [f"{rng.choice(['http', 'HTTPS', ''])}://{rng.choice(hosts)}{rng.choice(paths)}" for _ in range(400)]
    return [None, "", "example.org/es/", "http:/example.org/es/", "://", "http://a.com/de/://x.org/", *made]


def test_rules_of_the_contract(spark):
    rows = [(i, u, "old", "clash") for i, u in enumerate(urls())] + [(7, "http://www.example.org/es/", "x", "y")] * 3 + [(None, "http://a.org/", "x", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, host string, verdict string").repartition(3)
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = [(r.page_id, r.url, r.host, r.path, r.rule, r.verdict) for r in U.filter_urls(df, rules).collect()]
    assert sorted(got, key=str) == sorted(((r[0], r[1], *plain(r[1], URL_RULES)) for r in rows), key=str)


def test_many_rules_and_ties(spark):
    rng = random.Random(1)
    rules = [(rng.choice(["example.org", "org", "com", "b.com", "a.b.com", ""]), rng.choice(["", "/", "/e", "/en/1", "/es/", "/de/x"]), rng.choice(["allow", "block"])) for _ in range(30)]
    rules += [(None, "/", "block"), ("org", None, "block"), ("b.com", "/e", "allow"), ("b.com", "/e", "block")]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls())], "page_id long, url string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    for r in U.filter_urls(df, listed, default="block").collect():
        assert (r.host, r.path, r.rule, r.verdict) == plain(r.url, rules, "block"), r.url


def test_no_rules_and_no_rows(spark):
    df = spark.createDataFrame([(1, "http://a.org/x")], "page_id long, url string")
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert [(r.rule, r.verdict) for r in U.filter_urls(df, none).collect()] == [(None, "allow")]
    assert U.filter_urls(df.limit(0), spark.createDataFrame(URL_RULES, "host string, path string, verdict string")).collect() == []
