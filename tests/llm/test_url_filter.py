from __future__ import annotations

import re

from cases import CLASHING, ordered, plain

from tablewright.llm import url_filter
from tablewright.llm.queries import URL_RULES

URLS = [
    None,
    "",
    "no scheme example.com/en/",
    "http://example.com",
    "http://example.com/",
    "http://EXAMPLE.com/en/x?y#z",
    "http://WWW.Example.COM/en/",
    "https://a.www.example.com/en/1",
    "https://myexample.com/en/1",
    "ftp://x.net/es/#top",
    "ftp://net/fr/",
    "http://x.net/de/",
    "http://x.org/en/",
    "http://com/http://example.com/en/",
    "://b.com/en/",
    "http://example.com?/en/",
    "http://é.example.com/en/é",
    "http://x.net\n/es/",
    "http://example.com/en/" + "a" * 100_000,
    "http://" + "a." * 5000 + "example.com/en/",
]
PAGES = [(i, url, "") for i, url in enumerate(URLS)] + [(3, URLS[5], ""), (None, URLS[5], None)]


def brute(pages, rules):
    out = []
    for page_id, url, _ in pages:
        rest = (url or "").partition("://")[2]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [
            (len(h + p), len(h), v == "block", h + p, v)
            for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)
        ]
        best = max(fits, default=(0, 0, 0, None, "allow"))
        out.append((page_id, host, path, best[3], best[4]))
    return ordered(out)


def judged(spark, pages, rules):
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    frame = frame.selectExpr("*", *[f"'other' AS `{name}`" for name in [*CLASHING, "host", "path"][:-1] if name != "host"])
    found = url_filter.judge(frame, spark.createDataFrame(rules, "host string, path string, verdict string"))
    return plain(found, "page_id", "host", "path", "rule", "verdict")


def test_contract_rules(spark):
    assert judged(spark, PAGES, URL_RULES) == brute(PAGES, URL_RULES)


def test_many_rules_and_both_verdicts(spark):
    pages = [(i, f"http://h{i % 400}.d{i % 70}.com/p{i % 13}/q", None) for i in range(900)]
    rules = [(f"d{i}.com", f"/p{i % 13}", "block") for i in range(0, 70, 2)]
    rules += [(f"h{i}.d{i % 70}.com", "", "allow") for i in range(0, 400, 3)] + [("d4.com", "/p4", "allow")]
    assert judged(spark, pages, rules) == brute(pages, rules)


def test_a_cascade_is_exact_for_the_universe(spark):
    universe = spark.range(20_000).selectExpr("concat('k', id) AS key")
    listed = universe.filter("cast(substr(key, 2) AS int) % 37 = 0")
    cascade = url_filter.Cascade(listed, universe, "test")
    assert len(cascade.levels) > 1
    holds = cascade.holds(url_filter._hashes(universe["key"]))
    found = {row.key for row in universe.filter(holds).collect()}
    assert found == {row.key for row in listed.collect()}


def test_empty_tables(spark):
    assert judged(spark, [], URL_RULES) == []
    assert judged(spark, PAGES[:6], []) == brute(PAGES[:6], [])


def test_rule_hosts_are_lower_cased_as_url_hosts_are(spark):
    rules = [("É.com", "/", "block"), ("B.com", "/", "block")]
    pages = [(1, "http://É.com/x", None), (2, "http://é.com/x", None), (3, "http://b.COM/", None)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = url_filter.judge(frame, listed)
    assert plain(found, "page_id", "rule", "verdict") == ordered([(1, "É.com/", "block"), (2, None, "allow"), (3, "b.com/", "block")])


def test_long_lists_are_split(spark, monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_LISTED", 40)
    rules = [(f"h{i}.net", "/", "block" if i % 2 else "allow") for i in range(300)]
    pages = [(i, f"http://a.h{i}.net/p", None) for i in range(400)]
    frame = spark.createDataFrame(pages, "page_id bigint, url string, html string")
    listed = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = plain(url_filter.judge(frame, listed), "page_id", "rule", "verdict")
    verdicts = {i: (f"h{i}.net/", "block" if i % 2 else "allow") if i < 300 else (None, "allow") for i in range(400)}
    assert found == ordered([(i, *verdict) for i, verdict in verdicts.items()])
