import random

import pytest

from corvane.llm import url_filter


def brute(url, rules):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        tail = rest[cut:]
        path = tail[: min([tail.find(c) for c in "?#" if c in tail], default=len(tail))]
    best = None
    for verdict, rule in rules:
        h, p = rule.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p):
            key = (len(h) + len(p) + 1, len(h), verdict, rule)
            best = max(best, key) if best else key
    return host, path, best and best[3], best[2] if best else "allow"


URLS = [None, "", "no scheme", "http://", "://", "http:///p", "HTTP://A.EXAMPLE.net/en/x", "http://net", "http://net/", "http://x.net?q=/", "http://example.com/de/", "http://evilexample.com/de/x", "http://a.b.c.org/fr/y#z", "http://a..net/x", "http://u@example.net:80/en/", "http://EXAMPLE.net/EN/", "x://y://net/", "http://é.net/ü", "http://net/\u0001"]


def check(spark, urls, rules, buckets):
    df = spark.createDataFrame([(k % 40, u, "x") for k, u in enumerate(urls)], "page_id long, url string, host string")
    got = url_filter.judge(df, url_filter.rules_table(spark, rules), buckets=buckets).collect()
    want = sorted((str((k % 40, *brute(u, rules))) for k, u in enumerate(urls)))
    assert sorted(str(tuple(r)) for r in got) == want


@pytest.mark.parametrize("buckets", [1, 5, 60])
def test_rules_of_the_contract(spark, buckets):
    check(spark, URLS + URLS[:5], url_filter.RULES, buckets)


@pytest.mark.parametrize("seed", range(3))
def test_nested_rules_against_brute_force(spark, seed):
    rng = random.Random(seed)
    label = lambda: rng.choice(["a", "b", "ab", "net", "x-y"])
    part = lambda: rng.choice(["", "e", "en", "en/", "en/a", "f/g/"])
    rules = [(rng.choice(["block", "allow"]), ".".join(label() for _ in range(rng.randint(1, 3))) + "/" + part()) for _ in range(40)]
    rules = list({r: (v, r) for v, r in rules}.values())
    hot = "http://a.b.net/en/a"
    urls = [f"http://{'.'.join(label() for _ in range(rng.randint(1, 4)))}/{part()}{part()}" for _ in range(200)] + [hot] * 120
    check(spark, urls, rules, 30)


def test_empty_tables(spark):
    empty = spark.createDataFrame([], "page_id long, url string")
    assert url_filter.judge(empty, url_filter.rules_table(spark)).count() == 0
    some = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    assert url_filter.judge(some, url_filter.rules_table(spark).limit(0)).first()["verdict"] == "allow"


def test_native(spark):
    some = spark.createDataFrame([(1, "http://a.net/")], "page_id long, url string")
    plan = url_filter.judge(some, url_filter.rules_table(spark))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
