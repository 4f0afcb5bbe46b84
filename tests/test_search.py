import random

from corvane.operators import search

SCHEMA = "id string, path string, name string, qualified string, kind string, language string, signature string, doc string, depth int, line int"


def symbols(spark, names, **more):
    rows = []
    for k, n in enumerate(names):
        name, qualified, sig, doc, kind, depth = (list(n) + [None] * 6)[:6] if isinstance(n, tuple) else (n, None, None, None, None, None)
        rows.append((f"a.go::{qualified or name}#{kind or 'function'}", "a.go", name, qualified or name, kind or "function", "go", sig or "", doc or "", depth or 0, 3 * k + 1))
    return spark.createDataFrame(rows, SCHEMA)


def found(df):
    return [(r["name"], r["tier"]) for r in df.collect()]


def test_tiers_come_in_order(spark):
    many = "config " * 20
    rows = symbols(spark, ["config", "configure", ("configLoader", None, many, many), "parseConfig", "unrelated"])
    got = found(search.search_symbols(rows, search.SearchQuery("config")))
    assert got[0] == ("config", 4) and {got[1], got[2]} == {("configLoader", 3), ("configure", 3)} and got[3] == ("parseConfig", 2) and len(got) == 4


def test_a_flood_of_mentions_does_not_beat_the_name(spark):
    rows = symbols(spark, [("helperThing", None, "handler " * 30, "handler " * 30), ("Handler", None, None, None, "struct")])
    assert found(search.search_symbols(rows, search.SearchQuery("handler"))) == [("Handler", 4), ("helperThing", 2)]


def test_equal_case_first(spark):
    got = found(search.search_symbols(symbols(spark, ["server", "Server", "SERVER"]), search.SearchQuery("Server")))
    assert got[0] == ("Server", 4) and len(got) == 3


def test_all_spellings(spark):
    rows = symbols(spark, ["ParseConfigFile", "parse_config", "configParser", "Unrelated"])
    for q in ("parseConfig", "ParseConfig", "parse_config", "parse config"):
        got = dict(found(search.search_symbols(rows, search.SearchQuery(q))))
        assert got["parse_config"] == 4 and got["ParseConfigFile"] == 3 and "Unrelated" not in got


def test_coverage(spark):
    got = found(search.search_symbols(symbols(spark, ["loadUserConfig", "loadUser", "saveConfig"]), search.SearchQuery("user config")))
    assert got[0][0] == "loadUserConfig" and len(got) == 3


def test_depth_breaks_ties(spark):
    rows = symbols(spark, [("run", "T.run", None, None, "method", 1), ("run", None, None, None, "function", 0)])
    got = search.search_symbols(rows, search.SearchQuery("run")).collect()
    assert got[0]["kind"] == "function" and got[0]["total"] == 2 and not got[0]["truncated"]


def test_order_of_rows_does_not_matter(spark):
    names = ["loadConfig", "configLoad", "config", "Config", "loader", "reload_config", "xConfig"]
    rows = symbols(spark, names).collect()
    want = None
    for seed in range(3):
        random.Random(seed).shuffle(rows)
        got = [tuple(r) for r in search.search_symbols(spark.createDataFrame(rows, SCHEMA).repartition(3), search.SearchQuery("load config")).collect()]
        want = want or got
        assert got == want


def test_fuzzy_only_when_nothing_else(spark):
    rows = symbols(spark, ["servername", "manager", "other"])
    assert found(search.search_symbols(rows, search.SearchQuery("servernmae"))) == []
    assert found(search.search_symbols(rows, search.SearchQuery("servernmae", fuzzy=True))) == [("servername", 1)]
    assert found(search.search_symbols(rows, search.SearchQuery("manager", fuzzy=True))) == [("manager", 4)]


def test_filters_and_limits(spark):
    rows = symbols(spark, [("run", "A.run", None, None, "method"), "run", "runner", "rerun"])
    assert all(r["kind"] == "method" for r in search.search_symbols(rows, search.SearchQuery("run", kinds=("METHOD",))).collect())
    got = search.search_symbols(rows, search.SearchQuery("run", limit=1)).collect()
    assert len(got) == 1 and got[0]["total"] == 3 and got[0]["truncated"]
    assert search.search_symbols(rows, search.SearchQuery("  ")).count() == 0


def test_nearest(spark):
    names = spark.createDataFrame([(n,) for n in ["servername", "server_name", "serverNames", "zebra", "qux", "fly"]], "n string")
    assert [r["name"] for r in search.nearest_names(names, "n", "servernmae").collect()] == ["server_name", "servername", "serverNames"]
    assert [r["cost"] for r in search.stale_candidates(names, "n", "zebra").collect()][0] == 0
