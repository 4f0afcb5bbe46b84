import random

import pytest
from pyspark.sql import functions as F

from corvane.operators import budget, diffs, grep, history, intervals, paths, snapshot, task, verdicts


def test_globs(spark):
    files = ["a.go", "x/a.go", "x/y/a.py", "docs/readme.md", "docs", "src/[q].c", "v/w/z.test.js"]
    df = spark.createDataFrame([(f,) for f in files], "p string")
    fit = lambda *g: [r["p"] for r in df.where(paths.glob_set(F.col("p"), list(g))).orderBy("p").collect()]
    assert fit("*.go") == ["a.go", "x/a.go"]
    assert fit("x/*.go") == ["x/a.go"]
    assert fit("x/**") == ["x/a.go", "x/y/a.py"]
    assert fit("**/y/*.{py,go}") == ["x/y/a.py"]
    assert fit("docs") == ["docs", "docs/readme.md"]
    assert fit("!*.go", "!docs") == ["src/[q].c", "v/w/z.test.js", "x/y/a.py"]
    assert fit("?.go") == ["a.go", "x/a.go"]
    assert fit("[x]/**/a.*") == ["x/a.go", "x/y/a.py"]
    assert paths.expand_braces("{a,b{c,d}}e") == ["ae", "bce", "bde"] or sorted(paths.expand_braces("{a,b{c,d}}e")) == ["ae", "bce", "bde"]


def test_roots(spark):
    files = spark.createDataFrame([("a/b/c.go",), ("z.go",)], "p string")
    there = spark.createDataFrame([("a/go.mod",), ("a/b/.git",), (".git",)], "path string")
    assert {r["file"]: r["root"] for r in paths.nearest_root(files, "p", there, ["go.mod", ".git"]).collect()} == {"a/b/c.go": "a", "z.go": "."}


def test_grep(spark):
    df = spark.createDataFrame([("f", "one idiot\r\nÉ two idiots, Idiot\n\nlast"), ("g", None), ("h", "")], "k string, t string")
    got = [(r["k"], r["line"], r["col"], r["hits"]) for r in grep.search_text(df, "k", "t", "idiot").orderBy("k", "line").collect()]
    assert got == [("f", 1, 5, 1), ("f", 2, 8, 2)]
    words = [(r["line"], r["col"]) for r in grep.search_text(df, "k", "t", "idiot", word=True).orderBy("line").collect()]
    assert words == [(1, 5), (2, 16)]
    assert grep.search_text(df, "k", "t", "É", case=True).count() == 1 and grep.search_text(df, "k", "t", "é").count() == 1
    assert grep.search_text(df, "k", "t", r"^l.st$", regex=True).first()["line"] == 4
    assert grep.search_text(df, "k", "t", "a.b").count() == 0
    with pytest.raises(ValueError):
        grep.pattern_of("x" * 5000)


def test_fair_shares():
    assert budget.quotas([("a", 10), ("b", 2), ("c", 30)], 12) == {"a": 5, "b": 2, "c": 5}
    assert budget.quotas([("a", 1), ("b", 1)], 50) == {"a": 1, "b": 1}
    assert budget.quotas([("a", 9), ("b", 9), ("c", 9)], 2) == {"a": 1, "b": 1, "c": 0}


def test_prefix_budget(spark):
    df = spark.createDataFrame([(1, 5), (2, 6), (3, 1)], "k int, c int")
    assert [r["k"] for r in budget.first_overflow(df, F.col("c"), [F.col("k")], 10).collect()] == [1]


@pytest.mark.parametrize("line,to,lost", [(1, 1, False), (2, 2, False), (3, 5, False), (10, 12, True), (11, 15, False), (20, 23, True), (25, 28, False)])
def test_line_shift(spark, line, to, lost):
    hunk = lambda *v: F.struct(*[F.lit(x).alias(k) for k, x in zip(("old_start", "old_count", "new_start", "new_count"), v)])
    h = F.array(hunk(2, 0, 3, 2), hunk(10, 1, 12, 3), hunk(20, 1, 23, 0))
    got = spark.range(1).select(history.shift_line(F.lit(line), h).alias("m")).first()["m"]
    assert (got["line"], got["lost"]) == (to, lost)


def test_carry_through_layers(spark):
    hunk = lambda *v: F.struct(*[F.lit(x).alias(k) for k, x in zip(("old_start", "old_count", "new_start", "new_count"), v)])
    layers = F.array(F.array(hunk(1, 0, 2, 1)), F.array(hunk(1, 0, 2, 5)))
    assert spark.range(1).select(history.carry(F.lit(4), layers).alias("m")).first()["m"]["line"] == 10


def test_changed_symbols(spark):
    s = "file string, key string, line int, end_line int"
    new = spark.createDataFrame([("f", "Alpha", 3, 5), ("f", "Beta", 7, 9), ("f", "Delta", 11, 13)], s)
    old = spark.createDataFrame([("f", "Alpha", 3, 5), ("f", "Beta", 7, 9), ("f", "Gamma", 11, 13)], s)
    hunks = spark.createDataFrame([("f", 4, 1, 4, 1), ("f", 11, 3, 11, 3), ("f", 1, 1, 1, 1)], "file string, old_start int, old_count int, new_start int, new_count int")
    got = {(r["key"], r["change"]) for r in history.changed_symbols(new, old, hunks).collect()}
    assert got == {("Alpha", "modified"), ("Delta", "added"), ("Gamma", "removed"), (None, "modified")}
    nested = spark.createDataFrame([("f", "S", 1, 10), ("f", "S.m", 4, 6)], s)
    one = spark.createDataFrame([("f", 5, 1, 5, 1)], "file string, old_start int, old_count int, new_start int, new_count int")
    assert {(r["key"], r["change"]) for r in history.changed_symbols(nested, nested, one).collect()} == {("S.m", "modified")}


def test_meets_moves_a_side_only_where_lengths_ask_for_it(spark):
    """Where one side is shorter throughout, there is one join and no side is placed for a second one."""
    short = spark.createDataFrame([("f", k, k + 1) for k in range(0, 40, 5)], "file string, s int, e int")
    long_ = spark.createDataFrame([("f", k, k + 60) for k in range(0, 90, 30)], "file string, x int, y int")
    want = {(k, x) for k in range(0, 40, 5) for x in range(0, 90, 30) if k <= x + 60 and k + 1 >= x}
    for a, b, names in ((short, long_, "sexy"), (long_, short, "xyse")):
        got = intervals.meets(a, b, "file", *names)
        assert {(r["s"], r["x"]) for r in got.collect()} == want and got.count() == len(want)
        assert got._jdf.queryExecution().optimizedPlan().toString().count("Join Inner") == 1


def test_cochange(spark):
    baskets = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "b"), (2, "c"), (3, "b"), (4, "a"), *[(4, f"x{k}") for k in range(9)]], "c int, i string")
    got = {r["i"]: (r["together"], r["weight"]) for r in history.cochange(baskets, "c", "i", "a", 5).collect()}
    assert got == {"b": (2, 2.0), "c": (1, 1.0)}


def test_freshness(spark):
    entry = "path string, server string, size int, mtime_ns int, hash string, has_outline boolean, has_imports boolean"
    index = spark.createDataFrame([("same", "s", 1, 1, "h", True, True), ("touched", "s", 1, 1, "h", True, True), ("changed", "s", 1, 1, "h", True, True), ("moved", "t", 1, 1, "h", True, True), ("gone", "s", 1, 1, "h", True, True), ("half", "s", 1, 1, "h", True, False), ("racy", "s", 1, 1, "h", True, True)], entry)
    now = spark.createDataFrame([("same", "s", 1, 1, "h", False), ("touched", "s", 1, 2, "h", False), ("changed", "s", 2, 2, "i", False), ("moved", "s", 1, 1, "h", False), ("new", "s", 1, 1, "h", False), ("half", "s", 1, 1, "h", False), ("racy", "s", 1, 1, "i", True)], "path string, server string, size int, mtime_ns int, hash string, racy boolean")
    got = {r["path"]: r["state"] for r in snapshot.freshness(index, now).collect()}
    assert got == {"same": "fresh", "touched": "touched", "changed": "changed", "moved": "changed", "gone": "removed", "new": "added", "half": "rebuilt", "racy": "changed"}
    assert snapshot.sync_report(snapshot.freshness(index, now)).first()["changed"] == 3


def test_skips(spark):
    rows = spark.createDataFrame([("a", bytearray(b"x" * 10)), ("b", bytearray(b"a\x00b")), ("c", bytearray(b"x" * 200)), ("d", None), ("e", bytearray(b"\x10\x01"))], "p string, content binary")
    assert {r["p"]: r["skip"] for r in snapshot.skip_reason(rows, most=100).collect()} == {"a": None, "b": "binary", "c": "too_large", "d": "unreadable", "e": None}


def test_diff_and_apply_are_inverse():
    rng = random.Random(1)
    for _ in range(1000):
        a, b = ("".join(rng.choice("abω\n") for _ in range(rng.randint(0, 16))) for _ in range(2))
        assert diffs.apply_edits(a, diffs.text_edits(a, b)) == b
    with pytest.raises(ValueError):
        diffs.apply_edits("abc", [(0, 2, ""), (1, 3, "")])
    assert diffs.merge_edits([(0, 1, "x")], [(0, 1, "x"), (2, 3, "y")]) == [(0, 1, "x"), (2, 3, "y")]
    assert diffs.merge_edits([(0, 2, "x")], [(1, 3, "y")]) is None
    assert "\\ No newline at end of file" in diffs.unified("a\nb", "a\nc\n")


def test_edits(spark):
    docs = spark.createDataFrame([("u", 100, 3)], "uri string, length int, version int")
    edits = spark.createDataFrame([("u", 0, 5, "", 3), ("u", 4, 6, "", 3), ("u", 90, 200, "", 3), ("u", 50, 60, "", 2), ("v", 0, 1, "", None), ("u", 30, 20, "", 3)], "uri string, start int, end int, new_text string, version int")
    got = {(r["uri"], r["start"]): r["problem"] for r in intervals.validate_edits(edits, docs).collect()}
    assert got == {("u", 0): None, ("u", 4): "overlap", ("u", 90): "range outside the document", ("u", 50): "stale version", ("v", 0): "unknown document", ("u", 30): "range is reversed"}


def test_innermost(spark):
    points = spark.createDataFrame([("f", 5), ("f", 2), ("f", 50)], "file string, at int")
    spans = spark.createDataFrame([("f", 1, 10, "outer", 1), ("f", 4, 6, "inner", 2), ("f", 4, 6, "later", 3)], "file string, line int, end_line int, id string, ord int")
    got = {r["at"]: r["id"] for r in intervals.innermost(points, spans, "file", "at", "line", "end_line", ["file", "at"], "ord").collect()}
    assert got == {5: "later", 2: "outer", 50: None}


def test_verdicts(spark):
    rows = spark.createDataFrame([("go", "Foo", ""), ("go", "foo", ""), ("python", "_x", ""), ("python", "x", ""), ("rust", "x", "pub fn x"), ("rust", "x", "pub(crate) fn x"), ("c", "x", "static int x")], "l string, n string, s string")
    strict = [r[0] for r in rows.select(verdicts.exportedness(F.col("l"), F.col("n"), F.col("s"))).collect()]
    loose = [r[0] for r in rows.select(verdicts.exportedness(F.col("l"), F.col("n"), F.col("s"), strict=False)).collect()]
    assert strict == ["yes", "no", "no", "unknown", "yes", "no", "no"]
    assert loose == ["yes", "no", "no", "yes", "yes", "unknown", "no"]
    cands = spark.createDataFrame([("a", "f", 1, 5), ("b", "f", 6, 9), ("c", "f", 10, 12)], "id string, path string, line int, end_line int")
    refs = spark.createDataFrame([("a", "f", 3), ("b", "f", 2)], "id string, path string, line int")
    assert [r["id"] for r in verdicts.unreferenced(cands, refs).orderBy("id").collect()] == ["a", "c"]
    syms = spark.createDataFrame([("x.a.b",), ("a.b",), ("b",), ("c.b",)], "q string")
    assert [r["q"] for r in verdicts.dotted_suffix(syms, "q", "a.b").collect()] == ["a.b"]
    assert sorted(r["q"] for r in verdicts.dotted_suffix(syms.where("q <> 'a.b'"), "q", "a.b").collect()) == ["x.a.b"]


def test_repo_map(spark):
    files = spark.createDataFrame([("a.go", 0.2), ("b.go", 0.0), ("c.go", 0.5)], "path string, rank double")
    syms = spark.createDataFrame([(f"{p}.go", f"{p}{k}", f"F{k}", "function", "", 0, "", k, True) for p in "abc" for k in range(4)], "path string, id string, name string, kind string, signature string, depth int, parent_kind string, line int, exported boolean")
    rows = verdicts.repo_map(files, syms, 10_000, per_file=2).orderBy("file_rank", "k").collect()
    assert [r["text"] for r in rows if r["k"] == 0] == ["c.go", "a.go", "b.go"] and len(rows) == 9
    some = verdicts.repo_map(files, syms, 30, per_file=2).collect()
    assert sum(r["cost"] for r in some) <= 30 and len(some) == 2


def test_fair_cap_with_a_null_source(spark):
    df = spark.createDataFrame([(s, k) for s in ("a", None, "b") for k in range(10)], "source string, k int")
    got = budget.fair_cap(df, "source", [F.col("k")], 9, F.lit(0)).groupBy("source").count().collect()
    assert {r["source"]: r["count"] for r in got} == {"a": 3, None: 3, "b": 3}


def test_required_literals():
    from corvane.operators.grep import required_literal

    for pattern, want in ((r"[a-z]+\.[0-9]{2}@mail[0-9]", "@mail"), ("abc*d", "ab"), ("x(yz)?w", "x"), ("foo|bar", ""), ("colou?r", "colo"), ("a{2}bc", "bc"), (r"\d+abc", "abc")):
        assert required_literal(pattern) == want


def test_prefilter_keeps_what_folds(spark):
    """Texts whose letters fold to a query's without case pass the cheap test."""
    from corvane.operators import grep

    df = spark.createDataFrame([(1, "MA\u0130L here"), (2, "mail"), (3, "Ma\u0131l"), (4, "none"), (5, "\u212aelvin"), (6, "\u017fong")], "id int, text string")
    for q in ("mail", "kelvin", "song"):
        slow = {r["id"] for r in grep.lines(df, "id", "text").where(F.col("text").rlike(grep.pattern_of(q))).collect()}
        assert {r["id"] for r in grep.search_text(df, "id", "text", q).collect()} == slow


def test_innermost_held_moves_points_once(spark):
    points = spark.createDataFrame([("f", 5), ("f", 50), ("g", 5)], "file string, at int")
    spans = spark.createDataFrame([("f", "outer", 1, 20), ("f", "inner", 4, 6)], "file string, id string, line int, end_line int")
    got = intervals.innermost_held(points, spans, "file", "at", "line", "end_line", ["file", "at"], "id")
    assert [(r["file"], r["at"], r["id"]) for r in got.collect()] == [("f", 5, "inner")]
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_innermost_against_all_pairs(spark):
    import random

    rng = random.Random(4)
    spans = [(k % 3, k, a, a + rng.choice([0, 1, 5, 40, 300])) for k, a in enumerate(rng.randint(-200, 200) for _ in range(120))]
    points = sorted({(f, rng.randint(-250, 600)) for f in range(4) for _ in range(60)})
    got = intervals.innermost(spark.createDataFrame(points, "f int, at int"), spark.createDataFrame(spans, "f int, k int, s int, e int"), "f", "at", "s", "e", ["f", "at"], "k").collect()
    want = {}
    for f, at in points:
        inside = [(e - s, -k, k) for g, k, s, e in spans if g == f and s <= at <= e]
        want[f, at] = min(inside)[2] if inside else None
    assert {(r["f"], r["at"]): r["k"] for r in got} == want


def test_ranges_meet_against_all_pairs(spark):
    import random

    rng = random.Random(6)
    span = lambda k: (k % 3, k, s := rng.randint(-300, 300), s + rng.choice([0, 0, 1, 2, 7, 8, 63, 64, 500, -1]))
    a, b = [span(k) for k in range(150)], [span(k) for k in range(120)] + [(0, 120, -1000, 1000)]
    got = intervals.meets(spark.createDataFrame(a, "f int, i int, s int, e int"), spark.createDataFrame(b, "f int, j int, x int, y int"), "f", "s", "e", "x", "y").collect()
    want = {(i, j) for f, i, s, e in a for g, j, x, y in b if f == g and s <= e and x <= y and s <= y and x <= e}
    assert len(got) == len(want) and {(r["i"], r["j"]) for r in got} == want and set(got[0].asDict()) == set("fisejxy")


def test_overlap_counts_against_all_pairs(spark):
    import random

    rng = random.Random(5)
    rows = [(k % 2, a, a + rng.randint(0, 9)) for k, a in enumerate(rng.randint(0, 60) for _ in range(80))]
    want = {f: sum(a[1] <= b[2] and b[1] <= a[2] for i, a in enumerate(rows) for b in rows[:i] if a[0] == b[0] == f) for f in (0, 1)}
    got = intervals.overlap_counts(spark.createDataFrame(rows, "f int, s int, e int"), "f", "s", "e").collect()
    assert {r["f"]: r["pairs"] for r in got} == want


def test_surrogates_are_not_split(spark):
    docs = spark.createDataFrame([("u", 4, 1, "a\U0001f600b")], "uri string, length int, version int, text string")
    edits = spark.createDataFrame([("u", 2, 3, "x", 1), ("u", 3, 3, "y", 1)], "uri string, start int, end int, new_text string, version int")
    got = {r["start"]: r["problem"] for r in intervals.validate_edits(edits, docs).collect()}
    assert got == {2: "position inside a character", 3: None}
