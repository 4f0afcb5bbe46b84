import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from corvane.operators import graph


def edges_df(spark, edges):
    return spark.createDataFrame(edges, "src string, dst string")


def closure(edges):
    nodes = {n for e in edges for n in e}
    reach = {n: {b for a, b in edges if a == n} for n in nodes}
    changed = True
    while changed:
        changed = False
        for n in nodes:
            more = set().union(*(reach[m] for m in reach[n])) - reach[n] if reach[n] else set()
            if more:
                reach[n] |= more
                changed = True
    return reach


def test_cycles(spark):
    e = [("a", "b"), ("b", "a"), ("c", "d"), ("d", "e"), ("e", "c"), ("e", "e"), ("f", "a"), ("s", "s")]
    comps = graph.components_strong(edges_df(spark, e))
    assert {(r["id"], r["component"]) for r in comps.collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c"), ("e", "c"), ("s", "s")}
    paths = {r["component"]: r["nodes"] for r in graph.cycle_paths(edges_df(spark, e), comps).collect()}
    assert paths == {"a": ["a", "b"], "c": ["c", "d", "e"], "s": ["s"]}


@pytest.mark.parametrize("seed", range(3))
def test_strong_components_by_closure(spark, seed):
    rng = random.Random(seed)
    e = sorted({(f"n{rng.randint(0, 30):02}", f"n{rng.randint(0, 30):02}") for _ in range(45)})
    reach = closure(e)
    want = {(n, min(m for m in reach[n] if n in reach[m])) for n in reach if n in reach[n]}
    assert {(r["id"], r["component"]) for r in graph.components_strong(edges_df(spark, e)).collect()} == want


def test_strong_components_of_a_chain_in_few_rounds(spark, monkeypatch):
    """Rings in a row, each reached from all before it: both labels together part them in two rounds, one alone takes a round for each."""
    n = 8
    e = [(f"n{k:02}{a}", f"n{k:02}{b}") for k in range(n) for a, b in ("ab", "ba")] + [(f"n{k:02}b", f"n{k + 1:02}a") for k in range(n - 1)]
    cuts, cut = [], graph.cut
    monkeypatch.setattr(graph, "cut", lambda df: cuts.append(1) or cut(df))
    got = {(r["id"], r["component"]) for r in graph.components_strong(edges_df(spark, e)).collect()}
    assert got == {(f"n{k:02}{a}", f"n{k:02}a") for k in range(n) for a in "ab"}
    assert len(cuts) <= 25


def test_no_cycles(spark):
    assert graph.components_strong(edges_df(spark, [("a", "b"), ("b", "c")])).count() == 0


def test_walks(spark):
    e = edges_df(spark, [("a", "b"), ("b", "c"), ("c", "d"), ("x", "a"), ("d", "a")])
    roots = spark.createDataFrame([("a",)], "id string")
    at = lambda depth, way: {r["id"]: r["depth"] for r in graph.walk(e, roots, depth, way).collect()}
    assert at(2, "out") == {"a": 0, "b": 1, "c": 2}
    assert at(1, "in") == {"a": 0, "x": 1, "d": 1}
    assert at(9, "both") == {"a": 0, "b": 1, "x": 1, "d": 1, "c": 2}
    reached = graph.walk(e, roots, 3, "out")
    assert graph.walk_edges(e, reached, 3).count() == 3


def test_pagerank(spark):
    e = [("a", "b"), ("b", "c"), ("c", "a"), ("d", "a"), ("a", "d"), ("e", "f")]
    nodes = sorted({n for x in e for n in x})
    rank = {n: 1 / len(nodes) for n in nodes}
    out = {n: {b for a, b in e if a == n} for n in nodes}
    for _ in range(200):
        loose = sum(rank[n] for n in nodes if not out[n])
        rank = {n: 0.15 / len(nodes) + 0.85 * (sum(rank[m] / len(out[m]) for m in nodes if n in out[m]) + loose / len(nodes)) for n in nodes}
    got = {r["id"]: r["rank"] for r in graph.pagerank(edges_df(spark, e)).collect()}
    assert got == pytest.approx(rank, abs=1e-8) and sum(got.values()) == pytest.approx(1)
    files = spark.createDataFrame([("x/1.go", "a", False), ("x/2.go", "a", False), ("x/2_test.go", "a", True), ("y/only_test.go", "b", True)], "path string, package string, is_test boolean")
    shared = {r["path"]: r["rank"] for r in graph.file_ranks(graph.pagerank(edges_df(spark, e), rounds=5), files).collect()}
    assert set(shared) == {"x/1.go", "x/2.go", "y/only_test.go"} and sum(shared.values()) == pytest.approx(1)
    assert graph.pagerank(edges_df(spark, [])).count() == 0


def test_depths(spark):
    rows = spark.createDataFrame([(k, k - 1 if k else None) for k in range(70)], "k int, up int")
    assert {r["k"]: r["depth"] for r in graph.chain_depth(rows, "k", "up").collect()} == {k: min(k, 64) for k in range(70)}


def test_hierarchy(spark):
    e = edges_df(spark, [("a", "b"), ("a", "c"), ("b", "c"), ("c", "a")])
    got = graph.hierarchy(e, spark.createDataFrame([("a",)], "id string"), 3).collect()
    assert [(r["id"], r["depth"], r["repeat"]) for r in got] == [("a", 0, False), ("b", 1, False), ("c", 2, False), ("a", 3, False), ("c", 1, True)]  # at the depth nothing is expanded, so nothing repeats


def depth_first(edges, roots, depth, limit):
    kids, rows, expanded = defaultdict(set), [], set()
    for a, b in edges:
        kids[a].add(b)

    def visit(path):
        if len(rows) >= limit:
            return
        d, node = len(path) - 1, path[-1]
        again = d < depth and node in expanded
        rows.append((path, d, again))
        if d < depth and not again:
            expanded.add(node)
            for c in sorted(kids[node]):
                visit([*path, c])

    for r in sorted(roots):
        visit([r])
    return rows


@pytest.mark.parametrize("seed, n, m, depth, limit", [(1, 8, 20, 4, 500), (2, 12, 40, 5, 60), (3, 5, 25, 6, 33), (4, 30, 60, 3, 17), (5, 6, 36, 9, 500)])
def test_hierarchy_against_recursion(spark, seed, n, m, depth, limit):
    """Graphs with cycles, loops and diamonds, cut in the middle too."""
    rng = random.Random(seed)
    e = [(f"n{rng.randrange(n):02}", f"n{rng.randrange(n):02}") for _ in range(m)]
    roots = [f"n{k:02}" for k in rng.sample(range(n), 2)]
    got = graph.hierarchy(edges_df(spark, e), spark.createDataFrame([(r,) for r in roots], "id string"), depth, limit).collect()
    assert sorted((r["path"], r["depth"], r["repeat"]) for r in got) == sorted(depth_first(e, roots, depth, limit))


def breadth_first(kinds, edges, roots, depth, direction, ext, most):
    out, into, seen, links, truncated = defaultdict(set), defaultdict(set), {}, set(), False
    for a, b in edges:
        out[a].add(b)
        into[b].add(a)
    queue = []

    def meet(node, d, kind):
        nonlocal truncated
        if node in seen:
            return True
        if len(seen) >= most:
            truncated = True
            return False
        seen[node] = (kind, d)
        if kind != "external":
            queue.append((node, d))
        return True

    for r in sorted(roots):
        meet(r, 0, kinds.get(r, "file"))
    while queue:
        node, d = queue.pop(0)
        if d >= depth:
            continue
        for way, others in ((0, out[node] if direction != "in" else ()), (1, ext.get(node, ()) if direction != "in" else ()), (2, into[node] if direction != "out" else ())):
            for other in sorted(others):
                if meet(other, d + 1, "external" if way == 1 else kinds.get(other, "file")):
                    links.add((other, node, False) if way == 2 else (node, other, way == 1))
    return {(k, *v) for k, v in seen.items()}, links, truncated


@pytest.mark.parametrize("direction", ["out", "in", "both"])
@pytest.mark.parametrize("depth, most", [(3, 5000), (3, 9)])
def test_dependency_graph(spark, direction, depth, most):
    rng = random.Random(depth * most)
    names = [f"n{k:02}" for k in range(25)]
    e = [(rng.choice(names), rng.choice(names)) for _ in range(50)]
    kinds, ext = {n: rng.choice(["file", "package"]) for n in names[:20]}, {n: {f"ext{rng.randrange(6)}" for _ in range(2)} for n in names[::2]}
    nodes = spark.createDataFrame(list(kinds.items()), "id string, kind string")
    df = spark.createDataFrame([(a, b, f"{b}.h") for a, b in e], "src string, dst string, spec string")
    outer = spark.createDataFrame([(a, x) for a, xs in ext.items() for x in xs], "src string, spec string")
    got = graph.dependency_graph(nodes, df, spark.createDataFrame([("n03",), ("n01",)], "id string"), depth, direction, outer, most)
    want = breadth_first(kinds, e, ["n03", "n01"], depth, direction, ext, most)
    assert ({tuple(r) for r in got.nodes.collect()}, {(r["src"], r["dst"], r["external"]) for r in got.edges.collect()}, got.truncated) == want


def test_whole_graph(spark):
    nodes = spark.createDataFrame([(f"n{k}", "file") for k in range(6)], "id string, kind string")
    df = spark.createDataFrame([("n0", "n1", "b"), ("n0", "n1", "a"), ("n1", "n5", "x")], "src string, dst string, spec string")
    outer = spark.createDataFrame([("n1", "fmt"), ("n5", "os")], "src string, spec string")
    got = graph.dependency_graph(nodes, df, externals=outer, most=4)
    assert got.truncated and {tuple(r) for r in got.nodes.collect()} == {*[(f"n{k}", "file", 0) for k in range(4)], ("fmt", "external", 0)}
    assert {tuple(r) for r in got.edges.collect()} == {("n0", "n1", "a", False), ("n1", "fmt", "fmt", True)}


def test_test_only_importers(spark):
    rows = "src string, dst string, package string"
    tests = spark.createDataFrame([("p/a_test", "u", "p"), ("q/a_test", "u", "q"), ("u/a_test", "u", "u")], rows)
    prod = spark.createDataFrame([("q/a", "u", "q")], rows)
    assert [r["src"] for r in graph.test_only_importers(tests, prod, "u", "package", "u").collect()] == ["p/a_test"]


def test_symbol_depth_walks_the_whole_chain(spark, tmp_path):
    from corvane.plans import queries

    spark.range(100).selectExpr("1L as conv_id", "cast(id as int) as turn").write.parquet(f"{tmp_path}/conversations.parquet")
    assert {r["turn"]: r["depth"] for r in queries.symbol_depth(spark, str(tmp_path)).collect()} == {k: k for k in range(100)}


def test_nearest_ancestor(spark):
    rng = random.Random(8)
    rows = [(k, rng.randrange(k) if k and rng.random() < 0.97 else (None if rng.random() < 0.5 else 10_000), rng.random() < 0.15) for k in range(150)]
    rows += [(200 + k, 199 + k if k else None, k == 0) for k in range(70)]  # a chain whose top alone is wanted
    of = {k: (p, w) for k, p, w in rows}

    def near(k):
        while (k := of[k][0]) in of:
            if of[k][1]:
                return k

    got = graph.nearest_ancestor(spark.createDataFrame(rows, "id int, parent int, w boolean"), "id", "parent", F.col("w")).collect()
    assert len(got) == len(rows) and {r["id"]: r["ancestor"] for r in got} == {k: near(k) for k in of}
