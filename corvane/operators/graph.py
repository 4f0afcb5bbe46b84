"""Graph analytics over an edge table: walks, importers, cycles, ranks. Loops run on DataFrames and cut their lineage."""

from __future__ import annotations

import functools
import tempfile
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: nodes of a walk.
MAX_NODES = 5000
DAMPING, EPSILON, MAX_ROUNDS = 0.85, 1e-10, 100
#: Steps along edges between two checkpoints. A node's row is hashed in each, so that the edges need not be sorted.
STEPS = 7


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the folder that the session names; only a local master (tests) may do without one."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir names no shared folder")
        spark.sparkContext.setCheckpointDir(named or tempfile.mkdtemp(prefix="corvane-graph-"))
    return df.checkpoint(eager=True)


def shares(rows: DataFrame, each: int = 500_000) -> int:
    """How many partitions keep about `each` rows in one, so that a task's memory does not grow with the table."""
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), -(-rows.count() // each))


def edges_of(imports: DataFrame, source: str, target: str, spec: str | None = None) -> DataFrame:
    """Distinct edges src, dst, with the least spec of each; order them by these three."""
    rows = imports.select(F.col(source).alias("src"), F.col(target).alias("dst"), (F.col(spec) if spec else F.lit("")).alias("spec"))
    return rows.groupBy("src", "dst").agg(F.min("spec").alias("spec"))


def nodes_of(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("src").alias("id")).union(edges.select(F.col("dst").alias("id"))).distinct()


def walk(edges: DataFrame, roots: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """id and depth of what is reached from roots (id) in at most depth steps; direction is out, in or both."""
    steps = {"out": [("src", "dst")], "in": [("dst", "src")], "both": [("src", "dst"), ("dst", "src")]}[direction]
    seen = cut(roots.select("id").distinct().withColumn("depth", F.lit(0)))
    front = seen
    for d in range(1, depth + 1):
        found = None
        for a, b in steps:
            part = front.select(F.col("id").alias(a)).join(edges, a).select(F.col(b).alias("id"))
            found = part if found is None else found.union(part)
        front = cut(found.distinct().join(seen.select("id"), "id", "left_anti").withColumn("depth", F.lit(d)))
        if not front.limit(1).count():
            break
        seen = seen.unionByName(front)
    return seen


def walk_edges(edges: DataFrame, reached: DataFrame, depth: int, direction: str = "out") -> DataFrame:
    """The edges that a walk follows: out of (or into) nodes that it expands."""
    open_ = reached.where(F.col("depth") < depth).select("id")
    out = edges.join(open_, edges["src"] == open_["id"], "left_semi")
    into = edges.join(open_, edges["dst"] == open_["id"], "left_semi")
    return {"out": out, "in": into, "both": out.unionByName(into).distinct()}[direction]


def importers(edges: DataFrame, target: Column) -> DataFrame:
    """Edges into what target says; target is a condition on dst."""
    return edges.where(target)


def find_importers(edges: DataFrame, targets: DataFrame, tests: DataFrame | None = None) -> DataFrame:
    """Importers of targets (target, dst: a file, the files of a directory, or a package). edges: src, dst, line. tests: further
    edges that count only where they are wanted. Rows in order of file and line."""
    rows = edges if tests is None else edges.unionByName(tests)
    return targets.join(rows, "dst").select("target", F.col("src").alias("path"), "line").distinct().orderBy("target", "path", "line")


def node_lookup(asked: DataFrame, files: DataFrame, nodes: DataFrame, packages: DataFrame) -> DataFrame:
    """asked (name) with its node: of a file (files: path, node), a node itself (nodes: id), or an import path (packages: spec, node), the first that there is. A leading ./ and a trailing / don't count."""
    name = F.regexp_replace(F.regexp_replace("name", r"^\./", ""), r"/$", "")
    rows = asked.withColumn("_n", F.when(name == "", F.lit(".")).otherwise(name))
    rows = rows.join(files.select(F.col("path").alias("_n"), F.col("node").alias("_a")), "_n", "left")
    rows = rows.join(nodes.select(F.col("id").alias("_n")).distinct().withColumn("_b", F.col("_n")), "_n", "left")
    rows = rows.join(packages.select(F.col("spec").alias("_n"), F.col("node").alias("_c")), "_n", "left")
    return rows.select("name", F.coalesce("_a", "_b", "_c").alias("node"))


def roots_under(nodes: DataFrame, prefix: str) -> DataFrame:
    """The nodes at or beneath a directory, as roots of a walk."""
    from corvane.operators.paths import in_scope

    return nodes.where(in_scope(F.col("id"), prefix)).select("id")


def test_only_importers(test_edges: DataFrame, edges: DataFrame, target: str, package: str, own_package: str) -> DataFrame:
    """Tests that import target from packages with no other import of it, the target's own package apart."""
    prod = edges.where(F.col("dst") == target).select(package)
    return test_edges.where((F.col("dst") == target) & (F.col(package) != own_package)).join(prod, package, "left_anti")


def _arcs(edges: DataFrame) -> DataFrame:
    """Every edge from both of its ends: id, to and along (it is followed from src to dst)."""
    ends = F.array(F.struct(F.col("src").alias("id"), F.col("dst").alias("to"), F.lit(True).alias("along")), F.struct(F.col("dst").alias("id"), F.col("src").alias("to"), F.lit(False).alias("along")))
    return edges.select(F.explode(ends).alias("x")).select("x.*")


def trim(edges: DataFrame) -> DataFrame:
    """Edges that can lie on a cycle: nodes without way in or way out are taken off again and again."""
    live = cut(edges.select("src", "dst").where("src is not null and dst is not null").distinct())
    own = lambda id_, kept, in_, out: F.struct(id_.alias("id"), kept.alias("kept"), in_.alias("in_"), out.alias("out"))
    while True:
        arcs = _arcs(live)
        at = nodes_of(live).withColumn("stays", F.lit(True))
        for _ in range(STEPS):  # one exchange each; that of the edges is shared
            told = at.where("stays").hint("shuffle_hash").join(arcs, "id").select(F.explode(F.array(own(F.col("id"), F.lit(True), F.lit(False), F.lit(False)), own(F.col("to"), F.lit(False), F.col("along"), ~F.col("along")))).alias("x"))
            told = told.select("x.*").groupBy("id").agg(*[F.max(c).alias(c) for c in ("kept", "in_", "out")])
            at = told.where("kept").select("id", (F.col("in_") & F.col("out")).alias("stays"))
        at = cut(at)
        if not at.where("not stays").limit(1).count():
            return cut(_within(live, at.select("id")))
        live = cut(_within(live, at.where("stays").select("id")))


def _within(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among nodes."""
    return edges.join(nodes.withColumnRenamed("id", "src"), "src", "left_semi").join(nodes.withColumnRenamed("id", "dst"), "dst", "left_semi").select("src", "dst")


def _least_both_ways(edges: DataFrame) -> DataFrame:
    """id, above (the least node from which it is reached) and below (the least node that it reaches), itself included."""
    arcs = _arcs(edges)
    at = nodes_of(edges).select("id", F.col("id").alias("above"), F.col("id").alias("below"), F.lit(True).alias("up"), F.lit(True).alias("down"))
    kind = edges.schema["src"].dataType
    none = F.lit(None).cast(kind)
    row = lambda id_, *values: F.struct(id_.alias("id"), *[v.alias(k) for v, k in zip(values, ("above", "below", "_above", "_below"))])
    while True:
        for _ in range(STEPS):  # each takes the one before it once; only what moved is told
            told = F.when(F.col("along") & F.col("up"), F.col("above")), F.when(~F.col("along") & F.col("down"), F.col("below"))
            sent = at.hint("shuffle_hash").join(arcs, "id").select(F.explode(F.array(row(F.col("id"), F.col("above"), F.col("below"), F.col("above"), F.col("below")), row(F.col("to"), *told, none, none))).alias("x"))
            sent = sent.select("x.*").where("above is not null or below is not null").groupBy("id").agg(F.min("above").alias("above"), F.min("below").alias("below"), F.max("_above").alias("_above"), F.max("_below").alias("_below"))
            at = sent.select("id", "above", "below", (F.col("above") < F.col("_above")).alias("up"), (F.col("below") < F.col("_below")).alias("down"))
        at = cut(at)
        if not at.where("up or down").limit(1).count():
            return at.select("id", "above", "below")


def components_strong(edges: DataFrame) -> DataFrame:
    """id and component (its least node) for all nodes on cycles: least labels, spread along and against the edges at once.

    A node whose least ancestor is its least descendant too lies in that one's component, and leaves the graph with it.
    Nodes of one component share both labels, so edges between different ones go too; the least node of what is left is found
    in the next round. No closure is built.
    """
    live = trim(edges)
    done = []
    while live.limit(1).count():
        label = _least_both_ways(live)
        found = label.where("above = below").select("id", F.col("above").alias("component"))
        sizes = found.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
        loops = live.where("src = dst").select(F.col("src").alias("id")).distinct().withColumn("_loop", F.lit(True))
        done.append(cut(found.join(sizes, "component").join(loops, "id", "left").where("n > 1 or _loop").select("id", "component")))
        rest = label.where("above <> below")
        side = lambda end: rest.select(F.col("id").alias(end), F.col("above").alias(f"_a_{end}"), F.col("below").alias(f"_b_{end}"))
        live = cut(live.join(side("src"), "src").join(side("dst"), "dst").where("_a_src = _a_dst and _b_src = _b_dst").select("src", "dst"))
        if live.limit(1).count():
            live = trim(live)
    if not done:
        return edges.select(F.col("src").alias("id"), F.col("src").alias("component")).limit(0)
    return functools.reduce(DataFrame.unionByName, done)


def cycle_paths(edges: DataFrame, members: DataFrame) -> DataFrame:
    """component and its nodes in breadth-first order from the least one, joined; members: id, component."""
    inner = edges.join(members.select(F.col("id").alias("src"), F.col("component").alias("_a")), "src").join(members.select(F.col("id").alias("dst"), F.col("component").alias("_b")), "dst").where("_a = _b")
    inner = cut(inner.select(F.col("_a").alias("component"), F.col("src").alias("id"), "dst").distinct())
    order = cut(members.where("id = component").select("component", "id", F.lit(0).alias("depth")))
    front, d = order, 0
    while front.limit(1).count():
        d += 1
        step = front.select("component", "id").join(inner, ["component", "id"]).select("component", F.col("dst").alias("id")).distinct()
        front = cut(step.join(order, ["component", "id"], "left_anti").withColumn("depth", F.lit(d)))
        order = order.unionByName(front)
    listed = F.sort_array(F.collect_list(F.struct("depth", "id")))
    return order.groupBy("component").agg(F.transform(listed, lambda x: x.id.cast("string")).alias("nodes")).withColumn("length", F.size("nodes")).orderBy("component", "length")


def pagerank(edges: DataFrame, nodes: DataFrame | None = None, rounds: int | None = None, damping: float = DAMPING, every: int = 5) -> DataFrame:
    """id and rank, summing to 1. A fixed number of rounds, or until the ranks move less than EPSILON in all (looked at every few rounds).

    The step is linear but for what dangling nodes give to all alike. So the links alone carry a vector of ones along,
    round by round, and a rank is a sum of these vectors whose coefficients follow from their sums over dangling nodes:
    one join and one sum a round, and no other use of the round before.
    """
    links = edges.select("src", "dst").distinct()
    ids = cut((nodes.select("id").distinct() if nodes is not None else nodes_of(links)))
    n = ids.count()
    if not n:
        return ids.withColumn("rank", F.lit(0.0))
    degree = links.groupBy("src").agg(F.count(F.lit(1)).alias("deg"))
    links = cut(links.join(degree, "src"))
    loose = cut(ids.join(degree, ids["id"] == degree["src"], "left_anti"))
    vectors, sums, now = [], [(float(n), float(loose.count()))], ids.withColumn("v", F.lit(1.0))
    most = rounds or MAX_ROUNDS
    for k in range(1, most + 1):
        now = cut(links.join(now.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("v") / F.col("deg")).alias("v")))
        vectors.append(now)
        last = k == most or not now.limit(1).count()  # without cycles the links run out
        if last or (rounds is None and k % every == 0):
            sums += _sums(vectors[len(sums) - 1 :], loose)
            still = _weights(sums, most if last else k, n, damping, rounds is None)
            if last or still[1]:
                return _combined(ids, vectors, still[0])


def _sums(vectors: list[DataFrame], loose: DataFrame) -> list[tuple[float, float]]:
    """Of each vector the sum, and that over dangling nodes."""
    every = None
    for k, v in enumerate(vectors):
        part = v.join(loose.withColumn("_l", F.lit(1)), "id", "left").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("a"), F.coalesce(F.sum(F.when(F.col("_l") == 1, F.col("v"))), F.lit(0.0)).alias("l")).withColumn("k", F.lit(k))
        every = part if every is None else every.unionByName(part)
    got = {r["k"]: (r["a"], r["l"]) for r in every.collect()}  # one row for each vector
    return [got[k] for k in range(len(vectors))]


def _weights(sums: list[tuple[float, float]], rounds: int, n: int, damping: float, stop: bool) -> tuple[list[float], bool]:
    """How much of each vector the ranks hold after some rounds, or (stop) after those from which they are still; and whether they are.
    Vectors beyond those known are zero."""
    of = lambda k: sums[k] if k < len(sums) else (0.0, 0.0)
    now = [1.0 / n]
    for _ in range(rounds):
        new = [(1 - damping) / n + damping * sum(w * of(k)[1] for k, w in enumerate(now)) / n] + [damping * w for w in now]
        # no rank moves by more than its parts do
        moved = sum(abs(a - b) * of(k)[0] for k, (a, b) in enumerate(zip(new, [*now, 0.0])))
        now = new
        if stop and moved < EPSILON:
            return now, True
    return now, False


def _combined(ids: DataFrame, vectors: list[DataFrame], weights: list[float]) -> DataFrame:
    rows = ids.select("id", F.lit(weights[0]).alias("part"))
    for v, w in zip(vectors, weights[1:]):
        rows = rows.unionByName(v.select("id", (F.col("v") * w).alias("part")))
    return rows.groupBy("id").agg(F.sum("part").alias("rank"))


def file_ranks(package_ranks: DataFrame, files: DataFrame) -> DataFrame:
    """A package's rank in equal parts for its files that are no tests (for all if only tests), then to a sum of 1. files: path, package, is_test."""
    prod = files.groupBy("package").agg(F.count_if(~F.col("is_test")).alias("prod"), F.count(F.lit(1)).alias("every"))
    rows = files.join(prod, "package").where((F.col("prod") == 0) | ~F.col("is_test")).join(package_ranks.withColumnRenamed("id", "package"), "package")
    rows = rows.withColumn("rank", F.col("rank") / F.when(F.col("prod") == 0, F.col("every")).otherwise(F.col("prod")))
    total = rows.agg(F.sum("rank").alias("total"))
    return rows.crossJoin(F.broadcast(total)).select("path", (F.col("rank") / F.col("total")).alias("rank"))


def chain_depth(rows: DataFrame, key: str, parent: str, most: int = 64) -> DataFrame:
    """Depth of each row under its parents, by pointer doubling: every round doubles the steps known."""
    at = cut(rows.select(F.col(key).alias("k"), F.col(parent).alias("up"), F.when(F.col(parent).isNull(), 0).otherwise(1).alias("depth")))
    for _ in range(max(1, (most - 1).bit_length())):
        nxt = at.select(F.col("k").alias("up"), F.col("up").alias("_up"), F.col("depth").alias("_d"))
        at = cut(at.join(nxt, "up", "left").select("k", F.col("_up").alias("up"), F.least(F.col("depth") + F.coalesce("_d", F.lit(0)), F.lit(most)).alias("depth")))
        if not at.where("up is not null").limit(1).count():
            break
    return at.select(F.col("k").alias(key), "depth")


def nearest_ancestor(rows: DataFrame, key: str, parent: str, wanted: Column, most: int = 1 << 20) -> DataFrame:
    """Each row's nearest ancestor for which wanted holds: key and ancestor (null: none in `most` steps).

    By pointer doubling that carries what was found: a row knows the nearest one of its first n ancestors and the n-th,
    and takes from that one the next n. Rows that know their answer take no part in later rounds.
    """
    own = rows.select(F.col(key).alias("k"), F.col(parent).alias("up"), F.when(wanted, F.col(key)).alias("own"))
    above = own.select(F.col("k").alias("up"), F.col("own").alias("near"), F.lit(True).alias("there"))
    at = cut(own.join(above, "up", "left").select("k", F.when(F.col("there"), F.col("up")).alias("up"), "near"))
    done, steps = None, 1
    while steps < most:
        ready = at.where("near is not null or up is null").select("k", F.col("near").alias("ancestor"))
        done = ready if done is None else done.unionByName(ready)
        rest = at.where("near is null and up is not null")
        if not rest.limit(1).count():
            return done.withColumnRenamed("k", key)
        far = at.select(F.col("k").alias("up"), F.col("up").alias("_up"), F.col("near").alias("_near"))
        # ancestors that are done already keep what they know
        known = done.select(F.col("k").alias("up"), F.lit(None).cast(rows.schema[parent].dataType).alias("_up"), F.col("ancestor").alias("_near"))
        far = cut(far.where("_near is null and _up is not null").unionByName(known))
        at = cut(rest.join(far, "up", "left").select("k", F.col("_up").alias("up"), F.col("_near").alias("near")))
        steps *= 2
    return done.unionByName(at.select("k", F.col("near").alias("ancestor"))).withColumnRenamed("k", key)


def hierarchy(edges: DataFrame, roots: DataFrame, depth: int, limit: int = 500) -> DataFrame:
    """Depth-first listing of callers or callees, or of super- or subtypes: path, id, depth, repeat; children by id.

    A node is expanded where the listing first meets it above the depth, and listed wherever it is met; later places are
    marked repeat. Depth first is the order of paths, so a node's place is its least path from an expanded node; there is
    one such set of places, and rounds of least paths come to it from below. A row hangs on smaller rows alone, so each
    round keeps the first limit rows of its listing and no more; children of a node that has many are cut with it.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null")
    tops = cut(roots.select("id").distinct().orderBy("id").limit(limit).select(F.array("id").alias("path")))
    listing, places = tops, None
    while True:
        met = listing.where(F.size("path") <= depth).groupBy(F.element_at("path", -1).alias("src")).agg(F.min("path").alias("path"))
        met = cut(met.coalesce(1))
        if places is not None and met.count() == places.count() and not met.join(F.broadcast(places), ["src", "path"], "left_anti").limit(1).count():
            break
        places = met  # limit rows at most
        below = links.join(F.broadcast(places), "src").select(F.concat("path", F.array("dst")).alias("path")).distinct()
        listing = cut(tops.unionByName(below).orderBy("path").limit(limit))
    again = (F.size("path") <= depth) & (F.col("path") != F.col("_first"))
    rows = listing.withColumn("id", F.element_at("path", -1)).join(F.broadcast(places.select(F.col("src").alias("id"), F.col("path").alias("_first"))), "id", "left")
    return rows.select("path", "id", (F.size("path") - 1).alias("depth"), F.coalesce(again, F.lit(False)).alias("repeat"))


@dataclass
class Walk:
    """nodes: id, kind, depth. edges: src, dst, spec, external. truncated: the budget of nodes left some out."""

    nodes: DataFrame
    edges: DataFrame
    truncated: bool


def dependency_graph(nodes: DataFrame, edges: DataFrame, roots: DataFrame | None = None, depth: int = 1, direction: str = "out", externals: DataFrame | None = None, most: int = MAX_NODES) -> Walk:
    """The part of a graph within depth edges of roots (id), or all of it (at depth 0), of at most `most` nodes.

    nodes: id, kind. edges: src, dst, spec. externals: src, spec; each spec is a leaf of kind external. Nodes come in the
    order in which a breadth-first walk meets them: by their parent's place, along edges, then to externals, then against
    edges, by identifier. Beyond the budget they and the edges to them fall out. A level holds as many rows as the budget,
    so it is broadcast; nodes and edges of the graph are never numbered or moved as a whole.
    """
    edges = edges.where("src is not null and dst is not null").groupBy("src", "dst").agg(F.min("spec").alias("spec"))
    outer = externals.where("src is not null and spec is not null").select("src", "spec").distinct() if externals is not None else None
    kinds = nodes.select("id", "kind").dropDuplicates(["id"])
    beyond = F.lit("external")

    def numbered(found: DataFrame, room: int, have: int, d: int) -> tuple[DataFrame, int, bool]:
        some = cut(found.orderBy("by", "id").limit(room + 1))
        n = some.count()
        first = some.withColumn("pos", F.row_number().over(Window.orderBy("by", "id")) + have).where(F.col("pos") <= have + room)
        return cut(first.select("id", "kind", F.lit(d).alias("depth"), "pos")), min(n, room), n > room

    if roots is None:
        kept, _, truncated = numbered(kinds.withColumn("by", F.lit(0)), most, 0, 0)
        own = F.broadcast(kept.select("id"))
        inside = edges.join(own, edges["src"] == own["id"], "left_semi").join(own, edges["dst"] == own["id"], "left_semi").withColumn("external", F.lit(False))
        out = kept.select("id", "kind", "depth")
        if outer is not None:
            leaves = outer.join(own, outer["src"] == own["id"], "left_semi")
            inside = inside.unionByName(leaves.select("src", F.col("spec").alias("dst"), "spec", F.lit(True).alias("external")))
            out = out.unionByName(leaves.select(F.col("spec").alias("id"), beyond.alias("kind"), F.lit(0).alias("depth")).distinct())
        return Walk(out, inside, truncated)

    start = roots.select("id").distinct().join(kinds, "id", "left").select("id", F.coalesce("kind", F.lit("file")).alias("kind"), F.lit(0).alias("by"))
    seen, n, truncated = numbered(start, most, 0, 0)
    for d in range(1, max(depth, 1) + 1):
        front = F.broadcast(seen.where((F.col("depth") == d - 1) & (F.col("kind") != "external")).select(F.col("id").alias("at"), "pos"))
        steps = []
        if direction in ("out", "both"):
            steps.append(edges.join(front, edges["src"] == front["at"]).select(F.col("dst").alias("id"), "pos", F.lit(0).alias("way")))
            if outer is not None:
                steps.append(outer.join(front, outer["src"] == front["at"]).select(F.col("spec").alias("id"), "pos", F.lit(1).alias("way")))
        if direction in ("in", "both"):
            steps.append(edges.join(front, edges["dst"] == front["at"]).select(F.col("src").alias("id"), "pos", F.lit(2).alias("way")))
        found = functools.reduce(DataFrame.unionByName, steps).groupBy("id").agg(F.min(F.struct("pos", "way")).alias("by"))
        found = found.join(F.broadcast(seen.select("id")), "id", "left_anti")
        found = found.join(kinds, "id", "left").select("id", F.when(F.col("by.way") == 1, beyond).otherwise(F.coalesce("kind", F.lit("file"))).alias("kind"), "by")
        level, m, more = numbered(found, most - n, n, d)
        truncated, n = truncated or more, n + m
        if not m:
            break
        seen = seen.unionByName(level)
    own = F.broadcast(seen.select("id"))
    open_ = F.broadcast(seen.where((F.col("depth") < max(depth, 1)) & (F.col("kind") != "external")).select("id"))
    parts = []
    if direction in ("out", "both"):
        parts.append(edges.join(open_, edges["src"] == open_["id"], "left_semi").join(own, edges["dst"] == own["id"], "left_semi").withColumn("external", F.lit(False)))
        if outer is not None:
            parts.append(outer.join(open_, outer["src"] == open_["id"], "left_semi").join(own, outer["spec"] == own["id"], "left_semi").select("src", F.col("spec").alias("dst"), "spec", F.lit(True).alias("external")))
    if direction in ("in", "both"):
        parts.append(edges.join(open_, edges["dst"] == open_["id"], "left_semi").join(own, edges["src"] == own["id"], "left_semi").withColumn("external", F.lit(False)))
    return Walk(seen.select("id", "kind", "depth"), functools.reduce(DataFrame.unionByName, parts).distinct(), truncated)
