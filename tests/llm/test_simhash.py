import random
import re

import xxhash

from corvane.llm import simhash
from corvane.llm.components import connected
from tests.llm.helpers import SCHEMA, edge_rows, lower, random_rows


def naive(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    if not words:
        return 0
    parts = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) > 2 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(p.encode(), seed=42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(values, radius):
    """value -> least value reachable, by all pairs."""
    values = sorted(set(values))
    parent = {v: v for v in values}

    def root(v):
        while parent[v] != v:
            v = parent[v]
        return v

    for a in values:
        for b in values:
            if a < b and ((a ^ b) & (2**64 - 1)).bit_count() <= radius:
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {v: root(v) for v in values}


def test_fingerprint_is_the_plain_definition():
    for r in edge_rows() + random_rows(60):
        if r[1] is None or len(r[1]) < 10_000:
            assert simhash.fingerprint((r[1] or "").encode()) == naive(r[1])


def test_tree_finds_what_a_scan_finds():
    rng = random.Random(2)
    values = [rng.getrandbits(14) for _ in range(400)]
    tree = simhash.BKTree()
    for v in values:
        tree.add(v)
    for v in values[:50] + [rng.getrandbits(14) for _ in range(50)]:
        for radius in (0, 1, 2, 3):
            assert sorted(tree.values[n] for n in tree.within(v, radius)) == sorted({x for x in values if (x ^ v).bit_count() <= radius})


def dense_values(n, seed):
    """Families of near values, some signed, far more than a shard."""
    rng = random.Random(seed)
    out = set()
    for _ in range(6):
        center = rng.getrandbits(64)
        for _ in range(n // 6):
            v = center
            for _ in range(rng.randint(0, 5)):
                v ^= 1 << rng.randrange(64)
            out.add(v - 2**64 if v >= 2**63 else v)
    return sorted(out)


def test_links_connect_what_all_pairs_connect(spark):
    values = dense_values(400, 4)
    df = spark.createDataFrame([(v,) for v in values], "_fp long")
    for shard in (2, 10, 10_000):
        edges = simhash.links(df, shard=shard)
        got = {r["node"]: r["root"] for r in connected(edges).collect()}
        want = components(values, 2)
        assert {v: got.get(v, v) for v in values} == want


def test_components_of_a_long_path(spark):
    edges = spark.range(0, 400).selectExpr("id as a", "id + 1 as b")
    got = {r["node"]: r["root"] for r in connected(edges).collect()}
    assert got == {k: 0 for k in range(401)}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


def test_groups_against_all_pairs(spark):
    rows = edge_rows() + random_rows()
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = simhash.near_groups(df).collect()
    fps = [naive(r[1]) if r[1] is None or len(r[1]) < 10_000 else simhash.fingerprint(r[1].encode()) for r in rows]
    roots = components(fps, 2)
    least = {}
    for r, f in zip(rows, fps):
        if r[0] is not None:
            least[roots[f]] = min(least.get(roots[f], r[0]), r[0])
    want = sorted(((r[0], f - 2**64 if f >= 2**63 else f, least.get(roots[f])) for r, f in zip(rows, fps)), key=str)
    assert sorted(((r["_id"], r["_fp"], r["component_id"]) for r in got), key=str) == want


def test_dedup_keeps_one_of_each_group(spark):
    rows = [r for r in random_rows() if r[0] is not None]
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("kept", "_stays")
    got = simhash.dedup(df)
    assert got.columns == df.columns
    groups = simhash.near_groups(df).select("component_id").distinct().count()
    assert got.count() == groups
    assert simhash.dedup(spark.createDataFrame([], SCHEMA)).count() == 0


def test_dedup_goes_by_identifier_and_text(spark):
    """Null and repeated identifiers: one row of each group, whatever other rows bear its identifier."""
    a, b = "one two three four five six", "completely other words are in this text here"
    put = lambda rows: spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(map(tuple, simhash.dedup(put([(None, a), (1, b), (None, b)])).collect()), key=str) == [(1, b), (None, a)]
    assert sorted(map(tuple, simhash.dedup(put([(1, a), (1, b), (0, b)])).collect())) == [(0, b), (1, a)]
    assert simhash.dedup(put([(2, a), (2, a), (2, a)])).count() == 1
    assert simhash.dedup(put([(None, a), (None, a)])).count() == 1


def test_identifiers_and_names(spark):
    df = spark.createDataFrame([("b", "same words here"), ("a", "Same words HERE"), (None, None)], "`doc.id` string, `te``xt` string")
    for f in (simhash.dedup, simhash.dedup_similar):
        got = f(df, "doc.id", "te`xt")
        assert got.columns == df.columns
        assert {r[0] for r in got.collect()} == {"a", None}


def shingles(text, n=5):
    words = re.findall(r"[^\x20\x09-\x0D]+", lower(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def similar_components(texts, least=0.8):
    sets = [shingles(t) for t in texts]
    parent = list(range(len(texts)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            same = len(a & b)
            if (not a and not b) or (same and same >= least * (len(a) + len(b) - same)):
                parent[root(i)] = root(j)
    return [root(i) for i in range(len(texts))]


def near_texts(seed=6):
    """Families of texts that differ in a few words, some around the threshold, one of them large, and texts that share a passage."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    passage, out = [word() for _ in range(40)], []
    for family in range(25):
        base = [word() for _ in range(rng.randint(20, 200))]
        for _ in range(80 if family == 0 else rng.randint(1, 5)):
            own = list(base)
            for _ in range(rng.randint(0, 2)):
                own[rng.randrange(len(own))] = word()
            out.append(" ".join(own))
    out += [" ".join([word() for _ in range(60)] + passage) for _ in range(60)]
    return out + ["", None, " ", "tiny", "Tiny"]


def test_similar_groups_against_all_pairs(spark):
    texts = near_texts()
    df = spark.createDataFrame([(k, t, "en", "a", 0, 0, "", None) for k, t in enumerate(texts)], SCHEMA).repartition(5)
    roots, least = similar_components(texts), {}
    for k, r in enumerate(roots):
        least[r] = min(least.get(r, k), k)
    assert 30 < len(least) < len(texts) - 60
    for most in (4, 256):
        got = {r["_id"]: r["component_id"] for r in simhash.similar_groups(df, most=most).collect()}
        assert got == {k: least[r] for k, r in enumerate(roots)}
    kept = simhash.dedup_similar(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == sorted(least.values())
    assert simhash.dedup_similar(spark.createDataFrame([], SCHEMA)).count() == 0
