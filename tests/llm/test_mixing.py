import hashlib
import math
import re
from collections import Counter, defaultdict

import pytest

from corvane.llm import mixing
from corvane.llm.common import attach, cut
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, edge_rows, random_rows


def filled(sizes):
    """Targets by plain water-filling: what is above its limit is shared again by weight."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total, fixed = 1.5 * sum(sizes.values()), {}
    while True:
        free = [s for s in order if s not in fixed]
        left, w = total - sum(fixed.values()), sum(weight[s] for s in free)
        over = [s for s in free if left * weight[s] / w >= 2 * sizes[s]] if w else []
        if not over:
            return fixed | {s: left * weight[s] / w for s in free}
        fixed |= {s: 2.0 * sizes[s] for s in over}


def size_of(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


def rate(sizes, target, most=2.0):
    """c with sum(size * min(most, c * measure)) = target, by halving; None if every document is at the most."""
    words = lambda c: sum(n * min(most, c * math.isqrt(n)) for n in sizes)
    if words(most) <= target + 1e-9:
        return None
    low, high = 0.0, most
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if words(mid) < target else (low, mid)
    return high


def brute(rows, want, by_u=False):
    """Copies by (source, draw, size), from the whole ranking of each source; by_u: a ranking by the draw alone."""
    units = defaultdict(lambda: defaultdict(int))
    for r in rows:
        draw = str(r[0]) if r[0] is not None else "null:" + hashlib.md5((r[1] or "").encode()).hexdigest()
        units[r[3]][draw, size_of(r[1])] += size_of(r[1])
    copies, sizes = {}, defaultdict(list)
    for r in rows:
        sizes[r[3]].append(size_of(r[1]))
    for s, own in units.items():
        c, need, order = rate(sizes[s], want[s]), want[s], []
        for (draw, size), words in own.items():
            e = 0.0 if size == 0 else 2.0 if c is None else min(2.0, math.floor(c * math.isqrt(size) * 1e9 + 0.5) / 1e9)
            copies[s, draw, size] = int(e)
            need -= int(e) * words
            u, p = (int(hashlib.md5(("mix:" + draw).encode()).hexdigest()[:13], 16) + 0.5) / 2**52, e - int(e)
            if p > 0:
                order.append((u if by_u else (u / (1 - u)) / (p / (1 - p)), draw, size, words))
        at = 0
        for _, draw, size, words in sorted(order):
            if 2 * at + words <= 2 * need:
                copies[s, draw, size] += 1
            at += words
    return copies


def taken_by(df, most_listed=mixing.LIST):
    sizes = cut(df.select(*mixing.measured(df, "doc_id", "text", "source")))
    return mixing.with_copies(sizes, mixing.plan(sizes, mixing.targets(sizes), most_listed)).collect()


@pytest.mark.parametrize("most_listed", [0, 4096])
def test_mix_is_the_whole_ranking(spark, most_listed):
    rows = edge_rows() + random_rows(600)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = taken_by(df, most_listed)
    assert len(got) == len(rows)
    own = defaultdict(int)
    for r in rows:
        own[r[3]] += size_of(r[1])
    want, taken, biggest = filled(own), defaultdict(int), defaultdict(int)
    copies = brute(rows, want)
    for r in got:
        assert r["source_size"] == own[r["_source"]]
        assert r["target"] == pytest.approx(want[r["_source"]])
        assert r["_copies"] == copies[r["_source"], r["_draw"], r["_size"]]
        taken[r["_source"]] += r["_copies"] * r["_size"]
    for (s, _, size), n in Counter((r["_source"], r["_draw"], r["_size"]) for r in got).items():
        biggest[s] = max(biggest[s], n * size)
    for s in own:
        assert abs(want[s] - taken[s]) <= biggest[s] / 2 + 1e-6
    # the rank is not that of the draw alone
    assert copies != brute(rows, want, by_u=True)


def test_inclusion_goes_with_the_measure(spark):
    """Short and long documents of one source in the proportion of their measures, 2 to 10."""
    texts = {k: "w " * (100 if k % 5 == 0 else 4) for k in range(3000)}
    df = spark.createDataFrame([(k, t, "en", "a" if k < 2500 else "b", 0, 0, "", None) for k, t in texts.items()], SCHEMA)
    sizes = cut(df.select(*mixing.measured(df, "doc_id", "text", "source")))
    goals = mixing.targets(sizes).withColumn("target", F.col("source_size") * 0.15)
    got = mixing.with_copies(sizes, mixing.plan(sizes, goals)).where("_source = 'a'").groupBy("_size").agg(F.avg("_copies").alias("a")).collect()
    share = {r["_size"]: r["a"] for r in got}
    assert 3.5 <= share[100] / share[4] <= 7


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
def test_totals_of_the_tables(spark, data, sf):
    rows = mixing.query(spark, f"{data}/{sf}").join(spark.read.parquet(f"{data}/{sf}/documents.parquet").select("doc_id", "source"), "doc_id")
    for r in rows.groupBy("source").agg(F.sum("taken").alias("taken"), F.max("target").alias("target"), F.max("size").alias("biggest")).collect():
        assert abs(r["taken"] - r["target"]) <= r["biggest"] / 2 + 1e-6


def test_identifiers_and_names(spark):
    """String identifiers, and columns with dots and marks in their names."""
    rows = [(f"d{k}", "w " * (k % 9 + 1), ["a", None][k % 2], k) for k in range(60)]
    df = spark.createDataFrame(rows, "`doc.id` string, `te``xt` string, `my source` string, _size long")
    got = mixing.mix(df, "doc.id", "te`xt", "my source")
    assert got.columns == df.columns
    assert {r[0] for r in got.collect()} <= {r[0] for r in rows}


def test_order_of_rows_does_not_matter(spark):
    rows = random_rows(400)
    a = mixing.mix(spark.createDataFrame(rows, SCHEMA).repartition(2))
    b = mixing.mix(spark.createDataFrame(rows[::-1], SCHEMA).repartition(7))
    assert a.columns == list(b.columns) == [c.split()[0] for c in SCHEMA.split(", ")]
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_salted_join_is_the_broadcast_join(spark):
    big = spark.createDataFrame([(k, ["a", None, "b"][k % 3]) for k in range(60)], "_id long, s string")
    small = spark.createDataFrame([("a", 1), (None, 2)], "s string, v int")
    near, far = attach(big, small, "s", F.col("_id")), attach(big, small, "s", F.col("_id"), limit=0)
    assert sorted(map(str, near.collect())) == sorted(map(str, far.collect()))


def test_one_source_and_empty(spark):
    rows = [(k, "w " * (k % 9 + 1), "en", "only", 0, 0, "", None) for k in range(200)]
    df = spark.createDataFrame(rows, SCHEMA)
    total = sum(k % 9 + 1 for k in range(200))
    words = mixing.mix(df).select(mixing.word_count(F.col("text")).alias("n")).agg(F.sum("n")).first()[0]
    assert abs(words - 1.5 * total) <= 9
    assert mixing.mix(spark.createDataFrame([], SCHEMA)).count() == 0
