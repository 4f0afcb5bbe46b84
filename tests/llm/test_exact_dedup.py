import hashlib
from collections import defaultdict

import pytest

from corvane.llm import exact_dedup
from tests.llm.helpers import SCHEMA, edge_rows, lower, random_rows


def brute(rows, keep):
    groups = defaultdict(list)
    for r in rows:
        groups[lower(r[1])].append(r[0])
    out = []
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        best = (max if keep == "max" else min)(known) if known else None
        for i in ids:
            out.append((i, best, len(ids), hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("keep", ["max", "min"])
@pytest.mark.parametrize("buckets", [1, 7, 200])
def test_groups(spark, keep, buckets):
    long_ = "The same long beginning " * 40
    rows = edge_rows() + random_rows() + [(5000 + k, "One hot Text", "en", "a", 12, 0, "", None) for k in range(200)]
    rows += [(7000 + k, long_ + str(k % 40), "en", "a", 12, 0, "", None) for k in range(120)]
    rows += [(9000, "Repeated whole", "en", "a", 12, 0, "", None)] * 150 + [(None, "Repeated without", "en", "a", 12, 0, "", None)] * 90
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = exact_dedup.with_groups(df, keep=keep, buckets=buckets).collect()
    assert sorted(((r["_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got), key=str) == brute(rows, keep)
    kept = [r for r in got if r["kept"]]
    assert len(kept) == len({r["text_sha256"] for r in got}) == len({r["text_sha256"] for r in kept})
    assert all(r["_id"] == r["keep_id"] for r in kept)


def test_dedup_keeps_columns_and_one_of_repeated_rows(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    got = exact_dedup.dedup(df)
    assert got.columns == df.columns
    assert got.count() == len({lower(r[1]) for r in rows})
    assert got.where("doc_id = 5").count() == 1


def test_cuts():
    """Shortest prefixes between texts, parts inside of hot heads, and whole keys that repeat."""
    sample = sorted([("aa", "1"), ("abc", "2"), ("abd", "3"), ("hot", "4"), ("hot", "5"), ("hot", "6"), ("same", "7"), ("same", "7")])
    prefixes, heads, parts, same = exact_dedup.cuts(sample, 8)
    assert prefixes == ["ab", "abd", "h", "s"]
    assert heads == ["hot", "same"]
    assert parts == ["hot\u00015", "hot\u00016"] and same == ["same\u00017"]
    assert exact_dedup.shortest("ab", "abc") == "abc" and exact_dedup.shortest("", "x") == "x"


def test_identifiers_and_names(spark):
    rows = [("b", "Text"), ("a", "text"), (None, "TEXT"), ("c", None), ("d", "")]
    df = spark.createDataFrame(rows, "`doc.id` string, `te``xt` string")
    got = exact_dedup.dedup(df, "doc.id", "te`xt")
    assert got.columns == df.columns and sorted(r[0] for r in got.collect()) == ["b", "d"]
    assert sorted(r[0] for r in exact_dedup.dedup(df, "doc.id", "te`xt", keep="min").collect()) == ["a", "c"]


def test_empty(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert exact_dedup.with_groups(df).count() == 0
    assert exact_dedup.dedup(df).columns == df.columns


def test_native(spark):
    df = spark.createDataFrame(random_rows(), SCHEMA)
    plan = exact_dedup.with_groups(df.select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))
