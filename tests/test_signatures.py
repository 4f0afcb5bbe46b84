import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import grep, signatures
from corvane.sources import segments

WORDS = ["parse", "Config", "KEEP", "said", "naïve", "ſong", "\u212aelvin", "x", "a.b", "\n", "load_all", "Straße"]


def texts(seed, n):
    rng = random.Random(seed)
    return [(k, " ".join(rng.choices(WORDS, k=rng.randint(0, 7))) if rng.random() < 0.97 else None) for k in range(n)]


@pytest.mark.parametrize(
    "pattern, want",
    [
        ("abcd", ("and", (("run", b"abc"), ("run", b"bcd")))),
        ("abc|xyz", ("or", (("run", b"abc"), ("run", b"xyz")))),
        ("(abc)?x", None),
        ("(abc)+", ("run", b"abc")),
        ("ABC.def", ("and", (("run", b"abc"), ("run", b"def")))),
        (r"abc\\b\\.de", ("and", (("run", b".de"), ("run", b"abc"), ("run", b"bc."), ("run", b"c.d")))),
        (r"\\p{L}abc", ("run", b"abc")),
        ("ab|xyz", None),
        (r"\\Qabc\\E", None),
        ("(?i)kab.mno", ("run", b"mno")),
        ("[abc]def{0}", None),
    ],
)
def test_needed(pattern, want):
    pattern = pattern.replace("\\\\", "\\")
    got = signatures.needed(pattern, True)
    assert got == want or (got and want and got[0] == want[0] and sorted(map(str, got[1])) == sorted(map(str, want[1])))


def holds(tree, text):
    if tree is None:
        return True
    kind, arg = tree
    return arg in text if kind == "run" else (all if kind == "and" else any)(holds(p, text) for p in arg)


def test_no_match_is_lost(spark, tmp_path):
    rows = texts(1, 400)
    df = spark.createDataFrame(rows, "k int, text string")
    path = str(tmp_path / "s")
    signatures.store(df, "k", "text", path, buckets=8)
    for q, regex, case in [("parse", False, True), ("config", False, False), ("kelvin", False, False), ("song", False, False), ("naïve", False, True), ("(said|keep) x", True, False), (r"load_\w+ a\.b", True, True), ("zz+top", True, True)]:
        want = grep.search_text(df, "k", "text", q, regex=regex, case=case).select("k", "line", "col").collect()
        got = signatures.search(spark, path, "k", q, regex=regex, case=case).select("k", "line", "col").collect()
        assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert signatures.candidates(spark, path, "k", "parse Config parse", case=True).count() < 60


def test_signatures_hold_their_runs(spark):
    rng = random.Random(3)
    for _ in range(50):
        text = "".join(rng.choices("abcXYZ é", k=rng.randint(0, 300))).encode()
        bits = signatures.signature(text)
        low = text.lower()
        for k in range(len(low) - 2):
            at = int(signatures._hash(__import__("numpy").array([low[k] << 16 | low[k + 1] << 8 | low[k + 2]]))[0]) & (64 * len(bits) - 1)
            assert bits[at >> 6] >> (at & 63) & 1


def test_candidates_alone_are_opened(spark, tmp_path):
    path = str(tmp_path / "s")
    rows = [(k, f"plain text {k}" + (" needle" if k == 7 else "")) for k in range(300)]
    signatures.store(spark.createDataFrame(rows, "k int, text string"), "k", "text", path, buckets=8)
    assert [r["k"] for r in signatures.candidates(spark, path, "k", "needle", case=True).collect()] == [7]
    hits = signatures.search(spark, path, "k", "needle", case=True)
    assert re.search("dynamicpruning", hits._jdf.queryExecution().executedPlan().toString())
    # a changed text is a segment; a removed one has only a key
    signatures.store(spark.createDataFrame([(9, "a needle too")], "k int, text string"), "k", "text", path, 1, spark.createDataFrame([(9,), (7,)], "k int"), 8)
    assert [r["k"] for r in signatures.search(spark, path, "k", "needle", case=True).collect()] == [9]
    assert segments.manifest(spark, path)["number"] == 1 and signatures.search(spark, path, "k", "plain", case=True).count() == 298
