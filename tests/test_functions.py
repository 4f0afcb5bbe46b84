import random

import pytest
from pyspark.sql import functions as F

from corvane.functions import text as t

TOKENS = [("parseConfig", "parse config"), ("ParseConfigFile", "parse config file"), ("parse_config", "parse config"), ("parse-config.file", "parse config file"), ("HTTPServer_v2", "http server v 2"), ("getHTTPResponseCode", "get http response code"), ("ID", "id"), ("userID", "user id"), ("XMLHttpRequest", "xml http request"), ("__init__", "init"), ("a1b2", "a 1 b 2"), ("Server.Handle", "server handle"), ("func(a int) string", "func a int string"), ("名前Name", "名前 name"), ("Größe_ÄÖ", "größe äö"), ("  ", ""), ("", "")]
DISTANCES = [("", "", 0), ("abc", "", 3), ("kitten", "sitting", 3), ("servername", "servernmae", 1), ("manager", "mangaer", 1), ("ab", "ba", 1), ("abc", "bca", 2), ("same", "same", 0), ("名前", "名字", 1), ("ca", "abc", 3)]


def one(spark, c):
    return spark.range(1).select(c).first()[0]


def test_tokenize(spark):
    rows = spark.createDataFrame(TOKENS, "a string, b string").select("a", F.array_join(t.tokenize(F.col("a")), " ").alias("got"), "b").collect()
    assert [r["got"] for r in rows] == [r["b"] for r in rows]


def test_normalise(spark):
    rows = spark.createDataFrame([("parse_config", "parseconfig"), ("ParseConfig", "parseconfig"), ("parse config", "parseconfig"), ("(*Server).Run", "serverrun")], "a string, b string")
    assert rows.where(t.normalise(F.col("a")) != F.col("b")).count() == 0


def osa(a, b):
    older, old = [], list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            cost = min(new[-1] + 1, old[j] + 1, old[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                cost = min(cost, older[j - 2] + 1)
            new.append(cost)
        older, old = old, new
    return old[-1]


def test_osa_column(spark):
    import random

    rng = random.Random(9)
    word = lambda: "".join(rng.choices("abc\U0001f600é", k=rng.randint(0, 8)))
    more = [(x := word(), y := word(), osa(x, y)) for _ in range(400)]
    rows = spark.createDataFrame(DISTANCES + [(b, a, d) for a, b, d in DISTANCES] + more + [(None, "a", None), ("a", None, None)], "a string, b string, d int")
    assert rows.where(~t.osa_distance("a", "b").eqNullSafe(F.col("d"))).count() == 0


def test_trigrams(spark):
    j = lambda a, b: one(spark, t.jaccard(t.trigrams(F.lit(a)), t.trigrams(F.lit(b))))
    assert 0.3 <= j("servername", "servernmae") <= 0.6
    assert j("abc", "xyz") == 0 and j("ab", "ab") == 1 and j("", "ab") == 0


def test_positions(spark):
    row = spark.range(1).select(t.byte_column(F.lit("a😀b"), F.lit(2)).alias("b"), t.utf16_column(F.lit("a😀b"), F.lit(3)).alias("u")).first()
    assert (row["b"], row["u"]) == (6, 4)


def test_clips():
    rng = random.Random(1)
    for _ in range(300):
        line = "".join(rng.choice("aé漢😀 ") for _ in range(rng.randint(0, 300)))
        assert len(t.clip_bytes(line, 60).encode()) <= 60
        n = len(line.encode())
        at = rng.randint(0, n)
        got = t.clip_around(line, at, min(n, at + 5), 80)
        body = got.split("]…")[-1].split("…[")[0] if n > 80 else got
        assert body in line and len(body.encode()) <= 80


def test_languages(spark):
    want = {"a/b.go": "go", "x.py": "python", ".gitignore": "", "Makefile": "make", "a.tar.TSX": "typescriptreact", "noext": "", "go.mod": "gomod", ".eslintrc.json": "json"}
    rows = spark.createDataFrame([(k,) for k in want], "p string").select("p", t.language_id(F.col("p")).alias("l")).collect()
    assert {r["p"]: r["l"] for r in rows} == want


def test_paths_and_ids(spark):
    row = spark.range(1).select(t.package_of(F.lit("a/b/c.go")), t.package_of(F.lit("c.go")), t.ancestors(F.lit("a/b/c.go")), t.ancestors(F.lit("c")), t.parse_id(F.lit("a::b.go::T.M#method~3")).alias("id")).first()
    assert row[0] == "a/b" and row[1] == "." and row[2] == [".", "a", "a/b"] and row[3] == ["."]
    assert row["id"].asDict() == {"path": "a", "name": "b.go::T.M", "kind": "method", "ordinal": 3}
    assert one(spark, t.id_name(F.lit("(*T).M"))) == "T.M" and one(spark, t.id_name(F.lit("(T[X]).M"))) == "T.M"


def test_ends_of_lines(spark):
    kinds = {"a\nb": "lf", "a\r\nb": "crlf", "a\rb": "cr", "a\r\nb\n": "mixed", "a": "none"}
    for text, kind in kinds.items():
        assert one(spark, t.eol_kind(F.lit(text))) == kind
        assert one(spark, t.to_lf(F.lit(text))) == text.replace("\r\n", "\n").replace("\r", "\n")


def test_small_ones(spark):
    assert one(spark, t.first_sentence(F.lit("Does this. And that."))) == "Does this."
    assert one(spark, t.round_half_up(F.lit(1.0005))) == 1.001
    assert one(spark, t.rule_id(F.lit("vet"), F.lit(""))) == "vet" and one(spark, t.rule_id(F.lit(None), F.lit(None))) == "diagnostic"
    assert one(spark, t.is_test_file(F.lit("a/b_test.go"))) and not one(spark, t.is_test_file(F.lit("a/contest.go")))
    assert one(spark, t.is_empty_result(F.lit("[]"))) and not one(spark, t.is_empty_result(F.lit("[1]")))
