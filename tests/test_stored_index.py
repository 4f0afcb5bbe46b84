import random
import re

import pytest
from pyspark.sql import functions as F

from corvane.operators import search, stored_index
from corvane.sources import segments

SCHEMA = "id string, path string, name string, qualified string, kind string, language string, signature string, doc string, depth int, line int"
WORDS = "config parse load server handle request pool idle red bolt read write index token".split()


def made(seed, files, n):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        words = rng.choices(WORDS, k=rng.randint(1, 3))
        name = words[0] + "".join(w.title() for w in words[1:])
        path = f"src/{rng.choice(files)}.go"
        rows.append((f"{path}#{seed}-{k}", path, name, f"T.{name}" if rng.random() < 0.3 else name, rng.choice(["function", "type"]), "go", " ".join(rng.choices(WORDS, k=rng.randint(0, 6))), " ".join(rng.choices(WORDS, k=rng.randint(0, 9))), rng.randint(0, 2), k))
    return rows


def listed(df, *columns):
    return [tuple(r[c] for c in ("id", "tier", *columns)) + (round(r["score"], 9), round(r["raw"], 6)) for r in df.collect()]


QUERIES = ["config", "red bolt server", "p", "T.parse", ".."]


@pytest.mark.parametrize("block", [2, 128])
def test_same_hits_as_without_a_store(spark, tmp_path, block):
    path = str(tmp_path / "index")
    symbols = spark.createDataFrame(made(1, "abcdef", 300), SCHEMA)
    stored_index.write(symbols, path, buckets=8, block=block)
    for text in QUERIES[: 5 if block == 2 else 2]:
        q = search.SearchQuery(text, limit=7)
        want = listed(search.search_symbols(symbols, q), "total", "truncated")
        assert listed(stored_index.search_stored(spark, path, q, 8), "total", "truncated") == want
        assert listed(stored_index.search_stored(spark, path, q, 8, totals=False)) == [w[:2] + w[4:] for w in want]
    q = search.SearchQuery("config", kinds=("type",), path="src", exclude=("src/a*",), limit=0)
    assert sorted(listed(stored_index.search_stored(spark, path, q, 8), "total")) == sorted(listed(search.search_symbols(symbols, q), "total"))


def test_only_the_buckets_of_a_query_are_read(spark, tmp_path):
    path = str(tmp_path / "index")
    stored_index.write(spark.createDataFrame(made(2, "abc", 100), SCHEMA), path)
    hits = stored_index.search_stored(spark, path, search.SearchQuery("config", limit=5), totals=False)
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"PartitionFilters: \[[^\]]*_b#", plan)


def test_blocks_that_cannot_count_stay_closed(spark, tmp_path):
    path = str(tmp_path / "index")
    rows = [(f"s{k}", "a.go", "config" if k < 4 else f"x{k}", f"x{k}", "function", "go", "", "config " + "other " * k, 0, k) for k in range(400)]
    stored_index.write(spark.createDataFrame(rows, SCHEMA), path, block=8)
    blocks = segments.parts(spark, path, "postings", F.col("term") == "config")
    files = segments.live(spark, path, "files", "path")
    stats = files.agg(F.sum("n").alias("n"), (F.sum("len") / F.sum("n")).alias("avg_len"))
    assert stored_index._needed(spark, path, blocks, ["config"], stats, 5).count() < blocks.count() / 5


def test_changes_are_segments(spark, tmp_path):
    path = str(tmp_path / "index")
    now = {r[0]: r for r in made(1, "abcdef", 200)}
    stored_index.write(spark.createDataFrame(list(now.values()), SCHEMA), path, buckets=8, block=4)
    for number in range(1, 4):
        gone = {f"src/{x}.go" for x in random.Random(number).sample("abcdefg", 2)}
        fresh = [r for r in made(10 + number, "abcdefg", 60) if r[1] in gone]
        fresh = fresh if number < 3 else []
        now = {k: r for k, r in now.items() if r[1] not in gone} | {r[0]: r for r in fresh}
        changed = spark.createDataFrame([(p,) for p in sorted(gone)], "path string")
        args = (spark.createDataFrame(list(now.values()), SCHEMA), changed, path, number)
        assert stored_index.upsert(*args, buckets=8, block=4, ratio=100.0 if number < 3 else 0.0)
        assert not stored_index.upsert(*args, buckets=8, block=4)  # a repeated batch
        held = segments.manifest(spark, path)
        assert held["number"] == number and len(held["segments"]) == (number + 1 if number < 3 else 1)
        symbols = spark.createDataFrame(list(now.values()), SCHEMA)
        q = search.SearchQuery("parse config", limit=9)
        assert listed(stored_index.search_stored(spark, path, q, 8), "total") == listed(search.search_symbols(symbols, q), "total")
