"""What must not grow with a table, or change with its size."""

import datetime

import duckdb
from pyspark.sql import functions as F

from corvane.operators import diffs, imports, task, verdicts
from corvane.plans import queries as plans
from corvane.plans import scalars, workspace


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_files_of_a_workspace_are_not_broadcast(spark, tmp_path):
    """Only the modules, a small list, may go through the driver."""
    spark.range(200).select(F.concat(F.lit("p/f"), "id", F.lit(".c")).alias("path"), F.lit("c").alias("language"), F.lit('#include "f1.c"\n').alias("content")).write.parquet(f"{tmp_path}/files")
    files = spark.read.parquet(f"{tmp_path}/files")
    modules = spark.createDataFrame([("example.com/app", "")], "module string, dir string")
    got = imports.resolve(imports.extract(files), files.select("path"), modules)
    assert _plan(got).count("BroadcastHashJoin") <= 1
    assert got.where("target = 'p/f1.c'").count() == 199 and got.where("category = 'self'").count() == 1


def test_no_such_file_has_no_imports(spark, tmp_path):
    spark.createDataFrame([(8, 3)], "p_partkey bigint, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    assert workspace.QUERIES["imports_of_file"](spark, str(tmp_path)).count() == 0


def _sql(folder, name, *tables):
    c = duckdb.connect()
    for t in tables:
        c.execute(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    return [tuple(r) for r in c.execute(plans.ORACLE_SQL[name]).fetchall()]


def test_rings_stay_apart_at_large_keys(spark, tmp_path):
    spark.createDataFrame([(k,) for k in (0, 1, 2, 3, 99999, 100000, 100001, 100003, 200000)], "p_partkey bigint").write.parquet(f"{tmp_path}/part.parquet")
    got = scalars.QUERIES["cycle_paths"](spark, str(tmp_path)).select("component", "nodes").collect()
    assert sorted(map(tuple, got)) == sorted(_sql(tmp_path, "cycle_paths", "part"))


def test_page_of_dead_code_goes_by_place_whatever_a_file_is_called(spark, tmp_path):
    """One file with more candidates than a page: names that end with _linux.go don't come last."""
    day = datetime.datetime(1995, 1, 1)
    orders = [(k, 1 + k % 2, "O", float(k), day + datetime.timedelta(days=(k * 37) % 400), "1-URGENT") for k in range(400)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    lines = [(k, 3, day) for k in range(0, 400, 4)]
    spark.createDataFrame(lines, "l_orderkey bigint, l_linenumber int, l_shipdate timestamp").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = workspace.QUERIES["dead_code_page"](spark, str(tmp_path)).select("path", "line", "id", "name", "kind", "confidence").collect()
    assert len(got) == 50 and list(map(tuple, got)) == _sql(tmp_path, "dead_code_page", "orders", "lineitem")


def test_collisions_are_counted_before_they_meet(spark):
    """40,000 bearers of one name and as many renames would be 1.6 billion pairs; null containers are a container."""
    many = spark.range(40000).select("id", F.lit("n").alias("name"), F.when(F.col("id") % 2 == 0, "c").alias("container"), F.lit("s").alias("scope"))
    got = verdicts.collisions(many, many.withColumnRenamed("name", "new_name"))
    assert got._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") >= 3
    assert [tuple(r) for r in got.select("collisions").distinct().collect()] == [(19999,)] and got.count() == 40000
    few = spark.createDataFrame([(1, "a", "c", "s"), (2, "a", "c", "s"), (None, "a", "c", "s"), (3, "a", None, "s"), (4, "a", "c", None)], "id long, name string, container string, scope string")
    asked = spark.createDataFrame([(1, "a", "c", "s"), (1, "a", "c", "s"), (9, "a", "c", "s"), (None, "a", "c", "s"), (9, "a", None, "s"), (4, "a", "c", None), (1, None, "c", "s")], "id long, new_name string, container string, scope string")
    rows = {tuple(r) for r in verdicts.collisions(few, asked).collect()}
    assert rows == {(1, "a", "c", "s", 2), (9, "a", "c", "s", 2), (None, "a", "c", "s", 0), (9, "a", None, "s", 1), (4, "a", "c", None, 0), (1, None, "c", "s", 0)}


def test_a_word_that_comes_again_is_read_once(spark):
    text = "fix parseConfig in src/app_main.go and the `retry_count` reader --dry-run parse_config slow slow "
    once, often = (spark.createDataFrame([(1, text * n)], "task int, text string") for n in (1, 300))
    rows = lambda df: sorted(map(tuple, task.terms(df, "task", "text").collect()))
    assert rows(once) == rows(often)
    assert task.terms(often, "task", "text")._jdf.queryExecution().optimizedPlan().toString().count("array_distinct") >= 2


def test_previews_come_in_small_batches(spark):
    docs = spark.createDataFrame([(1, "a\nb\n"), (2, None)], "uri int, text string")
    edits = spark.createDataFrame([(1, 2, 3, "x"), (1, 0, 1, "y"), (2, 0, 0, "z")], "uri int, start int, end int, new_text string")
    got = diffs.preview(docs, edits)
    assert "ArrowEvalPython" not in _plan(got)
    rows = {r["uri"]: r["diff"] for r in got.collect()}
    assert rows[2] is None and "-a\n-b\n+y\n+x\n" in rows[1]


def test_overlaps_are_dealt_once(spark):
    from corvane.operators import intervals

    rows = spark.range(1000).select((F.col("id") % 10).alias("f"), F.col("id").alias("s"), (F.col("id") + 25).alias("e"))
    got = intervals.overlap_counts(rows, "f", "s", "e")
    assert _plan(got).count("Exchange") == 1
    assert {r["pairs"] for r in got.collect()} == {99 + 98}


def test_lines_of_orders_are_dealt_once(spark, data):
    got = scalars.QUERIES["limits"](spark, f"{data}/sf0.001")
    assert _plan(got).count("REPARTITION_BY_NUM") >= 1 and "ENSURE_REQUIREMENTS" not in _plan(got)
