"""Snapshots of files: differences, freshness, sync reports, and an index kept up to date."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def diff(prev: DataFrame, cur: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key and change: created, changed or deleted; unchanged rows are left out. One full outer join."""
    a = prev.select(F.col(key), F.struct(*columns).alias("_old"))
    b = cur.select(F.col(key), F.struct(*columns).alias("_new"))
    rows = a.join(b, key, "full_outer")
    change = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "deleted").when(~F.col("_old").eqNullSafe(F.col("_new")), "changed")
    return rows.select(key, change.alias("change")).where("change is not null")


#: Kinds of a file against its entry in the index.
def freshness(index: DataFrame, snapshot: DataFrame) -> DataFrame:
    """index: path, server, size, mtime_ns, hash, has_outline, has_imports. snapshot: path, server, size, mtime_ns, hash, racy.

    Equal size and time are trusted unless the time is racy; else the hash decides between touched and changed.
    """
    a = index.select("path", *[F.col(c).alias(f"_{c}") for c in ("server", "size", "mtime_ns", "hash", "has_outline", "has_imports")], F.lit(True).alias("_in"))
    rows = a.join(snapshot, "path", "full_outer")
    same = (F.col("_size") == F.col("size")) & (F.col("_mtime_ns") == F.col("mtime_ns")) & ~F.coalesce("racy", F.lit(False))
    state = (
        F.when(F.col("_in").isNull(), "added")
        .when(F.col("size").isNull(), "removed")
        .when(~F.col("_server").eqNullSafe(F.col("server")), "changed")
        .when(~same & (F.col("_hash") != F.col("hash")), "changed")
        .when(~(F.col("_has_outline") & F.col("_has_imports")), "rebuilt")
        .when(~same, "touched")
        .otherwise("fresh")
    )
    return rows.select("path", state.alias("state"))


def skip_reason(files: DataFrame, content: str = "content", most: int = 1 << 20) -> DataFrame:
    """Adds skip: too_large, binary (a zero byte in the first 8 KiB), unreadable, or null."""
    c = F.col(content)
    skip = F.when(c.isNull(), "unreadable").when(F.octet_length(c) > most, "too_large").when(F.contains(F.hex(F.substring(c, 1, 8192)), F.lit("00")) & F.expr(f"array_contains(transform(sequence(0, cast(least(octet_length({content}), 8192) as int)), i -> substring({content}, i + 1, 1)), x'00')"), "binary")
    return files.withColumn("skip", skip)


def sync_report(states: DataFrame, skips: DataFrame | None = None) -> DataFrame:
    kinds = ("fresh", "touched", "changed", "added", "removed", "rebuilt")
    return states.agg(*[F.count_if(F.col("state") == k).alias(k) for k in kinds], F.count(F.lit(1)).alias("files"))


def status(files: DataFrame, group: list[str], indexed: str, hash_now: str, hash_then: str, skip: str, key: str | None = None, examples: int = 3) -> DataFrame:
    """Counts by group: files, indexed, fresh, stale, missing, skipped. With a key, also the first few skipped keys with their reasons."""
    got = F.col(indexed)
    counts = files.groupBy(*group).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(got).alias("indexed"),
        F.count_if(got & (F.col(hash_now) == F.col(hash_then))).alias("fresh"),
        F.count_if(got & (F.col(hash_now) != F.col(hash_then))).alias("stale"),
        F.count_if(~got).alias("missing"),
        F.count_if(F.col(skip).isNotNull()).alias("skipped"),
    )
    if key is None:
        return counts
    first = Window.partitionBy(*group).orderBy(skip, key)
    some = files.where(F.col(skip).isNotNull()).withColumn("_r", F.row_number().over(first)).where(F.col("_r") <= examples)
    listed = F.array_sort(F.collect_list(F.struct("_r", F.concat_ws(": ", F.col(skip), F.col(key).cast("string")).alias("t"))))
    shown = some.groupBy(*group).agg(F.array_join(F.transform(listed, lambda x: x["t"]), ", ").alias("examples"))
    shown = shown.select(*[F.col(g).alias(f"_g{k}") for k, g in enumerate(group)], "examples")
    same = [F.col(g).eqNullSafe(F.col(f"_g{k}")) for k, g in enumerate(group)]
    return counts.join(shown, same, "left").drop(*[f"_g{k}" for k in range(len(group))])


def upsert(table: DataFrame, changes: DataFrame, fresh: DataFrame, key: str) -> DataFrame:
    """The table without what was deleted or changed, and the new rows of what was created or changed."""
    gone = changes.select(key)
    kept = table.join(gone, key, "left_anti")
    return kept.unionByName(fresh.join(changes.where("change <> 'deleted'").select(key), key, "left_semi"))


def scanned(files: DataFrame, at_ns: int, window_ns: int = 2_000_000_000) -> DataFrame:
    """files (path, mtime_ns, kind) of one scan: racy where the time is so near the scan that a later change could bear the
    same one, and skip for what is no regular file."""
    skip = F.when(F.col("kind") == "symlink", "symlink").when(F.col("kind") != "file", "not_regular")
    return files.withColumns({"racy": F.col("mtime_ns") > F.lit(at_ns - window_ns), "skip": skip})


def must_relist(before: DataFrame, now: DataFrame, listed: DataFrame, most: int = 50_000) -> DataFrame:
    """One row, relist: whether a listing can't be used again. before and now: directories (path, mtime_ns, ignore_hash);
    listed: files (path, there). It can't if a directory came, went, moved or has other ignore rules, if a listed file is gone, or past most directories."""
    a = before.select("path", F.struct("mtime_ns", "ignore_hash").alias("_a"))
    b = now.select("path", F.struct("mtime_ns", "ignore_hash").alias("_b"))
    moved = a.join(b, "path", "full_outer").agg(F.count_if(~F.col("_a").eqNullSafe(F.col("_b"))).alias("moved"), F.count("_b").alias("directories"))
    gone = listed.agg(F.count_if(~F.col("there")).alias("gone"))
    return moved.crossJoin(gone).select("moved", "gone", ((F.col("moved") > 0) | (F.col("gone") > 0) | (F.col("directories") > most)).alias("relist"))


def with_file_hash(hits: DataFrame, files: DataFrame, hash_column: str = "hash") -> DataFrame:
    """hits (path, indexed_hash) with the file's hash now, and whether the hit is stale; gone files have no hash and are stale."""
    now = files.select("path", F.col(hash_column).alias("file_hash"))
    return hits.join(now, "path", "left").withColumn("stale", ~F.col("file_hash").eqNullSafe(F.col("indexed_hash")))


def build_in_steps(files: DataFrame, build, path: str, key: str = "path", step: int = 500) -> DataFrame:
    """Builds rows of files and appends them to a table, about step files in each write. After a kill the files that the
    table has are passed over, so a second call goes on where the first one stopped.

    What is left to do is dealt into steps once, as folders of a table beside this one, so a step reads its own files only.
    """
    spark = files.sparkSession
    todo = files
    try:
        todo = files.join(spark.read.parquet(path).select(key).distinct(), key, "left_anti")
    except Exception as e:  # nothing is written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
    parts = max(1, -(-files.count() // step))
    plan = f"{path}-steps-{uuid.uuid4().hex}"
    todo.withColumn("_step", F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")).repartition("_step").write.partitionBy("_step").parquet(plan)
    schema = todo.withColumn("_step", F.lit(0)).schema
    for k in range(parts):
        build(spark.read.schema(schema).parquet(plan).where(F.col("_step") == k).drop("_step")).write.mode("append").parquet(path)
    clear(spark, plan)
    return spark.read.parquet(path)


def counts(symbols: DataFrame, group: str = "kind") -> DataFrame:
    """Symbols by kind."""
    return symbols.groupBy(group).agg(F.count(F.lit(1)).alias("n"))


def clear(spark, path: str) -> bool:
    """Takes a written index away; whether there was one."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return bool(folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True))
