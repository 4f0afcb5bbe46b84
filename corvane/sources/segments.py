"""Tables that change by deltas: a base and later segments under one folder, and a manifest that names what is live.

A commit writes its rows and the keys that it replaces to a folder of its own and then one small manifest, by a rename;
readers take the newest manifest, so they see whole versions only, and what a commit that died has left is never read. A
commit whose number is not above the newest one's has been made before and does nothing. When the later segments outgrow a
share of the first one, they are merged into a new base, so a commit writes what changed, and a merge comes after changes
in proportion to the table.
"""

from __future__ import annotations

import functools
import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Later segments may have this share of the first one's bytes before they are merged; manifests that stay readable.
RATIO, KEEP = 0.5, 3


def _fs(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder.getFileSystem(spark._jsc.hadoopConfiguration()), folder


def _manifests(spark: SparkSession, path: str) -> list[str]:
    fs, folder = _fs(spark, f"{path}/manifest")
    if not fs.exists(folder):
        return []
    return sorted(n for s in fs.listStatus(folder) if not (n := s.getPath().getName()).startswith((".", "_")))


def _read(spark: SparkSession, path: str, name: str) -> dict:
    fs, file = _fs(spark, f"{path}/manifest/{name}")
    stream = fs.open(file)
    try:
        return json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def manifest(spark: SparkSession, path: str) -> dict | None:
    """number, segments (folders, oldest first) and schemas of the newest whole version; None before the first."""
    names = _manifests(spark, path)
    return _read(spark, path, names[-1]) if names else None


def _publish(spark: SparkSession, path: str, number: int, turn: int, segments: list[str], schemas: dict) -> bool:
    """Names the live segments and the columns of the tables (one without rows has no file to tell them); false if another
    writer was first."""
    fs, draft = _fs(spark, f"{path}/manifest/_{uuid.uuid4().hex}")
    out = fs.create(draft, False)
    out.write(bytearray(json.dumps({"number": number, "segments": segments, "schemas": schemas}).encode()))
    out.close()
    if fs.rename(draft, _fs(spark, f"{path}/manifest/{number:015d}-{turn}")[1]):
        return True
    fs.delete(draft, False)
    return False


def size(spark: SparkSession, path: str, segment: str) -> int:
    fs, folder = _fs(spark, f"{path}/{segment}")
    return fs.getContentSummary(folder).getLength()


def commit(spark: SparkSession, path: str, number: int, tables: dict[str, DataFrame], gone: DataFrame, partition: tuple[str, ...] = (), ratio: float = RATIO, keep: int = KEEP, remake: Callable[[], dict[str, DataFrame]] | None = None, expected: int | None = None) -> bool:
    """Adds a segment with rows of each table, in place of all earlier rows whose key is in gone (its only column; the
    tables have it too). The keys of the rows must be in gone unless they are new. remake: gives the tables of a merge, where
    they are more than their live rows. Whether anything was done."""
    before = manifest(spark, path)
    if before is not None and number <= before["number"]:
        return False
    name = f"segment-{number:015d}-{uuid.uuid4().hex[:8]}"
    for table, rows in tables.items():
        some = [c for c in partition if c in rows.columns]
        (rows.write.partitionBy(*some) if some else rows.write).parquet(f"{path}/{name}/{table}")
    gone.distinct().write.parquet(f"{path}/{name}/gone")
    segments = [*(before["segments"] if before else []), name]
    schemas = {t: rows.schema.jsonValue() for t, rows in (tables | {"gone": gone}).items()}
    latest = manifest(spark, path)
    if (latest and latest["number"]) != (before and before["number"]) or not _publish(spark, path, number, 0, segments, schemas):
        fs, folder = _fs(spark, f"{path}/{name}")
        fs.delete(folder, True)
        return False
    later = sum(size(spark, path, s) for s in segments[1:])
    if later > ratio * size(spark, path, segments[0]):
        merge(spark, path, remake() if remake else {t: live(spark, path, t, gone.columns[0]).drop("_segment") for t in tables}, partition)
    _forget(spark, path, keep)
    return True


def merge(spark: SparkSession, path: str, tables: dict[str, DataFrame], partition: tuple[str, ...] = ()) -> None:
    """All segments become one of these tables, in a version of its own."""
    now = manifest(spark, path)
    name = f"segment-{now['number']:015d}-merged-{uuid.uuid4().hex[:8]}"
    for table, rows in tables.items():
        some = [c for c in partition if c in rows.columns]
        (rows.write.partitionBy(*some) if some else rows.write).parquet(f"{path}/{name}/{table}")
    _stored(spark, path, now, now["segments"][0], "gone").limit(0).write.parquet(f"{path}/{name}/gone")
    _publish(spark, path, now["number"], 1, [name], now["schemas"])


def _forget(spark: SparkSession, path: str, keep: int) -> None:
    """Deletes manifests before the last keep, and segments that none of these names and that are older than all of theirs."""
    names = _manifests(spark, path)
    used = {s for n in names[-keep:] for s in _read(spark, path, n)["segments"]}
    old = {s for n in names[:-keep] for s in _read(spark, path, n)["segments"]} - used
    for n in names[:-keep]:
        fs, file = _fs(spark, f"{path}/manifest/{n}")
        fs.delete(file, False)
    for s in old:
        fs, folder = _fs(spark, f"{path}/{s}")
        fs.delete(folder, True)


def _stored(spark: SparkSession, path: str, now: dict, segment: str, table: str) -> DataFrame:
    return spark.read.schema(StructType.fromJson(now["schemas"][table])).parquet(f"{path}/{segment}/{table}")


def parts(spark: SparkSession, path: str, table: str, where: Column | None = None) -> DataFrame:
    """Rows of all live segments with _segment, dead ones included; where prunes each segment's files."""
    out, now = [], manifest(spark, path)
    for k, s in enumerate(now["segments"]):
        rows = _stored(spark, path, now, s, table)
        out.append((rows if where is None else rows.where(where)).withColumn("_segment", F.lit(k)))
    return functools.reduce(DataFrame.unionByName, out)


def live(spark: SparkSession, path: str, table: str, key: str, where: Column | None = None) -> DataFrame:
    """Rows that no later segment replaces."""
    rows, now = parts(spark, path, table, where), manifest(spark, path)
    if len(now["segments"]) == 1:
        return rows
    gone = functools.reduce(DataFrame.unionByName, [_stored(spark, path, now, s, "gone").withColumn("_last", F.lit(k)) for k, s in enumerate(now["segments"]) if k])
    gone = gone.groupBy(F.col(key).alias("_gone")).agg(F.max("_last").alias("_last"))
    return rows.join(gone, rows[key].eqNullSafe(gone["_gone"]) & (rows["_segment"] < gone["_last"]), "left_anti")
