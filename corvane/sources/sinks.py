"""Sinks and renderers: envelopes, text lines, SARIF, index parts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.sources import segments

VERSION = 1
#: Levels of SARIF by severity.
LEVELS = {"error": "error", "warning": "warning", "information": "note", "hint": "note"}


def envelope(rows: DataFrame, limit_warning: Column | None = None) -> DataFrame:
    """One JSON text per row: version, ok, data, warnings, error."""
    warnings = F.filter(F.array(limit_warning), lambda w: w.isNotNull()) if limit_warning is not None else F.array().cast("array<string>")
    return rows.select(F.to_json(F.struct(F.lit(VERSION).alias("version"), F.lit(True).alias("ok"), F.struct(*rows.columns).alias("data"), warnings.alias("warnings"))).alias("json"))


def text_lines(rows: DataFrame, path: str, line: str, col: str, text: str) -> DataFrame:
    return rows.select(F.concat_ws(":", path, line, col, text).alias("value"))


def sarif(diagnostics: DataFrame, by: list[str] = ()) -> DataFrame:
    """diagnostics: path, line, col, severity, rule, message. A SARIF text with every rule once, for each part (by: its
    columns) or, without parts, one of all; a report is one text, so large ones are made by part."""
    level = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in LEVELS.items() for x in kv]), F.col("severity")), F.lit("none"))
    place = F.array(F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation")))
    result = F.struct(F.col("rule").alias("ruleId"), level.alias("level"), F.struct(F.col("message").alias("text")).alias("message"), place.alias("locations"))
    one = diagnostics.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("path", "line", "col", "rule", result.alias("r")))), lambda x: x.r).alias("results"), F.sort_array(F.collect_set("rule")).alias("rules"))
    driver = F.struct(F.struct(F.lit("corvane").alias("name"), F.transform("rules", lambda r: F.struct(r.alias("id"))).alias("rules")).alias("driver"))
    return one.select(*by, F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(F.struct(driver.alias("tool"), F.col("results"))).alias("runs"))).alias("sarif"))


def part_checksums(rows: DataFrame) -> DataFrame:
    """server, part_rows, part_sum: a sum over hashes of all rows, whatever their order."""
    columns = sorted(c for c in rows.columns if c not in ("server", "schema_version", "build", "part_rows", "part_sum"))
    return rows.groupBy("server").agg(F.count(F.lit(1)).alias("part_rows"), F.bit_xor(F.xxhash64(*columns)).alias("part_sum"))


def write_parts(rows: DataFrame, path: str, schema_version: int, build: str) -> None:
    """An index part per server, each with a checksum; parts of servers that rows don't have stay as they are. New parts
    are whole before they take the place of old ones, and readers see either these or those."""
    sums = part_checksums(rows).withColumnRenamed("server", "_s")
    full = rows.join(F.broadcast(sums), rows["server"].eqNullSafe(sums["_s"])).drop("_s")  # one row for each server
    full = full.withColumns({"schema_version": F.lit(schema_version), "build": F.lit(build)})
    now = segments.manifest(rows.sparkSession, path)
    number = now["number"] + 1 if now else 0
    if not segments.commit(rows.sparkSession, path, number, {"parts": full}, rows.select("server"), ("server",), expected=now and now["number"]):
        raise RuntimeError(f"another writer changed {path}")
