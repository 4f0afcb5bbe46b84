"""Listings of symbols: enumeration, outlines, source slices, diagnostics."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.budget import with_totals
from corvane.operators.grep import lines
from corvane.operators.paths import in_scope
from corvane.operators.search import SearchQuery, filters

#: Severities, the gravest first.
SEVERITIES = ("error", "warning", "information", "hint")


def enumerate_symbols(symbols: DataFrame, q: SearchQuery) -> DataFrame:
    """Symbols that pass the filters of a query, in order of place."""
    return with_totals(filters(symbols, q), [F.col("path"), F.col("line"), F.col("id")], q.limit)


def outline(symbols: DataFrame, path: str, limit: int = 0) -> DataFrame:
    """The symbols of one file or directory in document order, indented by depth; one limit for all levels."""
    rows = symbols.where(in_scope(F.col("path"), path))
    text = F.concat(F.repeat(F.lit("  "), F.col("depth")), F.col("kind"), F.lit(" "), F.col("name"))
    return with_totals(rows.withColumn("text", text), [F.col("path"), F.col("line"), F.col("depth")], limit)


def children(symbols: DataFrame) -> DataFrame:
    """Each symbol with the names of those right beneath it, in order. symbols: path, ordinal, parent, name, line."""
    kids = symbols.where("parent is not null").groupBy("path", F.col("parent").alias("ordinal")).agg(F.transform(F.sort_array(F.collect_list(F.struct("line", "name"))), lambda x: x["name"]).alias("children"))
    return symbols.join(kids, ["path", "ordinal"], "left")


def source_slices(files: DataFrame, spans: DataFrame, key: str, text: str) -> DataFrame:
    """Text of line ranges. spans: key, id, line, end_line. Files without a span are not split."""
    some = files.join(spans.select(key).distinct(), key, "left_semi")
    rows = lines(some, key, text).withColumnRenamed("line", "_line")
    hit = rows.join(spans, key).where(F.col("_line").between(F.col("line"), F.col("end_line")))
    got = F.sort_array(F.collect_list(F.struct("_line", "text")))
    return hit.groupBy(key, "id").agg(F.array_join(F.transform(got, lambda x: x.text), "\n").alias("source"))


def parent_ordinals(symbols: DataFrame) -> DataFrame:
    """After sorting by place: the new ordinal of each symbol and of its parent. symbols: path, ordinal, parent, line."""
    new = symbols.withColumn("new", F.row_number().over(Window.partitionBy("path").orderBy("line", "ordinal")) - 1)
    up = new.select("path", F.col("ordinal").alias("parent"), F.col("new").alias("new_parent"))
    return new.join(up, ["path", "parent"], "left")


def diagnostics(rows: DataFrame, severity: str, order: list, limit: int = 0) -> DataFrame:
    """Sorted diagnostics with has_errors over all of them, whatever the limit."""
    any_ = rows.agg(F.coalesce(F.bool_or(F.col(severity) == "error"), F.lit(False)).alias("has_errors"))
    return with_totals(rows, order, limit).crossJoin(F.broadcast(any_))


def enclosing_chain(symbols: DataFrame) -> DataFrame:
    """Each symbol with the names of those that hold it, from the top, by their parents. symbols: path, ordinal, parent, name.

    Parents are looked up level by level; the levels are those of nested declarations, 64 at most.
    """
    up = symbols.select(F.col("path").alias("_p"), F.col("ordinal").alias("_o"), F.col("parent").alias("_up"), F.col("name").alias("_name"))
    rows = symbols.withColumns({"chain": F.array().cast("array<string>"), "_at": F.col("parent")})
    for _ in range(64):
        if not rows.where("_at is not null").limit(1).count():
            break
        rows = rows.join(up, (F.col("path") == F.col("_p")) & (F.col("_at") == F.col("_o")), "left")
        rows = rows.select(*symbols.columns, F.when(F.col("_name").isNotNull(), F.concat(F.array("_name"), "chain")).otherwise(F.col("chain")).alias("chain"), F.col("_up").alias("_at"))
    return rows.drop("_at")


def context(files: DataFrame, symbols: DataFrame, key: str, text: str, header_lines: int = 80) -> DataFrame:
    """For each symbol (key, id, line, end_line): its source, and the import header of its file as header."""
    from corvane.functions.doc import header_of

    slices = source_slices(files, symbols.select(key, "id", "line", "end_line"), key, text)
    heads = files.join(symbols.select(key).distinct(), key, "left_semi").select(key, header_of(F.col(text), F.lit(header_lines)).alias("header"))
    return symbols.join(slices, [key, "id"], "left").join(heads, key, "left")
