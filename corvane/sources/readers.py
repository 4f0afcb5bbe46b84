"""Sources: files of a tree, version-control logs and diffs, language-server JSON, command lines."""

from __future__ import annotations

import json
import re
import shlex
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corvane.functions.text import language_id
from corvane.sources import segments

#: Directories that a walk passes over.
SKIPPED = ("node_modules", "vendor", "target", "dist", "build", "__pycache__")
#: Names of symbol kinds by number.
SYMBOL_KINDS = "file module namespace package class method property field constructor enum interface function variable constant string number boolean array object key null enum-member struct event operator type-parameter".split()


def read_files(spark: SparkSession, root: str) -> DataFrame:
    """path (under root), language, size, mtime, hash and content of every file, hidden and generated directories left out."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    top = root.rstrip("/").split("://")[-1].removeprefix("file:")
    path = F.regexp_replace(F.regexp_replace("path", r"^[a-z]+:/*", "/"), "^" + re.escape("/" + top.lstrip("/")) + "/", "")
    rows = raw.select(path.alias("path"), F.col("length").alias("size"), F.col("modificationTime").alias("mtime"), "content")
    hidden = r"(^|/)(\.[^/]+|" + "|".join(SKIPPED) + r")(/|$)"
    rows = rows.where(~F.col("path").rlike(hidden))
    return rows.select("path", language_id(F.col("path")).alias("language"), "size", "mtime", F.sha2("content", 256).alias("hash"), "content")


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """value: one record of a version-control log in each row, read from text files of any size. Records begin with \\x01,
    which is the row delimiter, so a large file is split among tasks and no row holds more than a commit."""
    return spark.read.option("lineSep", "\u0001").text(path).where("value <> ''")


def read_listing(spark: SparkSession, path: str) -> DataFrame:
    """path of every file in listings of any size (zero bytes between paths), each once, in order."""
    return spark.read.option("lineSep", "\u0000").text(path).select(F.col("value").alias("path")).where("path <> ''").distinct().orderBy("path")


def parse_log(texts: DataFrame, column: str) -> DataFrame:
    """Records of \\x01 sha \\x1f author \\x1f date \\x02 numstat lines: sha, author, date, path, added, removed, binary."""
    records = texts.select(F.explode(F.split(column, "\u0001")).alias("r")).where("r <> ''")
    head = F.split(F.substring_index("r", "\u0002", 1), "\u001f")
    rows = records.select(head[0].alias("sha"), head[1].alias("author"), F.trim(head[2]).alias("date"), F.explode(F.split(F.substring_index("r", "\u0002", -1), "\n")).alias("line"))
    parts = F.split("line", "\t")
    rows = rows.where(F.size(parts) == 3)
    number = lambda c: F.when(c == "-", 0).otherwise(c.cast("int"))
    return rows.select("sha", "author", F.to_timestamp("date").alias("date"), parts[2].alias("path"), number(parts[0]).alias("added"), number(parts[1]).alias("removed"), (parts[0] == "-").alias("binary"))


def parse_names(texts: DataFrame, column: str) -> DataFrame:
    """The same records with one path a line instead of counts: sha, author, date, path."""
    records = texts.select(F.explode(F.split(column, "\u0001")).alias("r")).where("r <> ''")
    head = F.split(F.substring_index("r", "\u0002", 1), "\u001f")
    rows = records.select(head[0].alias("sha"), head[1].alias("author"), F.to_timestamp(F.trim(head[2])).alias("date"), F.explode(F.split(F.substring_index("r", "\u0002", -1), "\n")).alias("path"))
    return rows.where("path <> ''")


def parse_patches(texts: DataFrame, column: str) -> DataFrame:
    """The same records with a zero-context diff each: sha, author, date and the columns of its hunks."""
    records = texts.select(F.explode(F.split(column, "\u0001")).alias("r")).where("r <> ''")
    head = F.split(F.substring_index("r", "\u0002", 1), "\u001f")
    rows = records.select(head[0].alias("sha"), head[1].alias("author"), F.to_timestamp(F.trim(head[2])).alias("date"), F.substring_index("r", "\u0002", -1).alias("diff"))
    return rows.drop("diff").join(parse_diff(rows, "sha", "diff"), "sha")


def git_listing(listed: DataFrame, column: str) -> DataFrame:
    """path of every file of a listing (text with zero bytes between paths), each once, in order."""
    return listed.select(F.explode(F.split(column, "\u0000")).alias("path")).where("path <> ''").distinct().orderBy("path")


def ignore_rules(lines: list[str]) -> tuple[list[tuple[bool, str]], ...]:
    """Ignore lines as (keeps, pattern over whole paths), in order; blank lines and comments fall out."""
    from corvane.operators.paths import glob_regex

    out = []
    for line in lines:
        line = line.rstrip()
        if not line or line.startswith("#"):
            continue
        keeps, p = line.startswith("!"), line.removeprefix("!").removeprefix("\\")
        inner, p = "/" in p.rstrip("/"), p.removeprefix("/")
        directory, p = p.endswith("/"), p.rstrip("/")
        p = p if inner else "**/" + p
        out.append((keeps, glob_regex(p + "/**")[:-1].removesuffix("(/.*)?") + ("/.*$" if directory else "(/.*)?$")))
    return out


def not_ignored(path, lines: list[str]):
    """Whether a file's path passes ignore rules: the last rule that fits decides."""
    verdict = F.lit(True)
    for keeps, pattern in ignore_rules(lines):
        verdict = F.when(path.rlike(pattern), F.lit(keeps)).otherwise(verdict)
    return verdict


HUNK = re.compile(r"^@@ -(\d+)(?:,(\d+))? \+(\d+)(?:,(\d+))? @@")


def diff_rows(text: str) -> list[tuple]:
    """(old_path, new_path, status, binary, old_start, old_count, new_start, new_count); files without hunks have one row."""
    out: list[tuple] = []
    old = new = status = None
    binary, hunks = False, []

    def close() -> None:
        if old is not None:
            for h in hunks or [(None,) * 4]:
                out.append((old, new, status, binary, *h))

    plain = lambda p: re.sub(r"^[ab]/", "", json.loads(p) if p.startswith('"') else p.rstrip("\t"))
    for line in text.split("\n"):
        if line.startswith("diff --git "):
            close()
            m = re.match(r'diff --git ("(?:\\.|[^"])*"|\S.*?) ("(?:\\.|[^"])*"|b/.*)$', line)
            old, new, status, binary, hunks = plain(m[1]) if m else "", plain(m[2]) if m else "", "M", False, []
        elif old is None:
            continue
        elif line.startswith("new file"):
            status = "A"
        elif line.startswith("deleted file"):
            status = "D"
        elif line.startswith("rename from "):
            old, status = plain(line[12:]), "R"
        elif line.startswith("rename to "):
            new = plain(line[10:])
        elif line.startswith("Binary files"):
            binary = True
        elif m := HUNK.match(line):
            hunks.append((int(m[1]), int(m[2] or 1), int(m[3]), int(m[4] or 1)))
    close()
    return out


DIFF = "old_path string, new_path string, status string, binary boolean, old_start int, old_count int, new_start int, new_count int"


def parse_diff(texts: DataFrame, key: str, column: str) -> DataFrame:
    """Hunks of zero-context diffs, by key."""
    kind = dict(texts.dtypes)[key]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(k, *r) for k, t in zip(batch[key], batch[column]) for r in diff_rows(t or "")]
            out = pd.DataFrame(rows, columns=[key, *[c.split()[0] for c in DIFF.split(", ")]])
            yield out.astype({c: "Int32" for c in ("old_start", "old_count", "new_start", "new_count")})

    return texts.select(key, column).mapInPandas(run, f"{key} {kind}, {DIFF}")


def decode_symbols(text: str) -> list[tuple]:
    """Nested or flat symbols of a JSON answer: (ordinal, parent ordinal, name, qualified, kind, line, end_line, depth)."""
    out: list[tuple] = []

    def put(s: dict, parent: int | None, prefix: str, depth: int) -> None:
        span = s.get("range") or s.get("location", {}).get("range") or {}
        name = re.sub(r"^\(\*?([\w]+)(?:\[[^\]]*\])?\)\.", r"\1.", s.get("name", ""))
        container = s.get("containerName") or prefix
        qualified = f"{container}.{name}" if container and "." not in name else name
        k = s.get("kind", 0)
        me = len(out)
        out.append((me, parent, s.get("name", ""), qualified, SYMBOL_KINDS[k - 1] if 1 <= k <= len(SYMBOL_KINDS) else f"kind-{k}", span.get("start", {}).get("line", 0) + 1, span.get("end", {}).get("line", 0) + 1, depth))
        for child in s.get("children") or []:
            put(child, me, qualified, min(depth + 1, 64))

    for s in json.loads(text or "[]") or []:
        put(s, None, "", 0)
    return out


SYMBOLS = "ordinal int, parent int, name string, qualified string, kind string, line int, end_line int, depth int"


def read_symbols(answers: DataFrame, path: str, column: str) -> DataFrame:
    """Symbols with ids path::Qualified#kind, numbered ~2, ~3 in order of position where they repeat."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, *r) for p, t in zip(batch[path], batch[column]) for r in decode_symbols(t)]
            yield pd.DataFrame(rows, columns=["path", *[c.split()[0] for c in SYMBOLS.split(", ")]]).astype({"parent": "Int32"})

    rows = answers.select(path, column).mapInPandas(run, f"path string, {SYMBOLS}")
    base = F.concat(F.col("path"), F.lit("::"), F.col("qualified"), F.lit("#"), F.col("kind"))
    return number_ids(rows.withColumn("_base", base), "_base", ["line", "ordinal"]).drop("_base")


def number_ids(rows: DataFrame, base: str, order: list[str], block: int = 4096) -> DataFrame:
    """Adds id: the base, and ~2, ~3 and so on where it comes again, in order.

    A base that comes often is numbered in parts: rows are counted by blocks of the order's first column (a whole
    number), so no task has to sort all rows of one base.
    """
    part = F.floor(F.col(order[0]) / block)
    counts = rows.groupBy(F.col(base).alias("_b"), part.alias("_part")).agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy("_b").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_b", F.col("_part").alias("_p"), F.coalesce(before, F.lit(0)).alias("_before"))
    placed = rows.withColumn("_part", part)
    placed = placed.join(counts, F.col(base).eqNullSafe(F.col("_b")) & F.col("_part").eqNullSafe(F.col("_p")))
    n = F.col("_before") + F.row_number().over(Window.partitionBy(base, "_part").orderBy(*order))
    return placed.withColumn("_n", n).withColumn("id", F.when(F.col("_n") == 1, F.col(base)).otherwise(F.concat(F.col(base), F.lit("~"), F.col("_n").cast("string")))).drop("_part", "_b", "_p", "_before", "_n")


def read_workspace_symbols(answers: DataFrame, key: str, column: str) -> DataFrame:
    """Flat symbols in the order that the server gave them: name, container, kind, path and, where there is a range, line."""
    kinds = F.array(*[F.lit(k) for k in SYMBOL_KINDS])
    item = "struct<name:string,kind:int,containerName:string,location:struct<uri:string,range:struct<start:struct<line:int>>>>"
    rows = answers.select(key, F.posexplode(F.from_json(column, f"array<{item}>")).alias("server_order", "s"))
    return rows.select(key, "server_order", F.col("s.name").alias("name"), F.col("s.containerName").alias("container"), F.element_at(kinds, F.col("s.kind")).alias("kind"), F.regexp_replace("s.location.uri", "^file://", "").alias("path"), (F.col("s.location.range.start.line") + 1).alias("line"))


@F.udf(ArrayType(StringType()), useArrow=True)
def split_command(line):
    """Words of a command line with shell quoting; null where quotes don't close."""
    try:
        return shlex.split(line or "")
    except ValueError:
        return None


def read_commands(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    return rows.select(F.col("value").alias("line"), split_command("value").alias("words"))


def read_parts(spark: SparkSession, path: str, schema_version: int, build: str) -> DataFrame:
    """Rows of a written index that belong to this schema and build; other parts, and those whose checksum is wrong, are as if they were not there."""
    from corvane.sources.sinks import part_checksums

    rows = segments.live(spark, path, "parts", "server").drop("_segment").where((F.col("schema_version") == schema_version) & (F.col("build") == build))
    sums = part_checksums(rows).select(F.col("server").alias("_s"), F.col("part_rows").alias("_n"), F.col("part_sum").alias("_x"))
    whole = rows.join(F.broadcast(sums), rows["server"].eqNullSafe(sums["_s"]) & (rows["part_rows"] == sums["_n"]) & (rows["part_sum"] == sums["_x"]), "left_semi")
    return whole.drop("schema_version", "build", "part_rows", "part_sum")
