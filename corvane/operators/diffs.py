"""Text differences: line edits, applying them, unified form, merging two lists of edits."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from corvane.sources import segments

EDITS = ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType()), StructField("new", StringType())]))


def text_edits(old: str, new: str) -> list[tuple[int, int, str]]:
    """Edits (start, end, new text) in characters of old that make new of it: by lines, then by characters inside changed lines."""
    a, b = old.splitlines(keepends=True), new.splitlines(keepends=True)
    starts = [0]
    for line in a:
        starts.append(starts[-1] + len(line))
    out = []
    for op, i, j, k, m in difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes():
        if op == "equal":
            continue
        left, right = old[starts[i] : starts[j]], "".join(b[k:m])
        head = 0
        while head < min(len(left), len(right)) and left[head] == right[head]:
            head += 1
        tail = 0
        while tail < min(len(left), len(right)) - head and left[-1 - tail] == right[-1 - tail]:
            tail += 1
        out.append((starts[i] + head, starts[j] - tail, right[head : len(right) - tail]))
    return out


def apply_edits(old: str, edits: list[tuple[int, int, str]]) -> str:
    """Edits in order; overlaps and ranges outside the text are errors."""
    out, at = [], 0
    for start, end, new in sorted(edits, key=lambda e: (e[0], e[1])):
        if start < at or end < start or end > len(old):
            raise ValueError("edits overlap or lie outside the text")
        out += [old[at:start], new]
        at = end
    return "".join(out) + old[at:]


def merge_edits(a: list[tuple[int, int, str]], b: list[tuple[int, int, str]]) -> list[tuple[int, int, str]] | None:
    """Both lists in one, equal edits once; None if they conflict."""
    out: list[tuple[int, int, str]] = []
    for e in sorted({*map(tuple, a), *map(tuple, b)}):
        if out and (e[0] < out[-1][1] or (e[0] == out[-1][0] and e[0] == e[1] and out[-1][0] == out[-1][1])):
            return None
        out.append(e)
    return out


def unified(old: str, new: str, old_name: str = "old", new_name: str = "new", context: int = 3) -> str:
    """Unified form with a mark where the last line has no newline."""
    out = []
    for line in difflib.unified_diff(old.splitlines(keepends=True), new.splitlines(keepends=True), old_name, new_name, n=context):
        out.append(line if line.endswith("\n") else line + "\n\\ No newline at end of file\n")
    return "".join(out)


@F.pandas_udf(EDITS)
def edits_udf(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else text_edits(a, b) for a, b in zip(old, new)])


@F.pandas_udf(StringType())
def apply_udf(old: pd.Series, edits: pd.Series) -> pd.Series:
    """Texts after their edits (arrays of start, end, new)."""
    plain = lambda es: [(int(e["start"]), int(e["end"]), e["new"]) for e in es]
    return pd.Series([None if a is None else a if e is None else apply_edits(a, plain(e)) for a, e in zip(old, edits)])


@F.pandas_udf(EDITS)
def merge_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    """Both lists of edits in one; null where they conflict."""
    plain = lambda es: [(int(e["start"]), int(e["end"]), e["new"]) for e in (es if es is not None else [])]
    return pd.Series([merge_edits(plain(x), plain(y)) for x, y in zip(a, b)])


def edited(text: Column, edits: Column) -> Column:
    """A text after sorted edits (start, end, new) that are known to lie inside it and apart."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    step = lambda acc, e: F.struct(F.concat(acc.out, F.substring(text, acc.at + 1, e.start - acc.at), e.new).alias("out"), e.end.alias("at"))
    return F.aggregate(edits, start, step, lambda acc: F.concat(acc.out, F.substring(text, acc.at + 1, F.length(text))))


def apply_transaction(documents: DataFrame, edits: DataFrame, group: str) -> DataFrame:
    """documents (uri, text, version, group) after edits (uri, start, end, new_text, version), each group whole or not at all:
    one edit with a problem leaves all texts of its group as they are. Adds applied and the group's first problem."""
    from corvane.operators.intervals import validate_edits

    known = documents.select("uri", "version", F.length("text").alias("length"))
    checked = validate_edits(edits, known)
    groups = checked.join(documents.select("uri", group), "uri").groupBy(group).agg(F.min("problem").alias("problem"))
    one = F.struct(F.col("start").cast("int").alias("start"), F.col("end").cast("int").alias("end"), F.coalesce("new_text", F.lit("")).alias("new"))
    lists = edits.groupBy("uri").agg(F.sort_array(F.collect_list(one)).alias("_edits"))
    rows = documents.join(lists, "uri", "left").join(groups.withColumnRenamed(group, "_g"), F.col(group).eqNullSafe(F.col("_g")), "left").drop("_g")
    applied = F.col("problem").isNull() & F.col("_edits").isNotNull()
    return rows.withColumn("text", F.when(applied, edited(F.col("text"), F.col("_edits"))).otherwise(F.col("text"))).withColumn("applied", applied).drop("_edits")


def store_documents(documents: DataFrame, path: str) -> None:
    """documents (uri, text, version, and what groups them) as the first version of a stored table."""
    segments.commit(documents.sparkSession, path, 0, {"documents": documents, "outcomes": documents.limit(0).select("uri", F.lit(False).alias("applied"), F.lit("").alias("problem"))}, documents.select("uri"))


def stored_documents(spark: SparkSession, path: str) -> DataFrame:
    return segments.live(spark, path, "documents", "uri").drop("_segment")


def commit_edits(spark: SparkSession, path: str, edits: DataFrame, group: str) -> bool:
    """Applies edits to stored documents: the changed texts are staged with a version one higher, and one manifest makes
    all groups without a problem current at once. A run that dies before leaves the old state whole. False, and nothing
    is written, if another writer was first: its texts are not the ones that were read. What became of each document with
    edits is in `outcomes`."""
    now = segments.manifest(spark, path)
    rows = apply_transaction(stored_documents(spark, path), edits, group)
    changed = rows.where("applied").withColumn("version", F.col("version") + 1).drop("applied", "problem")
    said = rows.join(edits.select("uri").distinct(), "uri", "left_semi").select("uri", "applied", F.coalesce("problem", F.lit("")).alias("problem"))
    return segments.commit(spark, path, now["number"] + 1, {"documents": changed, "outcomes": said}, changed.select("uri"), expected=now["number"])


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """uri, applied and problem ('' for none) of the last commit."""
    newest = segments.parts(spark, path, "outcomes")
    return newest.where(F.col("_segment") == len(segments.manifest(spark, path)["segments"]) - 1).drop("_segment")


def preview(documents: DataFrame, edits: DataFrame) -> DataFrame:
    """uri and the unified difference that a server's edits (rename, code action, format) would make; nothing is written."""
    lists = edits.groupBy("uri").agg(F.sort_array(F.collect_list(F.struct("start", "end", F.col("new_text").alias("new")))).alias("_edits"))
    return documents.join(lists, "uri").select("uri", preview_udf("text", "_edits").alias("diff"))


@F.udf(StringType(), useArrow=False)
def preview_udf(text, edits):
    """The difference that edits make. Rows come in batches of a hundred, however many a task has and however long."""
    if text is None or edits is None:
        return None if text is None else unified(text, text)
    return unified(text, apply_edits(text, [(int(e["start"]), int(e["end"]), e["new"]) for e in edits]))


@F.pandas_udf(StringType())
def unified_udf(old: pd.Series, new: pd.Series) -> pd.Series:
    return pd.Series([None if a is None or b is None else unified(a, b) for a, b in zip(old, new)])


@F.pandas_udf(BooleanType())
def roundtrip_udf(old: pd.Series, new: pd.Series) -> pd.Series:
    """Applying the difference of two texts to the first gives the second."""
    return pd.Series([None if a is None or b is None else apply_edits(a, text_edits(a, b)) == b for a, b in zip(old, new)])
