"""Full-text search by line: matches with line, byte column, hits and context."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import byte_column, quoted, word_pattern

LIMIT = 50
MAX_QUERY_BYTES = 4096


def lines(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, line (from 1), text: split at newlines, a carriage return at the end dropped, an empty tail left out."""
    parts = F.split(F.col(text), "\n")
    parts = F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)
    rows = df.select(F.col(key), F.posexplode(parts).alias("pos", "text"))
    return rows.select(key, (F.col("pos") + 1).alias("line"), F.regexp_replace("text", "\r$", "").alias("text"))


def pattern_of(query: str, regex: bool = False, word: bool = False, case: bool = False) -> str:
    if len(query.encode()) > MAX_QUERY_BYTES:
        raise ValueError("query too long")
    body = word_pattern(query) if word and not regex else query if regex else quoted(query)
    if word and regex:
        body = r"(?<![\p{L}\p{Nd}_])(?:" + body + r")(?![\p{L}\p{Nd}_])"
    return body if case else "(?iu)" + body


def required_literal(pattern: str) -> str:
    """The longest run of plain characters that every match of a pattern holds; "" where none is sure."""
    if "|" in pattern or "(?" in pattern:
        return ""
    best = run = ""
    depth, i = 0, 0
    while i < len(pattern):
        c, plain = pattern[i], None
        if c == "\\":
            i += 1
            follows = pattern[i : i + 1]
            plain = follows if follows and not follows.isalnum() else None
        elif c == "[":
            i = pattern.find("]", i + 2)
            if i < 0:
                return ""
        elif c in "()":
            depth += 1 if c == "(" else -1
        elif c not in ".^$*+?{}":
            plain = c
        following = pattern[i + 1 : i + 2]
        if c == "{":
            i = max(i, pattern.find("}", i))
        optional = following in ("*", "?", "{")
        if plain is not None and depth == 0 and not optional:
            run += plain
            if len(run) > len(best):
                best = run
        if plain is None or depth or following in ("*", "+", "?", "{"):
            run = ""
        i += 1
    return best


#: Letters beyond ASCII that fold to ASCII ones, or change their length, without case.
FOLDING = "\u017f\u0130\u0131\u212a"


def may_hold(text: Column, literal: str, case: bool) -> Column:
    """A cheap test that every text with the literal passes."""
    if case or not literal:
        return F.contains(text, F.lit(literal))
    if not literal.isascii():
        return F.lit(True)
    found = F.contains(F.lower(text), F.lit(literal.lower()))
    if literal.upper() == literal.lower():
        return found
    for c in FOLDING:
        found = found | F.contains(text, F.lit(c))
    return found


def search_text(df: DataFrame, key: str, text: str, query: str, regex: bool = False, word: bool = False, case: bool = False) -> DataFrame:
    """key, line, col (bytes, from 1), hits, text for every line that matches. Rows whose whole text can't match fall out before they are split."""
    pattern = pattern_of(query, regex, word, case)
    whole = may_hold(F.col(text), required_literal(query) if regex else query, case)
    one = F.contains(F.col("text"), F.lit(query)) if case and not regex and not word else F.col("text").rlike(pattern)
    rows = lines(df.where(whole), key, text).where(one)
    inline, body = ("(?iu)", pattern[5:]) if pattern.startswith("(?iu)") else ("", pattern)
    first = F.length(F.regexp_extract(F.col("text"), f"{inline}^(.*?)(?:{body})", 1))
    return rows.select(key, "line", byte_column(F.col("text"), first).alias("col"), F.regexp_count("text", F.lit(pattern)).alias("hits"), "text")


def with_context(df: DataFrame, key: str, text: str, matches: DataFrame, n: int) -> DataFrame:
    """Matches with n lines before and after, joined by newlines. Only texts with a match are split again."""
    some = df.join(matches.select(key).distinct(), key, "left_semi")
    spec = Window.partitionBy(key).orderBy("line")
    near = lines(some, key, text).select(key, "line", F.array_join(F.collect_list("text").over(spec.rowsBetween(-n, -1)), "\n").alias("before"), F.array_join(F.collect_list("text").over(spec.rowsBetween(1, n)), "\n").alias("after"))
    return matches.join(near, [key, "line"])


def totals(matches: DataFrame, key: str, limit: int = LIMIT) -> DataFrame:
    """The first matches in (key, line) with the exact totals over all."""
    all_ = matches.agg(F.count(F.lit(1)).alias("total"), F.countDistinct(key).alias("files_matched"))
    return matches.orderBy(key, "line").limit(limit).crossJoin(F.broadcast(all_)).withColumn("truncated", F.col("total") > limit)


def position_of(text: Column, offset: Column) -> Column:
    """Line (from 1) and byte column (from 1) of a 0-based character offset."""
    before = F.substring(text, F.lit(1), offset)
    last = F.substring_index(before, "\n", -1)
    return F.struct((F.length(before) - F.length(F.translate(before, "\n", "")) + 1).cast("long").alias("line"), (F.octet_length(last) + 1).cast("long").alias("col"))


def line_range(df: DataFrame, key: str, text: str, start: int, end: int) -> DataFrame:
    return lines(df, key, text).where(F.col("line").between(start, end))
