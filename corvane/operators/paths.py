"""Scopes, glob sets, directory roll-ups, routing of files to definitions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import ancestors

MAX_ALTERNATIVES = 256


def in_scope(path: Column, scope: str) -> Column:
    """The path itself or what lies beneath; "." and "" are all."""
    scope = scope.rstrip("/")
    if scope in ("", "."):
        return F.lit(True)
    return (path == scope) | F.startswith(path, F.lit(scope + "/"))


def expand_braces(pattern: str) -> list[str]:
    """Alternatives of {a,b}, nested ones too."""
    todo, done = [pattern], []
    while todo:
        if len(todo) + len(done) > MAX_ALTERNATIVES:
            raise ValueError("too many alternatives")
        p = todo.pop(0)
        close = p.find("}")
        open_ = p.rfind("{", 0, close) if close >= 0 else -1
        if open_ < 0:
            done += [p] * (p not in done)
        else:
            todo += [p[:open_] + x + p[close + 1 :] for x in p[open_ + 1 : close].split(",")]
    return done


def glob_regex(pattern: str) -> str:
    """One pattern without braces: ** is any number of segments, * and ? stay in one, a trailing /** also fits what is before it."""
    out, segments = "", pattern.split("/")
    for k, seg in enumerate(segments):
        last = k == len(segments) - 1
        if seg == "**":
            if last:
                out = (out[:-1] + "(/.*)?") if out.endswith("/") else out + ".*"
            else:
                out += "([^/]+/)*"
            continue
        i = 0
        while i < len(seg):
            c = seg[i]
            end = seg.find("]", i + 2) if c == "[" else -1
            if c == "*":
                out += "[^/]*"
            elif c == "?":
                out += "[^/]"
            elif end > 0:
                inner = seg[i + 1 : end]
                inner = "^" + inner[1:] if inner[0] in "!^" else inner
                out += "[" + inner.replace("\\", "\\\\") + "]"
                i = end
            else:
                out += re.escape(c) if not c.isalnum() and c != "_" else c
            i += 1
        out += "" if last else "/"
    return "^" + out + "$"


def set_regexes(patterns: list[str]) -> tuple[list[str], list[str]]:
    """Includes and excludes (!) as regexes: without a slash a pattern fits at any depth, and each also fits what lies beneath."""
    sides: tuple[list[str], list[str]] = ([], [])
    for p in patterns:
        side, p = (sides[1], p[1:]) if p.startswith("!") else (sides[0], p)
        p = p.removeprefix("./").rstrip("/")
        p = p if "/" in p else "**/" + p
        for q in expand_braces(p):
            side += [glob_regex(q.removeprefix("/")), glob_regex(q.removeprefix("/") + "/**")]
    return sides


def glob_set(path: Column, patterns: list[str]) -> Column:
    """Any include (or none given) and no exclude."""
    include, exclude = set_regexes(patterns)
    fits = F.lit(True) if not include else path.rlike("|".join(f"(?:{r})" for r in include))
    return fits & ~path.rlike("|".join(f"(?:{r})" for r in exclude)) if exclude else fits


def directory_rollup(files: DataFrame, path: str, depth: int, measures: dict[str, Column] | None = None) -> DataFrame:
    """Every file counts at the top and at each directory above it down to a depth."""
    dirs = F.filter(ancestors(F.col(path)), lambda d: (d == ".") | (F.size(F.split(d, "/")) <= depth))
    rows = files.withColumn("dir", F.explode(dirs))
    return rows.groupBy("dir").agg(F.count(F.lit(1)).alias("files"), *[c.alias(k) for k, c in (measures or {}).items()])


def tree(files: DataFrame, path: str, scope: str, limit: int) -> DataFrame:
    from corvane.operators.budget import with_totals

    return with_totals(files.where(in_scope(F.col(path), scope)), [F.col(path)], limit)


def coverage(files: DataFrame, language: str, extractors: list[str]) -> DataFrame:
    """Files of each language, and whether there is an extractor for it."""
    return files.groupBy(language).agg(F.count(F.lit(1)).alias("files")).withColumn("extractor", F.col(language).isin(extractors))


def route(files: DataFrame, key: str, path: str, language: str, definitions: list[dict]) -> DataFrame:
    """The definition of the highest priority, then the first name, whose languages or globs fit. Definitions are a short list in the plan."""
    fits = []
    for d in sorted(definitions, key=lambda d: (-d.get("priority", 0), d["name"])):
        ok = F.lit(False)
        if d.get("languages"):
            ok = ok | F.col(language).isin(d["languages"])
        if d.get("globs"):
            ok = ok | glob_set(F.col(path), d["globs"])
        fits.append(F.when(ok, F.lit(d["name"])))
    return files.select(key, F.coalesce(*fits, F.lit(None).cast("string")).alias("server"))


def nearest_root(files: DataFrame, path: str, existing: DataFrame, markers: list[str]) -> DataFrame:
    """The directory that holds the first marker in order; of directories with one marker, the deepest. existing: path."""
    up = files.select(F.col(path).alias("file"), F.explode(ancestors(F.col(path))).alias("dir"))
    wanted = up.select("file", "dir", F.posexplode(F.array(*[F.lit(m) for m in markers])).alias("rank", "marker"))
    wanted = wanted.withColumn("path", F.when(F.col("dir") == ".", F.col("marker")).otherwise(F.concat_ws("/", "dir", "marker")))
    found = wanted.join(existing.select("path").distinct(), "path")
    return found.groupBy("file").agg(F.min_by("dir", F.struct(F.col("rank"), (-F.when(F.col("dir") == ".", 0).otherwise(F.size(F.split("dir", "/")))).alias("d"))).alias("root"))
