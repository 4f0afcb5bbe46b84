"""Analyses of version history: churn, hotspots, co-change, line shifts, changed symbols."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.operators.graph import cut
from corvane.operators.intervals import meets

from corvane.functions.text import round_half_up


def churn(changes: DataFrame, file: str, commit: str, author: str, added: Column, removed: Column, when: str, since: Column | None = None) -> DataFrame:
    """Per file: commits, authors, added, removed, last. Distinct counts are exact."""
    rows = changes.where(F.col(when) >= since) if since is not None else changes
    return rows.groupBy(file).agg(F.countDistinct(commit).alias("commits"), F.countDistinct(author).alias("authors"), F.sum(added).alias("added"), F.sum(removed).alias("removed"), F.max(when).alias("last"))


def churn_order(rows: DataFrame, file: str, limit: int | None = None) -> DataFrame:
    """By commits, then lines that came or went, then file."""
    out = rows.orderBy(F.col("commits").desc(), (F.col("added") + F.col("removed")).desc(), file)
    return out.limit(limit) if limit else out


def hotspot_order(rows: DataFrame, file: str, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(F.col("score").desc(), file)
    return out.limit(limit) if limit else out


def since(age: str) -> Column:
    """An age like 90d, 6w or 2y as an interval, to take from a fixed time."""
    n, unit = int(age[:-1]), {"h": "hours", "d": "days", "w": "weeks", "m": "months", "y": "years"}[age[-1]]
    return F.expr(f"interval {n} {unit}")


def hot_score(commits: Column, size: Column) -> Column:
    return round_half_up(commits * (1 + F.log(1 + size)))


def hotspots(churned: DataFrame, sizes: DataFrame, file: str, size: str) -> DataFrame:
    """Churn times size; files that are gone fall out with the inner join."""
    return churned.join(sizes, file).withColumn("score", hot_score(F.col("commits"), F.col(size)))


def cochange(baskets: DataFrame, commit: str, item: str, subject, bulk: int) -> DataFrame:
    """Items in commits with the subject, and in how many; commits of more than bulk items are left out.

    Commits are cut down to those with the subject before anything is joined, so no basket is paired with itself.
    """
    pairs = baskets.select(commit, item).distinct()
    small = pairs.join(pairs.where(F.col(item) == F.lit(subject)).select(commit), commit, "left_semi")
    sizes = small.groupBy(commit).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") <= bulk)
    found = small.join(sizes.select(commit), commit, "left_semi").where(F.col(item) != F.lit(subject)).groupBy(item).agg(F.count(F.lit(1)).alias("together"))
    most = found.agg(F.max("together").alias("most"))
    return found.crossJoin(F.broadcast(most)).select(item, "together", (2.0 * F.col("together") / F.col("most")).alias("weight"))


def shift_line(line: Column, hunks: Column) -> Column:
    """A line of the old side carried to the new side of one diff: struct(line, lost).

    hunks: array of (old_start, old_count, new_start, new_count). A pure insertion moves only lines after old_start.
    """
    start = F.struct(line.cast("long").alias("line"), F.lit(False).alias("lost"), F.lit(False).alias("done"), F.lit(0).cast("long").alias("shift"))

    def step(acc, h):
        end = h.old_start + F.when(h.old_count == 0, 1).otherwise(h.old_count)
        first = F.when(h.old_count == 0, h.old_start + 1).otherwise(h.old_start)
        inside = (h.old_count > 0) & (line >= h.old_start) & (line < h.old_start + h.old_count)
        return (
            F.when(acc.done | (line < first), acc)
            .when(inside, F.struct(h.new_start.cast("long").alias("line"), F.lit(True).alias("lost"), F.lit(True).alias("done"), acc["shift"].alias("shift")))
            .otherwise(F.struct(acc["line"].alias("line"), F.lit(False).alias("lost"), F.lit(False).alias("done"), (acc["shift"] + h.new_count - h.old_count).cast("long").alias("shift")))
        )

    got = F.aggregate(F.array_sort(hunks), start, step)
    return F.struct(F.when(got.lost, got["line"]).otherwise(line + got["shift"]).cast("long").alias("line"), got.lost.alias("lost"))


def carry(line: Column, layers: Column) -> Column:
    """A line through layers of hunks, the oldest first."""
    return F.aggregate(layers, F.struct(line.cast("long").alias("line"), F.lit(False).alias("lost")), lambda acc, hunks: _through(acc, hunks))


def _through(acc, hunks):
    moved = shift_line(acc["line"], hunks)
    return F.struct(moved["line"].alias("line"), (acc["lost"] | moved["lost"]).alias("lost"))


def touches(start: Column, end: Column, new_start: Column, new_count: Column) -> Column:
    """A hunk's new side meets lines start to end; a pure deletion counts between two of them."""
    return F.when(new_count > 0, (start <= new_start + new_count - 1) & (end >= new_start)).otherwise((start <= new_start) & (new_start < end))


def _near(hunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Hunks with the symbols that their new sides touch."""
    sides = hunks.withColumn("_z", F.col("new_start") + F.greatest(F.col("new_count") - 1, F.lit(0)))
    hit = meets(sides, symbols, "file", "new_start", "_z", "line", "end_line").drop("_z")
    return hit.where(touches(F.col("line"), F.col("end_line"), F.col("new_start"), F.col("new_count")))


def changed_symbols(new: DataFrame, old: DataFrame, hunks: DataFrame) -> DataFrame:
    """new and old: file, key (the identifier without its path), line, end_line; hunks: file, old_start, old_count, new_start, new_count.

    A hunk belongs to the innermost symbols it lies in. Rows: file, key, change, line; hunks that explain nothing give
    one row of the file (key null).
    """
    hunks = cut(hunks.select("file", "old_start", "old_count", "new_start", "new_count"))  # made once: four steps read them
    hit = _near(hunks, new)
    whole = (F.col("new_start") >= F.col("line")) & (F.col("new_start") + F.greatest(F.col("new_count"), F.lit(1)) - 1 <= F.col("end_line"))
    inner = F.min(F.when(whole, F.col("end_line") - F.col("line"))).over(Window.partitionBy("file", "new_start", "new_count", "old_start", "old_count"))
    hit = hit.withColumn("_inner", inner).where(F.col("_inner").isNull() | (F.col("end_line") - F.col("line") <= F.col("_inner")))
    hit = cut(hit.select("file", "key", "old_start", "old_count", "new_start", "new_count"))
    touched = hit.select("file", "key").distinct().withColumn("_hit", F.lit(True))
    both = new.select("file", "key", "line").join(old.select("file", "key", F.col("line").alias("old_line")), ["file", "key"], "full_outer").join(touched, ["file", "key"], "left")
    change = F.when(F.col("old_line").isNull(), "added").when(F.col("line").isNull(), "removed").when(F.col("_hit"), "modified")
    rows = both.select("file", "key", change.alias("change"), F.coalesce("line", "old_line").alias("line")).where("change is not null")
    gone = old.join(new.select("file", "key"), ["file", "key"], "left_anti").select("file", F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    keys = ["file", "old_start", "old_count", "new_start", "new_count"]
    before = hunks.where("old_count > 0").withColumn("_z", F.col("old_start") + F.col("old_count") - 1)
    explained = hit.select(*keys).distinct().unionByName(meets(before, gone, "file", "old_start", "_z", "_a", "_b").select(*keys))
    loose = hunks.join(explained, keys, "left_anti").groupBy("file").agg(F.min("new_start").alias("line"))
    return rows.unionByName(loose.select("file", F.lit(None).cast("string").alias("key"), F.lit("modified").alias("change"), "line"))


def symbol_churn(symbols: DataFrame, hunks: DataFrame) -> DataFrame:
    """symbols: id, file, line, end_line; hunks (on today's lines): commit, author, file, new_start, new_count, old_count, when.

    added counts the lines of a hunk inside the symbol; removed counts once, for the first symbol a hunk touches.
    """
    hit = _near(cut(hunks), symbols)
    hunk = Window.partitionBy("commit", "file", "new_start", "new_count", "old_count")
    hit = hit.withColumn("_inner", F.min(F.col("end_line") - F.col("line")).over(hunk)).where("end_line - line = _inner")
    hit = hit.withColumn("_first", F.row_number().over(hunk.orderBy("line", "id")) == 1)
    lines_in = F.greatest(F.least(F.col("end_line"), F.col("new_start") + F.col("new_count") - 1) - F.greatest("line", "new_start") + 1, F.lit(0))
    return hit.groupBy("id").agg(F.countDistinct("commit").alias("commits"), F.countDistinct("author").alias("authors"), F.sum(lines_in).alias("added"), F.sum(F.when(F.col("_first"), F.col("old_count")).otherwise(0)).alias("removed"))
