"""Points in intervals, overlaps, and validation of edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def innermost(points: DataFrame, intervals: DataFrame, on: str, point: str, start: str, end: str, point_keys: list[str], ordinal: str) -> DataFrame:
    """Each point with the shortest interval of its file that holds it (the later one of equals), left-joined.

    An interval lies in one or two cells of the width that its own length has, rounded up to a power of two, so a point
    meets only intervals that begin near it, whatever else its file holds.
    """
    best = innermost_held(points, intervals, on, point, start, end, point_keys, ordinal)
    keys = best.withColumnsRenamed({k: f"_p{n}" for n, k in enumerate(point_keys)})
    same = [F.col(k).eqNullSafe(F.col(f"_p{n}")) for n, k in enumerate(point_keys)]
    return points.join(keys, same, "left").drop(*[f"_p{n}" for n in range(len(point_keys))])


def innermost_held(points: DataFrame, intervals: DataFrame, on: str, point: str, start: str, end: str, point_keys: list[str], ordinal: str) -> DataFrame:
    """The same for points that an interval holds only, one row for each of their keys: points are made and moved once."""
    near = on_levels(points, intervals, on, point, start, end)
    # ties without an ordinal go to the larger one
    best = near.groupBy(*point_keys).agg(F.max_by(F.struct(*[F.col(c) for c in intervals.columns if c != on]), F.struct(-(F.col(end) - F.col(start)), F.col(ordinal))).alias("_best"))
    return best.select(*point_keys, "_best.*")


def _level(length: Column) -> Column:
    """The least n with 2 ** n at or above a length (1 at least)."""
    return F.ceil(F.log2(F.greatest(length, F.lit(1)).cast("double"))).cast("int")


def on_levels(points: DataFrame, intervals: DataFrame, on: str, point: str, start: str, end: str) -> DataFrame:
    """points with every interval of their file that holds them."""
    cell = lambda at, level: F.floor(at / F.pow(F.lit(2.0), level)).cast("long")
    placed = intervals.where(F.col(end) >= F.col(start)).withColumnRenamed(on, "_on").withColumn("_level", _level(F.col(end) - F.col(start) + 1))
    placed = placed.withColumn("_cell", F.explode(F.sequence(cell(F.col(start), F.col("_level")), cell(F.col(end), F.col("_level")))))
    levels = sorted(r[0] for r in placed.select("_level").distinct().collect())  # powers of two: 64 at most
    asked = points.withColumn("_l", F.explode(F.array(*[F.lit(n) for n in levels]) if levels else F.array().cast("array<int>")))
    asked = asked.withColumn("_c", cell(F.col(point), F.col("_l")))
    same = (F.col(on) == F.col("_on")) & (F.col("_l") == F.col("_level")) & (F.col("_c") == F.col("_cell"))
    inside = (F.col(point) >= F.col(start)) & (F.col(point) <= F.col(end))
    return asked.join(placed, same & inside).drop("_on", "_level", "_cell", "_l", "_c")


def overlap_counts(intervals: DataFrame, on: str, start: str, end: str) -> DataFrame:
    """Per file, how many pairs of its intervals meet, by counting: all pairs less those in which one ends before the other begins."""
    from corvane.operators.graph import shares

    # files are dealt once, into shares of a bounded size; all that follows stays within a share
    rows = intervals.select(on, start, end).repartition(shares(intervals), on)
    point = lambda at, ends, starts: F.struct(F.col(at).alias("at"), F.lit(ends).cast("long").alias("ends"), F.lit(starts).cast("long").alias("starts"))
    at = rows.select(on, F.explode(F.array(point(end, 1, 0), point(start, 0, 1))).alias("x")).groupBy(on, "x.at").agg(F.sum("x.ends").alias("ends"), F.sum("x.starts").alias("starts"))
    before = Window.partitionBy(on).orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    at = at.withColumn("apart", F.col("starts") * F.coalesce(F.sum("ends").over(before), F.lit(0)))
    n = F.sum("starts")
    return at.groupBy(on).agg((F.floor(n * (n - 1) / 2) - F.sum("apart")).cast("long").alias("pairs"))


def meets(a: DataFrame, b: DataFrame, on: str, a_start: str, a_end: str, b_start: str, b_end: str) -> DataFrame:
    """Pairs of ranges of one file that share a point: all columns of both, on once. Ranges that end before they start meet nothing.

    The longer range of a pair lies in one or two cells of the width that its own length has, rounded up to a power of
    two, and so does the shorter one at that width. So a range is placed at its own level, and once more at each higher
    level that the other side has; ranges far apart never meet, and a pair counts in the cell where its later start lies.
    """
    cell = lambda at, level: F.floor(at / F.pow(F.lit(2.0), level)).cast("long")
    a = a.where(F.col(a_end) >= F.col(a_start)).withColumn("_la", _level(F.col(a_end) - F.col(a_start) + 1))
    b = b.where(F.col(b_end) >= F.col(b_start)).withColumn("_lb", _level(F.col(b_end) - F.col(b_start) + 1)).withColumnRenamed(on, "_on")
    levels = lambda df, c: sorted(r[0] for r in df.select(c).distinct().collect())  # noqa: E731  # 64 at most
    of_a, of_b = levels(a, "_la"), levels(b, "_lb")

    def placed(df: DataFrame, start: str, end: str, own: str, higher: list[int] | None, strictly: bool) -> DataFrame:
        level = F.array(F.col(own))
        if higher is not None:
            every = F.array(*[F.lit(n) for n in higher]) if higher else F.array().cast("array<int>")
            level = F.filter(every, lambda x: x > F.col(own) if strictly else x >= F.col(own))
        df = df.withColumn("_level", F.explode(level))
        return df.withColumn("_cell", F.explode(F.sequence(cell(F.col(start), F.col("_level")), cell(F.col(end), F.col("_level")))))

    def joined(x: DataFrame, y: DataFrame) -> DataFrame:
        x, y = x.withColumnsRenamed({"_level": "_lx", "_cell": "_cx"}), y.withColumnsRenamed({"_level": "_ly", "_cell": "_cy"})
        near = (F.col(on) == F.col("_on")) & (F.col("_lx") == F.col("_ly")) & (F.col("_cx") == F.col("_cy"))
        both = (F.col(a_start) <= F.col(b_end)) & (F.col(a_end) >= F.col(b_start))
        once = cell(F.greatest(a_start, b_start), F.col("_lx")) == F.col("_cx")
        return x.join(y, near & both & once).drop("_on", "_lx", "_ly", "_cx", "_cy", "_la", "_lb")

    # a at least as short as b: b at its own level; a shorter b: a at its own level. A side is not moved where no level asks for it
    short = joined(placed(a, a_start, a_end, "_la", of_b, False), placed(b, b_start, b_end, "_lb", None, False))
    if not of_a or not of_b or of_a[-1] <= of_b[0]:
        return short
    long_ = joined(placed(a, a_start, a_end, "_la", None, False), placed(b, b_start, b_end, "_lb", of_a, True))
    return long_ if of_a[0] > of_b[-1] else short.unionByName(long_)


def without_outer(pairs: DataFrame, hunk: list[str], start: str, end: str, h_start: str, h_end: str) -> DataFrame:
    """Of intervals touched by one hunk, those that don't hold another one in which the hunk lies whole."""
    inner = F.min(F.when((F.col(h_start) >= F.col(start)) & (F.col(h_end) <= F.col(end)), F.col(end) - F.col(start))).over(Window.partitionBy(*hunk))
    return pairs.withColumn("_inner", inner).where(F.col("_inner").isNull() | (F.col(end) - F.col(start) <= F.col("_inner"))).drop("_inner")


def edit_overlaps(edits: DataFrame, partition: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """Marks an edit that begins before all edits before it have ended."""
    spec = Window.partitionBy(*partition).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return edits.withColumn("overlap", F.coalesce(F.col(start) < F.max(end).over(spec), F.lit(False)))


def validate_edits(edits: DataFrame, documents: DataFrame) -> DataFrame:
    """edits: uri, start, end, new_text, version; documents: uri, length, version, and text where positions are UTF-16 units of
    it. Adds problem, null where there is none."""
    known = documents.select("uri", F.col("length").alias("_length"), F.col("version").alias("_version"), *([F.col("text").alias("_text")] if "text" in documents.columns else []))
    rows = edits.join(known, "uri", "left")
    if "_text" not in rows.columns:
        rows = rows.withColumn("_text", F.lit(None).cast("string"))
    raw = F.encode("_text", "UTF-16BE")
    # the unit at a position is the second half of a pair: D800-DBFF come first, DC00-DFFF second
    second = lambda at: F.hex(F.substring(raw, 2 * at + 1, F.lit(1))).between("DC", "DF")
    split = F.coalesce(second(F.col("start")) | second(F.col("end")), F.lit(False))
    spec = Window.partitionBy("uri").orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    before = F.max("end").over(spec)
    problem = F.when(F.col("_length").isNull(), "unknown document").when(F.col("start") > F.col("end"), "range is reversed").when(F.col("end") > F.col("_length"), "range outside the document").when(F.col("version").isNotNull() & (F.col("version") != F.col("_version")), "stale version").when(F.col("start") < before, "overlap").when(split, "position inside a character")
    return rows.withColumn("problem", problem).drop("_length", "_version", "_text")
