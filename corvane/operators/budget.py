"""Limits with totals, prefix budgets, fair shares and keyset pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType


def with_totals(df: DataFrame, order: list[Column], limit: int | None) -> DataFrame:
    """The first rows of an order, with total and truncated; 0 or None keeps all. The count is one aggregate row.

    Rows that come out of a shuffle are written once, so that counting and ordering don't make them twice.
    """
    if "Exchange" in df._jdf.queryExecution().executedPlan().toString():
        from corvane.operators.graph import cut

        df = cut(df)
    total = df.agg(F.count(F.lit(1)).alias("total"))
    some = df.orderBy(*order).limit(limit) if limit else df
    return some.crossJoin(F.broadcast(total)).withColumn("truncated", F.col("total") > F.lit(limit or 2**62))


def first_overflow(df: DataFrame, cost: Column, order: list[Column], limit: int, partition: list[str] | None = None, least: int = 0) -> DataFrame:
    """The rows before the running cost first passes the limit; later rows don't skip ahead. Adds spent.

    least: what every row costs at least. Over one order, no more than limit / least rows can fit, so only these go on.
    """
    if least and not partition:
        df = df.orderBy(*order).limit(limit // least + 1)
    spec = Window.partitionBy(*(partition or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("spent", F.sum(cost).over(spec)).where(F.col("spent") <= limit)


def quotas(counts: list[tuple[str, int]], room: int) -> dict[str, int]:
    """Fair shares of room: rounds of equal shares, one at least, in the order given, for those with rows left."""
    given = {k: 0 for k, _ in counts}
    pending = [(k, n) for k, n in counts if n > 0]
    while pending and room > 0:
        share, left = max(1, room // len(pending)), []
        for key, n in pending:
            take = min(share, n - given[key], room)
            given[key] += take
            room -= take
            if given[key] < n:
                left.append((key, n))
        pending = left
    return given


def fair_cap(df: DataFrame, source: str, order: list[Column], room: int, first_seen: Column) -> DataFrame:
    """At most room rows, shared fairly over sources (in the order in which they are first seen). A null source is one of its own."""
    counts = df.groupBy(source).agg(F.count(F.lit(1)).alias("n"), F.min(first_seen).alias("seen")).orderBy("seen", source)
    rows = [(r[source], r["n"]) for r in counts.limit(room).collect()]  # later sources than room get nothing
    given = quotas(rows, room)
    spec = StructType([df.schema[source], StructField("_quota", LongType())])
    quota = F.broadcast(df.sparkSession.createDataFrame(list(given.items()), spec).withColumnRenamed(source, "_s"))
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_rank") <= max(room, 0))
    return ranked.join(quota, F.col(source).eqNullSafe(F.col("_s")) & (F.col("_rank") <= F.col("_quota")), "left_semi").drop("_rank")


def keyset_page(df: DataFrame, keys: list[str], after: tuple | None, limit: int) -> DataFrame:
    """The rows strictly after a key, in key order."""
    if after is not None:
        later = F.lit(False)
        for k in range(len(keys) - 1, -1, -1):
            later = (F.col(keys[k]) > F.lit(after[k])) | ((F.col(keys[k]) == F.lit(after[k])) & later)
        df = df.where(later)
    return df.orderBy(*keys).limit(limit)


def per_source_top(df: DataFrame, source: str, order: list[Column], n: int) -> DataFrame:
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(source).orderBy(*order))).where(F.col("_rank") <= n).drop("_rank")


def resolve_limit(given: int | None, default: int) -> int:
    """An explicit 0 means all; nothing given means the default."""
    return default if given is None else given


def limit_of(given: Column, default: int) -> Column:
    """The same over a column of limits; 0 still means all."""
    return F.coalesce(given, F.lit(default))
