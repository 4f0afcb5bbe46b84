"""URL rules by a sort-merge range join, with DataFrame functions only.

A rule host/path fits its host, all subdomains, and every path that starts with its path. Hosts are written with their
labels reversed, so (host, path) becomes one string key and a rule becomes the interval of keys that start with it. The
rules of a host are swept in key order: each opening and closing of an interval changes the depth of a stack, and the
innermost open rule at any place is the last one that opened at that depth. This turns the rules into disjoint segments.
Each url asks with one key for every suffix of its host that is no longer than the longest rule host; keys and segments
are cut into ranges by sampled splitters, each range carries in the segment that begins before it, and a sorted sweep
gives every key the segment that it lies in. A common host spreads over ranges, as path and identifier are in the key.

Defined cases: a null url, or one without ://, has an empty host and path and no rule; rules given twice count once, a
block before an allow; rules with equal length (ties): the longer host wins; repeated rows stay repeated; identifiers may
have any type and be null; very long urls are keys in full; columns of the input may have any name; empty tables give
empty results.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.llm.common import bucket_of, cut, lower_ascii, named, partitions, sampled_splitters

#: Verdict, then host/path.
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
DEFAULT = "allow"
#: Between host and path of a key, and the end of an interval: after every key that starts with its rule.
GAP, END = "\u0000", "\U0010ffff\U0010ffff"


def host_of(url: Column) -> Column:
    rest = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return lower_ascii(rest)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def labels_reversed(host: Column) -> Column:
    return F.reverse(F.split(host, r"\."))


def rules_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Verdict, host and path of each rule; every rule has a slash."""
    rows = [dict(verdict=verdict, host=rule.split("/", 1)[0].lower(), path="/" + rule.split("/", 1)[1], rule=rule) for verdict, rule in rules]
    return spark.range(1).select(F.inline(F.array(*[F.struct(*[F.lit(v).alias(k) for k, v in row.items()]) for row in rows])))


def segments(rules: DataFrame) -> DataFrame:
    """Disjoint segments of the key space: key (where it begins) and the innermost rule there, or null."""
    rules = rules.withColumn("_n", F.row_number().over(Window.partitionBy("host", "path").orderBy(F.col("verdict").desc(), "rule"))).where("_n = 1")
    own = F.struct("host", "path", "verdict", "rule")
    key = F.concat(F.concat_ws(".", labels_reversed(F.col("host"))), F.lit(GAP), F.col("path"))
    opened = rules.select(F.col("host").alias("_h"), key.alias("key"), F.lit(1).alias("step"), own.alias("own"))
    closed = rules.select(F.col("host").alias("_h"), F.concat(key, F.lit(END)).alias("key"), F.lit(-1).alias("step"), own.alias("own"))
    # closings in one place: the inner rule first, so the last of them leaves the outer depth
    order = [F.col("key"), F.col("step").desc(), F.length("own.path").desc()]
    events = opened.unionByName(closed).withColumn("depth", F.sum("step").over(Window.partitionBy("_h").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)))
    slot = Window.partitionBy("_h", "depth").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    top = F.last(F.when(F.col("step") == 1, F.col("own")), ignorenulls=True).over(slot)
    events = events.withColumn("active", F.when(F.col("depth") > 0, top))
    last = Window.partitionBy("key").orderBy(F.col("depth").asc())
    events = events.withColumn("_n", F.row_number().over(last)).where((F.col("step") == 1) | (F.col("_n") == 1))
    return events.select("key", "active")


def judge(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url", default: str = DEFAULT, buckets: int | None = None) -> DataFrame:
    """_id, host, path, rule (null if none fits) and verdict for every row."""
    spark = pages.sparkSession
    buckets = buckets or 6 * partitions(spark)
    levels = rules.agg(F.max(F.size(F.split("host", r"\.")))).first()[0] or 1
    parts = segments(rules)
    rows = pages.select(named(id_col).alias("_id"), host_of(named(url_col)).alias("host"), path_of(named(url_col)).alias("path"))
    asks = rows.withColumn("_labels", labels_reversed(F.col("host"))).withColumn("_level", F.explode(F.sequence(F.lit(1), F.least(F.size("_labels"), F.lit(levels)))))
    asks = asks.withColumn("key", F.concat(F.concat_ws(".", F.slice("_labels", F.lit(1), F.col("_level"))), F.lit(GAP), F.col("path"))).drop("_labels")
    place = F.concat(F.col("key"), F.lit(GAP), F.coalesce(F.col("_id").cast("string"), F.lit("")))
    splitters = sampled_splitters(asks, lambda some: some.select(place.alias("place")), buckets)
    asks = asks.withColumn("_bucket", bucket_of(place, splitters))
    # segments by range; the last of each range is carried into the next ones that need it
    parts = cut(parts.withColumn("_bucket", bucket_of(F.col("key"), splitters)))
    lasts = parts.groupBy("_bucket").agg(F.max_by("active", "key").alias("active"), F.lit(None).cast("string").alias("key"))
    ranges = spark.range(len(splitters) + 1).select(F.col("id").cast("int").alias("_bucket"))
    filled = ranges.join(lasts.withColumn("_there", F.lit(True)), "_bucket", "left").select("_bucket", F.when(F.col("_there"), F.struct("active")).alias("_last"))
    over = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # as many rows as ranges
    carried = filled.select("_bucket", F.lit("").alias("key"), F.last("_last", ignorenulls=True).over(over)["active"].alias("active"))
    begins = parts.select("_bucket", "key", "active").unionByName(carried).select("_bucket", "key", F.lit(0).alias("_kind"), F.struct("active").alias("_seg"))
    begins = begins.select("*", *[F.lit(None).cast(asks.schema[c].dataType).alias(c) for c in ("_id", "host", "path", "_level")])
    both = begins.unionByName(asks.select("_bucket", "key", F.lit(1).alias("_kind"), F.lit(None).cast(begins.schema["_seg"].dataType).alias("_seg"), "_id", "host", "path", "_level"))
    sweep = Window.partitionBy("_bucket").orderBy("key", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("_rule", F.last("_seg", ignorenulls=True).over(sweep)["active"]).where("_kind = 1")
    # the interval's end stands for infinity: what lies in a segment is compared with its rule once more
    level_host = F.concat_ws(".", F.reverse(F.slice(labels_reversed(F.col("host")), F.lit(1), F.col("_level"))))
    fits = (F.col("_rule.host") == level_host) & F.startswith(F.col("path"), F.col("_rule.path"))
    size = F.length("_rule.host") + F.length("_rule.path")
    found = swept.groupBy("_id", "host", "path").agg(
        F.max(F.when(fits, F.struct(size.alias("n"), F.length("_rule.host").alias("h"), F.col("_rule.verdict").alias("verdict"), F.col("_rule.rule").alias("rule")))).alias("_best"),
        F.sum((F.col("_level") == 1).cast("int")).alias("_times"),
    )
    found = found.withColumn("_time", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))))
    return found.select("_id", "host", "path", F.col("_best.rule").alias("rule"), F.coalesce("_best.verdict", F.lit(default)).alias("verdict"))


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return judge(pages, rules_table(spark)).withColumnRenamed("_id", "page_id")


ORACLE = """
with u as (select page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
r(verdict, h, p, rule) as (values ('block', 'net', '/', 'net/'), ('allow', 'example.net', '/en/', 'example.net/en/'), ('block', 'example.com', '/de/', 'example.com/de/'), ('allow', 'org', '/fr/', 'org/fr/')),
f as (select u.*, r.rule, r.verdict, row_number() over (partition by page_id order by length(r.rule) desc nulls last) as k
  from u left join r on (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from f where k = 1"""
