"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only.

A document's measure is the whole part of the root of its size, so long documents come again somewhat more often. Within
a source its expected copies are min(MOST, c * measure), with the one c that makes the expected words the source's
target. The whole part of the expected copies is certain. The rest is an inclusion probability p below 1: documents rank
by (u / (1 - u)) / (p / (1 - p)), u uniform and fixed by the identifier, and the lowest ranks are taken. The sample has a
fixed size in words: the last document is taken if that brings the source's words nearer to the target, so they end
within half a document of it.

c is solved on the counts of sizes of a source, exact whole-number sums. The last rank is found by narrowing: words are
summed by the leading bits of the rank (BITS more in each pass), until every source has at most LIST documents with the
bits at which its words are reached; only these are ordered. So no task gathers a source.

Defined cases: null and empty texts have size 0 and are never taken; a null source is one of its own, last in order;
identifiers may be numbers or strings, and one that is null draws by its text; rows equal in identifier, source and size
(ties) share one decision; very long texts count in full; columns of the input may have any name; an empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import attach, cut, ident, named, texts_of, word_count

#: Weights of the sources in code-point order, repeating; words wanted over words there; copies of a document at most.
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0
SEED = "mix:"
#: Bits of a rank, bits of it that each pass looks at, and documents of a source that are ordered in one list at most.
RANK_BITS, BITS, LIST = 50, 10, 4096


def uniform(draw: Column, seed: str = SEED) -> Column:
    """A fixed number in (0, 1) for a string: 13 hex digits of an MD5."""
    digest = F.md5(F.concat(F.lit(seed), draw).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """One row per source: _source, source_size, target. Ranks and the water level come from aggregates, however many sources there are."""
    by = sizes.groupBy("_source").agg(F.sum("_size").cast("long").alias("source_size"))
    by = cut(by.orderBy(F.col("_source").asc_nulls_last()))
    by = by.withColumn("_m", F.monotonically_increasing_id()).withColumn("_part", F.shiftright("_m", 33))
    before, at = [], 0
    for part, n in sorted(tuple(r) for r in by.groupBy("_part").count().collect()):  # as many rows as partitions
        before += [F.lit(part), F.lit(at)]
        at += n
    if not before:
        return by.select("_source", "source_size", F.lit(0.0).alias("target"))
    rank = F.element_at(F.create_map(*before), F.col("_part")) + F.col("_m").bitwiseAND(F.lit(2**33 - 1))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights) + 1).cast("int"))
    by = cut(by.select("_source", "source_size", weight.alias("_w"), (F.col("source_size") * F.lit(most)).alias("_cap")))
    total = by.agg(F.sum("source_size")).first()[0] * share
    level = 0.0
    while True:  # every further pass caps one more source at least
        full = F.col("_cap") <= F.col("_w") * level
        capped, free = by.agg(F.sum(F.when(full, F.col("_cap")).otherwise(0.0)), F.sum(F.when(full, 0.0).otherwise(F.col("_w")))).first()
        if not free:
            level = float("inf")
            break
        if (new := (total - capped) / free) <= level:
            break
        level = new
    return by.select("_source", "source_size", F.least(F.col("_cap"), F.col("_w") * F.lit(level)).alias("target"))


def measure(size: Column) -> Column:
    return F.floor(F.sqrt(size.cast("double")))


def rates(sizes: DataFrame, goals: DataFrame, most: float = MOST) -> DataFrame:
    """goals with _c. Sizes go from the largest down: those before a row are at the most, and _c shares what is left of the
    target over the others by words times measure; the first row that is not above the most itself is the solution."""
    counts = sizes.where("_size > 0").groupBy("_source", "_size").agg(F.count(F.lit(1)).alias("_n"))
    counts = counts.withColumns({"_words": F.col("_n") * F.col("_size"), "_weight": F.col("_n") * F.col("_size") * measure(F.col("_size"))})
    down, up = Window.partitionBy("_source").orderBy(F.col("_size").desc()), Window.partitionBy("_source").orderBy("_size")
    counts = counts.withColumns({"_above": F.sum("_words").over(down) - F.col("_words"), "_rest": F.sum("_weight").over(up)})
    goal = goals.select(F.col("_source").alias("_s"), "target")
    rows = counts.join(goal, counts["_source"].eqNullSafe(goal["_s"]))
    rows = rows.withColumn("_try", (F.col("target") - F.lit(most) * F.col("_above")) / F.col("_rest"))
    found = rows.where(F.col("_try") * measure(F.col("_size")) <= most).groupBy("_s").agg(F.max_by("_try", "_size").alias("_c"))
    return goals.join(found, goals["_source"].eqNullSafe(found["_s"]), "left").drop("_s")


def expected(size: Column, rate: Column, most: float = MOST) -> Column:
    """Expected copies, to nine places; no solution means that every document is at the most."""
    copies = F.least(F.lit(most), F.floor(rate * measure(size) * 1e9 + 0.5) / 1e9)
    return F.when(size == 0, 0.0).otherwise(F.coalesce(copies, F.lit(most)))


def pareto(p: Column, u: Column) -> Column:
    """The rank q = (u / (1 - u)) / (p / (1 - p)) as q / (1 + q), which keeps the order and lies in (0, 1)."""
    return u * (1 - p) / (u * (1 - p) + (1 - u) * p)


def ranked(rows: DataFrame) -> DataFrame:
    """rows (with _draw, _size, _c) and _whole, _p, _q (null where p is 0) and _r, the leading bits of _q."""
    e = expected(F.col("_size"), F.col("_c"))
    rows = rows.withColumn("_whole", F.floor(e)).withColumn("_p", e - F.floor(e))
    rows = rows.withColumn("_q", F.when(F.col("_p") > 0, pareto(F.col("_p"), uniform(F.col("_draw")))))
    return rows.withColumn("_r", F.floor(F.col("_q") * F.lit(float(2**RANK_BITS))))


def plan(sizes: DataFrame, goals: DataFrame, most_listed: int = LIST) -> DataFrame:
    """goals with _c and _last, the rank, draw and size of the last unit that is taken beyond the whole copies (null if none is)."""
    goals = cut(rates(sizes, goals))
    units = sizes.where("_size > 0").groupBy("_source", "_draw", "_size").agg(F.sum("_size").alias("_words"))
    units = ranked(attach(units, goals.select("_source", "_c"), "_source", F.col("_draw")))
    units = cut(units.select("_source", "_draw", "_size", "_words", "_q", "_r", (F.col("_words") * F.col("_whole")).alias("_sure")))
    sure = units.groupBy("_source").agg(F.sum("_sure").alias("_sure")).withColumnRenamed("_source", "_s")
    state = goals.join(sure, goals["_source"].eqNullSafe(sure["_s"])).select("_source", (F.col("target") - F.col("_sure")).alias("_need"))
    state = state.withColumns({"_lead": F.lit(0).cast("long"), "_below": F.lit(0).cast("long")})
    for done in range(0, RANK_BITS, BITS):
        # units whose leading bits are those at which their source's words are reached, by BITS more of them
        near = attach(units.where("_q is not null"), state, "_source", F.col("_draw")).where(F.shiftright("_r", RANK_BITS - done) == F.col("_lead"))
        bars = near.groupBy("_source", "_need", "_below", F.shiftright("_r", RANK_BITS - done - BITS).alias("_bits")).agg(F.sum("_words").alias("_w"), F.count(F.lit(1)).alias("_n"))
        upto = F.sum("_w").over(Window.partitionBy("_source").orderBy("_bits"))  # at most 2 ** BITS rows for a source
        bars = bars.withColumn("_before", F.col("_below") + upto - F.col("_w")).where("_before <= _need")
        ends = bars.groupBy("_source", "_need").agg(F.max_by(F.struct("_bits", "_before", "_n"), "_bits").alias("e"))
        state = cut(ends.select("_source", "_need", F.col("e._bits").alias("_lead"), F.col("e._before").alias("_below"), F.col("e._n").alias("_n")))
        if (state.agg(F.max("_n")).first()[0] or 0) <= most_listed:
            break
        state = state.drop("_n")
    left = RANK_BITS - done - BITS
    last = attach(units.where("_q is not null"), state.select("_source", "_need", "_lead", "_below"), "_source", F.col("_draw")).where(F.shiftright("_r", left) == F.col("_lead"))
    lists = last.groupBy("_source", "_need", "_below", "_lead").agg(F.sort_array(F.collect_list(F.struct("_q", "_draw", "_size", "_words"))).alias("_list"))
    # a unit is taken if the words before it and those after it lie around the need, or both below it
    start = F.struct(F.col("_below").alias("sum"), F.struct((F.shiftleft("_lead", left) / F.lit(float(2**RANK_BITS))).alias("q"), F.lit("").alias("draw"), F.lit(0).cast("long").alias("size")).alias("last"))
    walked = F.aggregate(
        "_list",
        start,
        lambda acc, x: F.when(2 * acc["sum"] + x["_words"] <= 2 * F.col("_need"), F.struct((acc["sum"] + x["_words"]).alias("sum"), F.struct(x["_q"].alias("q"), x["_draw"].alias("draw"), x["_size"].alias("size")).alias("last"))).otherwise(F.struct((acc["sum"] + x["_words"]).alias("sum"), acc["last"].alias("last"))),
    )
    cuts = lists.select(F.col("_source").alias("_s"), walked["last"].alias("_last"))
    return cut(goals.join(cuts, goals["_source"].eqNullSafe(cuts["_s"]), "left").drop("_s"))


def with_copies(rows: DataFrame, goals: DataFrame) -> DataFrame:
    """rows (with _draw, _source, _size) and source_size, target, _copies. The rows themselves are not shuffled while sources are few."""
    rows = ranked(attach(rows, goals.select("_source", "source_size", "target", "_c", "_last"), "_source", F.col("_draw")))
    more = F.coalesce(F.struct(F.col("_q").alias("q"), F.col("_draw").alias("draw"), F.col("_size").alias("size")) <= F.col("_last"), F.lit(False)) & F.col("_q").isNotNull()
    return rows.withColumn("_copies", (F.col("_whole") + more.cast("int")).cast("int")).drop("_c", "_last", "_whole", "_p", "_q", "_r")


def measured(docs: DataFrame, id_col: str, text_col: str, source_col: str) -> list[Column]:
    """_id, _source, _size and _draw, the string that an identifier (or, without one, the text) draws by."""
    own = ident(docs, id_col)
    draw = F.coalesce(own.cast("string"), F.concat(F.lit("null:"), F.md5(texts_of(text_col).cast("binary"))))
    return [own.alias("_id"), named(source_col).cast("string").alias("_source"), word_count(named(text_col)).alias("_size"), draw.alias("_draw")]


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The documents that the mix takes, each as often as it takes it, with the input's own columns."""
    columns = measured(docs, id_col, text_col, source_col)
    sizes = cut(docs.select(*columns))
    goals = plan(sizes, targets(sizes))
    rows = docs.select(F.struct(*[named(c) for c in docs.columns]).alias("_row"), *columns)
    times = with_copies(rows, goals).where("_copies > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies"))))
    return times.select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    sizes = cut(docs.select(*measured(docs, "doc_id", "text", "source")))
    out = with_copies(sizes, plan(sizes, targets(sizes)))
    return out.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), "source_size", "target", (F.col("_copies") * F.col("_size")).cast("long").alias("taken"))


#: The rule of the sample as one sum over each source's whole ranking.
ORACLE = """
with d as (select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) as bigint) as size,
  coalesce(cast(doc_id as varchar), 'null:' || md5(coalesce(text, ''))) as draw from documents),
s as (select source, cast(sum(size) as bigint) as source_size from d group by source),
w as (select *, cast(source_size as double) * 2.0::double as cap, cast([3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) as w from s),
o as (select *, sum(cap) over (order by cap / w, source rows unbounded preceding) as capped, (select sum(w) from w) - sum(w) over (order by cap / w, source rows unbounded preceding) as free,
  cap / w as ratio, lead(cap / w) over (order by cap / w, source) as next_ratio from w),
l as (select min(level) as level from (
  select (1.5::double * (select sum(source_size) from s)) / (select sum(w) from w) as level where (select min(cap / w) from w) > (1.5::double * (select sum(source_size) from s)) / (select sum(w) from w)
  union all select (1.5::double * (select sum(source_size) from s) - capped) / free from o
  where free > 0 and ratio <= (1.5::double * (select sum(source_size) from s) - capped) / free and next_ratio > (1.5::double * (select sum(source_size) from s) - capped) / free)),
t as (select source, source_size, least(cap, w * level) as target from w, l),
h as (select source, size, count(*) * size as words, cast(count(*) * size * floor(sqrt(size)) as bigint) as weight from d where size > 0 group by source, size),
a as (select h.source, h.size, target, sum(words) over (partition by h.source order by size desc) - words as above, sum(weight) over (partition by h.source order by size) as rest from h join t on h.source is not distinct from t.source),
c as (select source, arg_max((target - 2.0::double * above) / rest, size) as c from a where (target - 2.0::double * above) / rest * floor(sqrt(size)) <= 2.0::double group by source),
e as (select d.*, t.source_size, t.target, (cast('0x' || substr(md5('mix:' || draw), 1, 13) as bigint) + 0.5::double) / 4503599627370496.0::double as u,
  case when size = 0 then 0.0::double else coalesce(least(2.0::double, floor(c.c * floor(sqrt(size)) * 1e9::double + 0.5::double) / 1e9::double), 2.0::double) end as e
  from d join t on d.source is not distinct from t.source left join c on d.source is not distinct from c.source),
q as (select *, floor(e) as whole, case when e > floor(e) then (u / (1 - u)) / ((e - floor(e)) / (1 - (e - floor(e)))) end as q from e),
r as (select *, target - sum(size * whole) over (partition by source) as need, sum(case when q is not null then size end) over (partition by source order by q nulls last, draw, size rows unbounded preceding) as upto from q)
select doc_id, size, source_size, target, cast(size * (whole + case when q is not null and 2 * upto - size <= 2 * need then 1 else 0 end) as bigint) as taken from r"""
