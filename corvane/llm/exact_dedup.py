"""Exact duplicates by content sort, with DataFrame functions only.

Rows are sorted by (normalised text, identifier). Splitters sampled from the texts cut their order into ranges: each is
the shortest prefix that tells two neighbouring samples apart. One shuffle brings each range together, where Spark's
external sort puts equal texts next to each other and every row is compared in full with its neighbour. A head (HEAD
characters) that neighbouring samples share is a hot one: the rows that begin with it are cut further, by text digest and
identifier, so a group of copies that holds a third of all rows spans many ranges. Rows
that repeat both are dealt over SALTS parts. A group can span ranges only if a splitter of a hot head names it; these groups (at most as many as ranges) are counted by a pre-aggregated pass of their
own. Elsewhere the digest is an output and nothing else.

Defined cases: a null text is an empty text; a null identifier is a group's identifier only if it has no other; of
repeated rows with one identifier (ties) exactly one is kept; identifiers may be numbers or strings; very long texts are
compared in full; columns of the input may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import bucket_of, ident, lower_ascii, named, partitions, sampled_keys, texts_of

#: Characters of a text that the driver sees of a sampled row.
HEAD = 256
#: Parts of a key (one text, one identifier) that repeats so often that samples meet it twice in a row.
SALTS = 16
BETWEEN = "\u0001"


def shortest(before: str, text: str) -> str:
    """The shortest prefix of text that comes after before."""
    same = next((k for k, (a, b) in enumerate(zip(before, text)) if a != b), min(len(before), len(text)))
    return text[: same + 1]


def cuts(sample: list[tuple[str, str]], buckets: int) -> tuple[list[str], list[str], list[str], list[str]]:
    """From sorted (head, rest of the key): prefixes between ranges, hot heads, whole keys between parts of hot heads, and
    whole keys that repeat."""
    prefixes, heads, parts, same = set(), set(), set(), set()
    for i in range(1, buckets):
        at = len(sample) * i // buckets
        if not 0 < at < len(sample):
            continue
        (before, last), (head, rest) = sample[at - 1], sample[at]
        if before != head:
            prefixes.add(shortest(before, head))
        else:
            heads.add(head)
            (same if last == rest else parts).add(head + BETWEEN + rest)
    return sorted(prefixes), sorted(heads), sorted(parts), sorted(same)


def ordered(ident: Column, kind: str) -> Column:
    """Identifiers as text in their own order, null first."""
    text = F.lpad(F.hex(ident.bitwiseXOR(F.lit(-(2**63)))), 16, "0") if kind == "long" else F.concat(F.lit("0"), ident)
    return F.when(ident.isNull(), "").otherwise(text)


def with_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max", buckets: int | None = None, carry: bool = False) -> DataFrame:
    """One row per input row: _id, keep_id, group_size, kept, text_sha256 and, if asked, _row (a struct of the input's columns).

    keep: "min" or "max", which identifier stays.
    """
    if keep not in ("min", "max"):
        raise ValueError("keep is min or max")
    best = F.max if keep == "max" else F.min
    buckets = buckets or 6 * partitions(docs.sparkSession)
    # normalised once, before the shuffle, where the rows themselves are not wanted
    held = F.struct(*[named(c) for c in docs.columns]) if carry else lower_ascii(texts_of(text_col))
    plain = docs.select(ident(docs, id_col).alias("_id"), held.alias("_held"))
    norm = lower_ascii(F.coalesce(F.col("_held").getField(text_col).cast("string"), F.lit(""))) if carry else F.col("_held")
    head, sha = F.substring(norm, 1, HEAD), F.sha2(norm.cast("binary"), 256)
    rest = F.concat(sha, F.lit(BETWEEN), ordered(F.col("_id"), plain.schema["_id"].dataType.simpleString().replace("bigint", "long")))
    sample = sampled_keys(plain, lambda some: some.select(head.alias("head"), rest.alias("rest")), buckets)
    prefixes, heads, parts, same = cuts(sample, buckets)
    key = F.concat(head, F.lit(BETWEEN), rest)
    part = F.when(head.isin(heads), bucket_of(key, parts) + 1).otherwise(0) if parts else F.lit(0)
    salt = F.when(head.isin(heads) & key.isin(same), F.floor(F.rand(7) * SALTS)).otherwise(0) if same else F.lit(0)
    rows = plain.withColumn("_bucket", ((bucket_of(norm, prefixes) * (len(parts) + 2) + part) * SALTS + salt).cast("long"))
    inside = Window.partitionBy("_bucket").orderBy(norm, F.col("_id").asc_nulls_first())
    before = F.lag(norm).over(inside)
    runs = rows.withColumn("_place", F.row_number().over(inside)).withColumn("_new", (before.isNull() | (before != norm)).cast("int"))
    runs = runs.withColumn("_run", F.sum("_new").over(inside)).withColumn("_sha", sha).drop("_new", *([] if carry else ["_held"]))
    whole = Window.partitionBy("_bucket", "_run")
    runs = runs.withColumns({"_n": F.count(F.lit(1)).over(whole), "_best": best("_id").over(whole)})
    # the row that may stay: of those with the run's best identifier, the last in order
    stays = F.max(F.when(F.col("_id").eqNullSafe(F.col("_best")), F.col("_place"))).over(whole)
    runs = runs.withColumn("_stays", stays == F.col("_place"))
    if heads:  # groups that a splitter names: at most one for each of them
        texts = sorted({p.rsplit(BETWEEN, 2)[1] for p in parts + same})
        hot = plain.where(head.isin(heads)).withColumn("_s", sha).where(F.col("_s").isin(texts))
        hot = hot.groupBy("_s", norm.alias("_norm")).agg(best("_id").alias("_all_best"), F.count(F.lit(1)).alias("_all_n")).drop("_norm")
        runs = runs.join(F.broadcast(hot), F.col("_sha") == F.col("_s"), "left")
    else:
        runs = runs.withColumns({"_all_best": F.col("_best"), "_all_n": F.lit(None).cast("long")})
    group = F.when(F.col("_all_n").isNull(), F.col("_best")).otherwise(F.col("_all_best"))
    runs = runs.withColumn("_last", F.col("_stays") & F.col("_best").eqNullSafe(group))
    if same:  # a repeated key lies in several parts, each of which has a row that may stay
        spread = F.when(F.col("_last") & F.col("_all_n").isNotNull(), F.col("_sha")).otherwise(F.concat_ws(":", "_bucket", "_place"))
        runs = runs.withColumn("_last", F.col("_last") & (F.col("_bucket") == F.max("_bucket").over(Window.partitionBy(spread))))
    return runs.select("_id", group.alias("keep_id"), F.coalesce("_all_n", "_n").alias("group_size"), F.col("_last").alias("kept"), F.col("_sha").alias("text_sha256"), *([F.col("_held").alias("_row")] if carry else []))


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "max") -> DataFrame:
    """The rows that stay, with the input's own columns."""
    return with_groups(docs, id_col, text_col, keep, carry=True).where("kept").select("_row.*")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return with_groups(docs).withColumnRenamed("_id", "doc_id")


ORACLE = """
with n as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
g as (select t, max(doc_id) as keep_id, count(*) as group_size from n group by t)
select n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id as kept, sha256(n.t) as text_sha256
from n join g on n.t = g.t"""
