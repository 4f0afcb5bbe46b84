"""A search index that stays on disk: postings by bucket of their term, names by bucket of their first letters.

Postings of a term lie in blocks of BLOCK entries, the weightiest first, each with the greatest frequency and the least
length that it holds. A search reads the buckets of its terms and names alone. Where only the first hits are wanted, the
first block of each term sets a bound, and blocks that cannot come above it are not opened.

Files change by `upsert`: their new symbols are a segment that replaces what earlier ones say of these files. A search
over several segments leaves out dead entries before it counts documents for a term, so its scores are those of an index
made anew. Symbols are id, path, name, qualified, kind, language, signature, doc, depth and line; ids are unique.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions.text import normalise, tokenize
from corvane.operators import search
from corvane.operators.budget import with_totals
from corvane.sources import segments

BUCKETS, BLOCK = 64, 128
#: Symbols of a bucket that one task sorts.
PIECE = 50_000
PARTITION = ("_b",)
FIELDS = {"name": search.NAME, "qualified": search.QUALIFIED, "signature": search.SIGNATURE, "doc": search.DOC}


def _bucket(c: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(c), F.lit(buckets)).cast("int")


def _parts(fields: dict[str, float]) -> Column:
    """A symbol's tokens with the weights of their fields."""
    parts = None
    for name, weight in fields.items():
        tokens = tokenize(F.coalesce(F.col(name).cast("string"), F.lit("")))
        part = F.transform(F.slice(tokens, 1, search.SIGNATURE_TOKENS) if name == "signature" else tokens, search.weighted(float(weight)))
        parts = part if parts is None else F.concat(parts, part)
    return parts


def _tables(symbols: DataFrame, fields: dict[str, float], buckets: int, block: int) -> dict[str, DataFrame]:
    key = "id"
    pieces = -(-symbols.count() // (buckets * PIECE))  # of a bucket, each one task's to sort and one file
    piece = lambda c: F.pmod(F.xxhash64(c, F.lit(1)), F.lit(pieces or 1))
    many = buckets * max(pieces, 1)
    named = search.name_columns(symbols).withColumn("_parts", _parts(fields)).withColumn("_len", F.aggregate("_parts", F.lit(0.0), lambda a, p: a + p.w)).withColumn("_b", _bucket(F.col(key), buckets))
    tf = named.select("path", key, "_len", F.explode("_parts").alias("p")).groupBy("path", key, "_len", F.col("p.term").alias("term")).agg(F.sum("p.w").alias("tf"))
    # blocks of a term: dealt by hash into runs first, so no task has to sort a term that is in every symbol
    # (terms of more than one run, at most one for every 64 blocks of postings, are told to all)
    often = tf.groupBy("term").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 64 * block)
    runs = tf.join(F.broadcast(often), "term", "left").withColumn("_run", F.pmod(F.xxhash64(key), F.coalesce(F.ceil(F.col("_n") / (64 * block)), F.lit(1))))
    order = Window.partitionBy("term", "_run").orderBy((F.col("tf") / (F.col("tf") + F.col("_len"))).desc(), key)
    placed = runs.withColumn("block", F.floor((F.row_number().over(order) - 1) / block))
    blocks = placed.groupBy("term", "_run", "block").agg(F.max("tf").alias("max_tf"), F.min("_len").alias("min_len"), F.collect_list(F.struct("path", key, "tf", F.col("_len").alias("len"))).alias("entries"))
    blocks = blocks.withColumn("_b", _bucket(F.col("term"), buckets)).repartition(many, "_b", piece("_run")).sortWithinPartitions("_b", "term", "_run", "block")
    norms = F.array_distinct(F.array(F.col("_name_norm"), F.col("_last_norm"), F.col("_qual_norm")))
    names = named.select("path", key, F.explode(norms).alias("norm")).where("norm <> ''").withColumn("_b", _bucket(F.substring("norm", 1, 2), buckets))
    files = named.groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("_len").alias("len"))
    by_name = names.repartition(many, "_b", piece(key)).sortWithinPartitions("_b", "norm")
    return {"symbols": named.drop("_parts", "_display", "_name_norm", "_last_norm", "_qual_norm").repartition(many, "_b", piece(key)).sortWithinPartitions("_b", key), "postings": blocks, "names": by_name, "files": files}


def write(symbols: DataFrame, path: str, fields: dict[str, float] | None = None, buckets: int = BUCKETS, block: int = BLOCK) -> None:
    """A new index, version 0."""
    made = _tables(symbols, fields or FIELDS, buckets, block)
    segments.commit(symbols.sparkSession, path, 0, made, symbols.select("path"), PARTITION)


def upsert(symbols: DataFrame, changed: DataFrame, path: str, number: int, fields: dict[str, float] | None = None, buckets: int = BUCKETS, block: int = BLOCK, ratio: float = segments.RATIO) -> bool:
    """The symbols of changed files (path; deleted ones have none) as a segment of their own."""
    some = symbols.join(changed.select("path").distinct(), "path", "left_semi")
    spark = symbols.sparkSession
    again = lambda: _tables(segments.live(spark, path, "symbols", "path").drop("_b", "_len", "_segment"), fields or FIELDS, buckets, block)
    return segments.commit(spark, path, number, _tables(some, fields or FIELDS, buckets, block), changed.select("path"), PARTITION, ratio, remake=again)


def _saturated(tf: Column, length: Column, avg: Column) -> Column:
    return tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * length / F.greatest(avg, F.lit(1e-9))))


def _needed(spark: SparkSession, path: str, blocks: DataFrame, terms: list[str], stats: DataFrame, limit: int) -> DataFrame:
    """Blocks that may hold one of the first `limit` hits by score. The first blocks give lower bounds of scores, and so
    of the score that a hit must have; a block's upper bound is its own best entry with the best of all other terms."""
    df_ = blocks.groupBy("term").agg(F.sum(F.size("entries")).alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    rows = blocks.join(F.broadcast(df_), "term").crossJoin(F.broadcast(stats)).withColumn("idf", idf)
    rows = rows.withColumn("_up", F.col("idf") * _saturated(F.col("max_tf"), F.col("min_len"), F.col("avg_len")))
    best = rows.groupBy("term").agg(F.max("_up").alias("_best"))
    others = F.broadcast(best.agg(F.sum("_best").alias("_all")))
    rows = rows.join(F.broadcast(best), "term").crossJoin(others)
    first = rows.where("block = 0").select("idf", "avg_len", F.explode("entries").alias("e"))
    low = first.groupBy("e.id").agg(F.sum(F.col("idf") * _saturated(F.col("e.tf"), F.col("e.len"), F.col("avg_len"))).alias("s"), F.count(F.lit(1)).alias("m"))
    low = low.select((F.col("s") * (0.5 + 0.5 * F.col("m") / len(terms))).alias("s")).orderBy(F.col("s").desc()).limit(limit)
    bound = F.broadcast(low.agg(F.when(F.count(F.lit(1)) >= limit, F.min("s")).otherwise(0.0).alias("_bound")))
    kept = rows.crossJoin(bound).where(F.col("_all") - F.col("_best") + F.col("_up") >= F.col("_bound") - 1e-9)
    return kept.select(*blocks.columns, "df")


def search_stored(spark: SparkSession, path: str, q: search.SearchQuery, buckets: int = BUCKETS, totals: bool = True) -> DataFrame:
    """Ranked hits as `search.search_symbols` gives them. totals=False leaves out total and truncated, and blocks that the
    first q.limit hits do not need."""
    qnorm = spark.range(1).select(normalise(F.lit(q.text))).first()[0]
    terms = search.query_terms(spark, q.text)
    every = segments.live(spark, path, "symbols", "path")
    if not qnorm or not terms:
        none = every.limit(0).drop("_b", "_len", "_segment").withColumns({"tier": F.lit(0), "raw": F.lit(0.0), "score": F.lit(0.0)})
        return none.withColumns({"total": F.lit(0).cast("long"), "truncated": F.lit(False)}) if totals else none
    at = sorted({r[0] for r in spark.createDataFrame([(t,) for t in terms], "t string").select(_bucket(F.col("t"), buckets)).collect()})
    blocks = segments.parts(spark, path, "postings", F.col("_b").isin(at) & F.col("term").isin(terms))
    files = segments.live(spark, path, "files", "path")
    stats = files.agg(F.sum("n").alias("n"), (F.sum("len") / F.sum("n")).alias("avg_len"))
    first_letters = F.startswith("norm", F.lit(qnorm))
    if len(qnorm) > 1:
        first_letters = first_letters & (F.col("_b") == spark.range(1).select(_bucket(F.lit(qnorm[:2]), buckets)).first()[0])
    names = segments.parts(spark, path, "names", first_letters).select("id", "_segment").distinct()
    plain = not (q.kinds or q.languages or q.include or q.exclude or q.path)
    skipping = not totals and q.limit and plain and blocks.select("_segment").distinct().count() <= 1 and len(segments.manifest(spark, path)["segments"]) == 1
    if skipping:
        blocks = _needed(spark, path, blocks, terms, stats, q.limit)
    entries = blocks.select("_segment", "term", *(["df"] if skipping else []), F.explode("entries").alias("e"))
    said = entries.groupBy(F.col("e.id").alias("id"), "_segment").agg(F.collect_list(F.struct("term", F.col("e.tf").alias("tf"))).alias("_m"))
    none = F.array().cast("array<struct<term:string,tf:double>>")
    found = said.unionByName(names.withColumn("_m", none)).groupBy("id", "_segment").agg(F.flatten(F.collect_list("_m")).alias("_m")).withColumn("_b", _bucket(F.col("id"), buckets))
    rows = every.join(found, ["_b", "id", "_segment"])
    if skipping:  # blocks with other terms of these hits may be closed; the hits' own texts tell
        each = F.transform(F.array(*map(F.lit, terms)), lambda t: F.struct(t.alias("term"), F.aggregate("_p", F.lit(0.0), lambda a, p: a + F.when(p.term == t, p.w).otherwise(0.0)).alias("tf")))
        rows = rows.withColumn("_p", _parts(q.fields)).withColumn("_m", F.filter(each, lambda x: x.tf > 0)).drop("_p")
    tf = lambda t: F.aggregate("_m", F.lit(0.0), lambda a, x: a + F.when(x.term == t, x.tf).otherwise(0.0))
    if skipping:
        counts = blocks.groupBy().agg(*[F.max(F.when(F.col("term") == t, F.col("df"))).alias(f"_df{k}") for k, t in enumerate(terms)])
    else:
        counts = rows.agg(*[F.count_if(tf(t) > 0).alias(f"_df{k}") for k, t in enumerate(terms)])
    rows = rows.crossJoin(F.broadcast(stats)).crossJoin(F.broadcast(counts))
    score = F.lit(0.0)
    for k, t in enumerate(terms):
        idf = F.log(1 + (F.col("n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5))
        score = score + F.when(tf(t) > 0, idf * _saturated(tf(t), F.col("_len"), F.col("avg_len"))).otherwise(0.0)
    matched = F.size("_m")
    rows = rows.withColumns({"matched": matched.cast("long"), "bm": score * (0.5 + 0.5 * matched / len(terms))})
    rows = rows.drop("n", "avg_len", "_m", "_b", "_len", "_segment", *[f"_df{k}" for k in range(len(terms))])
    rows = search.tiered(search.filters(search.name_columns(rows), q), q.text, qnorm).where("tier > 0")
    rows = search.scored(rows)
    if totals:
        return with_totals(rows, search.order(), q.limit)
    return rows.orderBy(*search.order()).limit(q.limit) if q.limit else rows.orderBy(*search.order())
