"""Ranked search: weighted term frequencies, BM25, tiers, fuzzy fallback and near names."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.operators.grep import may_hold
from corvane.functions.text import fuzzy_score, jaccard, last_segment, nearest_ok, normalise, osa_distance, squash, tokenize, trigrams

#: Fixed values of the ranking.
K1, B = 1.2, 0.75
NAME, QUALIFIED, SIGNATURE, DOC = 3.0, 1.5, 1.0, 1.0
SIGNATURE_TOKENS = 40
EXACT, PREFIX, TOKEN, FUZZY = 4, 3, 2, 1


@dataclass
class Index:
    """postings: key, term, tf. docs: key, len. n and average length are one aggregate row (stats)."""

    postings: DataFrame
    docs: DataFrame
    stats: DataFrame
    key: str


def weighted(w: float):
    return lambda t: F.struct(t.alias("term"), F.lit(w).alias("w"))


def build_index(df: DataFrame, key: str, fields: dict[str, float], caps: dict[str, int] | None = None) -> Index:
    """Weighted term frequencies per row. All rows count for the average length, also those without tokens."""
    caps = caps or {}
    parts = None
    for name, weight in fields.items():
        tokens = tokenize(F.coalesce(F.col(name).cast("string"), F.lit("")))
        if name in caps:
            tokens = F.slice(tokens, 1, caps[name])
        part = F.transform(tokens, weighted(float(weight)))
        parts = part if parts is None else F.concat(parts, part)
    rows = df.select(F.col(key), parts.alias("parts"))
    postings = rows.select(key, F.explode("parts").alias("p")).groupBy(key, F.col("p.term").alias("term")).agg(F.sum("p.w").alias("tf"))
    docs = rows.select(key, F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p.w).alias("len"))
    stats = docs.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"))
    return Index(postings, docs, stats, key)


def query_terms(spark, text: str) -> list[str]:
    """Distinct tokens of a query, sorted; the query is one short string."""
    return sorted(set(spark.range(1).select(tokenize(F.lit(text))).first()[0]))


def bm25(index: Index, terms: list[str]) -> DataFrame:
    """key, score (with coverage) and matched for every row that has a query term. Terms prune the postings before any join."""
    hits = index.postings.where(F.col("term").isin(terms))
    df_ = hits.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    rows = hits.join(F.broadcast(df_), "term").join(index.docs, index.key).crossJoin(F.broadcast(index.stats))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1e-9))))
    out = rows.groupBy(index.key).agg(F.sum(part).alias("bm"), F.count(F.lit(1)).alias("matched"))
    return out.select(index.key, (F.col("bm") * (0.5 + 0.5 * F.col("matched") / len(terms))).alias("score"), "matched")


def bm25_direct(df: DataFrame, key: str, fields: dict[str, float], terms: list[str], caps: dict[str, int] | None = None) -> DataFrame:
    """The same without an index: one pass for the counts, which are one row, and one over the rows that hold a term at all."""
    caps, parts, near = caps or {}, None, F.lit(False)
    for name, weight in fields.items():
        text = F.coalesce(F.col(name).cast("string"), F.lit(""))
        tokens = F.slice(tokenize(text), 1, caps[name]) if name in caps else tokenize(text)
        part = F.transform(tokens, weighted(float(weight)))
        parts = part if parts is None else F.concat(parts, part)
        for t in terms:  # a token's letters stand together in the text, in whatever case
            near = near | (may_hold(text, t, case=False) if t.isascii() else F.lit(True))
    tf = lambda t: F.aggregate(F.col("parts"), F.lit(0.0), lambda acc, p: acc + F.when(p.term == t, p.w).otherwise(0.0))
    names = [f"_tf{k}" for k in range(len(terms))]
    rows = df.select(F.col(key), parts.alias("parts"), near.alias("_near")).withColumn("len", F.aggregate("parts", F.lit(0.0), lambda acc, p: acc + p.w))
    has = lambda t: F.exists("parts", lambda p: p.term == t)
    held = [has(t) for t in terms]
    stats = rows.agg(F.count(F.lit(1)).alias("n"), F.avg("len").alias("avg_len"), *[F.count_if(F.col("_near") & h).alias(f"_df{k}") for k, h in enumerate(held)])
    scored = rows.where("_near").select(key, "len", *[tf(t).alias(c) for t, c in zip(terms, names)]).crossJoin(F.broadcast(stats))
    score = matched = F.lit(0.0)
    for k, c in enumerate(names):
        idf = F.log(1 + (F.col("n") - F.col(f"_df{k}") + 0.5) / (F.col(f"_df{k}") + 0.5))
        score = score + F.when(F.col(c) > 0, idf * F.col(c) * (K1 + 1) / (F.col(c) + K1 * (1 - B + B * F.col("len") / F.greatest(F.col("avg_len"), F.lit(1e-9))))).otherwise(0.0)
        matched = matched + (F.col(c) > 0).cast("long")
    rows = scored.select(key, score.alias("_bm"), matched.cast("long").alias("matched")).where("matched > 0")
    return rows.select(key, (F.col("_bm") * (0.5 + 0.5 * F.col("matched") / len(terms))).alias("score"), "matched")


@dataclass
class SearchQuery:
    """kinds and languages go without case; path is a prefix of segments; limit 0 keeps all."""

    text: str
    kinds: tuple[str, ...] = ()
    languages: tuple[str, ...] = ()
    include: tuple[str, ...] = ()
    exclude: tuple[str, ...] = ()
    path: str = ""
    limit: int = 20
    fuzzy: bool = False
    fields: dict[str, float] = field(default_factory=lambda: {"name": NAME, "qualified": QUALIFIED, "signature": SIGNATURE, "doc": DOC})


def filters(df: DataFrame, q: SearchQuery) -> DataFrame:
    from corvane.operators.paths import glob_set, in_scope

    if q.kinds and "kind" in df.columns:
        df = df.where(F.lower("kind").isin([k.lower() for k in q.kinds]))
    if q.languages and "language" in df.columns:
        df = df.where(F.lower("language").isin([k.lower() for k in q.languages]))
    if q.path:
        df = df.where(in_scope(F.col("path"), q.path))
    if q.include or q.exclude:
        df = df.where(glob_set(F.col("path"), [*q.include, *["!" + x for x in q.exclude]]))
    return df


def name_columns(df: DataFrame) -> DataFrame:
    display = last_segment(F.when(F.col("qualified") == "", F.col("name")).otherwise(F.coalesce("qualified", "name")))
    return df.withColumns({"_display": display, "_name_norm": normalise(F.col("name")), "_last_norm": normalise(display), "_qual_norm": normalise(F.coalesce("qualified", F.lit("")))})


def tiered(rows: DataFrame, text: str, qnorm: str) -> DataFrame:
    """Adds tier (exact, prefix, token, or 0) and raw to rows with bm, matched and the name columns."""
    exact = F.lit(qnorm).isin(F.col("_name_norm"), F.col("_last_norm"), F.col("_qual_norm"))
    prefix = F.startswith("_name_norm", F.lit(qnorm)) | F.startswith("_last_norm", F.lit(qnorm))
    tier = F.when(exact, EXACT).when(prefix, PREFIX).when(F.col("matched") > 0, TOKEN).otherwise(0)
    raw = F.coalesce("bm", F.lit(0.0))
    raw = raw + F.when(exact & F.lit(text).isin(F.col("name"), F.col("_display"), F.col("qualified")), 1000.0).otherwise(0.0)
    shorter = F.greatest(F.least(F.octet_length("_name_norm"), F.octet_length("_last_norm")), F.lit(1))
    raw = raw + F.when(~exact & prefix, len(qnorm.encode()) / shorter).otherwise(0.0)
    return rows.withColumns({"tier": tier, "raw": raw})


def order() -> list:
    """The order of hits; of equal ones the nearer to the top, then by place."""
    return [F.col("tier").desc(), F.col("raw").desc(), F.col("depth"), F.col("path"), F.col("line"), F.col("id")]


def scored(rows: DataFrame) -> DataFrame:
    """Hits with their score, without what the ranking alone needs."""
    return rows.withColumn("score", F.col("tier") + squash(F.col("raw"))).drop("_display", "_name_norm", "_last_norm", "_qual_norm", "bm", "matched")


def search_symbols(symbols: DataFrame, q: SearchQuery) -> DataFrame:
    """symbols: id, path, name, qualified, kind, language, signature, doc, depth, line. Ranked hits with tier, score, total, truncated.

    The index is over symbols as given (the scope); kinds and globs filter candidates after scoring.
    """
    spark = symbols.sparkSession
    qnorm = spark.range(1).select(normalise(F.lit(q.text))).first()[0]
    terms = query_terms(spark, q.text)
    named = name_columns(symbols)
    wanted = filters(named, q)
    if not qnorm or not terms:
        return wanted.limit(0).withColumns({"tier": F.lit(0), "raw": F.lit(0.0), "score": F.lit(0.0), "total": F.lit(0).cast("long"), "truncated": F.lit(False)})
    scores = bm25_direct(symbols, "id", q.fields, terms, {"signature": SIGNATURE_TOKENS}).withColumnRenamed("score", "bm")
    rows = wanted.join(scores, "id", "left")
    rows = tiered(rows, q.text, qnorm).where("tier > 0")
    if q.fuzzy and not rows.limit(1).count():
        grams = trigrams(F.lit(qnorm))
        # symbols of one name are alike to the query: each name is compared once
        near = wanted.select(F.col("_last_norm").alias("_near")).distinct().withColumn("_d", osa_distance(F.lit(qnorm), F.col("_near")))
        near = near.withColumn("raw", fuzzy_score(F.col("_d"), jaccard(grams, trigrams(F.col("_near"))), F.lit(qnorm), F.col("_near"))).where("raw > 0").drop("_d")
        rows = wanted.withColumns({"bm": F.lit(None).cast("double"), "matched": F.lit(None).cast("long"), "tier": F.lit(FUZZY)})
        rows = rows.join(near, F.col("_last_norm") == F.col("_near")).drop("_near")
    from corvane.operators.budget import with_totals

    return with_totals(scored(rows), order(), q.limit)


def nearest_names(names: DataFrame, column: str, query: str, n: int = 5) -> DataFrame:
    """The nearest distinct names: by distance, then similarity, then name."""
    q = names.sparkSession.range(1).select(normalise(F.lit(query))).first()[0]
    rows = names.select(F.col(column).alias("name")).distinct().withColumn("norm", normalise(F.col("name")))
    # the distance is at least the difference of lengths, so most names are settled without it
    gap, far = F.abs(F.length("norm") - len(q)), F.greatest(F.lit(2), F.floor(F.lit(len(q)) / 2))
    alike = (jaccard(trigrams(F.lit(q)), trigrams(F.col("norm"))) >= 0.3) | F.contains("norm", F.lit(q)) | F.contains(F.lit(q), F.col("norm"))
    rows = rows.where((gap <= far) | alike)
    rows = rows.withColumn("distance", osa_distance(F.lit(q), F.col("norm"))).withColumn("similarity", jaccard(trigrams(F.lit(q)), trigrams(F.col("norm"))))
    return rows.where(nearest_ok(F.col("distance"), F.col("similarity"), F.lit(q), F.col("norm"))).orderBy("distance", F.col("similarity").desc(), "name").limit(n)


def stale_candidates(names: DataFrame, column: str, query: str, n: int = 5) -> DataFrame:
    """Names that a stale one may stand for: same, same last part, one in the other, near by distance."""
    name, last = F.col("name"), last_segment(F.col("name"))
    q, q_last = F.lit(query), last_segment(F.lit(query))
    d, d_last = F.levenshtein(name, q), F.levenshtein(last, q_last)
    cost = F.when(name == q, 0).when(last == q_last, 1).when(F.contains(name, q) | F.contains(q, name), 2).when(d <= 3, 3 + d).when(d_last <= 2, 10 + d_last)
    return names.select(F.col(column).alias("name")).distinct().withColumn("cost", cost).where("cost is not null").orderBy("cost", "name").limit(n)


#: Columns by level of detail.
DETAIL = {
    "compact": ("id", "path", "line", "kind", "name", "tier", "score"),
    "standard": ("id", "path", "line", "end_line", "kind", "name", "qualified", "signature", "tier", "score"),
}


def detail(df: DataFrame, level: str) -> DataFrame:
    """The columns of a level (compact, standard or full) that the rows have; total and truncated always."""
    if level == "full":
        return df
    return df.select(*[c for c in df.columns if c in (*DETAIL[level], "total", "truncated")])


#: One or more names with dots or double colons between them, and no spaces.
IDENTIFIER = r"^[\p{L}_][\p{L}\p{N}_]*(?:(?:\.|::)[\p{L}_][\p{L}\p{N}_]*)*$"


def identifier_notice(hits: DataFrame, query: str) -> DataFrame:
    """One row, notice: says that no symbol has the name, where the query looks like one and the hits are weaker; else null."""
    best = hits.agg(F.max("tier").alias("best"))
    notice = F.when(F.lit(query).rlike(IDENTIFIER) & (F.col("best") < PREFIX), F.concat(F.lit(f"no symbol named {query}: "), F.when(F.col("best") == TOKEN, "token matches").otherwise("near matches")))
    return best.select(notice.alias("notice"))


def workspace_symbol(symbols: DataFrame, query: str, limit: int = 0) -> DataFrame:
    """Symbols whose name holds the query, without case, in the order that the server gave (server_order)."""
    from corvane.operators.budget import with_totals

    return with_totals(symbols.where(F.contains(F.lower("name"), F.lit(query.lower()))), [F.col("server_order"), F.col("id")], limit)


def reference_rows(references: DataFrame, limit: int = 0) -> DataFrame:
    """References by file, line and column."""
    from corvane.operators.budget import with_totals

    return with_totals(references, [F.col("path"), F.col("line"), F.col("col")], limit)


def lookup(positions: DataFrame, answers: DataFrame, method: str) -> DataFrame:
    """What a server answered at positions (path, line, col): rows of answers (method, path, line, start_col, end_col, ...) whose span holds the column."""
    some = answers.where(F.col("method") == method).drop("method")
    own = positions.select(F.col("path").alias("_p"), F.col("line").alias("_l"), F.col("col").alias("_c"), *[c for c in positions.columns if c not in ("path", "line", "col")])
    near = (F.col("path") == F.col("_p")) & (F.col("line") == F.col("_l")) & F.col("_c").between(F.col("start_col"), F.col("end_col") - 1)
    return own.join(some, near).withColumnRenamed("_c", "col").drop("_p", "_l")
