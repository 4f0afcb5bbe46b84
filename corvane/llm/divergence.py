"""Source divergence audit: how far the word shares of each source of a language lie from those of the others.

Terms are counted in Arrow batches and leave a task summed by (language, source, term). A language keeps the terms that
enough of its documents hold. Every source gives every kept term a smoothed share in billionths, also those it never uses
(its base share), so the distance of two sources runs over all kept terms:

- terms are dealt by hash into tiles of about TILE; a tile meets the base shares of its language's sources;
- heavy terms, which HEAVY sources or more hold, fill dense matrices of sources x terms, whose rows are compared whole;
- light terms are postings. A tile adds for each source what its own terms change against a base share (by prefix sums
  over sorted shares), and corrects the pairs that one posting list holds (fewer than HEAVY squared).

Both give, for each pair, whole numbers by which its terms exceed the distance of the two base shares. They add up over
tiles exactly, and the distance of the base shares comes in once for every kept term. Sources go in blocks of BLOCK: a tile of a
language with more is repeated for each pair of blocks, so no task holds more than BLOCK x TILE shares. Pairs of sources
are the result asked for; no pairs of documents or terms leave a task.

Defined cases: null text, language and source are empty strings (and null and '' are one source); repeated rows count as
documents of their own; ties of value go by item in UTF-8 order; very long texts are counted whole; a source without terms
has pairs (with its base shares) and no terms; a language with no kept term has distance 0; other columns do not matter,
whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import LOWER, LOWER_BYTES, UPPER, attach, cut, texts_of

LEAST_DOCUMENTS = 30
SMOOTH, UNIT = 5, 1_000_000_000
TOP = 50
TILE, HEAVY, BLOCK = 4096, 6, 256
#: Counts that a task holds before it hands them on.
HELD = 600_000
#: In UTF-8 all letters beyond ASCII are bytes beyond 127, so the class can be read by bytes.
TERMS = re.compile(rb"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
PAIR = "lang string, a long, b long, value long"


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    totals: dict[tuple, Counter] = {}
    docs: dict[tuple, Counter] = {}

    def out() -> Iterator[pa.RecordBatch]:
        for (lang, source), own in totals.items():
            # the term '' stands for the group itself
            terms = ["", *(t.decode("utf-8", "replace") for t in own)]
            n, d = [0, *own.values()], [0, *map(docs[lang, source].__getitem__, own)]
            columns = [pa.array([x] * len(terms), pa.string()) for x in (lang, source)] + [pa.array(terms, pa.string()), pa.array(n, pa.int64()), pa.array(d, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])
        totals.clear()
        docs.clear()

    for batch in batches:
        for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            found = TERMS.findall(text.as_py().translate(LOWER_BYTES))
            if (lang, source) not in totals:
                totals[lang, source], docs[lang, source] = Counter(), Counter()
            totals[lang, source].update(found)
            docs[lang, source].update(set(found))
        if sum(map(len, totals.values())) > HELD:
            yield from out()
    yield from out()


def term_counts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """lang, source, term, n (occurrences) and docs (documents that hold it); one more row for each group, with the term ''."""
    rows = docs.select(texts_of(lang_col).alias("lang"), texts_of(source_col).alias("source"), texts_of(text_col).cast("binary").alias("t"))
    parts = rows.mapInArrow(_count, "lang string, source string, term string, n long, docs long")
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def share_of(n: Column, total: Column, kept: Column, smooth: int = SMOOTH, unit: int = UNIT) -> Column:
    """1 + floor(unit * (n + smooth) / (total + smooth * kept)), exact at any count."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.lit(1) + F.call_function("div", wide(n + smooth) * F.lit(unit).cast("decimal(10,0)"), wide(total + kept * smooth))


def tile_sums(base: np.ndarray, side: np.ndarray, term: np.ndarray, group: np.ndarray, p: np.ndarray, heavy: np.ndarray) -> np.ndarray:
    """Sums over a tile's terms of |p_a - p_b| - |base_a - base_b|, for all pairs of groups. base: a group's share of terms it does not use.
    side: 0 or 1 for the two blocks of groups compared (only pairs across them are read; in one block, all are).
    term, group, p: postings; heavy: which of them are of heavy terms. Terms are numbers from 0."""
    g = len(base)
    out, apart = np.zeros((g, g), dtype=np.int64), np.abs(base[:, None] - base[None, :])
    rows = np.unique(term[heavy], return_inverse=True)
    if len(rows[0]):
        dense = np.repeat(base[:, None], len(rows[0]), axis=1)
        dense[group[heavy], rows[1]] = p[heavy]
        for a in range(g):
            others = np.arange(a + 1, g) if (side == side[0]).all() else np.flatnonzero(side > side[a])
            out[a, others] += np.abs(dense[others] - dense[a]).sum(axis=1) - len(rows[0]) * apart[a, others]
    light = ~heavy
    order = np.lexsort((group[light], term[light]))
    term, group, p = term[light][order], group[light][order], p[light][order]
    out_light = np.zeros((g, g), dtype=np.int64)
    for a in range(g):  # what a's own terms change where the other side has none
        own = np.sort(p[group == a])
        below = np.searchsorted(own, base)
        sums = np.r_[0, np.cumsum(own)]
        to_base = base * below - sums[below] + (sums[-1] - sums[below]) - base * (len(own) - below)
        change = to_base - len(own) * apart[a]
        out_light[a] += change
        out_light[:, a] += change
    for far in range(1, HEAVY):  # both sides have the term
        same = np.flatnonzero(term[:-far] == term[far:]) if len(term) > far else np.zeros(0, dtype=np.int64)
        a, b = group[same], group[same + far]
        x, y = p[same], p[same + far]
        both = np.abs(x - y) - np.abs(x - base[b]) - np.abs(y - base[a]) + apart[a, b]
        np.add.at(out_light, (a, b), both)
        np.add.at(out_light, (b, a), both)
    return np.triu(out_light, 1) + np.triu(out + out.T, 1)


def _tile(postings: pa.Table, groups: pa.Table) -> pa.Table:
    """One tile of one pair of blocks: its sums by pair of group numbers."""
    groups = groups.sort_by("g")
    number, base, block = (groups[c].to_numpy() for c in ("g", "base", "block"))
    lang = groups["lang"][0].as_py()  # every tile has its language's groups
    term = postings["term"].combine_chunks().dictionary_encode()
    term = term.indices.to_numpy().astype(np.int64) if len(term) else np.zeros(0, dtype=np.int64)
    at = np.searchsorted(number, postings["g"].to_numpy())
    side = ((block == block.max(initial=0)) & (block != block.min(initial=1 << 62))).astype(np.int64)
    sums = tile_sums(base, side, term, at, postings["p"].to_numpy(), postings["held"].to_numpy() >= HEAVY)
    a, b = np.triu_indices(len(number), 1)
    if side.any():
        across = side[a] != side[b]
        a, b = a[across], b[across]
    return pa.table({"lang": pa.array([lang] * len(a), pa.string()), "a": number[a].astype(np.int64), "b": number[b].astype(np.int64), "value": sums[a, b]})


def audit(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least: int = LEAST_DOCUMENTS, top: int = TOP, tile: int = TILE, block: int = BLOCK) -> DataFrame:
    """lang, source, part, item, value, rank: part `pair` holds the distances to the other sources of the language, part
    `term` the terms that a source uses beyond its language's share, to rank top."""
    counts = cut(term_counts(docs, text_col, lang_col, source_col))
    by_term = Window.partitionBy("lang", "term")
    kept = counts.where("term <> ''").withColumns({"in_docs": F.sum("docs").over(by_term), "lang_n": F.sum("n").over(by_term), "held": F.count(F.lit(1)).over(by_term)})
    kept = cut(kept.where(F.col("in_docs") >= least).drop("docs", "in_docs"))
    # one row for each language and for each (language, source)
    langs = kept.groupBy("lang").agg(F.count_distinct("term").alias("v"), F.sum("n").alias("lang_total"))
    groups = counts.where("term = ''").select("lang", "source").join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    groups = groups.join(langs, "lang", "left").na.fill(0, ["total", "v", "lang_total"])
    groups = groups.withColumn("g", F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1)
    groups = groups.withColumns({"block": F.floor(F.col("g") / block), "tiles": F.floor(F.col("v") / tile) + 1, "base": F.when(F.col("v") > 0, share_of(F.lit(0), F.col("total"), F.col("v"))).otherwise(0)})
    groups = cut(groups.withColumn("blocks", F.max("block").over(Window.partitionBy("lang")) + 1).withColumn("_key", F.concat_ws("\u0000", "lang", "source")))
    own = attach(kept.withColumn("_key", F.concat_ws("\u0000", "lang", "source")), groups.drop("lang", "source"), "_key", F.col("term"))
    own = own.withColumns({"p": share_of(F.col("n"), F.col("total"), F.col("v")), "q": share_of(F.col("lang_n"), F.col("lang_total"), F.col("v"))})

    best = Window.partitionBy("lang", "source").orderBy(F.col("value").desc(), F.col("item"))
    terms = own.where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    terms = terms.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= top)

    # pairs of blocks: every block meets itself and each other one
    meets = lambda b: F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda o: F.struct(F.least(o, b).alias("i"), F.greatest(o, b).alias("j"))))
    cells = ["lang", "tile", "i", "j"]
    postings = own.select("lang", F.pmod(F.xxhash64("term"), F.col("tiles")).alias("tile"), "term", "g", "p", "held", meets(F.col("block")).alias("m")).select("*", "m.i", "m.j").drop("m")
    postings = postings.select(*[F.col(c).alias(c, metadata={"side": "terms"}) for c in postings.columns])  # columns of their own: both sides come from groups
    sides = groups.withColumn("tile", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    sides = sides.select("lang", "tile", "g", "base", "block", meets(F.col("block")).alias("m")).select("*", "m.i", "m.j").drop("m")
    sides = sides.select(*[F.col(c).alias(c, metadata={"side": "groups"}) for c in sides.columns])
    sums = postings.groupBy(*cells).cogroup(sides.groupBy(*cells)).applyInArrow(_tile, PAIR).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = sums.unionByName(sums.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    place = lambda g: F.concat_ws("\u0000", "lang", F.col(g).cast("string"))
    of = lambda x: groups.select(place("g").alias(f"_k{x}"), F.col("source").alias(f"source_{x}"), F.col("base").alias(f"base_{x}"), F.col("v").alias(f"v_{x}"))
    pairs = cut(both).withColumns({"_ka": place("a"), "_kb": place("b")})
    for x in "ab":
        pairs = attach(pairs, of(x), f"_k{x}", F.concat_ws(",", "a", "b"))
    value = F.col("value") + F.col("v_a") * F.abs(F.col("base_a") - F.col("base_b"))
    pairs = pairs.select("lang", F.col("source_a").alias("source"), F.lit("pair").alias("part"), F.col("source_b").alias("item"), value.alias("value"))
    return pairs.withColumn("rank", F.row_number().over(best)).unionByName(terms)


def query(spark, sf_dir: str) -> DataFrame:
    return audit(spark.read.parquet(f"{sf_dir}/documents.parquet").select("text", "lang", "source"))


ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce("text", '') AS t FROM documents
), w AS (
  SELECT rid, lang, source, unnest(regexp_extract_all(translate(t, '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d
), kept AS (
  SELECT lang, term, count(*)::HUGEINT AS n FROM w GROUP BY lang, term HAVING count(DISTINCT rid) >= {LEAST_DOCUMENTS}
), langs AS (
  SELECT lang, count(*)::HUGEINT AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), groups AS (
  SELECT DISTINCT lang, source FROM d
), counts AS (
  SELECT g.lang, g.source, k.term, k.n AS lang_n, coalesce(c.n, 0)::HUGEINT AS n
  FROM groups g JOIN kept k USING (lang)
  LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY lang, source, term) c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
), totals AS (
  SELECT lang, source, sum(n)::HUGEINT AS total FROM counts GROUP BY lang, source
), shares AS (
  SELECT c.lang, c.source, c.term, c.n,
         1 + (1000000000::HUGEINT * (c.n + {SMOOTH})) // (t.total + {SMOOTH} * l.v) AS p,
         1 + (1000000000::HUGEINT * (c.lang_n + {SMOOTH})) // (l.total + {SMOOTH} * l.v) AS q
  FROM counts c JOIN totals t USING (lang, source) JOIN langs l USING (lang)
), pairs AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
  FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (
    SELECT x.lang, x.source AS sa, y.source AS sb, sum(abs(x.p - y.p)) AS value
    FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term AND x.source <> y.source GROUP BY ALL
  ) s ON s.lang = a.lang AND s.sa = a.source AND s.sb = b.source
), terms AS (
  SELECT lang, source, 'term' AS part, term AS item, (p - q)::BIGINT AS value FROM shares WHERE n > 0 AND p > q
), every_part AS (
  SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms)
)
SELECT lang, source, part, item, value, rank FROM every_part WHERE part = 'pair' OR rank <= {TOP}
"""
