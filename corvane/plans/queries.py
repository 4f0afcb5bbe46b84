"""Registry of the queries over the given tables, with the SQL that they must agree with where SQL can express them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import budget, diffs, graph, grep, history, imports, intervals, outline, paths, search, signatures, snapshot, stored_index, task, verdicts
from corvane.sources import readers
from corvane.streaming import gate as gates

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def sql_round(x: str, places: int) -> str:
    """floor(x * 10^n + 0.5) / 10^n in DuckDB, in doubles."""
    return f"(floor(cast({x} as double) * {float(10**places)}::double + 0.5::double) / {float(10**places)}::double)"


LINES = r"""lines as (select doc_id, cast(i as bigint) as line, regexp_replace(parts[i], '\r$', '') as text from (
  select doc_id, parts, unnest(range(1, len(parts) + case when parts[-1] = '' then 0 else 1 end)) as i from (select doc_id, string_split(text, chr(10)) as parts from documents)))"""

# ---- text and search


@query(f"select doc_id, token, count(*) as n from (select doc_id, unnest({t.sql_tokens('text')}) as token from documents) group by doc_id, token")
def tokenize_documents(spark, d):
    rows = table(spark, d, "documents").select("doc_id", F.explode(t.tokenize(F.col("text"))).alias("token"))
    return rows.groupBy("doc_id", "token").agg(F.count(F.lit(1)).alias("n"))


@query(f"select p_partkey, {t.sql_normalise('p_name')} as name, {t.sql_normalise('p_brand')} as brand, {t.sql_normalise('p_type')} as type from part")
def normalise_parts(spark, d):
    return table(spark, d, "part").select("p_partkey", t.normalise(F.col("p_name")).alias("name"), t.normalise(F.col("p_brand")).alias("brand"), t.normalise(F.col("p_type")).alias("type"))


BM25_QUERY = "thanedble worthless orantion"


def _bm25_sql(terms: list[str], fields: dict[str, float], source: str, key: str) -> str:
    parts = " union all ".join(f"select {key}, unnest({t.sql_tokens(f)}) as term, {w}::double as w from {source}" for f, w in fields.items())
    listed = ", ".join(f"'{x}'" for x in terms)
    return f"""toks as ({parts}),
lens as (select s.{key}, coalesce(sum(w), 0) as len from {source} s left join toks using ({key}) group by s.{key}),
st as (select count(*) as n, avg(len) as avg_len from lens),
tf as (select {key}, term, sum(w) as tf from toks where term in ({listed}) group by {key}, term),
dfs as (select term, count(*) as df from tf group by term),
bm as (select tf.{key}, sum(ln(1 + (n - df + 0.5::double) / (df + 0.5::double)) * tf * 2.2::double / (tf + 1.2::double * (0.25::double + 0.75::double * len / greatest(avg_len, 1e-9::double)))) as b, count(*) as matched
  from tf join dfs using (term) join lens using ({key}), st group by tf.{key}),
scored as (select {key}, b * (0.5::double + 0.5::double * matched / {len(terms)}) as score, matched from bm)"""


@query(f"with {_bm25_sql(sorted(BM25_QUERY.split()), {'text': 1.0, 'source': 1.5, 'lang': 3.0}, 'documents', 'doc_id')} select doc_id, {sql_round('score', 6)} as score, matched from scored order by 2 desc, doc_id limit 20")
def bm25_search_documents(spark, d):
    """Top 20 of a ranked search over three fields."""
    docs = table(spark, d, "documents").select("doc_id", "text", "source", "lang")
    index = search.build_index(docs, "doc_id", {"text": 1.0, "source": 1.5, "lang": 3.0})
    hits = search.bm25(index, search.query_terms(spark, BM25_QUERY))
    return hits.select("doc_id", t.round_half_up(F.col("score"), 6).alias("score"), "matched").orderBy(F.col("score").desc(), "doc_id").limit(20)


def _part_symbols(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.lit("part").alias("path"), F.col("p_name").alias("name"), F.concat_ws(".", "p_brand", "p_name").alias("qualified"), F.col("p_type").alias("signature"), F.lit("").alias("doc"), F.lit("part").alias("kind"), F.lit("").alias("language"), F.lit(0).alias("depth"), F.col("p_partkey").alias("line"))


_TIERS = f"""with parts as (select p_partkey as id, p_name as name, p_brand || '.' || p_name as qualified, p_type as signature from part),
{_bm25_sql(['bolt', 'red'], {'name': 3.0, 'qualified': 1.5, 'signature': 1.0}, 'parts', 'id')},
n as (select p.*, {t.sql_normalise('name')} as nn, {t.sql_normalise('name')} as ln_, {t.sql_normalise('qualified')} as qn from parts p),
r as (select n.id, n.name, n.qualified, coalesce(s.score, 0) as bm, coalesce(s.matched, 0) as matched, 'redbolt' in (nn, ln_, qn) as exact, starts_with(nn, 'redbolt') or starts_with(ln_, 'redbolt') as prefix, greatest(least(strlen(nn), strlen(ln_)), 1) as shorter
  from n left join scored s using (id)),
x as (select *, case when exact then 4 when prefix then 3 when matched > 0 then 2 else 0 end as tier,
  bm + case when exact and 'red bolt' in (name, qualified) then 1000 else 0 end + case when not exact and prefix then 7.0::double / shorter else 0 end as raw from r)
select id, tier, {sql_round('tier + least(raw / (1 + raw), 0.999999::double)', 3)} as score, count(*) over () as total from x where tier > 0 order by tier desc, raw desc, id"""


@query(_TIERS)
def search_parts_tiers(spark, d):
    """All hits of a symbol search in tiers: exact, prefix, token."""
    hits = search.search_symbols(_part_symbols(spark, d), search.SearchQuery("red bolt", limit=0, fields={"name": 3.0, "qualified": 1.5, "signature": 1.0}))
    return hits.select("id", "tier", t.round_half_up(F.col("score"), 3).alias("score"), "total")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder beside the session's checkpoints."""
    graph.cut(spark.range(1))
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


_STORED: dict[tuple, str] = {}


def _stored_parts(spark, d) -> str:
    """The index of all parts, made once in a session."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _STORED:
        path = scratch(spark, "search-index")
        stored_index.write(_part_symbols(spark, d), path, {"name": 3.0, "qualified": 1.5, "signature": 1.0}, buckets=16)
        _STORED[key] = path
    return _STORED[key]


@query(_TIERS)
def search_stored_parts(spark, d):
    """The hits of the symbol search from an index on disk: the buckets of its terms and names alone."""
    q = search.SearchQuery("red bolt", limit=0, fields={"name": 3.0, "qualified": 1.5, "signature": 1.0})
    hits = stored_index.search_stored(spark, _stored_parts(spark, d), q, 16)
    return hits.select("id", "tier", t.round_half_up(F.col("score"), 3).alias("score"), "total")


@query(f"select id, tier, score from ({_TIERS.replace('raw desc, id', 'raw desc, id limit 25')})")
def search_stored_top(spark, d):
    """Its first twenty-five, with blocks left closed that cannot hold one of them."""
    q = search.SearchQuery("red bolt", limit=25, fields={"name": 3.0, "qualified": 1.5, "signature": 1.0})
    hits = stored_index.search_stored(spark, _stored_parts(spark, d), q, 16, totals=False)
    return hits.select("id", "tier", t.round_half_up(F.col("score"), 3).alias("score"))


@query(_TIERS.replace("from part)", "from part where p_partkey % 5 <> 1 union all select p_partkey, p_name || ' bolt', p_brand || '.' || p_name || ' bolt', p_type from part where p_partkey % 5 = 1 and p_partkey % 10 <> 1)", 1))
def search_stored_changes(spark, d):
    """The same after a fifth of the files changed and half of these went: a segment over the first one."""
    parts = _part_symbols(spark, d).withColumn("path", F.concat(F.lit("part"), "id"))
    fields = {"name": 3.0, "qualified": 1.5, "signature": 1.0}
    path = scratch(spark, "search-index")
    stored_index.write(parts, path, fields, buckets=16)
    name = lambda c: F.concat(c, F.lit(" bolt"))
    fresh = parts.where("id % 5 = 1 and id % 10 <> 1").withColumns({"name": name("name"), "qualified": name("qualified")})
    stored_index.upsert(fresh, parts.where("id % 5 = 1").select("path"), path, 1, fields, buckets=16, ratio=2.0)
    hits = stored_index.search_stored(spark, path, search.SearchQuery("red bolt", limit=0, fields=fields), 16)
    return hits.select("id", "tier", t.round_half_up(F.col("score"), 3).alias("score"), "total")


@query(r"""select lang, source, count(*) as candidates from documents where lower(lang) in ('en', 'de') and regexp_matches(source, '^src1[^/]*$') and not regexp_matches(source, '^src1[3-5]$') group by lang, source""")
def search_filters(spark, d):
    docs = table(spark, d, "documents").select(F.col("source").alias("path"), F.col("lang").alias("language"), "doc_id")
    some = search.filters(docs, search.SearchQuery("", languages=("EN", "de"), include=("src1*",), exclude=("src1[3-5]",)))
    return some.groupBy(F.col("language").alias("lang"), F.col("path").alias("source")).agg(F.count(F.lit(1)).alias("candidates"))


def _sql_grams(x: str) -> str:
    return f"case when length({x}) = 0 then []::varchar[] when length({x}) < 3 then [{x}] else list_distinct(list_transform(range(1, length({x}) - 1), lambda i: substr({x}, cast(i as int), 3))) end"


@query(f"""with n as (select distinct p_name as name, {t.sql_normalise('p_name')} as norm from part),
g as (select name, {_sql_grams('norm')} as a, {_sql_grams("'redbotl'")} as b from n)
select name, {sql_round('len(list_intersect(a, b)) / cast(len(list_distinct(list_concat(a, b))) as double)', 6)} as similarity from g where len(list_intersect(a, b)) / cast(len(list_distinct(list_concat(a, b))) as double) >= 0.3""")
def fuzzy_trigram_parts(spark, d):
    norm = t.normalise(F.col("p_name"))
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), norm.alias("norm")).distinct()
    s = t.jaccard(t.trigrams(F.col("norm")), t.trigrams(F.lit("redbotl")))
    return rows.withColumn("s", s).where("s >= 0.3").select("name", t.round_half_up(F.col("s"), 6).alias("similarity"))


@query("""with n as (select distinct p_name as name from part), c as (select name, case when name = 'red bolts' then 0 when contains(name, 'red bolts') or contains('red bolts', name) then 2
  when levenshtein(name, 'red bolts') <= 3 then 3 + levenshtein(name, 'red bolts') end as cost from n) select name, cast(cost as int) as cost from c where cost is not null order by cost, name limit 5""")
def nearest_names_levenshtein(spark, d):
    return search.stale_candidates(table(spark, d, "part"), "p_name", "red bolts")


#: The whole table of the distance as a list, a cell a step: row after row, for the query's letters against the name's.
_OSA = f"""with recursive n as (select distinct p_name as name, {t.sql_normalise('p_name')} as norm, 'redbotl' as q from part),
w as (select name, norm, q, length(norm) as m, 0 as k, []::integer[] as c from n
  union all select name, norm, q, m, k + 1, list_append(c, cast(case when k // (m + 1) = 0 then k % (m + 1) when k % (m + 1) = 0 then k // (m + 1) else least(c[k] + 1, c[k - m] + 1, c[k - m - 1] + case when q[k // (m + 1)] = norm[k % (m + 1)] then 0 else 1 end,
    case when k // (m + 1) > 1 and k % (m + 1) > 1 and q[k // (m + 1)] = norm[k % (m + 1) - 1] and q[k // (m + 1) - 1] = norm[k % (m + 1)] then c[k - 2 * m - 3] + 1 else 1000 end) end as integer)) from w where k < 8 * (m + 1)),
d as (select name, norm, c[-1] as distance from w where k = 8 * (m + 1)), g as (select *, {_sql_grams("'redbotl'")} as a, {_sql_grams('norm')} as b from d),
s as (select *, len(list_intersect(a, b)) / cast(len(list_distinct(list_concat(a, b))) as double) as similarity from g)
select name, norm, distance, {sql_round('similarity', 6)} as similarity from s where distance <= 3 or similarity >= 0.3 or contains(norm, 'redbotl') or contains('redbotl', norm) order by distance, s.similarity desc, name limit 5"""


@query(_OSA)
def fuzzy_osa(spark, d):
    """Near names by the distance that counts a swap once, which no engine has built in."""
    return search.nearest_names(table(spark, d, "part"), "p_name", "red botl").withColumn("similarity", t.round_half_up(F.col("similarity"), 6))


def _grep_sql(pattern: str, flags: str = "") -> str:
    p = pattern.replace("'", "''")
    return rf"""with {LINES} select doc_id, line, cast(strlen(regexp_extract(text, '{flags}^(.*?)(?:{p})', 1)) + 1 as int) as col, cast(len(regexp_extract_all(text, '{flags}{p}')) as int) as hits from lines where regexp_matches(text, '{flags}{p}')"""


def _grep(spark, d, q, **how) -> DataFrame:
    return grep.search_text(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", q, **how).select("doc_id", F.col("line").cast("long").alias("line"), F.col("col").cast("int").alias("col"), F.col("hits").cast("int").alias("hits"))


@query(_grep_sql("worthless"))
def grep_literal(spark, d):
    return _grep(spark, d, "worthless", case=True)


@query(_grep_sql(r"[a-z]+\.[0-9]{2}@mail[0-9]", "(?i)"))
def grep_regex(spark, d):
    return _grep(spark, d, r"[a-z]+\.[0-9]{2}@mail[0-9]", regex=True)


@query(_grep_sql("(worthless|thanedble) [a-z]+"))
def grep_signed(spark, d):
    """A choice of words by stored signatures: the texts that hold the runs of one of them."""
    path = scratch(spark, "signatures")
    signatures.store(table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text", path, buckets=16)
    hits = signatures.search(spark, path, "doc_id", "(worthless|thanedble) [a-z]+", regex=True, case=True)
    return hits.select("doc_id", F.col("line").cast("long").alias("line"), F.col("col").cast("int").alias("col"), F.col("hits").cast("int").alias("hits"))


@query(rf"""with {LINES} select doc_id, line, cast(1 as int) as found from lines where regexp_matches(text, '(?i)(?:^|[^\p{{L}}\p{{Nd}}_])idiot(?:$|[^\p{{L}}\p{{Nd}}_])')""")
def grep_word(spark, d):
    return _grep(spark, d, "idiot", word=True).select("doc_id", "line", F.lit(1).alias("found"))


@query(rf"""with {LINES}, c as (select doc_id, line, text, string_agg(text, chr(10)) over (partition by doc_id order by line rows between 2 preceding and 1 preceding) as b, string_agg(text, chr(10)) over (partition by doc_id order by line rows between 1 following and 2 following) as a from lines)
select doc_id, line, coalesce(b, '') as before, coalesce(a, '') as after from c where contains(text, 'worthless')""")
def grep_context(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = grep.search_text(docs, "doc_id", "text", "worthless", case=True)
    return grep.with_context(docs, "doc_id", "text", found, 2).select("doc_id", F.col("line").cast("long").alias("line"), "before", "after")


@query(rf"""with {LINES}, m as (select doc_id, line from lines where contains(text, 'idiot')), n as (select count(*) as total, count(distinct doc_id) as files_matched from m)
select doc_id, line, total, files_matched, total > 50 as truncated from m, n order by doc_id, line limit 50""")
def grep_totals(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = grep.search_text(docs, "doc_id", "text", "idiot", case=True).select("doc_id", F.col("line").cast("long").alias("line"))
    return grep.totals(found, "doc_id")


@query("""select doc_id, cast(length(b) - length(replace(b, chr(10), '')) + 1 as bigint) as line, cast(strlen(string_split(b, chr(10))[-1]) + 1 as bigint) as col from (select doc_id, substr(text, 1, cast(n_chars // 2 as bigint)) as b from documents)""")
def line_byte_columns(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", grep.position_of(F.col("text"), F.floor(F.col("n_chars") / 2).cast("int")).alias("p")).select("doc_id", "p.line", "p.col")


@query("select doc_id, 'sha256:' || sha256(text) as hash from documents")
def content_hashes(spark, d):
    return table(spark, d, "documents").select("doc_id", t.content_hash(F.col("text")).alias("hash"))


@query("select doc_id, strlen(text) as bytes, cast(ceil(strlen(text) / 4.0) as bigint) as tokens from documents")
def token_estimates(spark, d):
    return table(spark, d, "documents").select("doc_id", F.octet_length("text").cast("long").alias("bytes"), t.estimate_tokens(F.col("text")).cast("long").alias("tokens"))


# ---- coverage, trees, routing


@query("select lang, count(*) as files, lang in ('en', 'fr') as extractor from documents group by lang")
def lang_coverage(spark, d):
    return paths.coverage(table(spark, d, "documents"), "lang", ["en", "fr"])


@query("""select lang, count(*) as files, count(*) filter (l.doc_id is not null) as indexed, count(*) filter (l.doc_id is not null and l.quality = 1) as fresh, count(*) filter (l.doc_id is not null and l.quality <> 1) as stale, count(*) filter (l.doc_id is null) as missing, count(*) filter (length(text) < 50) as skipped from documents d left join labels l using (doc_id) group by lang""")
def status_counts(spark, d):
    docs = table(spark, d, "documents").join(table(spark, d, "labels"), "doc_id", "left").withColumn("in_", F.col("quality").isNotNull()).withColumn("one", F.lit(1)).withColumn("skip", F.when(F.length("text") < 50, "short"))
    return snapshot.status(docs, ["lang"], "in_", "one", "quality", "skip")


_PATH = r"regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '')"


def _page_path() -> Column:
    return F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")


@query(rf"""with p as (select page_id, {_PATH} as path from pages), s as (select page_id, string_split(path, '/') as s from p), x as (select page_id, unnest(['.'] || case when len(s) > 1 then [s[1]] else [] end || case when len(s) > 2 then [s[1] || '/' || s[2]] else [] end) as dir from s)
select dir, count(*) as files from x group by dir""")
def dir_rollup(spark, d):
    return paths.directory_rollup(table(spark, d, "pages").select("page_id", _page_path().alias("path")), "path", 2)


@query("""select path, doc_id, total, total > 100 as truncated from (select 'src1/' || doc_id as path, doc_id, count(*) over () as total from documents where source = 'src1') order by path limit 100""")
def tree_prefix_limit(spark, d):
    files = table(spark, d, "documents").select(F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("path"), "doc_id")
    return paths.tree(files, "path", "src1", 100)


@query("""select doc_id, case when regexp_matches(source, '^src1[^/]*$') then 'globbed' when lang in ('de', 'fr') then 'both' when lang = 'en' then 'english' end as server from documents""")
def route_priority(spark, d):
    defs = [{"name": "english", "languages": ["en"], "priority": 1}, {"name": "both", "languages": ["de", "fr"], "priority": 5}, {"name": "globbed", "globs": ["src1*"], "priority": 9}, {"name": "later", "languages": ["de", "en"], "priority": 1}]
    return paths.route(table(spark, d, "documents").withColumnRenamed("lang", "language"), "doc_id", "source", "language", defs)


@query(rf"""select page_id, {_PATH} as path from pages where regexp_matches({_PATH}, '^([^/]+/)*(en|fr)(/.*)?$') and not regexp_matches({_PATH}, '^([^/]+/)*[^/]*\.html$')""")
def glob_filter(spark, d):
    rows = table(spark, d, "pages").select("page_id", _page_path().alias("path"))
    return rows.where(paths.glob_set(F.col("path"), ["**/{en,fr}/**", "!*.html"]))


@query("select conv_id, turn, role || case when n = 1 then '' else '~' || n end as id from (select *, row_number() over (partition by role order by conv_id, turn) as n from conversations)")
def dup_id_numbering(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", "role")
    return readers.number_ids(rows, "role", ["conv_id", "turn"]).select("conv_id", "turn", "id")


@query("""with recursive w as (select conv_id, turn, 0 as depth from conversations c where not exists (select 1 from conversations p where p.conv_id = c.conv_id and p.turn = c.turn - 1)
union all select c.conv_id, c.turn, w.depth + 1 from w join conversations c on c.conv_id = w.conv_id and c.turn = w.turn + 1) select conv_id, turn, depth from w""")
def symbol_depth(spark, d):
    rows = table(spark, d, "conversations").select("conv_id", "turn", F.concat_ws(":", "conv_id", "turn").alias("key"), F.concat_ws(":", "conv_id", (F.col("turn") - 1)).alias("_p"))
    known = rows.select(F.col("key").alias("_p")).withColumn("_there", F.lit(True))
    rows = rows.join(known, "_p", "left").withColumn("parent", F.when(F.col("_there"), F.col("_p")))
    return rows.join(graph.chain_depth(rows, "key", "parent", most=2**31 - 1), "key").select("conv_id", "turn", "depth")


# ---- history


_SINCE = "timestamp '1998-01-01'"


@query(f"select l_partkey, count(distinct l_orderkey) as commits, count(distinct l_suppkey) as authors, cast(sum(cast(l_quantity as bigint)) as bigint) as added, cast(sum(l_linenumber) as bigint) as removed, max(l_shipdate) as last from lineitem where l_shipdate >= {_SINCE} group by l_partkey")
def churn_parts(spark, d):
    return history.churn(table(spark, d, "lineitem"), "l_partkey", "l_orderkey", "l_suppkey", F.col("l_quantity").cast("long"), F.col("l_linenumber"), "l_shipdate", F.lit("1998-01-01 00:00:00").cast(table(spark, d, "lineitem").schema["l_shipdate"].dataType))


@query(f"""with c as (select l_partkey, count(distinct l_orderkey) as commits from lineitem group by l_partkey) select p_partkey, commits, {sql_round('commits * (1 + ln(1 + p_size))', 3)} as score from c join part on p_partkey = l_partkey""")
def hotspots_parts(spark, d):
    churned = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("commits"))
    return history.hotspots(churned, table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "p_size").select("p_partkey", "commits", "score")


_COCHANGE = """b as (select distinct l_orderkey, l_partkey from lineitem), s as (select l_orderkey from b group by l_orderkey having count(*) <= 8), t as (select l_orderkey from b join s using (l_orderkey) where l_partkey = 1),
c as (select l_partkey, count(*) as together from b join t using (l_orderkey) where l_partkey <> 1 group by l_partkey)"""


@query(f"with {_COCHANGE} select l_partkey, together, {sql_round('2.0::double * together / (select max(together) from c)', 6)} as weight from c")
def cochange_parts(spark, d):
    out = history.cochange(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 1, 8)
    return out.withColumn("weight", t.round_half_up(F.col("weight"), 6))


@query(f"""with {_COCHANGE}, w as (select l_partkey, 2.0::double * together / (select max(together) from c) as weight, 'co_change' as source, 2 as o from c),
p as (select p_partkey as l_partkey, 2 + 1.0::double / (1 + greatest(0, p_partkey - 1, 1 - p_partkey)) as weight, 'sibling' as source, 0 as o from part where p_partkey <> 1 and p_brand = (select p_brand from part where p_partkey = 1)),
n as (select p_partkey as l_partkey, 1.5::double as weight, 'similar' as source, 3 as o from part where p_partkey <> 1 and p_name = (select p_name from part where p_partkey = 1)),
e as (select * from p union all select * from w union all select * from n)
select l_partkey, {sql_round('sum(weight)', 3)} as score, string_agg(source, ',' order by o) as sources from e group by l_partkey""")
def related_fusion(spark, d):
    part = table(spark, d, "part")
    me = part.where("p_partkey = 1").select(F.col("p_brand").alias("_b"), F.col("p_name").alias("_n"))
    beside = part.where("p_partkey <> 1").crossJoin(F.broadcast(me))  # one row
    sib = verdicts.siblings(beside.where("p_brand = _b").withColumnRenamed("p_partkey", "l_partkey"), "l_partkey", "l_partkey", "l_partkey", 1, 1)
    co = history.cochange(table(spark, d, "lineitem"), "l_orderkey", "l_partkey", 1, 8).select("l_partkey", "weight", F.lit("co_change").alias("source"))
    same = beside.where("p_name = _n").select(F.col("p_partkey").alias("l_partkey"), F.lit(1.5).alias("weight"), F.lit("similar").alias("source"))
    return verdicts.fuse([sib, co, same], "l_partkey").select("l_partkey", "score", "sources")


@query("""with a as (select o_orderkey, o_totalprice, o_orderstatus from orders where o_orderstatus <> 'P'), b as (select o_orderkey, o_totalprice, case when o_orderpriority = '1-URGENT' then 'X' else o_orderstatus end as o_orderstatus from orders where o_orderpriority <> '5-LOW')
select coalesce(a.o_orderkey, b.o_orderkey) as o_orderkey, case when a.o_orderkey is null then 'created' when b.o_orderkey is null then 'deleted' else 'changed' end as change from a full join b on a.o_orderkey = b.o_orderkey
where a.o_orderkey is null or b.o_orderkey is null or a.o_totalprice <> b.o_totalprice or a.o_orderstatus <> b.o_orderstatus""")
def changed_orders(spark, d):
    o = table(spark, d, "orders")
    prev = o.where("o_orderstatus <> 'P'")
    cur = o.where("o_orderpriority <> '5-LOW'").withColumn("o_orderstatus", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("o_orderstatus")))
    return snapshot.diff(prev, cur, "o_orderkey", ["o_totalprice", "o_orderstatus"])


@query("""with i as (select o_custkey as file, o_orderkey as key, date_diff('day', timestamp '1995-01-01', o_orderdate) as line, date_diff('day', timestamp '1995-01-01', o_orderdate) + 90 as end_line from orders),
h as (select distinct o_custkey as file, date_diff('day', timestamp '1995-01-01', l_shipdate) as at from lineitem join orders on o_orderkey = l_orderkey),
r as (select h.file, h.at, i.key, row_number() over (partition by h.file, h.at order by i.end_line - i.line, i.line desc, i.key desc) as k from h join i on i.file = h.file and h.at between i.line and i.end_line)
select file, key, count(*) as hunks from r where k = 1 group by file, key""")
def changed_symbols_hunks(spark, d):
    """Points (shipping days) to the innermost of a customer's intervals (90 days from each order)."""
    day = lambda c: F.datediff(F.col(c), F.lit("1995-01-01"))
    o = table(spark, d, "orders")
    i = o.select(F.col("o_custkey").alias("file"), F.col("o_orderkey").alias("key"), day("o_orderdate").alias("line"), (day("o_orderdate") + 90).alias("end_line"))
    h = table(spark, d, "lineitem").join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("file"), day("l_shipdate").alias("at")).distinct()
    got = intervals.innermost_held(h, i.withColumn("ord", F.struct("line", "key")), "file", "at", "line", "end_line", ["file", "at"], "ord")
    return got.where("key is not null").groupBy("file", "key").agg(F.count(F.lit(1)).alias("hunks"))


@query("""select o_orderkey, cast(year(o_orderdate) as varchar) || '-' || lpad(cast(month(o_orderdate) as varchar), 2, '0') as inner_id from orders""")
def enclosing_interval(spark, d):
    """Nested years, quarters and months; every order's day lies in the month."""
    o = table(spark, d, "orders").select("o_orderkey", F.lit(0).alias("f"), F.datediff("o_orderdate", F.lit("1995-01-01")).alias("at"))
    months = spark.range(0, 96).select(F.add_months(F.lit("1995-01-01"), F.col("id").cast("int")).alias("m"))
    years, quarters = months.where(F.month("m") == 1), months.where(F.month("m") % 3 == 1)
    span = lambda df, n, name: df.select(F.lit(0).alias("f"), F.datediff("m", F.lit("1995-01-01")).alias("line"), (F.datediff(F.add_months("m", n), F.lit("1995-01-01")) - 1).alias("end_line"), name.alias("inner_id"))
    nested = span(years, 12, F.date_format("m", "yyyy")).union(span(quarters, 3, F.concat(F.date_format("m", "yyyy"), F.lit("q"), F.quarter("m")))).union(span(months, 1, F.date_format("m", "yyyy-MM")))
    got = intervals.innermost(o, F.broadcast(nested), "f", "at", "line", "end_line", ["o_orderkey"], "inner_id")
    return got.select("o_orderkey", "inner_id")


@query("""with h(i, os, oc, ns, nc) as (values (1, 2, 0, 3, 2), (2, 10, 1, 12, 3), (3, 20, 1, 23, 0)), n as (select distinct l_linenumber * 3 as line from lineitem),
m as (select line, max(case when oc > 0 and line >= os and line < os + oc then ns end) as inside, coalesce(sum(case when (oc = 0 and line > os) or (oc > 0 and line >= os + oc) then nc - oc end), 0) as shift from n, h group by line)
select cast(line as bigint) as line, cast(coalesce(inside, line + shift) as bigint) as to_line, inside is not null as lost from m""")
def line_shift(spark, d):
    h = F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("old_start", "old_count", "new_start", "new_count"), v)]) for v in ((2, 0, 3, 2), (10, 1, 12, 3), (20, 1, 23, 0))])
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") * 3).cast("long").alias("line")).distinct()
    return rows.withColumn("m", history.shift_line(F.col("line"), h)).select("line", F.col("m.line").alias("to_line"), "m.lost")


# ---- graph: customers' urgent orders as edges


_EDGES = "edges as (select distinct o_orderkey % (select count(*) from customer) as src, o_custkey as dst from orders where o_orderpriority = '1-URGENT')"


def _edges(spark, d) -> DataFrame:
    n = table(spark, d, "customer").count()
    return table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").select((F.col("o_orderkey") % n).alias("src"), F.col("o_custkey").alias("dst")).distinct()


@query(f"with {_EDGES} select src, dst from edges")
def graph_edges(spark, d):
    n = table(spark, d, "customer").count()
    rows = table(spark, d, "orders").where("o_orderpriority = '1-URGENT'").withColumn("from_", F.col("o_orderkey") % n)
    return graph.edges_of(rows, "from_", "o_custkey").select("src", "dst")


@query(f"with {_EDGES} select dst, count(*) as importers, min(src) as first from edges group by dst")
def importers(spark, d):
    return graph.importers(_edges(spark, d), F.col("dst").isNotNull()).groupBy("dst").agg(F.count(F.lit(1)).alias("importers"), F.min("src").alias("first"))


@query(f"with {_EDGES} select src, count(*) as n, bool_or(src = dst) as self from edges group by src")
def imports_of(spark, d):
    rows = _edges(spark, d)
    return rows.groupBy("src").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("src") == F.col("dst")).alias("self"))


def _walk_sql(steps: str) -> str:
    return f"""with recursive {_EDGES}, steps as ({steps}), w as (select cast(1 as bigint) as id, 0 as depth union select s.b, w.depth + 1 from w join steps s on s.a = w.id where w.depth < 2) select id, min(depth) as depth from w group by id"""


def _walk(spark, d, direction) -> DataFrame:
    return graph.walk(_edges(spark, d), spark.range(1, 2), 2, direction)


@query(_walk_sql("select src as a, dst as b from edges"))
def graph_walk_out_d2(spark, d):
    return _walk(spark, d, "out")


@query(_walk_sql("select dst as a, src as b from edges"))
def graph_walk_in_d2(spark, d):
    return _walk(spark, d, "in")


@query(_walk_sql("select src as a, dst as b from edges union select dst, src from edges"))
def graph_walk_both_d2(spark, d):
    return _walk(spark, d, "both")


@query(f"""with recursive {_EDGES}, r as (select src as a, dst as b from edges union select r.a, e.dst from r join edges e on e.src = r.b)
select x.a as id, least(x.a, min(x.b)) as component from r x join r y on x.a = y.b and x.b = y.a group by x.a""")
def graph_cycles(spark, d):
    return graph.components_strong(_edges(spark, d))


def _pagerank_sql(rounds: int) -> str:
    steps = []
    for k in range(1, rounds + 1):
        steps.append(f"g{k} as (select e.dst as id, sum(r.rank / deg) as given from edges e join deg using (src) join r{k - 1} r on r.id = e.src group by e.dst), l{k} as (select coalesce(sum(rank), 0) as loose from r{k - 1} where id not in (select src from deg)), r{k} as materialized (select r.id, 0.15::double / n + 0.85::double * (coalesce(given, 0) + loose / n) as rank from r{k - 1} r left join g{k} using (id), n, l{k})")
    return f"with {_EDGES}, ids as (select src as id from edges union select dst from edges), n as (select count(*) as n from ids), deg as (select src, count(*) as deg from edges group by src), r0 as (select id, 1.0::double / n as rank from ids, n), {', '.join(steps)} select id, {sql_round('rank', 8)} as rank from r{rounds}"


@query(_pagerank_sql(20))
def pagerank_k20(spark, d):
    return graph.pagerank(_edges(spark, d), rounds=20).select("id", t.round_half_up(F.col("rank"), 8).alias("rank"))


# ---- budgets and verdicts


@query("""with r as (select doc_id, source, sum(2 + strlen(source) + cast(ceil(strlen(text) / 4.0) as bigint)) over (partition by source order by n_chars desc, doc_id) as spent from documents) select doc_id, source, cast(spent as bigint) as spent from r where spent <= 20000""")
def repo_map_budget(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars", (2 + F.octet_length("source") + t.estimate_tokens(F.col("text"))).cast("long").alias("cost"))
    return budget.first_overflow(docs, F.col("cost"), [F.col("n_chars").desc(), F.col("doc_id")], 20000, ["source"]).select("doc_id", "source", "spent")


@query("""with r as (select event_id, event_type, row_number() over (partition by event_type order by ts, event_id) as k from events) select event_id, event_type from r where k <= 10""")
def fair_cap(spark, d):
    """Fifty rows, shared by five kinds with plenty each."""
    e = table(spark, d, "events")
    return budget.fair_cap(e, "event_type", [F.col("ts"), F.col("event_id")], 50, F.col("ts")).select("event_id", "event_type")


@query("""select o_orderkey, case when o_orderstatus = 'P' then 'ignored' when o_orderpriority = '5-LOW' then 'local' end as excluded, case when o_orderpriority in ('1-URGENT', '2-HIGH') then 'low' when o_orderstatus = 'F' then 'medium' else 'high' end as confidence from orders where not exists (select 1 from lineitem where l_orderkey = o_orderkey)""")
def dead_orders(spark, d):
    """Orders that no line refers to, why they might be no candidates, and how sure the rest are."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), "o_orderkey", F.lit("o").alias("path"), F.lit(0).alias("line"), F.lit(0).alias("end_line"), "o_orderpriority", "o_orderstatus")
    refs = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.lit("l").alias("path"), F.lit(1).alias("line"))
    o = verdicts.unreferenced(o, refs)
    sure = verdicts.confidence(F.when(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"), "yes").otherwise("no"), F.lit(False), F.lit("function"), F.lit(True), F.col("o_orderstatus") == "F")
    return o.select("o_orderkey", F.when(F.col("o_orderstatus") == "P", "ignored").when(F.col("o_orderpriority") == "5-LOW", "local").alias("excluded"), sure.alias("confidence"))


_TERMS = ("thnt", "worthless", "idiot", "erblest", "clown", "notaword")


@query(f"""with t(term) as (values {', '.join(f"('{x}')" for x in _TERMS)}), s as (select term, count(item_id) as semantic from t left join benchmark on contains(text, term) group by term), x as (select term, count(doc_id) as text_hits from t left join documents on contains(text, term) group by term)
select term, semantic, text_hits, case when semantic > 0 then 'used' when text_hits > 0 then 'used_only_in_text' else 'unused' end as verdict from s join x using (term)""")
def check_references_verdict(spark, d):
    """Terms with uses in benchmark items, or only in documents; all terms are counted in one pass over each table."""
    counts = lambda df: df.agg(*[F.count_if(F.contains("text", F.lit(x))).alias(x) for x in _TERMS])
    unpivot = lambda df, name: df.unpivot([], list(_TERMS), "term", name)
    both = unpivot(counts(table(spark, d, "benchmark")), "semantic").join(unpivot(counts(table(spark, d, "documents")), "text_hits"), "term")
    return both.withColumn("verdict", verdicts.reference_verdict(F.lit(False), F.col("semantic"), F.col("text_hits")))


@query("""with r as (select o_orderkey, count(*) filter (l_returnflag <> 'R') as refs, count(*) filter (l_returnflag = 'R') as test_refs from orders left join lineitem on l_orderkey = o_orderkey group by o_orderkey)
select o.o_orderkey, case when r.refs > 0 then 'in_use' when r.test_refs > 0 then 'used_by_tests_only' when o_orderstatus = 'O' and o_custkey % 2 = 1 then 'leaves_importers_dangling' else 'unused' end as verdict from orders o join r using (o_orderkey)""")
def delete_check_verdict(spark, d):
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count_if(F.col("l_returnflag") != "R").alias("refs"), F.count_if(F.col("l_returnflag") == "R").alias("tests"))
    o = table(spark, d, "orders").join(li, "o_orderkey", "left").fillna(0, ["refs", "tests"])
    return o.select("o_orderkey", verdicts.delete_verdict(F.col("refs"), F.col("tests"), F.col("o_custkey") % 2, F.col("o_orderstatus") == "O").alias("verdict"))


@query("""with c as (select p_brand, p_name, count(*) as n from part group by p_brand, p_name) select p_partkey, case when p.p_name = 'red bolt' then 'noop' when coalesce(c.n, 0) > 0 then 'collision' else 'ok' end as verdict from part p left join c on c.p_brand = p.p_brand and c.p_name = 'red bolt'""")
def rename_collisions(spark, d):
    """What renaming each part to one name would hit within its brand."""
    p = table(spark, d, "part")
    taken = verdicts.taken_names(p.select(F.col("p_name").alias("name"), "p_brand"), "red bolt", "p_brand")
    rows = p.join(taken, "p_brand", "left")
    return rows.select("p_partkey", verdicts.rename_verdict(F.col("p_name") == "red bolt", F.lit(False), F.coalesce("collisions", F.lit(0)), F.lit(1), F.lit(True)).alias("verdict"))


@query("""select s_suppkey, count(distinct l_orderkey) as orders, count(distinct o_custkey) as customers, count(*) as lines from supplier join lineitem on l_suppkey = s_suppkey join orders on o_orderkey = l_orderkey group by s_suppkey""")
def blast_summary(spark, d):
    """What each supplier reaches in two steps."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    s = table(spark, d, "supplier").select("s_suppkey")
    rows = li.join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(o, F.col("o_orderkey") == F.col("l_orderkey"))
    return rows.groupBy("s_suppkey").agg(F.countDistinct("l_orderkey").alias("orders"), F.countDistinct("o_custkey").alias("customers"), F.count(F.lit(1)).alias("lines"))


_EXIT = {"view": 0, "click": 1, "signup": 3, "purchase": 5, "error": 2}


@query(f"""with e as (select user_id, case event_type {' '.join(f"when '{k}' then {v}" for k, v in _EXIT.items())} else 4 end as x from events) select user_id, cast(arg_max(x, list_position([0, 1, 3, 5, 2, 4], x)) as int) as exit, count(*) as n from e group by user_id""")
def batch_severity(spark, d):
    e = table(spark, d, "events").withColumn("x", F.coalesce(F.element_at(F.create_map(*[F.lit(v) for kv in _EXIT.items() for v in kv]), F.col("event_type")), F.lit(4)))
    return verdicts.worst_exit(e, ["user_id"], "x")


@query("""select event_type || '/' || (json_extract(props, '$.k') :: varchar) as rule, count(*) as n, bool_or(event_type = 'error') as has_errors from events group by 1""")
def diagnostics_rule_ids(spark, d):
    e = table(spark, d, "events").withColumn("rule", t.rule_id(F.col("event_type"), F.get_json_object("props", "$.k")))
    return e.groupBy("rule").agg(F.count(F.lit(1)).alias("n"), F.bool_or(F.col("event_type") == "error").alias("has_errors"))


@query("select o_orderdate, o_orderkey from orders where o_orderdate > timestamp '1998-03-01' or (o_orderdate = timestamp '1998-03-01' and o_orderkey > 100) order by o_orderdate, o_orderkey limit 50")
def keyset_page(spark, d):
    o = table(spark, d, "orders").select("o_orderdate", "o_orderkey")
    at = F.lit("1998-03-01 00:00:00").cast(o.schema["o_orderdate"].dataType)
    return budget.keyset_page(o, ["o_orderdate", "o_orderkey"], (at, 100), 50)


@query("""with i as (select o_custkey, o_orderkey, o_orderdate as s, o_orderdate + interval 30 day as e from orders), m as (select *, max(e) over (partition by o_custkey order by s, o_orderkey rows between unbounded preceding and 1 preceding) as before from i) select o_orderkey, coalesce(s < before, false) as overlap from m""")
def edit_overlap(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("e"))
    return intervals.edit_overlaps(o, ["o_custkey"], "s", "e", ["s", "o_orderkey"]).select("o_orderkey", "overlap")


@query("""with g as (select event_id, user_id, (epoch_us(lead(ts) over (partition by user_id order by ts, event_id)) - epoch_us(ts)) // 1000 as gap_ms from events) select event_id, user_id, coalesce(gap_ms, -1) as gap_ms from g where gap_ms is null or gap_ms >= 36000000""")
def gate_settle(spark, d):
    """Events after which a user stays quiet for ten hours."""
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    e = e.withColumn("ts", F.col("ts").cast("timestamp"))
    return gates.settled(e, "user_id", "ts", 36_000_000).select("event_id", "user_id", F.coalesce("gap_ms", F.lit(-1).cast("long")).alias("gap_ms"))


@query(r"""with h as (select page_id, regexp_extract_all(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), '(?is)<script.*?</script>', '', 'g'), 'href="([^"]*)"', 1) as hrefs from pages) select page_id, len(hrefs) as links, len(list_distinct(hrefs)) as targets from h where len(hrefs) > 0""")
def page_links(spark, d):
    rows = imports.page_links(table(spark, d, "pages"), "page_id", "html")
    return rows.groupBy("page_id").agg(F.count(F.lit(1)).alias("links"), F.countDistinct("href").alias("targets"))


@query("select doc_id, true as same from (select doc_id, lead(doc_id) over (partition by source order by doc_id) as next from documents) where next is not null")
def text_diff_roundtrip(spark, d):
    """Each document against the next of its source: applying the difference gives the other text."""
    docs = table(spark, d, "documents").select("doc_id", "source", "text")
    pairs = docs.select("doc_id", F.lead("doc_id").over(Window.partitionBy("source").orderBy("doc_id")).alias("next")).where("next is not null")
    rows = docs.join(pairs, "doc_id").join(docs.select(F.col("doc_id").alias("next"), F.col("text").alias("other")), "next")
    return rows.select("doc_id", diffs.roundtrip_udf("text", "other").alias("same"))


_TASK = [("worthless", 3.0), ("idiot", 1.0), ("clown", 2.0)]


@query(rf"""with m as (select doc_id, term, weight * case when contains(string_split(text, chr(10))[1], term) then 1.0::double else 0.3::double end as s, contains(source, '9') as boosted from documents, (values {', '.join(f"('{a}', {b}::double)" for a, b in _TASK)}) as q(term, weight) where contains(text, term)),
s as (select doc_id, sum(s) * case when bool_or(boosted) then 1.5::double else 1.0::double end as score, count(*) as named from m group by doc_id) select doc_id, {sql_round('score', 6)} as score, named from s where score >= 0.15::double * (select max(score) from s)""")
def task_rank(spark, d):
    """Documents ranked by the terms of a question: a hit in the first line is exact, elsewhere a token."""
    docs = table(spark, d, "documents")
    hits = docs.select("doc_id", "text", F.contains("source", F.lit("9")).alias("boosted"), F.explode(F.array(*[F.lit(a) for a, _ in _TASK])).alias("term")).where(F.contains("text", F.col("term")))
    quality = F.when(F.contains(F.substring_index("text", "\n", 1), F.col("term")), "exact").otherwise("token")
    return task.rank(hits.select("doc_id", "term", quality.alias("quality"), "boosted"), "doc_id", _TASK, path_boost="boosted").select("doc_id", "score", "named")


# ---- listings


@query(rf"""with {LINES} select doc_id, string_agg(text, chr(10) order by line) as source from lines where line between 2 and 4 group by doc_id""")
def source_slices(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    spans = docs.select("doc_id", F.lit(0).alias("id"), F.lit(2).alias("line"), F.lit(4).alias("end_line"))
    return outline.source_slices(docs, spans, "doc_id", "text").select("doc_id", "source")


@query("""select doc_id, source, n_chars from (select *, row_number() over (partition by source order by n_chars desc, doc_id) as k from documents) where k <= 3""")
def top_per_source(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "source", "n_chars")
    return budget.per_source_top(docs, "source", [F.col("n_chars").desc(), F.col("doc_id")], 3)


@query("""select o_orderkey, case when o_orderpriority = '1-URGENT' then 'X' else o_orderstatus end as status from orders where o_orderpriority <> '5-LOW'""")
def index_upsert(spark, d):
    """A table brought up to date by the differences of two snapshots is the newer snapshot."""
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority")
    prev = o.where("status <> 'P'").select("o_orderkey", "status")
    cur = o.where("o_orderpriority <> '5-LOW'").select("o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "X").otherwise(F.col("status")).alias("status"))
    return snapshot.upsert(prev, snapshot.diff(prev, cur, "o_orderkey", ["status"]), cur, "o_orderkey")


@query("""with i as (select o_custkey as f, o_orderkey as k, o_orderdate as s, o_orderdate + interval 30 day as e from orders) select a.f as o_custkey, count(*) as pairs from i a join i b on a.f = b.f and a.s <= b.e and a.e >= b.s and a.k < b.k group by a.f""")
def interval_overlaps(spark, d):
    """Pairs of a customer's orders whose thirty days overlap."""
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("f"), F.col("o_orderkey").alias("k"), F.col("o_orderdate").alias("s"), (F.col("o_orderdate") + F.expr("interval 30 days")).alias("e"))
    return intervals.overlap_counts(o, "f", "s", "e").where("pairs > 0").select(F.col("f").alias("o_custkey"), "pairs")


@query(rf"""select page_id, case when regexp_matches({_PATH}, '\.html$') then 'html' else '' end as language from pages""")
def page_languages(spark, d):
    return table(spark, d, "pages").select("page_id", t.language_id(_page_path()).alias("language"))


@query("""select event_id, user_id, count(*) over () as total, true as has_errors from events where event_type = 'error' order by user_id, ts, event_id limit 100""")
def diagnostics_sorted(spark, d):
    """The first hundred errors by user and time, with the total."""
    e = table(spark, d, "events").withColumnRenamed("event_type", "severity").where("severity = 'error'")
    return outline.diagnostics(e, "severity", [F.col("user_id"), F.col("ts"), F.col("event_id")], 100).select("event_id", "user_id", "total", "has_errors")


@query("""with recursive e as (select distinct o_orderkey % (select count(*) from customer) as src, o_custkey as dst from orders where o_orderpriority = '1-URGENT'),
w as (select [cast(1 as bigint)] as path, cast(1 as bigint) as id, 0 as depth union all select list_append(w.path, e.dst), e.dst, w.depth + 1 from w join e on e.src = w.id where w.depth < 1 and not list_contains(w.path, e.dst)) select id, depth from w""")
def call_hierarchy_d1(spark, d):
    """What one node calls, in depth-first order."""
    return graph.hierarchy(_edges(spark, d), spark.range(1, 2), 1, 500).where("not repeat or depth = 0").select("id", "depth")
