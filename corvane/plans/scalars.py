"""Queries of scalar functions, predicates, verdict rules, snapshots and streams' offline forms."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from corvane.functions import doc
from corvane.functions import text as t
from corvane.operators import budget, graph, grep, history, outline, paths, search, snapshot, task, verdicts
from corvane.plans.queries import _OSA, LINES, ORACLE_SQL, QUERIES, _EDGES, _edges, _part_symbols, _sql_grams, query, scratch, sql_round, table
from corvane.streaming import gate as gates

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- cases by number: every part takes one of a list, and the SQL lists what each must give


def _case(values: list, key: str = "p_partkey") -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (F.col(key) % len(values) + 1).cast("int"))


def _sql_list(values: list) -> str:
    one = lambda v: str(v).lower() if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "[" + ", ".join(map(one, values)) + "]"


def _expected(values: list, name: str = "value") -> str:
    return f"select p_partkey, {_sql_list(values)}[1 + p_partkey % {len(values)}] as {name} from part"


TESTS = [("a/test_x.py", True), ("conftest.py", True), ("a/x_test.go", True), ("a/x.spec.ts", True), ("FooTest.java", True), ("FooTests.kt", True), ("src/tests/x.c", True), ("__tests__/a.js", True), ("a/contest.py", False), ("attest.go", False), ("latest/x.go", False), ("src/x.go", False), ("spec/x.rb", True), ("x_spec.rb", True)]


@query(_expected([b for _, b in TESTS]))
def test_files(spark, d):
    return table(spark, d, "part").select("p_partkey", t.is_test_file(_case([p for p, _ in TESTS])).alias("value"))


CODE = [("a.go", "go", True), ("b.PY", "python", True), ("README.md", "markdown", False), ("x.json", "json", False), ("go.mod", "gomod", False), ("Makefile", "make", True), (".env", "", False), ("a/Dockerfile", "dockerfile", True), ("noending", "", False), ("x.tar.rs", "rust", True), ("y.tsx", "typescriptreact", True)]


@query(f"select p_partkey, {_sql_list([g for _, g, _ in CODE])}[1 + p_partkey % {len(CODE)}] as language, {_sql_list([b for _, _, b in CODE])}[1 + p_partkey % {len(CODE)}] as code from part")
def code_files(spark, d):
    """Languages by name and ending, and which of them are code."""
    rows = table(spark, d, "part").select("p_partkey", t.language_id(_case([p for p, _, _ in CODE])).alias("language"))
    return rows.withColumn("code", t.is_code(F.col("language")))


EXPORTS = [("go", "Run", "func Run()", "yes", "yes"), ("go", "run", "func run()", "no", "no"), ("python", "_x", "def _x():", "no", "no"), ("python", "x", "def x():", "unknown", "yes"), ("python", "__init__", "def __init__():", "no", "yes"), ("typescript", "f", "export function f()", "yes", "yes"), ("typescript", "f", "function f()", "no", "no"), ("rust", "f", "pub fn f()", "yes", "yes"), ("rust", "f", "pub(crate) fn f()", "no", "unknown"), ("rust", "f", "fn f()", "no", "no"), ("c", "f", "static int f()", "no", "no"), ("c", "f", "int f()", "unknown", "unknown"), ("lua", "f", "local function f()", "no", "no"), ("java", "f", "void f()", "unknown", "unknown")]


@query(f"select p_partkey, {_sql_list([x[3] for x in EXPORTS])}[1 + p_partkey % {len(EXPORTS)}] as strict, {_sql_list([x[4] for x in EXPORTS])}[1 + p_partkey % {len(EXPORTS)}] as simple from part")
def exportedness(spark, d):
    g, n, line = (_case([x[k] for x in EXPORTS]) for k in range(3))
    return table(spark, d, "part").select("p_partkey", verdicts.exportedness(g, n, line).alias("strict"), verdicts.exportedness(g, n, line, strict=False).alias("simple"))


ENTRIES = [("go", "main", "function", True), ("go", "TestRun", "function", True), ("go", "Testify", "function", False), ("go", "BenchmarkX", "function", True), ("go", "TestRun", "method", False), ("go", "init", "function", True), ("python", "__str__", "method", True), ("python", "test_x", "function", False), ("rust", "main", "function", True), ("go", "Example", "function", True), ("go", "Fuzz_x", "function", True)]


@query(_expected([x[3] for x in ENTRIES]))
def entry_points(spark, d):
    g, n, k = (_case([x[i] for x in ENTRIES]) for i in range(3))
    return table(spark, d, "part").select("p_partkey", verdicts.entry_point(g, n, k).alias("value"))


EXCLUDED = [("a_test.go", "x", "function", False, "no", "test_file"), ("a.go", "main", "function", True, "yes", "entry_point"), ("a.go", "String", "method", False, "yes", "ignored"), ("a.go", "String", "function", False, "no", ""), ("a.go", "tmp_x", "function", False, "no", "ignored"), ("gen/a.go", "x", "function", False, "no", "ignored"), ("a.go", "x", "function", True, "yes", "local"), ("a.go", "X", "function", False, "yes", "exported"), ("a.go", "x", "function", False, "no", "")]


@query(_expected([x[5] for x in EXCLUDED]))
def dead_code_exclusions(spark, d):
    """Why a symbol is no candidate: the first of tests, entry points, ignored names and paths, locals, exports."""
    rows = table(spark, d, "part").select("p_partkey", *[_case([x[k] for x in EXCLUDED]).alias(n) for k, n in enumerate(("path", "name", "kind", "local", "exported"))])
    rule = verdicts.exclusion("g", "name", "kind", "path", F.col("local"), F.col("exported"), False, ["tmp_*"], ["gen/*"])
    return rows.withColumn("g", F.lit("go")).select("p_partkey", F.coalesce(rule, F.lit("")).alias("value"))


BUILDS = [("a_linux.go", "package a", True), ("a_linux_amd64.go", "package a", True), ("a_test.go", "package a", False), ("a.go", "//go:build linux\n\npackage a", True), ("a.go", "package a\n\n//go:build linux\n", False), ("a.go", "  // +build x\npackage a", True), ("a.go", 'package a\nimport "C"\n', True), ("a.go", "// go:build\npackage a", False)]


@query(_expected([x[2] for x in BUILDS]))
def build_sensitive(spark, d):
    return table(spark, d, "part").select("p_partkey", verdicts.build_sensitive(_case([x[0] for x in BUILDS]), _case([x[1] for x in BUILDS])).alias("value"))


SENTENCES = [("One two. Three.", "One two."), ("No stop here", "No stop here"), ("First\nline. Next", "First line."), ("Para one\n\nPara two.", "Para one"), ("v1.2 is out. Yes", "v1.2 is out."), ("  lead  ", "lead")]


@query(_expected([x[1] for x in SENTENCES]))
def first_sentences(spark, d):
    return table(spark, d, "part").select("p_partkey", t.first_sentence(_case([x[0] for x in SENTENCES])).alias("value"))


DECLARATIONS = [
    ("// Run does it.\n// Twice.\nfunc Run(\n\ta int,\n) error {\n}\n", 3, "func Run( a int, ) error", "Run does it.\nTwice."),
    ("# note\ndef f(a, b):\n    pass\n", 2, "def f(a, b)", "note"),
    ("/**\n * Makes x.\n */\nexport function x() {\n", 4, "export function x()", "Makes x."),
    ("let a = 1;\nfn f() -> u8 {\n", 2, "fn f() -> u8", ""),
    ("--- Adds.\nlocal function add(a, b)\n", 2, "local function add(a, b)", "Adds."),
]


@query(f"select p_partkey, {_sql_list([x[2] for x in DECLARATIONS])}[1 + p_partkey % {len(DECLARATIONS)}] as signature, {_sql_list([x[3] for x in DECLARATIONS])}[1 + p_partkey % {len(DECLARATIONS)}] as doc from part")
def declarations(spark, d):
    """Signatures until their brackets balance, and the comments above them without marks."""
    text, line = _case([x[0] for x in DECLARATIONS]), _case([x[1] for x in DECLARATIONS])
    return table(spark, d, "part").select("p_partkey", doc.signature(text, line).alias("signature"), doc.doc_above(text, line).alias("doc"))


DOCSTRINGS = [('def f():\n    """Adds.\n\n    More."""\n', "Adds.\n\nMore."), ("def f():\n    'One'\n    pass\n", "One"), ("def f():\n    return 1\n", ""), ('class A(\n    B,\n):\n    r"""Raw."""\n', "Raw.")]


@query(_expected([x[1] for x in DOCSTRINGS]))
def docstrings(spark, d):
    return table(spark, d, "part").select("p_partkey", doc.docstring(_case([x[0] for x in DOCSTRINGS]), F.lit(1)).alias("value"))


HEADERS = [("package p\n\nimport (\n\t\"a\"\n)\n\nfunc f() {}\n", 'package p\n\nimport (\n\t"a"\n)'), ("import os\nfrom a import b\nx = 1\n", "import os\nfrom a import b"), ("x = 1\n", "")]


@query(_expected([x[1] for x in HEADERS]))
def import_headers(spark, d):
    return table(spark, d, "part").select("p_partkey", doc.header_of(_case([x[0] for x in HEADERS]), F.lit(80)).alias("value"))


IDS = [("a/b.go::T.Run#method", "a/b.go", "T.Run", "method", 1), ("x.py::f#function~3", "x.py", "f", "function", 3), ("c.rs::a::b#fn", "c.rs", "a::b", "fn", 1), ("d.cs::op#eq#operator~12", "d.cs", "op#eq", "operator", 12)]


@query(f"select p_partkey, {', '.join(f'{_sql_list([x[k] for x in IDS])}[1 + p_partkey % {len(IDS)}] as {n}' for k, n in ((1, 'path'), (2, 'name'), (3, 'kind'), (4, 'ordinal')))} from part")
def parse_ids(spark, d):
    return table(spark, d, "part").select("p_partkey", t.parse_id(_case([x[0] for x in IDS])).alias("i")).select("p_partkey", "i.path", "i.name", "i.kind", "i.ordinal")


RECEIVERS = [("(*Server).Run", "Server.Run"), ("(List[T]).Len", "List.Len"), ("Server.Run", "Server.Run"), ("(*Map[K, V]).Get", "Map.Get"), ("plain", "plain")]


@query(_expected([x[1] for x in RECEIVERS]))
def receiver_names(spark, d):
    return table(spark, d, "part").select("p_partkey", t.id_name(_case([x[0] for x in RECEIVERS])).alias("value"))


ENDS = [("a\r\nb", "crlf", "a\nb"), ("a\nb\n", "lf", "a\nb\n"), ("a\rb", "cr", "a\nb"), ("a\r\nb\nc", "mixed", "a\nb\nc"), ("ab", "none", "ab"), ("a\r\r\n", "mixed", "a\n\n")]


@query(f"select p_partkey, {_sql_list([x[1] for x in ENDS])}[1 + p_partkey % {len(ENDS)}] as kind, {_sql_list([x[2] for x in ENDS])}[1 + p_partkey % {len(ENDS)}] as plain from part")
def line_ends(spark, d):
    c = _case([x[0] for x in ENDS])
    return table(spark, d, "part").select("p_partkey", t.eol_kind(c).alias("kind"), t.to_lf(c).alias("plain"))


WORDS = [("foo bar", 5, "bar"), ("foo bar", 4, "foo"), ("éa.b", 4, "éa"), ("x(y_1)", 4, "y_1"), ("a  b", 3, ""), ("", 1, "")]


@query(_expected([x[2] for x in WORDS]))
def identifier_at(spark, d):
    """The word around a byte column."""
    return table(spark, d, "part").select("p_partkey", t.identifier_at(_case([x[0] for x in WORDS]), _case([x[1] for x in WORDS])).alias("value"))


BASES = [("a/b.go", "a", "b", "a/b"), ("b.tar.gz", ".", "b.tar", "."), ("a/b/c/.env", "a/b/c", ".env", "a,a/b,a/b/c"), ("Makefile", ".", "Makefile", ".")]


@query(f"select p_partkey, {_sql_list([x[1] for x in BASES])}[1 + p_partkey % {len(BASES)}] as package, {_sql_list([x[2] for x in BASES])}[1 + p_partkey % {len(BASES)}] as base from part")
def path_algebra(spark, d):
    c = _case([x[0] for x in BASES])
    return table(spark, d, "part").select("p_partkey", t.package_of(c).alias("package"), t.file_base(c).alias("base"))


# ---- over the tables


@query("select doc_id, case when strlen(text) <= 40 then text else substr(text, 1, 37) || '...' end as clipped from documents where regexp_full_match(text, '[\\x00-\\x7F]*')")
def clip_texts(spark, d):
    """At most forty bytes with the mark, over texts of ASCII."""
    docs = table(spark, d, "documents").where(F.octet_length("text") == F.length("text"))
    return docs.select("doc_id", t.clipped(40)(F.col("text")).alias("clipped"))


@query(rf"""with {LINES}, m as (select doc_id, line, text, strlen(regexp_extract(text, '^(.*?)worthless', 1)) as pos from lines where contains(text, 'worthless') and regexp_full_match(text, '[\x00-\x7F]*')),
w as (select *, greatest(0, least(pos - (60 - 9) // 2, strlen(text) - 60)) as lo from m)
select doc_id, line, case when strlen(text) <= 60 then text else case when lo > 0 then '[+' || lo || 'B]…' else '' end || substr(text, cast(lo + 1 as bigint), 60) || case when lo + 60 < strlen(text) then '…[+' || (strlen(text) - lo - 60) || 'B]' else '' end end as clip from w""")
def clip_lines(spark, d):
    """A window of sixty bytes around the match, with what is cut as counts."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = grep.search_text(docs, "doc_id", "text", "worthless", case=True).where(F.octet_length("text") == F.length("text"))
    start = F.col("col") - 1
    return found.select("doc_id", F.col("line").cast("long").alias("line"), t.clip_window(60)("text", start, start + 9).alias("clip"))


@query("select doc_id, array_to_string(string_split(text, chr(10))[1:2], chr(10)) as source from documents where strlen(array_to_string(string_split(text, chr(10))[1:2], chr(10))) <= 4000")
def cap_sources(spark, d):
    """The first two lines, where these are short enough to stay whole."""
    docs = table(spark, d, "documents").where(F.octet_length(F.array_join(F.slice(F.split("text", "\n"), 1, 2), "\n")) <= 4000)
    return docs.select("doc_id", t.cap_source(F.col("text"), 2, 4000).alias("source"))


@query(r"""with b as (select doc_id, substr(text, 1, cast(n_chars // 2 as bigint)) as b from documents), l as (select doc_id, string_split(b, chr(10))[-1] as tail from b)
select doc_id, cast(length(tail) + len(regexp_extract_all(tail, '[\x{10000}-\x{10FFFF}]')) as int) as col from l""")
def line_utf16_columns(spark, d):
    """UTF-16 columns of the middle of each text in its line."""
    docs = table(spark, d, "documents").select("doc_id", F.substring_index(F.substring(F.col("text"), F.lit(1), F.floor(F.col("n_chars") / 2).cast("int")), "\n", -1).alias("tail"))
    return docs.select("doc_id", t.utf16_column(F.col("tail"), F.length("tail")).alias("col"))


@query(rf"with {LINES} select doc_id, line, text from lines where line between 2 and 3")
def line_ranges(spark, d):
    docs = table(spark, d, "documents").select("doc_id", "text")
    return grep.line_range(docs, "doc_id", "text", 2, 3).select("doc_id", F.col("line").cast("long").alias("line"), "text")


@query("select doc_id, case when doc_id % 50 = 9 then 'unreadable' when strlen(text) + case when doc_id % 50 = 3 then 1 else 0 end > 6000 then 'too_large' when doc_id % 50 = 3 then 'binary' else '' end as skip from documents")
def skip_reasons(spark, d):
    """Files that are not read: gone, too large, with a zero byte near the top."""
    docs = table(spark, d, "documents").select("doc_id", F.when(F.col("doc_id") % 50 != 9, F.concat(F.when(F.col("doc_id") % 50 == 3, "\u0000").otherwise(""), "text")).cast("binary").alias("content"))
    return snapshot.skip_reason(docs, "content", 6000).select("doc_id", F.coalesce("skip", F.lit("")).alias("skip"))


_SNAP = """a as (select doc_id as path, n_chars as size, doc_id % 3 as mtime, case when doc_id % 7 = 1 then 'x' else md5(text) end as hash, doc_id % 11 <> 2 as has_outline, case when doc_id % 13 = 4 then 's2' else 's1' end as server from documents where doc_id % 5 <> 0),
b as (select doc_id as path, n_chars as size, case when doc_id % 4 = 0 then 9 else doc_id % 3 end as mtime, md5(text) as hash, doc_id % 17 = 3 as racy from documents where doc_id % 6 <> 0),
states as (select coalesce(a.path, b.path) as path, case when a.path is null then 'added' when b.path is null then 'removed' when a.server <> 's1' then 'changed' when (a.mtime <> b.mtime or racy) and a.hash <> b.hash then 'changed' when not has_outline then 'rebuilt' when a.mtime <> b.mtime or racy then 'touched' else 'fresh' end as state from a full join b on a.path = b.path)"""


def _freshness(spark, d):
    docs = table(spark, d, "documents")
    md5 = F.md5(F.col("text").cast("binary"))
    a = docs.where("doc_id % 5 <> 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), (F.col("doc_id") % 3).alias("mtime_ns"), F.when(F.col("doc_id") % 7 == 1, "x").otherwise(md5).alias("hash"), (F.col("doc_id") % 11 != 2).alias("has_outline"), F.lit(True).alias("has_imports"), F.when(F.col("doc_id") % 13 == 4, "s2").otherwise("s1").alias("server"))
    # the scan sees a time as racy if it is near enough
    b = docs.where("doc_id % 6 <> 0").select(F.col("doc_id").alias("path"), F.col("n_chars").alias("size"), F.when(F.col("doc_id") % 4 == 0, 9).otherwise(F.col("doc_id") % 3).alias("mtime_ns"), md5.alias("hash"), (F.col("doc_id") % 17 == 3).alias("racy"), F.lit("s1").alias("server"))
    return snapshot.freshness(a, b)


@query(f"with {_SNAP} select path, state from states")
def freshness_states(spark, d):
    return _freshness(spark, d)


@query(f"with {_SNAP} select {', '.join(f'count(*) filter (state = {chr(39)}{k}{chr(39)}) as {k}' for k in ('fresh', 'touched', 'changed', 'added', 'removed', 'rebuilt'))}, count(*) as files from states")
def sync_report(spark, d):
    return snapshot.sync_report(_freshness(spark, d))


@query("select event_id, epoch_us(ts) > (select max(epoch_us(ts)) from events) - 7200000000 as racy, case event_type when 'view' then 'symlink' when 'click' then 'not_regular' else '' end as skip from events")
def stat_scan(spark, d):
    """Times near the scan are racy; what is no regular file is passed over with a reason."""
    e = table(spark, d, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("mtime_ns"), F.when(F.col("event_type") == "view", "symlink").when(F.col("event_type") == "click", "pipe").otherwise("file").alias("kind"))
    at = e.agg(F.max("mtime_ns")).first()[0]
    return snapshot.scanned(e, at, 7_200_000_000_000).select("event_id", "racy", F.coalesce("skip", F.lit("")).alias("skip"))


@query("select count(*) filter (n_chars % 9 = 0) + count(*) filter (doc_id % 40 = 1 and n_chars % 9 <> 0) as moved, cast(0 as bigint) as gone, true as relist from documents")
def listing_reuse(spark, d):
    """Directories that moved or went make a listing unusable."""
    docs = table(spark, d, "documents")
    before = docs.select(F.col("doc_id").alias("path"), F.col("n_chars").alias("mtime_ns"), F.lit("").alias("ignore_hash"))
    now = before.where("path % 40 <> 1 or mtime_ns % 9 = 0").withColumn("ignore_hash", F.when(F.col("mtime_ns") % 9 == 0, "other").otherwise(""))
    listed = docs.select(F.col("doc_id").alias("path"), F.lit(True).alias("there"))
    return snapshot.must_relist(before, now, listed)


@query("""with r as (select source, doc_id, row_number() over (partition by source order by doc_id) as k from documents where length(text) < 200) select source, string_agg('short: ' || doc_id, ', ' order by k) as examples from r where k <= 3 group by source""")
def status_examples(spark, d):
    """Up to three skipped documents of each source, by name."""
    docs = table(spark, d, "documents").withColumn("skip", F.when(F.length("text") < 200, "short")).withColumns({"in_": F.lit(True), "one": F.lit(1)})
    rows = snapshot.status(docs, ["source"], "in_", "one", "one", "skip", key="doc_id")
    return rows.where("examples is not null").select("source", "examples")


@query("select p_partkey as id, p_name as name, p_size as n from part where p_size > 10")
def build_in_steps(spark, d):
    """An index built in steps, stopped and taken up again."""
    path = scratch(spark, "steps")
    files = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_size").alias("n")).where("n > 10")
    files.where("id % 3 = 0").write.parquet(path)  # what was there when the first run was stopped
    return snapshot.build_in_steps(files, lambda x: x, path, "id", max(500, files.count() // 3)).select("id", "name", "n")


@query(f"""with n as (select distinct p_name as name, {t.sql_normalise('p_name')} as norm from part), s as (select name, norm, levenshtein('gizmored', norm) as dist, len(list_intersect({_sql_grams("'gizmored'")}, {_sql_grams('norm')})) / cast(len(list_distinct(list_concat({_sql_grams("'gizmored'")}, {_sql_grams('norm')}))) as double) as sim from n)
select name, {sql_round('greatest(0.001::double, ((1 - dist / cast(greatest(8, length(norm)) as double)) + sim) / 2)', 6)} as score from s where dist <= 2 or sim >= 0.3""")
def fuzzy_scores(spark, d):
    """Names alike to a query by distance or trigrams, with the mean of both."""
    norm = t.normalise(F.col("p_name"))
    rows = table(spark, d, "part").select(F.col("p_name").alias("name"), norm.alias("norm")).distinct()
    q = F.lit("gizmored")
    s = t.fuzzy_score(F.levenshtein(q, F.col("norm")), t.jaccard(t.trigrams(q), t.trigrams(F.col("norm"))), q, F.col("norm"))
    return rows.withColumn("s", s).where("s > 0").select("name", t.round_half_up(F.col("s"), 6).alias("score"))


_FUZZY_HIT = "greatest(0.001::double, ((1 - distance / cast(greatest(7, length(norm), 1) as double)) + sim) / 2)"


@query(
    f"""{_OSA[: _OSA.index("g as (select *")]}g as (select *, {_sql_grams("'redbotl'")} as a, {_sql_grams('norm')} as b from d),
s as (select *, len(list_intersect(a, b)) / cast(len(list_distinct(list_concat(a, b))) as double) as sim from g), h as (select *, {_FUZZY_HIT} as raw from s where distance <= 1 or sim >= 0.3)
select p_partkey as id, p_name as name, 1 as tier, {sql_round("1 + raw / (1 + raw)", 6)} as score, count(*) over () as total from part join h on h.name = p_name"""
)
def fuzzy_fallback(spark, d):
    """A search that finds nothing turns to near names: all of them, with their scores."""
    parts = _part_symbols(spark, d).withColumns({"qualified": F.col("name"), "signature": F.lit("")})
    hits = search.search_symbols(parts, search.SearchQuery("redbotl", limit=0, fuzzy=True))
    return hits.select("id", "name", "tier", t.round_half_up(F.col("score"), 6).alias("score"), "total")


@query("select 'no symbol named bolt_red: token matches' as notice, count(*) as hits from part where p_name like '%red%' or p_name like '%bolt%'")
def identifier_notice(spark, d):
    """A query like a name that none has: what the hits are is said."""
    parts = _part_symbols(spark, d).withColumns({"qualified": F.col("name"), "signature": F.lit("")})
    hits = search.search_symbols(parts, search.SearchQuery("bolt_red", limit=0))
    notice = search.identifier_notice(hits, "bolt_red")
    return notice.crossJoin(hits.agg(F.count(F.lit(1)).alias("hits")))


@query("select p_partkey as id, 'part' as path, p_partkey as line, 'part' as kind, p_name as name from part")
def detail_columns(spark, d):
    return search.detail(_part_symbols(spark, d), "compact")


@query("select event_type as kind, count(*) as n from events where lower(event_type) in ('view', 'error') group by event_type")
def kind_filter(spark, d):
    """Kinds without case."""
    e = table(spark, d, "events").withColumnRenamed("event_type", "kind")
    return search.filters(e, search.SearchQuery("", kinds=("VIEW", "Error"))).groupBy("kind").agg(F.count(F.lit(1)).alias("n"))


_ROOTS = "p as (select page_id, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '[?#].*$', '') as path from pages)"


@query(rf"""with {_ROOTS}, s as (select page_id, path, string_split(path, '/') as x from p) select page_id, case when len(x) > 2 and x[2] = 'en' then x[1] || '/en' when len(x) > 1 and contains(x[1], 'example.com') then x[1] else '.' end as root from s""")
def nearest_roots(spark, d):
    """The directory with the first marker in order, the deepest of several; the top has the last one."""
    path = F.regexp_replace(F.regexp_replace("url", "^[a-z]+://", ""), r"[?#].*$", "")
    rows = table(spark, d, "pages").select("page_id", path.alias("path"))
    x = F.split("path", "/")
    have = rows.select(x.alias("x")).select(F.explode(F.array(F.when((F.size("x") > 2) & (F.col("x")[1] == "en"), F.concat(F.col("x")[0], F.lit("/en/a.mod"))), F.when((F.size("x") > 1) & F.contains(F.col("x")[0], F.lit("example.com")), F.concat(F.col("x")[0], F.lit("/b.mod"))), F.lit("c.mod"))).alias("path")).where("path is not null").distinct()
    files = rows.withColumn("file_path", F.concat("path", F.lit("#"), F.col("page_id").cast("string"))).select("page_id", "file_path")
    got = paths.nearest_root(files, "file_path", have, ["a.mod", "b.mod", "c.mod"])
    return got.select(F.substring_index("file", "#", -1).cast("long").alias("page_id"), "root")


# ---- graphs


@query(f"with recursive {_EDGES}, w as (select cast(id as bigint) as id, 0 as depth from (values (1), (2)) v(id) union select e.dst, w.depth + 1 from w join edges e on e.src = w.id where w.depth < 2), m as (select id, min(depth) as depth from w group by id) select distinct e.src, e.dst from edges e join m on m.id = e.src where m.depth < 2")
def walk_edges(spark, d):
    """Edges that a walk from two roots follows, once each."""
    e = _edges(spark, d)
    reached = graph.walk(e, spark.range(1, 3), 2)
    return graph.walk_edges(e, reached, 2).select("src", "dst").distinct()


@query("with e as (select distinct 'a/n' || (p_partkey % 40) as src, 'b/n' || p_size as dst from part), w as (select distinct dst as id from e where src like 'a/%') select id, 1 as depth from w union all select distinct src, 0 from e where src like 'a/%'")
def multi_root_walk(spark, d):
    """All nodes beneath a directory as roots."""
    e = table(spark, d, "part").select(F.concat(F.lit("a/n"), (F.col("p_partkey") % 40).cast("string")).alias("src"), F.concat(F.lit("b/n"), F.col("p_size").cast("string")).alias("dst")).distinct()
    return graph.walk(e, graph.roots_under(graph.nodes_of(e), "a"), 1)


@query("select g as component, case when g % 3 = 0 then g || '>' || (g + 100000) || '>' || (g + 200000) when g % 3 = 1 then g || '>' || (g + 100000) else cast(g as varchar) end as nodes from (select distinct cast(p_partkey as bigint) as g from part)")
def cycle_paths(spark, d):
    """Rings of three, of two and loops, each in order from its least node."""
    g = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, 3).when(F.col("p_partkey") % 3 == 1, 2).otherwise(1).alias("n"))
    # a node's identifier is its part's and its place in the ring, so that rings of different parts stay apart at any key
    e = g.withColumn("k", F.explode(F.sequence(F.lit(0), F.col("n") - 1))).select((F.col("p_partkey") * 3 + F.col("k")).alias("src"), (F.col("p_partkey") * 3 + (F.col("k") + 1) % F.col("n")).alias("dst"))
    part, place = (lambda x: F.floor(x / 3).cast("long")), (lambda x: F.pmod(x, F.lit(3)))
    shown = F.transform("nodes", lambda x: (part(x.cast("long")) + place(x.cast("long")) * 100000).cast("string"))
    return graph.cycle_paths(e, graph.components_strong(e)).select(part(F.col("component")).alias("component"), F.array_join(shown, ">").alias("nodes"))


@query(f"""with s as (select distinct o_custkey % 20 as src, o_custkey % 7 + 20 as dst from orders), n as (select count(*) as n from (select src as id from s union select dst from s)) select cast(n as bigint) as nodes, true as one from n""")
def pagerank_converged(spark, d):
    """Ranks run until they are still; they sum to one."""
    e = table(spark, d, "orders").select((F.col("o_custkey") % 20).alias("src"), (F.col("o_custkey") % 7 + 20).alias("dst"))
    return graph.pagerank(e).agg(F.count(F.lit(1)).alias("nodes"), (F.abs(F.sum("rank") - 1) < 1e-9).alias("one"))


@query("""with f as (select p_partkey as path, p_brand as package, p_partkey % 4 = 0 as is_test from part), r as (select package, count(*) as w from f group by package), c as (select package, count(*) filter (not is_test) as prod, count(*) as every from f group by package),
x as (select path, w / cast(case when prod = 0 then every else prod end as double) as rank from f join r using (package) join c using (package) where prod = 0 or not is_test)
select path, floor(rank / (select sum(rank) from x) * 1000000000 + 0.5) / 1000000000 as rank from x""")
def file_ranks(spark, d):
    """Ranks of packages in equal parts for their files that are no tests."""
    f = table(spark, d, "part").select(F.col("p_partkey").alias("path"), F.col("p_brand").alias("package"), (F.col("p_partkey") % 4 == 0).alias("is_test"))
    ranks = f.groupBy(F.col("package").alias("id")).agg(F.count(F.lit(1)).cast("double").alias("rank"))
    return graph.file_ranks(ranks, f).select("path", t.round_half_up(F.col("rank"), 9).alias("rank"))


@query("""with s as (select p_brand as path, p_partkey, p_name as name, p_partkey % 2 = 0 as exported, case when p_partkey % 3 = 0 then 'function' else 'variable' end as kind from part), fr as (select path, count(*) as n, row_number() over (order by count(*) desc, path) as fk from s group by path),
k as (select s.*, fk, row_number() over (partition by s.path order by exported desc, case kind when 'function' then 1 else 3 end, p_partkey) as pick from s join fr using (path)),
l as (select fk, path, row_number() over (partition by path order by p_partkey) as k, kind || ' ' || name as text from k where pick <= case when fk <= 20 then 8 else 3 end union all select fk, path, 0, path from fr),
c as (select *, sum(strlen(text) + case when k = 0 then 2 else 3 end) over (order by fk, k) as spent from l) select path, text, cast(spent as bigint) as spent from c where spent <= 3000""")
def repo_map(spark, d):
    """A map of brands and their first parts within three thousand bytes."""
    p = table(spark, d, "part")
    symbols = p.select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.when(F.col("p_partkey") % 3 == 0, "function").otherwise("variable").alias("kind"), F.lit("").alias("signature"), F.lit(0).alias("depth"), F.lit("").alias("parent_kind"), F.col("p_partkey").alias("line"), (F.col("p_partkey") % 2 == 0).alias("exported"))
    files = p.select(F.col("p_brand").alias("path")).distinct().withColumn("rank", F.lit(1.0))
    return verdicts.repo_map(files, symbols, 3000).select("path", "text", F.col("spent").cast("long").alias("spent"))


# ---- tasks, evidence, streams


@query("""with c as (select l_partkey as key, l_suppkey as other, row_number() over (partition by l_partkey order by l_suppkey) as r from (select distinct l_partkey, l_suppkey from lineitem)), o as (select l_partkey as key, l_orderkey as other, row_number() over (partition by l_partkey order by l_orderkey) as r from (select distinct l_partkey, l_orderkey from lineitem))
select key, other, 'callers' as relation from c where r <= 2 union all select key, other, 'imports' from o where r <= 4""")
def task_neighbourhood(spark, d):
    """The first few of each relation of every symbol."""
    li = table(spark, d, "lineitem")
    rel = lambda c: li.select(F.col("l_partkey").alias("key"), F.col(c).alias("other")).distinct().withColumn("at", F.col("other"))
    return task.neighbourhood({"callers": rel("l_suppkey"), "imports": rel("l_orderkey")}, "key", "at", {"callers": 2})


def _sql_filled(items: str, used: str, ceiling: str, ends: bool, first: bool = False) -> str:
    """Items that fit under a ceiling, in order, folded in lists."""
    fits = f"(acc.used + x.cost <= {ceiling}" + (" or (len(acc.out) = 0 and not acc.closed)" if first else "") + ")" + (" and not acc.closed" if ends else "")
    return f"list_reduce({items}, lambda acc, x: {{'used': acc.used + case when {fits} then x.cost else 0 end, 'out': case when {fits} then list_append(acc.out, x.id) else acc.out end, 'closed': acc.closed or not ({fits}), 'id': '', 'file': '', 'of': '', 'cost': 0::bigint}}, {{'used': ({used})::bigint, 'out': []::varchar[], 'closed': false, 'id': '', 'file': '', 'of': '', 'cost': 0::bigint}})"


_ITEM = "{{'used': 0::bigint, 'out': []::varchar[], 'closed': false, 'id': {0}, 'file': {1}, 'of': {2}, 'cost': ({3})::bigint}}"
_FILE_COST = "ceil((strlen({0}) + 30) / 4.0)"


@query(
    f"""with s as (select l_orderkey as t, l_linenumber as pos, 's' || l_linenumber as id, 'f' || (min(l_suppkey) % 4) || '.go' as file, cast(10 + min(l_quantity) * 3 as bigint) as cost, (min(l_partkey) % 40) * 100 as bytes, 1 + min(l_partkey) % 5 as rk, 'g' || (min(l_partkey) % 3) || '.go' as other from lineitem group by l_orderkey, l_linenumber),
a as (select t, 20 + t % 100 as fixed, list({_ITEM.format("id", "file", "''", "cost")} order by pos) as sy, list({_ITEM.format("id", "''", "''", "ceil((bytes + 300) / 4.0)")} order by pos) as src, list({_ITEM.format("'r' || pos", "other", "id", "cost // 2")} order by rk, pos) as rel from s group by t),
b as (select *, {_sql_filled("sy", "fixed", "fixed + 350", True, True)} as sr from a),
c as (select *, list_reduce(list_filter(src, lambda x: list_contains(sr.out[1:3], x.id)), lambda acc, x: {{'used': acc.used + case when acc.used + x.cost <= 800 then x.cost when (800 - acc.used) * 4 - 300 >= 400 then 800 - acc.used else 0 end, 'out': case when acc.used + x.cost <= 800 or (800 - acc.used) * 4 - 300 >= 400 then list_append(acc.out, x.id) else acc.out end, 'closed': false, 'id': case when acc.used + x.cost > 800 and (800 - acc.used) * 4 - 300 >= 400 then acc.id || x.id || ':' || ((800 - acc.used) * 4 - 300) || ' ' else acc.id end, 'file': '', 'of': '', 'cost': 0::bigint}}, {{'used': sr.used, 'out': []::varchar[], 'closed': false, 'id': '', 'file': '', 'of': '', 'cost': 0::bigint}}) as tr,
  list_filter(rel, lambda x: list_contains(sr.out, x.of)) as near, list_reduce(list_transform(list_filter(sy, lambda x: list_contains(sr.out, x.id)), lambda x: [x.file]), lambda acc, x: case when list_contains(acc, x[1]) then acc else list_concat(acc, x) end, []::varchar[]) as fs from b),
d as (select *, {_sql_filled("near", "tr.used", f"1000 - list_sum(list_transform(fs, lambda f: {_FILE_COST.format('f')}))", False)} as rr from c),
e as (select *, list_concat(fs, list_sort(list_distinct(list_filter(list_transform(list_filter(near, lambda x: list_contains(rr.out, x.id)), lambda x: x.file), lambda f: not list_contains(fs, f))))) as al from d),
f as (select *, {_sql_filled("list_transform(al, lambda g: " + _ITEM.format("g", "''", "''", _FILE_COST.format("g")) + ")", "rr.used", "1000", True)} as fr from e)
select t, array_to_string(sr.out, ' ') as symbols, array_to_string(tr.out, ' ') as sources, trim(tr.id) as cut, array_to_string(rr.out, ' ') as related, array_to_string(fr.out, ' ') as files, fr.used as used from f"""
)
def task_capsule_sections(spark, d):
    """Each order as a task: what of its lines' rows, sources, neighbours and files fits a thousand tokens."""
    li = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("t"), F.col("l_linenumber").alias("pos")).agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity")])
    cost = (10 + F.col("l_quantity") * 3).cast("long")
    of = li.select("t", "pos", F.concat(F.lit("s"), "pos").alias("id"), F.concat(F.lit("f"), (F.col("l_suppkey") % 4).cast("string"), F.lit(".go")).alias("file"), cost.alias("cost"), (F.col("l_partkey") % 40 * 100).alias("bytes"), (1 + F.col("l_partkey") % 5).cast("int").alias("rk"), F.concat(F.lit("g"), (F.col("l_partkey") % 3).cast("string"), F.lit(".go")).alias("other"))
    relation = F.element_at(F.array(*map(F.lit, task.RELATIONS)), F.col("rk"))
    related = of.select("t", F.col("id").alias("of"), relation.alias("relation"), F.concat(F.lit("r"), "pos").alias("id"), F.col("other").alias("file"), F.floor(F.col("cost") / 2).alias("cost"))
    tasks = of.select("t").distinct().withColumn("fixed", 20 + F.col("t") % 100)
    got = task.assemble(tasks, of.select("t", "pos", "id", "file", "cost"), of.select("t", "id", "bytes"), related, "t", 1000)
    cut = F.array_join(F.zip_with("cut", "cut_bytes", lambda i, b: F.concat_ws(":", i, b)), " ")
    return got.select("t", *[F.array_join(c, " ").alias(c) for c in ("symbols", "sources", "related", "files")], cut.alias("cut"), "used")


def _sql_spans(n: int, mark: str, put: str, of: str) -> str:
    """CTE that takes the names between one kind of marks out of a text."""
    prose = "regexp_matches(x, '[ \\t]')"
    return rf"""p{n} as (select task, names, string_split_regex(regexp_replace(rest, '{mark}', '{put}', 'g'), '[\x{{E000}}\x{{E001}}]') as x from {of}),
s{n} as (select task, list_concat(names, list_filter(x, lambda x, i: i % 2 = 0 and not {prose})) as names, list_aggregate(list_transform(x, lambda x, i: case when i % 2 = 1 then x when {prose} then ' ' || x || ' ' else ' ' end), 'string_agg', '') as rest from p{n})"""


_EDGE = "[.,;:!?()\\[\\]{}<>\"''`]"
_STOP_SQL = "(" + ", ".join(f"'{w}'" for w in sorted(task.STOP)) + ")"
_ENDINGS = "|".join(task.PATH_ENDINGS)
_TASKS_SQL = "q as (select 'd' || doc_id as task, text from documents union all select 'p' || page_id, html from pages union all select 'c' || conv_id || '-' || turn, text || ' \"' || role || '.' || turn || '\" --' || role || '-turn src/' || role || '_turn.py `' || role || 'Turn' || turn || '`' from conversations)"


@query(
    rf"""with {_TASKS_SQL},
s0 as (select task, []::varchar[] as names, translate(coalesce(text, ''), chr(57344) || chr(57345), '  ') as rest from q),
{_sql_spans(1, "`([^`\\n]+)`", "\ue000\\1\ue001", "s0")},
{_sql_spans(2, '"([^"\\n]+)"', "\ue000\\1\ue001", "s1")},
{_sql_spans(3, "(^|[\\t\\n\\f\\r (\\[])''([^''\\t\\n\\f\\r ]+)''", "\\1\ue000\\2\ue001", "s2")},
l as (select task, list_concat(list_transform(names, lambda x: {{'raw': x, 'quoted': true}}), list_transform(list_filter(string_split_regex(rest, '[\s\x0b\x{{85}}\p{{Z}}]+'), lambda x: x <> ''), lambda x: {{'raw': x, 'quoted': false}})) as r from s3),
t as (select task, a as at_, r[a].quoted as quoted, regexp_replace(r[a].raw, '^{_EDGE}+|{_EDGE}+$', '', 'g') as token, suffix(regexp_replace(r[a].raw, '[.,;:!?]+$', ''), '()') as call from (select task, r, unnest(range(1, len(r) + 1)) as a from l)),
k as (select *, case when regexp_matches(token, '^--.') then 'flag' when contains(token, '/') or regexp_matches(token, '(?i)^[^.].*\.({_ENDINGS})$') then 'path' when regexp_matches(token, '^[A-Za-z_][A-Za-z0-9_]*(\.[A-Za-z_][A-Za-z0-9_]*)+$') then 'dotted' when regexp_matches(token, '^[A-Za-z0-9_]+$') then 'word' else 'runs' end as shape from t where token <> ''),
w as (select task, at_, 1 as run, token, quoted, call, shape from k where shape <> 'runs' union all select task, at_, run, x[run], false, false, 'word' from (select task, at_, x, unnest(range(1, len(x) + 1)) as run from (select task, at_, regexp_extract_all(token, '[A-Za-z0-9_]+') as x from k where shape = 'runs'))),
n as (select *, case when quoted then 'backticks/quotes ' else '' end as mark, case when shape = 'word' then case when contains(token, '_') and regexp_matches(token, '[^_]') then 'snake_case' when len(regexp_extract_all(token, '^[A-Z]')) + len(regexp_extract_all(token, '[a-z0-9][A-Z]')) + len(regexp_extract_all(token, '[A-Z][A-Z][a-z]')) >= 2 or regexp_matches(token, '[a-z][A-Z]') then 'camelCase' when call then 'call' when quoted then 'quoted' end end as rule,
  string_split(regexp_replace(translate(regexp_replace(token, '^-+', ''), '-', '_'), '=.*$', '', 's'), chr(0))[1] as flag,
  case when starts_with(token, '/') then '/' else '' end || list_aggregate(list_filter(string_split(token, '/'), lambda x: x not in ('', '.')), 'string_agg', '/') as path from w),
f as (select *, regexp_replace(regexp_extract(coalesce(path, ''), '[^/]*$'), '\.[^.]*$', '') as stem,
  string_split_regex(regexp_replace(regexp_replace(regexp_replace(token, '([a-z])([A-Z])', '\1 \2', 'g'), '([A-Z])([A-Z][a-z])', '\1 \2', 'g'), '([A-Za-z])([0-9])', '\1 \2', 'g'), '[ _]+') as parts from n),
e as (select task, at_, run, unnest(case shape
  when 'flag' then case when length(flag) >= 2 then [{{'k': 0, 'term': flag, 'kind': 'flag', 'origin': mark || 'flag', 'weight': 2.0, 'quoted': quoted}}] else [] end
  when 'path' then case when coalesce(path, '') = '' then [] else list_concat([{{'k': 0, 'term': path, 'kind': 'path', 'origin': mark || 'path', 'weight': 2.5, 'quoted': quoted}}], case when length(stem) >= 4 and regexp_matches(stem, '^[A-Za-z0-9_]+$') and lower(stem) not in {_STOP_SQL} then [{{'k': 1, 'term': stem, 'kind': 'word', 'origin': 'path stem', 'weight': 1.2, 'quoted': false}}] else [] end) end
  when 'dotted' then list_transform(string_split(token, '.'), lambda x, i: {{'k': i, 'term': x, 'kind': 'identifier', 'origin': mark || 'dotted', 'weight': (case when i = len(string_split(token, '.')) then 3.0 else 1.5 end + case when quoted then 0.5 else 0 end)::decimal(3, 1), 'quoted': quoted}})
  else case when rule is not null then list_concat([{{'k': 0, 'term': token, 'kind': 'identifier', 'origin': mark || rule, 'weight': case when quoted then 3.5 else 3.0 end, 'quoted': quoted}}], list_transform(list_filter(parts, lambda x: length(x) >= 3 and lower(x) not in {_STOP_SQL}), lambda x, i: {{'k': i, 'term': lower(x), 'kind': 'word', 'origin': 'split', 'weight': 0.8, 'quoted': false}}))
    when length(token) < 3 or lower(token) in {_STOP_SQL} or regexp_matches(token, '^[0-9]+$') then [] else [{{'k': 0, 'term': lower(token), 'kind': 'word', 'origin': 'prose', 'weight': 1.0, 'quoted': false}}] end end) as r from f),
o as (select task, r.*, row_number() over (partition by task order by at_, run, r.k) as at_, case when r.kind = 'path' then 'p:' || lower(r.term) else 'n:' || lower(replace(r.term, '_', '')) end as same from e),
g as (select task, same, arg_min(term, at_) as term, arg_min({{'kind': kind, 'origin': origin, 'weight': weight, 'quoted': quoted}}, -weight * 100000000 + at_) as r, min(at_) as at_ from o group by task, same),
h as (select task, term, r.kind as kind, r.origin as origin, r.weight::double as weight, r.quoted as quoted, row_number() over (partition by task order by r.weight desc, at_) as n, greatest(count(*) over (partition by task) - 12, 0) as dropped from g)
select * from h where n <= 12"""
)
def task_terms(spark, d):
    """The terms of whole documents, pages and marked-up turns, each taken as a task."""
    docs, pages, turns = (table(spark, d, x) for x in ("documents", "pages", "conversations"))
    role, turn = F.col("role"), F.col("turn").cast("string")
    said = F.concat("text", F.lit(' "'), role, F.lit("."), turn, F.lit('" --'), role, F.lit("-turn src/"), role, F.lit("_turn.py `"), role, F.lit("Turn"), turn, F.lit("`"))
    tasks = docs.select(F.concat(F.lit("d"), "doc_id").alias("task"), "text").unionByName(pages.select(F.concat(F.lit("p"), "page_id").alias("task"), F.col("html").alias("text")))
    tasks = tasks.unionByName(turns.select(F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("task"), said.alias("text")))
    return task.terms(tasks, "task", "text")


_JUDGED = """e as (select l_orderkey as task, l_partkey as part, l_suppkey as supp, l_linenumber as line, l_quantity::bigint as q, l_discount as disc, (l_partkey + l_suppkey) % 11 as x, (l_orderkey % 4) as mood from lineitem),
c as (select task, 'n' || (part % 5) as name, 'q' || part || '.' || line as qualified, x % 3 = 0 as member, line, part,
  (case when mood = 3 then 0.3 else (q % 10) * 0.4 end)::double as raw, ((case when mood = 3 then 0.3 else (q % 10) * 0.4 end) * (case when x % 4 = 1 then 0.5 else 1 end))::double as score,
  list_filter(['alpha', 'beta', 'gamma'], lambda t, i: (q + i) % 3 <> 0 and (mood <> 3 or i = 1)) as matched, list_filter(['alpha', 'beta', 'gamma'], lambda t, i: (q + i) % 3 = 1 and mood <> 3 and x % 2 = 0) as named,
  mood = 0 and x = 2 as strong_exact, mood = 0 and x = 5 as strong_prefix, mood <> 0 and x < 5 as exact_word, x <> 7 as match_ev, mood = 1 and x in (7, 8) as in_file, x % 4 = 1 as demoted from e)"""


@query(
    rf"""with {_JUDGED}, r as (select *, row_number() over (partition by task order by score desc, part, line) as pos, first(name) over (partition by task order by score desc, part, line) as top_name, first(member) over (partition by task order by score desc, part, line) as top_member from c),
t as (select o_orderkey as task, unnest(['alpha', 'beta', 'gamma'][1:1 + o_orderkey % 3]) as term from orders where o_orderkey % 13 <> 0),
m as (select task, term, count(r.pos) as matches from t left join (select task as task_, pos, unnest(matched) as term_ from r) r on task_ = task and term_ = term group by task, term),
w as (select task, count(*) as n, sum(case term when 'alpha' then 1.0 when 'beta' then 3.0 else 0.8 end)::double as total, coalesce(string_agg(term, ', ' order by term) filter (matches = 0), '') as missing from m group by task),
a as (select task, count(*) as cnt, arg_min(r, pos) as top, max(score) filter (pos = 2) as nxt, arg_min(r, pos) filter (pos > 1 and strong_exact) as rx, arg_min(r, pos) filter (strong_exact or strong_prefix) as strong, arg_min(r, pos) filter (in_file) as filed, arg_min(r, pos) filter (exact_word) as worded,
  arg_min(r, {{'r': -raw, 'p': pos}}) as best, arg_min(r, {{'d': demoted, 'n': -len(named), 'r': -raw, 'p': pos}}) filter (len(named) >= 1 and len(matched) >= 2) as comp, arg_min(r, pos) filter (pos > 1 and not (not top_member and member and name = top_name)) as rival from r group by task),
j as (select o_orderkey as task, a.*, w.n, w.total, w.missing, best.raw / total as cover, top.strong_exact and (rx is null or top.score >= 1.5 * rx.score) as clear from orders left join a on a.task = o_orderkey left join w on w.task = o_orderkey)
select task, case when cnt is null then 'low' when clear and (cnt = 1 or top.score >= 1.25 * nxt) then 'high' when strong is not null or filed is not null then 'medium' when n is null or total = 0 then 'low' when n = 1 and worded is not null then 'medium' when n = 1 then 'low' when comp is null and cover < 0.5 then 'low'
    when len(top.matched) = n and top.exact_word and top.raw / total >= 0.6 and top.score >= 1.25 * coalesce(rival.score, 0) then 'high' else 'medium' end as confidence,
  case when cnt is null then 'no symbol name matches any term of the task' when clear and cnt = 1 then top.qualified || ' matches a name in the task exactly and nothing else scored' when clear and top.score >= 1.25 * nxt then printf('%s matches a name in the task exactly and scores %.1f against %.1f for the next candidate', top.qualified, top.score, nxt)
    when strong.strong_exact then printf('%s matches a name in the task exactly but is not clearly ahead of the other candidates (%.1f against %.1f)', strong.qualified, strong.score, top.score) when strong is not null then strong.qualified || ' starts with a name in the task; no symbol is named exactly that'
    when filed.match_ev then filed.qualified || ' is in a file the task names and matches a term of it, but not as a name' when filed is not null then 'the task names a file; its symbols are listed, but nothing in the task names a symbol'
    when n is null or total = 0 then 'the task has no term to search for' when n = 1 and worded is not null then worded.qualified || ' is named exactly like the one word of the task; a single word is weak evidence on its own' when n = 1 then 'only single loose token matches (best: ' || best.qualified || ', from one term)'
    when comp is null and cover < 0.5 then 'no symbol matches two of the task''s ' || n || ' terms with one of them in its name, and the best symbol (' || best.qualified || ') accounts for ' || round_even(cover * 100, 0)::bigint || '% of their weight' || case when missing <> '' then '; ' || missing || ' matches no symbol' else '' end
    when len(top.matched) = n and top.exact_word and top.raw / total >= 0.6 and top.score >= 1.25 * coalesce(rival.score, 0) then printf('%s matches all %d terms of the task, one of them exactly, and scores %.1f against %.1f for the next candidate', top.qualified, n, top.score, coalesce(rival.score, 0))
    when comp is not null then comp.qualified || ' matches ' || len(comp.matched) || ' of the task''s ' || n || ' terms (' || array_to_string(list_sort(comp.matched), ', ') || '), ' || len(comp.named) || ' of them in its name, not decisively enough to be the answer' || case when missing <> '' then '; ' || missing || ' matches no symbol, so that part may not exist yet' else '' end
    else best.qualified || ' accounts for ' || round_even(cover * 100, 0)::bigint || '% of the task''s terms (' || len(best.matched) || ' of ' || n || ' matched), not decisively enough to be the answer' || case when missing <> '' then '; ' || missing || ' matches no symbol, so that part may not exist yet' else '' end end as reason from j"""
)
def task_confidence(spark, d):
    """Orders as tasks, their lines as candidates with evidence of all kinds: every rule decides some of them."""
    e = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task"), F.col("l_partkey").alias("part"), F.col("l_linenumber").alias("line"), F.col("l_quantity").cast("long").alias("q"), ((F.col("l_partkey") + F.col("l_suppkey")) % 11).alias("x"), (F.col("l_orderkey") % 4).alias("mood"))
    x, mood, q = F.col("x"), F.col("mood"), F.col("q")
    raw = F.when(mood == 3, F.lit("0.3").cast("decimal(4,2)")).otherwise((q % 10) * F.lit("0.4").cast("decimal(4,2)"))
    told = F.array(*map(F.lit, ("alpha", "beta", "gamma")))
    rows = e.select(
        "task", "part", "line", F.concat(F.lit("n"), F.col("part") % 5).alias("name"), F.concat(F.lit("q"), "part", F.lit("."), "line").alias("qualified"), (x % 3 == 0).alias("member"),
        raw.cast("double").alias("raw"), (raw * F.when(x % 4 == 1, F.lit("0.5").cast("decimal(2,1)")).otherwise(F.lit("1.0").cast("decimal(2,1)"))).cast("double").alias("score"),
        F.filter(told, lambda w, i: ((q + i + 1) % 3 != 0) & ((mood != 3) | (i == 0))).alias("matched"), F.filter(told, lambda w, i: ((q + i + 1) % 3 == 1) & (mood != 3) & (x % 2 == 0)).alias("named"),
        ((mood == 0) & (x == 2)).alias("strong_exact"), ((mood == 0) & (x == 5)).alias("strong_prefix"), ((mood != 0) & (x < 5)).alias("exact_word"), (x != 7).alias("match_ev"), ((mood == 1) & x.isin(7, 8)).alias("in_file"), (x % 4 == 1).alias("demoted"),
    )
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("task").orderBy(F.col("score").desc(), "part", "line")))
    tasks = table(spark, d, "orders").select(F.col("o_orderkey").alias("task"))
    terms = tasks.where("task % 13 <> 0").select("task", F.posexplode(F.slice(told, F.lit(1), (F.col("task") % 3 + 1).cast("int"))).alias("n", "term"))
    terms = terms.withColumns({"kind": F.lit("word"), "weight": F.when(F.col("term") == "alpha", 1.0).when(F.col("term") == "beta", 3.0).otherwise(0.8)})
    return task.judge(rows, task.with_matches(terms, rows, "task"), "task", tasks)


@query("select o_orderkey, least(n, case when o_orderkey % 3 = 0 then 2 when o_orderkey % 3 = 1 then n else 1 + o_orderkey % 4 end) as shown from (select l_orderkey as o_orderkey, count(*) as n from lineitem group by l_orderkey)")
def limits(spark, d):
    """Lines shown of each order: nothing asked for is the default of two, zero is no limit, else what is asked for."""
    asked = F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).when(F.col("o_orderkey") % 3 == 1, F.lit(0)).otherwise(1 + F.col("o_orderkey") % 4)
    own = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey")
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    n = graph.shares(lines)  # both sides are dealt alike, once, and an order stays in its share
    orders = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), asked.alias("a"))
    lines = lines.repartition(n, "l_orderkey").join(orders.repartition(n, "l_orderkey"), "l_orderkey")
    most = budget.limit_of(F.col("a"), 2)
    shown = lines.withColumn("k", F.row_number().over(own)).where((most == 0) | (F.col("k") <= most))
    return shown.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count(F.lit(1)).alias("shown"))


@query("with r as (select doc_id, sum(cast(ceil(strlen(text) / 4.0) as bigint)) over (order by n_chars, doc_id) as spent from documents) select doc_id, cast(spent as bigint) as spent from r where spent <= 350")
def task_capsule(spark, d):
    """The shortest documents that fit into a share of a token budget."""
    docs = table(spark, d, "documents").where("n_chars is not null").select("doc_id", "n_chars", "text")
    return task.capsule(docs, "text", [F.col("n_chars"), F.col("doc_id")], 1000).select("doc_id", F.col("spent").cast("long").alias("spent"))


@query(rf"with {LINES}, t as (select doc_id, line from lines where contains(text, 'idiot')), s as (select doc_id from labels where toxic = 1) select t.doc_id, t.line from t where not exists (select 1 from s where s.doc_id = t.doc_id and t.line = 1)")
def text_only_hits(spark, d):
    """Text matches at places that no reference covers (the first line of labelled documents stands for these)."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    hits = grep.search_text(docs, "doc_id", "text", "idiot", case=True).select("doc_id", F.col("line").cast("long").alias("line"))
    semantic = table(spark, d, "labels").where("toxic = 1").select("doc_id", F.lit(1).cast("long").alias("line"))
    return verdicts.text_only(hits, semantic, ["doc_id", "line"])


@query("""with e as (select user_id as server, event_id % 3 as token, event_id, case event_type when 'view' then 'begin' when 'click' then 'report' when 'error' then 'create' else 'end' end as kind from events), l as (select server, token, arg_max(kind, event_id) as last from e where kind <> 'report' group by server, token)
select server, count(*) as tokens, bool_and(last = 'end') as drained from l group by server""")
def progress_drain(spark, d):
    """Per server, whether every token's last word is an end."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type") == "click", "report").when(F.col("event_type") == "error", "create").otherwise("end")
    return gates.drained(e.select(F.col("user_id").alias("server"), (F.col("event_id") % 3).alias("token"), F.col("event_id").alias("at"), kind.alias("kind")), "server", "token", "at", "kind")


@query("""with p as (select user_id % 5 as server, event_type as uri, epoch_us(ts) // 1000 as ms from events where event_type <> 'error' or user_id % 5 = 0), o as (select distinct user_id % 5 as server, event_type as uri from events), l as (select server, uri, max(ms) as ms from p group by server, uri),
n as (select max(ms) as m from p) select o.server, count(*) filter (l.ms is null) as missing, coalesce((select m from n) + 1000000 - max(l.ms) >= 2000000, false) as quiet from o left join l on l.server = o.server and l.uri = o.uri group by o.server""")
def diagnostics_settled(spark, d):
    """Per server: files that nothing was said of, and whether it has been quiet."""
    e = table(spark, d, "events").select((F.col("user_id") % 5).alias("server"), F.col("event_type").alias("uri"), F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"))
    said = e.where("uri <> 'error' or server = 0")
    now = said.agg(F.max("at_ms")).first()[0] + 1_000_000
    return gates.diagnostics_settled(said, e.select("server", "uri").distinct(), now, 2_000_000).select("server", "missing", "quiet")


_GATE = {"settle": 36_000_000, "grace": 21_600_000, "timeout": 2_592_000_000}


@query(f"""with e as (select user_id, event_id, epoch_us(ts) // 1000 as ms, case event_type when 'view' then 'result' when 'error' then 'error' when 'click' then 'begin' when 'signup' then 'report' else 'end' end as kind, 't' || (event_id % 2) as token, case when event_id % 3 = 0 then '[]' else 'r' || (event_id % 2) end as result from events),
s as (select *, last_value(case when kind = 'begin' then 1 when kind = 'end' then 0 end ignore nulls) over (partition by user_id, token order by ms, event_id) as on_ from e),
s2 as (select *, coalesce(lag(on_) over (partition by user_id, token order by ms, event_id), 0) as was from s),
s3 as (select *, sum(case when kind in ('begin', 'report', 'end') then coalesce(on_, 0) - was else 0 end) over w as active, max(case when kind in ('begin', 'report', 'end') then 1 else 0 end) over w = 1 as seen, max(case when kind in ('begin', 'report', 'end') then ms end) over w as moved, min(ms) over w as first,
  last_value(case kind when 'result' then result when 'error' then '!' end ignore nulls) over w as mark, coalesce(lead(ms) over (partition by user_id order by ms, event_id), 4611686018427387904) as next from s2 window w as (partition by user_id order by ms, event_id rows unbounded preceding)),
s4 as (select *, case when kind = 'error' or (kind = 'result' and mark is distinct from lag(mark) over (partition by user_id order by ms, event_id)) then ms end as fresh from s3),
s5 as (select *, coalesce(max(fresh) over (partition by user_id order by ms, event_id rows unbounded preceding), first) + 36000000 as stable, coalesce(mark <> '!', false) as known, coalesce(mark not in ('[]', '!'), false) as filled, coalesce(mark <> '!', false) and seen and active = 0 as drained from s4),
c as (select user_id, next, mark, case when active > 0 or mark = '!' then 'indexing' when known and not filled then 'empty' else 'unstable' end as why, unnest([{{'ms': case when drained and filled then ms end, 'k': 0, 'rule': 'R1'}}, {{'ms': case when drained then greatest(ms, stable) end, 'k': 1, 'rule': 'R2'}}, {{'ms': case when known and not seen then greatest(ms, stable, first + 21600000) end, 'k': 2, 'rule': 'R3'}}, {{'ms': case when seen and filled then greatest(ms, stable, moved + 36000000) end, 'k': 3, 'rule': 'R4'}}, {{'ms': greatest(ms, first + 2592000000), 'k': 4, 'rule': 'not_ready'}}]) as x from s5),
r as (select user_id, x.ms as ms, x.rule as rule, mark, why, row_number() over (partition by user_id order by x.ms, x.k) as n from c where x.ms <= next)
select user_id, rule, ms as at_ms, case when rule <> 'not_ready' then mark end as result, case when rule = 'not_ready' then why end as reason from r where n = 1""")
def gate_rules(spark, d):
    """When each user's log becomes final, and by which rule."""
    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "view", "result").when(F.col("event_type") == "error", "error").when(F.col("event_type") == "click", "begin").when(F.col("event_type") == "signup", "report").otherwise("end")
    log = e.select("user_id", "event_id", F.unix_millis(F.col("ts").cast("timestamp")).alias("at_ms"), kind.alias("kind"), F.concat(F.lit("t"), (F.col("event_id") % 2).cast("string")).alias("token"), F.when(F.col("event_id") % 3 == 0, "[]").otherwise(F.concat(F.lit("r"), (F.col("event_id") % 2).cast("string"))).alias("result"))
    return gates.gate_rules(log, "user_id", ["event_id"], **_GATE).select("user_id", "rule", "at_ms", "result", "reason")
