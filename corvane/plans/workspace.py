"""Queries over workspaces that the given tables spell out: source files, symbols, references, hunks, logs, edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvane.functions import text as t
from corvane.operators import diffs, graph, history, imports, intervals, outline, paths, search, snapshot, verdicts
from corvane.plans.queries import ORACLE_SQL, QUERIES, query, scratch, sql_round, table
from corvane.sources import readers, sinks

__all__ = ["ORACLE_SQL", "QUERIES"]

# ---- source files: one for each part, in six languages, with decoys in comments and strings

_FILES = """files as (select p_partkey as k, cast(p_size % 10 as int) as d, cast(p_partkey % 6 as int) as g, 'pkg' || (p_size % 10) || '/f' || p_partkey || ['.go', '.py', '.js', '.rs', '.c', '.lua'][1 + p_partkey % 6] as path,
  ['go', 'python', 'javascript', 'rust', 'c', 'lua'][1 + p_partkey % 6] as language from part)"""
_IMPORTS = (
    _FILES
    + """, rows as (
  select k, d, g, path, language, 'fmt' as spec, 'import' as kind, '' as names, 5 as line from files where g = 0
  union all select k, d, g, path, language, 'example.com/app/pkg' || d, 'import', 'x', 6 from files where g = 0
  union all select k, d, g, path, language, 'os', 'import', '', 2 from files where g = 1
  union all select k, d, g, path, language, 'sys', 'import', '', 2 from files where g = 1
  union all select k, d, g, path, language, '.f' || (k + 6), 'import', 'a,b', 3 from files where g = 1
  union all select k, d, g, path, language, './f' || (k + 6), 'import', 'a,b', 2 from files where g = 2
  union all select k, d, g, path, language, './lib', 'reexport', '', 3 from files where g = 2
  union all select k, d, g, path, language, 'fs', 'require', '', 4 from files where g = 2
  union all select k, d, g, path, language, 'std::fs', 'use', '', 2 from files where g = 3
  union all select k, d, g, path, language, 'std::io::Read', 'use', '', 2 from files where g = 3
  union all select k, d, g, path, language, 'f' || (k + 6), 'mod', '', 3 from files where g = 3
  union all select k, d, g, path, language, 'serde', 'extern', '', 4 from files where g = 3
  union all select k, d, g, path, language, 'stdio.h', 'system', '', 2 from files where g = 4
  union all select k, d, g, path, language, 'f' || (k + 6) || '.c', 'include', '', 3 from files where g = 4
  union all select k, d, g, path, language, 'pkg' || d || '.f' || (k + 6), 'require', '', 2 from files where g = 5)"""
)
_RESOLVED = (
    _IMPORTS
    + """, resolved as (select r.*, case
  when r.g = 0 and r.line = 6 then 'pkg' || r.d when r.g in (1, 2, 5) and n.d = r.d and r.spec like '%f' || (r.k + 6) then n.path when r.g = 4 and r.line = 3 then n.path end as target
  from rows r left join files n on n.k = r.k + 6)"""
)


def source_files(spark, d: str) -> DataFrame:
    """path, language, content."""
    p = table(spark, d, "part").select("p_partkey", (F.col("p_size") % 10).alias("d"), (F.col("p_partkey") % 6).cast("int").alias("g"))
    nxt = (F.col("p_partkey") + 6).cast("string")
    pick = lambda *x: F.element_at(F.array(*x), F.col("g") + 1)
    cat = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v for v in x])
    content = pick(
        cat('package p\n\n// import "decoy"\nimport (\n\t"fmt"\n\tx "example.com/app/pkg', F.col("d").cast("string"), '"\n)\nvar s = `import "no"`\n'),
        cat("# import decoy\nimport os, sys as s\nfrom .f", nxt, ' import a, b as c\nx = "import no"\n'),
        cat("// import decoy\nimport a, { b as c } from './f", nxt, "';\nexport * from \"./lib\";\nconst q = require('fs');\nconst u = \"import x from 'no'\";\n"),
        cat("// use decoy;\nuse std::{fs, io::Read};\nmod f", nxt, ";\nextern crate serde;\n"),
        cat('/* #include "decoy.h" */\n#include <stdio.h>\n#include "f', nxt, '.c"\n'),
        cat("-- require 'decoy'\nlocal m = require('pkg", F.col("d").cast("string"), ".f", nxt, "')\n"),
    )
    ending = pick(*[F.lit(x) for x in (".go", ".py", ".js", ".rs", ".c", ".lua")])
    language = pick(*[F.lit(x) for x in ("go", "python", "javascript", "rust", "c", "lua")])
    return p.select(cat("pkg", F.col("d").cast("string"), "/f", F.col("p_partkey").cast("string"), ending).alias("path"), language.alias("language"), content.alias("content"))


def resolved_imports(spark, d: str, path: str | None = None) -> DataFrame:
    """Imports of all files, or of one, against all files."""
    files = source_files(spark, d)
    asked = files if path is None else files.where(F.col("path") == path)
    modules = imports.go_modules(spark.createDataFrame([("go.mod", "module example.com/app // the root\n\ngo 1.22\n")], "path string, content string"))
    return imports.resolve(imports.extract(asked), files.select("path"), modules)


@query(f"with {_IMPORTS} select path, language, spec, kind, names, line from rows")
def imports_extract(spark, d):
    """Imports of six languages; what stands in comments and strings is none."""
    return imports.extract(source_files(spark, d)).select("path", "language", "spec", "kind", F.array_join("names", ",").alias("names"), "line")


_CATEGORY = """case when target is not null then 'workspace' when kind = 'system' then 'system' when g = 0 then 'stdlib' when g = 1 and line = 2 then 'stdlib' when g = 2 and kind = 'require' then 'stdlib' when g = 3 and kind = 'use' then 'stdlib'
  when g = 3 and kind = 'extern' then 'third-party' when g = 5 then 'third-party' else 'unresolved' end"""


@query(f"with {_RESOLVED} select path, spec, line, target, {_CATEGORY} as category, case when {_CATEGORY} in ('stdlib', 'third-party', 'system') then spec end as external from resolved")
def imports_resolve(spark, d):
    return resolved_imports(spark, d).select("path", "spec", "line", "target", "category", "external")


_EDGES = f"{_RESOLVED}, edges as (select case when g = 0 then 'pkg' || d else path end as src, target as dst, min(spec) as spec from resolved where target is not null group by 1, 2)"


@query(f"with {_EDGES} select src, dst, spec from edges")
def import_graph(spark, d):
    """Edges between files (for Go, packages), one for each pair with the least spec."""
    return imports.package_edges(resolved_imports(spark, d))


@query(f"with {_RESOLVED} select cast(line as int) as line, spec, kind, target, {_CATEGORY} as category, case when {_CATEGORY} in ('stdlib', 'third-party', 'system') then spec end as external from resolved where k = 7")
def imports_of_file(spark, d):
    """One file's imports in order, with where each belongs."""
    files = source_files(spark, d)
    found = files.where(F.col("path").rlike("/f7[.]")).select("path").first()
    path = found["path"] if found else ""
    return imports.imports_of(resolved_imports(spark, d, path), path)


@query(f"""with {_EDGES}, q as (select k, path as name, case when g = 0 then 'pkg' || d else path end as node from files where k <= 60 union all select k, './pkg' || d || '/', case when exists (select 1 from files f where f.g = 0 and f.d = files.d) then 'pkg' || d end from files where k <= 60
  union all select k, 'example.com/app/pkg' || d, case when exists (select 1 from files f where f.g = 0 and f.d = files.d) then 'pkg' || d end from files where k <= 60) select distinct name, node from q""")
def node_lookup(spark, d):
    """Files, directories and Go import paths to nodes of the graph."""
    files = source_files(spark, d)
    here = F.substring_index("path", "/", 1)
    of = files.select("path", F.when(F.col("language") == "go", here).otherwise(F.col("path")).alias("node"))
    dirs = files.where("language = 'go'").select(here.alias("id")).distinct()
    packages = dirs.select(F.concat(F.lit("example.com/app/"), "id").alias("spec"), F.col("id").alias("node"))
    some = files.where(F.regexp_extract("path", r"/f(\d+)\.", 1).cast("int") <= 60)
    asked = some.select(F.explode(F.array("path", F.concat(F.lit("./"), here, F.lit("/")), F.concat(F.lit("example.com/app/"), here))).alias("name")).distinct()
    return graph.node_lookup(asked, of, dirs, packages)


@query(f"with {_RESOLVED}, e as (select distinct path, target, line from resolved where target is not null) select 'dir' as target, path, cast(line as int) as line from e where target like 'pkg3/%' or target = 'pkg3' order by path, line")
def find_importers(spark, d):
    """Who imports the files of a directory, or its package."""
    rows = resolved_imports(spark, d).where("target is not null").select(F.col("path").alias("src"), F.col("target").alias("dst"), "line")
    targets = rows.where(paths.in_scope(F.col("dst"), "pkg3")).select(F.lit("dir").alias("target"), "dst").distinct()
    return graph.find_importers(rows, targets)


@query(f"""with {_RESOLVED}, e as (select distinct path, d, k, target from resolved where target is not null), tests as (select *, 'pkg' || d as package from e where k % 4 = 0), prod as (select *, 'pkg' || d as package from e where k % 4 <> 0)
select path from tests t where target = 'pkg3' and package <> 'pkg3' and not exists (select 1 from prod p where p.target = t.target and p.package = t.package)""")
def test_only_importers(spark, d):
    """Every fourth file as a test: tests that import a package which nothing else of their package imports."""
    e = resolved_imports(spark, d).where("target is not null").select("path", F.col("target").alias("dst"), F.substring_index("path", "/", 1).alias("package"), (F.regexp_extract("path", r"/f(\d+)\.", 1).cast("int") % 4 == 0).alias("test")).distinct()
    return graph.test_only_importers(e.where("test"), e.where("not test"), "pkg3", "package", "pkg3").select("path")


@query("select p_partkey, case when p_partkey % 3 = 0 then 'lib/m' || (p_size % 5) when p_partkey % 3 = 1 then 'app' else 'vendor/x' end as dir from part where p_partkey % 3 < 2")
def go_module_replace(spark, d):
    """Modules of a go.work, one of them replaced by a local directory: the directory that each import's module has."""
    mods = [("app/go.mod", "module example.com/app\n\nrequire example.com/m v1.0.0\n\nreplace (\n\texample.com/none => example.org/none v1.2.3\n)\n"), ("out/go.mod", "module example.com/out\n")]
    mods += [(f"lib/m{k}/go.mod", f"module example.com/m{k}\n") for k in range(5)]
    files = spark.createDataFrame(mods + [("app/sub/go.mod", "module example.com/sub\nreplace example.com/repl => ../../vendor/x\n")], "path string, content string")
    work = spark.createDataFrame([("go.work", "go 1.22\n\nuse (\n\t./app\n" + "".join(f"\t./lib/m{k}\n" for k in range(5)) + ")\n")], "path string, content string")
    known = imports.go_modules(files, work)
    p = table(spark, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 3 == 0, F.concat(F.lit("example.com/m"), (F.col("p_size") % 5).cast("string"))).when(F.col("p_partkey") % 3 == 1, "example.com/app").otherwise("example.com/out").alias("module"))
    return p.join(F.broadcast(known), "module").select("p_partkey", "dir")


# ---- symbols: orders as ninety-day spans of their customer's file; lines as references


_DAY = "date_diff('day', timestamp '1995-01-01', {})"
_SYMBOLS = f"symbols as (select o_orderkey as id, o_custkey as path, {_DAY.format('o_orderdate')} as line, {_DAY.format('o_orderdate')} + 90 as end_line, o_orderstatus as s, o_orderpriority as p from orders)"
_REFS = f"refs as (select o_orderkey as id, o_custkey + (l_linenumber % 2) as path, {_DAY.format('l_shipdate')} as line from lineitem join orders on o_orderkey = l_orderkey where l_linenumber > 2)"


def _day(c: str) -> Column:
    return F.datediff(F.col(c), F.lit("1995-01-01"))


def _symbols(spark, d: str) -> DataFrame:
    o = table(spark, d, "orders")
    return o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("path"), _day("o_orderdate").alias("line"), (_day("o_orderdate") + 90).alias("end_line"), F.col("o_orderstatus").alias("s"), F.col("o_orderpriority").alias("p"))


def _references(spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_linenumber > 2").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_orderkey").alias("id"), (F.col("o_custkey") + F.col("l_linenumber") % 2).alias("path"), _day("l_shipdate").alias("line"))


@query(f"with {_SYMBOLS}, {_REFS} select id, path, cast(line as int) as line from symbols s where not exists (select 1 from refs r where r.id = s.id and not (r.path = s.path and r.line between s.line and s.end_line))")
def unreferenced_symbols(spark, d):
    """Symbols without use from outside their own lines."""
    return verdicts.unreferenced(_symbols(spark, d), _references(spark, d)).select("id", "path", "line")


_HELD = f"""{_SYMBOLS}, {_REFS}, held as (select r.path, r.line, r.id as of, s.id, row_number() over (partition by r.path, r.line, r.id, r.n order by s.end_line - s.line, s.id desc) as k
  from (select path, line, id, row_number() over () as n from refs) r left join symbols s on s.path = r.path and r.line between s.line and s.end_line)"""


@query(f"with {_HELD} select path, coalesce(id, -1) as id, count(*) as count, cast(min(line) as int) as line from held where k = 1 group by path, id")
def references_by_symbol(spark, d):
    """References grouped by the innermost symbol that holds them."""
    places = _references(spark, d).groupBy("path", F.col("line").alias("at")).agg(F.count(F.lit(1)).alias("n"))
    spans = _symbols(spark, d).select("path", F.col("id").alias("inner_id"), "line", "end_line")
    held = intervals.innermost(places, spans, "path", "at", "line", "end_line", ["path", "at"], "inner_id")
    each = held.withColumn("_n", F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))).select("path", F.col("inner_id").alias("id"), F.col("at").alias("line"))
    return verdicts.by_enclosing(each, "path", "id", "line").withColumn("id", F.coalesce("id", F.lit(-1)))


_DEAD = f"""{_SYMBOLS}, {_REFS}, c as (select *, row_number() over (order by path, line, id) as k from (select *, id % 7 = 0 as test, id % 11 = 0 as local, id % 5 = 0 as exported from symbols) where not test and id % 13 <> 0 and not local and not exported)"""


@query(f"""with {_DEAD} select cast(path as varchar) || case when id % 3 = 0 then '_linux.go' else '.go' end as path, cast(line as int) as line, id, 'fn' || id as name, 'function' as kind, case when id % 3 = 0 then 'low' else 'high' end as confidence
from c where k <= 400 and not exists (select 1 from refs r where r.id = c.id and not (r.path = c.path and r.line between c.line and c.end_line)) order by cast(path as bigint), line, id limit 50""")
def dead_code_page(spark, d):
    """The first page of a sweep: exclusions, a budget of candidates in order, uses, how sure."""
    s = _symbols(spark, d).withColumns({"number": F.col("path"), "language": F.lit("go"), "kind": F.lit("function")})
    path = F.concat(F.col("number").cast("string"), F.when(F.col("id") % 7 == 0, "_test.go").when(F.col("id") % 3 == 0, "_linux.go").otherwise(".go"))
    name = F.when(F.col("id") % 13 == 0, "main").otherwise(F.concat(F.lit("fn"), F.col("id").cast("string")))
    s = s.withColumns({"path": path, "name": name, "local": F.col("id") % 11 == 0, "exported": F.when(F.col("id") % 5 == 0, "yes").otherwise("no"), "can_implement": F.lit(True), "implements": F.lit(False)})
    s = s.withColumn("sensitive", verdicts.build_sensitive(F.col("path"), F.lit("package p\n")))
    key = F.concat(F.col("path").cast("string"), F.lit(".go"))
    own = s.select("id", F.col("path").alias("own"), "number")
    refs = _references(spark, d).join(own, "id").select("id", F.when(F.col("path") == F.col("number"), F.col("own")).otherwise(key).alias("path"), "line")
    # files sort as numbers do, and the names that a number's symbols give its file don't count
    return verdicts.dead_code(s, refs, budget=400, order=("number", "line", "id"))


_SWEPT = """s as (select l_orderkey * 10 + l_linenumber as id, case when l_linenumber > 1 then l_orderkey * 10 + l_linenumber - 1 - (l_suppkey % least(2, l_linenumber - 1)) end as parent, ['struct', 'method', 'variable', 'function', 'enum'][1 + l_partkey % 5] as kind,
  case when l_suppkey % 7 = 0 then 'main' when l_suppkey % 7 = 1 then 'String' else 'run' || l_partkey end as name, 'p' || (l_suppkey % 50) || case when l_suppkey % 11 = 0 then '_test.go' when l_suppkey % 3 = 0 then '_linux.go' else '.go' end as path, l_quantity > 30 as exported from (select distinct l_orderkey, l_linenumber, min(l_suppkey) as l_suppkey, min(l_partkey) as l_partkey, min(l_quantity) as l_quantity from lineitem group by all))"""


def _swept(spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(*[F.min(c).alias(c) for c in ("l_suppkey", "l_partkey", "l_quantity")])
    line, supp, key = F.col("l_linenumber"), F.col("l_suppkey"), F.col("l_orderkey") * 10 + F.col("l_linenumber")
    kind = F.element_at(F.array(*map(F.lit, ("struct", "method", "variable", "function", "enum"))), (F.col("l_partkey") % 5 + 1).cast("int"))
    name = F.when(supp % 7 == 0, "main").when(supp % 7 == 1, "String").otherwise(F.concat(F.lit("run"), "l_partkey"))
    path = F.concat(F.lit("p"), (supp % 50).cast("string"), F.when(supp % 11 == 0, "_test.go").when(supp % 3 == 0, "_linux.go").otherwise(".go"))
    return li.select(key.alias("id"), F.when(line > 1, key - 1 - supp % F.least(F.lit(2), line - 1)).alias("parent"), kind.alias("kind"), name.alias("name"), path.alias("path"), F.lit("go").alias("language"), F.when(F.col("l_quantity") > 30, "yes").otherwise("no").alias("exported"))


@query(
    f"""with recursive {_SWEPT}, up as (select id, parent, false as local from s union all select up.id, s.parent, s.kind in ('function', 'method') from up join s on s.id = up.parent where not local),
l as (select id, bool_or(local) as local from up group by id)
select case when path like '%\\_test.go' escape '\\' then 'test_file' when name = 'main' then 'entry_point' when name = 'String' and kind = 'method' then 'ignored' when local then 'local' when exported then 'exported' end as reason, count(*) as n from s join l using (id) group by reason"""
)
def dead_code_reasons(spark, d):
    """Lines of orders as nested symbols: which of them a sweep leaves out and why; locals by their ancestors."""
    return verdicts.excluded_counts(verdicts.with_local(_swept(spark, d)))


_BLAST = f"""with {_SYMBOLS}, refs as (select o_orderkey % 40 as id, o_custkey + (l_linenumber % 2) as path, {_DAY.format('l_shipdate')} as line from lineitem join orders on o_orderkey = l_orderkey where l_linenumber > 2),
spots as (select path, line, count(*) as n from refs where id = 7 group by path, line),
held as (select a.path, a.line, a.n, s.id, row_number() over (partition by a.path, a.line order by s.end_line - s.line, s.id desc) as k from spots a left join symbols s on s.path = a.path and a.line between s.line and s.end_line),
calls as (select distinct o_orderkey as src, cast(o_orderkey % 40 as bigint) as dst from orders where o_orderkey % 40 <> o_orderkey and o_orderkey < 400), c1 as (select src from calls where dst = 7 and src <> 7), c2 as (select distinct c.src from calls c join c1 on c1.src = c.dst where c.src <> 7 and c.src not in (select src from c1)),
files as (select distinct o_custkey as src, o_custkey % 25 as dst from orders where o_custkey % 25 <> o_custkey)
select 'reference' as evidence, path, coalesce(id, -1) as id, cast(sum(n) as bigint) as count, cast(min(line) as int) as line, 1 as depth from held where k = 1 group by path, id
union all select 'caller', s.path, c.src, 1, cast(s.line as int), c.d from (select src, 1 as d from c1 union all select src, 2 from c2) c left join symbols s on s.id = c.src
union all select 'importer', src, -1, 1, -1, 1 from files where dst = 3"""


def _blast(spark, d: str) -> DataFrame:
    refs = _references(spark, d).withColumn("id", F.col("id") % 40)
    o = table(spark, d, "orders")
    calls = o.where("o_orderkey % 40 <> o_orderkey and o_orderkey < 400").select(F.col("o_orderkey").alias("src"), (F.col("o_orderkey") % 40).alias("dst")).distinct()
    files = o.where("o_custkey % 25 <> o_custkey").select(F.col("o_custkey").alias("src"), (F.col("o_custkey") % 25).alias("dst")).distinct()
    return verdicts.blast_radius(refs, _symbols(spark, d), calls, files, 7, 3)


@query(_BLAST)
def blast_radius(spark, d):
    """References by enclosing symbol, transitive callers and importers of one symbol."""
    return _blast(spark, d).select("evidence", "path", F.coalesce("id", F.lit(-1)).alias("id"), "count", F.coalesce("line", F.lit(-1)).alias("line"), "depth")


@query(f"with b as ({_BLAST}) select count(distinct path) as files, count(distinct path % 10) as packages, count(*) filter (evidence = 'reference') as reference, count(*) filter (evidence = 'caller') as caller, count(*) filter (evidence = 'importer') as importer, max(depth) as depth from b")
def blast_totals(spark, d):
    rows = _blast(spark, d).withColumn("file", F.col("path").cast("string"))
    return verdicts.blast_summary(rows, "file", F.col("path") % 10, "evidence", "depth").drop("test_files")


@query(f"with b as ({_BLAST}) select least(30, count(*)) as rows, true as fair from b")
def blast_fair_page(spark, d):
    """Thirty rows in fair shares of three kinds of evidence: none has less than a third, but for those that have no more."""
    all_ = _blast(spark, d)
    n = all_.groupBy("evidence").agg(F.count(F.lit(1)).alias("n"))
    got = verdicts.blast_page(all_, 30).groupBy("evidence").agg(F.count(F.lit(1)).alias("rows"))
    both = n.join(got, "evidence", "left")
    return both.agg(F.sum("rows").alias("rows"), F.bool_and(F.coalesce("rows", F.lit(0)) >= F.least("n", F.lit(10))).alias("fair"))


# hunks: the lines of an order, on the days on which they were shipped
_HUNKS = f"hunks as (select distinct o_custkey as file, {_DAY.format('l_shipdate')} as new_start, cast(l_linenumber % 3 as int) as new_count from lineitem join orders on o_orderkey = l_orderkey where l_linenumber < 4)"
_SPANS = f"""new as (select o_custkey as file, 'o' || o_orderkey as key, {_DAY.format('o_orderdate')} as line, {_DAY.format('o_orderdate')} + 60 as end_line from orders where o_orderstatus <> 'P'),
old as (select o_custkey as file, 'o' || o_orderkey as key, {_DAY.format('o_orderdate')} as line, {_DAY.format('o_orderdate')} + 60 as end_line from orders where o_orderpriority <> '5-LOW')"""
_HIT = """hit as (select h.*, n.key, n.line, n.end_line, min(case when h.new_start >= n.line and h.new_start + greatest(h.new_count, 1) - 1 <= n.end_line then n.end_line - n.line end) over (partition by h.file, h.new_start, h.new_count) as inner_len
  from hunks h join new n on n.file = h.file and case when h.new_count > 0 then n.line <= h.new_start + h.new_count - 1 and n.end_line >= h.new_start else n.line <= h.new_start and h.new_start < n.end_line end),
mine as (select * from hit where inner_len is null or end_line - line <= inner_len)"""


def _hunks(spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_linenumber < 4").select("l_orderkey", "l_linenumber", "l_shipdate")
    o = table(spark, d, "orders").select("o_orderkey", "o_custkey")
    return li.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(F.col("o_custkey").alias("file"), _day("l_shipdate").alias("new_start"), (F.col("l_linenumber") % 3).cast("int").alias("new_count")).distinct()


@query(f"""with {_HUNKS}, {_SPANS}, {_HIT}, touched as (select distinct file, key from mine),
both_ as (select coalesce(n.file, o.file) as file, coalesce(n.key, o.key) as key, n.line, o.line as old_line from new n full join old o on o.file = n.file and o.key = n.key),
rows as (select b.file, b.key, case when old_line is null then 'added' when line is null then 'removed' when t.key is not null then 'modified' end as change, coalesce(line, old_line) as line from both_ b left join touched t on t.file = b.file and t.key = b.key),
gone as (select o.* from old o left join new n on n.file = o.file and n.key = o.key where n.key is null),
loose as (select file, min(new_start) as line from hunks h where not exists (select 1 from mine m where m.file = h.file and m.new_start = h.new_start and m.new_count = h.new_count)
  and not exists (select 1 from gone g where g.file = h.file and g.line <= h.new_start and g.end_line >= h.new_start) group by file)
select file, coalesce(key, '') as key, change, cast(line as int) as line from rows where change is not null union all select file, '', 'modified', cast(line as int) from loose""")
def changed_symbols(spark, d):
    """Symbols added, removed and modified between two outlines and a diff, and files with hunks that no symbol explains."""
    o = table(spark, d, "orders")
    outline_of = lambda df: df.select(F.col("o_custkey").alias("file"), F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("key"), _day("o_orderdate").alias("line"), (_day("o_orderdate") + 60).alias("end_line"))
    hunks = _hunks(spark, d).withColumns({"old_start": F.col("new_start"), "old_count": F.lit(1)})
    return history.changed_symbols(outline_of(o.where("o_orderstatus <> 'P'")), outline_of(o.where("o_orderpriority <> '5-LOW'")), hunks).withColumn("key", F.coalesce("key", F.lit("")))


_LOG = f"log as (select l_orderkey as commit, l_suppkey as author, o_custkey as file, {_DAY.format('l_shipdate')} as new_start, cast(l_linenumber % 3 as int) as new_count, cast(l_quantity as bigint) as old_count, row_number() over (order by l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, l_shipdate, l_extendedprice) as r from lineitem join orders on o_orderkey = l_orderkey where l_linenumber <= 3)"


@query(f"""with {_LOG}, once as (select distinct commit, author, file, new_start, new_count, old_count from log), {_SPANS},
hit as (select h.*, n.key, n.line, n.end_line, min(n.end_line - n.line) over (partition by commit, h.file, new_start, new_count, old_count) as least_len, row_number() over (partition by commit, author, h.file, new_start, new_count, old_count order by n.line, n.key) as k
  from once h join new n on n.file = h.file and case when h.new_count > 0 then n.line <= h.new_start + h.new_count - 1 and n.end_line >= h.new_start else n.line <= h.new_start and h.new_start < n.end_line end)
select key as id, count(distinct commit) as commits, count(distinct author) as authors from hit group by key""")
def symbol_churn(spark, d):
    """Commits and authors whose hunks touch each symbol."""
    li = table(spark, d, "lineitem").where("l_linenumber <= 3")
    o = table(spark, d, "orders")
    log = li.join(o.select("o_orderkey", "o_custkey"), F.col("o_orderkey") == F.col("l_orderkey"))
    hunks = log.select(F.col("l_orderkey").alias("commit"), F.col("l_suppkey").alias("author"), F.col("o_custkey").alias("file"), _day("l_shipdate").alias("new_start"), (F.col("l_linenumber") % 3).cast("int").alias("new_count"), F.col("l_quantity").cast("long").alias("old_count")).distinct()
    spans = o.where("o_orderstatus <> 'P'").select(F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("id"), F.col("o_custkey").alias("file"), _day("o_orderdate").alias("line"), (_day("o_orderdate") + 60).alias("end_line"))
    return history.symbol_churn(spans, hunks).select("id", "commits", "authors")


@query("""with a(line) as (select distinct cast(l_linenumber * 5 as bigint) from lineitem), m as (select line, case when line >= 10 and line < 12 then 14 when line < 10 then line else line + 3 end as l1, line >= 10 and line < 12 as lost1 from a),
n as (select line, lost1, case when l1 > 20 then l1 + 2 else l1 end as to_line from m) select line, cast(to_line as bigint) as to_line, lost1 as lost from n""")
def line_carry(spark, d):
    """Lines through two layers of hunks, the older one first."""
    layer = lambda *hs: F.array(*[F.struct(*[F.lit(x).alias(k) for k, x in zip(("old_start", "old_count", "new_start", "new_count"), h)]) for h in hs])
    layers = F.array(layer((10, 2, 14, 5)), layer((20, 0, 21, 2)))
    rows = table(spark, d, "lineitem").select((F.col("l_linenumber") * 5).cast("long").alias("line")).distinct()
    return rows.withColumn("m", history.carry(F.col("line"), layers)).select("line", F.col("m.line").alias("to_line"), "m.lost")


@query("""select l_partkey, count(distinct l_orderkey) as commits, cast(sum(cast(l_quantity as bigint)) + sum(l_linenumber) as bigint) as moved from lineitem where l_shipdate >= (select max(l_shipdate) from lineitem) - interval 90 day group by l_partkey order by commits desc, moved desc, l_partkey limit 20""")
def churn_top(spark, d):
    """The twenty parts of the last ninety days with most commits, then lines, in order."""
    li = table(spark, d, "lineitem")
    last = li.agg(F.max("l_shipdate").alias("m"))
    since = F.lit(last.first()[0]).cast(li.schema["l_shipdate"].dataType) - history.since("90d")
    rows = history.churn(li, "l_partkey", "l_orderkey", "l_suppkey", F.col("l_quantity").cast("long"), F.col("l_linenumber"), "l_shipdate", since)
    return history.churn_order(rows, "l_partkey", 20).select("l_partkey", "commits", (F.col("added") + F.col("removed")).cast("long").alias("moved"))


@query(f"""with c as (select l_partkey, count(distinct l_orderkey) as commits from lineitem group by l_partkey) select p_partkey, {sql_round('commits * (1 + ln(1 + p_size))', 3)} as score from c join part on p_partkey = l_partkey order by score desc, p_partkey limit 20""")
def hotspots_top(spark, d):
    churned = table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("p_partkey")).agg(F.countDistinct("l_orderkey").alias("commits"))
    rows = history.hotspots(churned, table(spark, d, "part").select("p_partkey", "p_size"), "p_partkey", "p_size")
    return history.hotspot_order(rows, "p_partkey", 20).select("p_partkey", "score")


# ---- logs and diffs as text: one record for each order


def _record(tail: Column) -> Column:
    return F.concat(F.lit("\u0001sha"), F.col("o_orderkey").cast("string"), F.lit("\u001fau"), F.col("o_custkey").cast("string"), F.lit("\u001f"), F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("\u0002\n"), tail)


def _lines_of_orders(spark, d: str, line: Column) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", line.alias("x")).groupBy("l_orderkey").agg(F.array_join(F.sort_array(F.collect_list("x")), "\n").alias("tail"))
    o = table(spark, d, "orders")
    return o.join(li, F.col("o_orderkey") == F.col("l_orderkey"))


@query("select 'part' || l_partkey as path, count(*) as n, cast(sum(case when l_linenumber % 4 = 0 then 0 else cast(l_quantity as bigint) end) as bigint) as added, count(*) filter (l_linenumber % 4 = 0) as binary, count(distinct 'au' || o_custkey) as authors from lineitem join orders on o_orderkey = l_orderkey group by l_partkey")
def git_log_numstat(spark, d):
    """Logs written out as text and read again: counts by path, binary files without numbers."""
    number = F.when(F.col("l_linenumber") % 4 == 0, "-").otherwise(F.col("l_quantity").cast("long").cast("string"))
    logs = _lines_of_orders(spark, d, F.concat(number, F.lit("\t"), number, F.lit("\tpart"), F.col("l_partkey").cast("string"))).select(_record(F.concat(F.col("tail"), F.lit("\n"))).alias("log"))
    return readers.parse_log(logs, "log").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("added").cast("long").alias("added"), F.count_if("binary").alias("binary"), F.countDistinct("author").alias("authors"))


@query(ORACLE_SQL["git_log_numstat"])
def git_log_files(spark, d):
    """The same logs as text files, whose records are rows wherever a file is split."""
    number = F.when(F.col("l_linenumber") % 4 == 0, "-").otherwise(F.col("l_quantity").cast("long").cast("string"))
    logs = _lines_of_orders(spark, d, F.concat(number, F.lit("\t"), number, F.lit("\tpart"), F.col("l_partkey").cast("string"))).select(_record(F.concat(F.col("tail"), F.lit("\n"))).alias("log"))
    path = scratch(spark, "log")
    logs.write.option("lineSep", "\u0001").text(path)
    return readers.parse_log(readers.read_log(spark, path), "value").groupBy("path").agg(F.count(F.lit(1)).alias("n"), F.sum("added").cast("long").alias("added"), F.count_if("binary").alias("binary"), F.countDistinct("author").alias("authors"))


@query("select distinct p_brand || '/' || p_name || '-' || p_partkey as path from part")
def git_listing_files(spark, d):
    """A listing with zero bytes between paths as text files, with some paths twice."""
    listed = table(spark, d, "part").select(F.concat("p_brand", F.lit("/"), "p_name", F.lit("-"), "p_partkey").alias("value"))
    path = scratch(spark, "listing")
    listed.unionByName(listed.where("length(value) % 2 = 0")).write.option("lineSep", "\u0000").text(path)
    return readers.read_listing(spark, path)


@query("select 'sha' || l_orderkey as sha, count(*) as files, min('part ' || l_partkey) as first from lineitem join orders on o_orderkey = l_orderkey group by l_orderkey")
def git_log_names(spark, d):
    logs = _lines_of_orders(spark, d, F.concat(F.lit("part "), F.col("l_partkey").cast("string"))).select(_record(F.concat(F.col("tail"), F.lit("\n"))).alias("log"))
    return readers.parse_names(logs, "log").groupBy("sha").agg(F.count(F.lit(1)).alias("files"), F.min("path").alias("first"))


_DIFFS = """select o_orderkey, case when o_orderkey % 5 = 4 then 'old' || o_custkey else 'dir/f' || o_custkey end as old_path, 'dir/f' || o_custkey as new_path, ['M', 'A', 'D', 'M', 'R'][1 + o_orderkey % 5] as status, o_orderkey % 5 = 3 as binary,
  cast(case when o_orderkey % 5 in (0, 1, 2) then o_custkey else -1 end as int) as old_start, cast(case when o_orderkey % 5 in (0, 1, 2) then 1 else -1 end as int) as old_count, cast(case when o_orderkey % 5 in (0, 1, 2) then o_custkey + 1 else -1 end as int) as new_start, cast(case when o_orderkey % 5 in (0, 1, 2) then o_orderkey % 7 else -1 end as int) as new_count from orders"""


def _diff_text() -> Column:
    c, k = F.col("o_custkey").cast("string"), F.col("o_orderkey") % 5
    old = F.when(k == 4, F.concat(F.lit("old"), c)).otherwise(F.concat(F.lit("dir/f"), c))
    head = F.concat(F.lit("diff --git a/"), old, F.lit(" b/dir/f"), c, F.lit("\n"))
    hunk = F.concat(F.lit("@@ -"), c, F.lit(" +"), (F.col("o_custkey") + 1).cast("string"), F.lit(","), (F.col("o_orderkey") % 7).cast("string"), F.lit(" @@ fn\n-x\n"))
    more = F.when(k == 1, F.concat(F.lit("new file mode 100644\n"), hunk)).when(k == 2, F.concat(F.lit("deleted file mode 100644\n"), hunk)).when(k == 3, F.lit("Binary files a/x and b/x differ\n")).when(k == 4, F.concat(F.lit("similarity index 100%\nrename from "), old, F.lit("\nrename to dir/f"), c, F.lit("\n"))).otherwise(hunk)
    return F.concat(head, more)


@query(_DIFFS)
def git_diff_hunks(spark, d):
    """Zero-context diffs as text: files added, deleted, renamed, binary, and their hunks."""
    texts = table(spark, d, "orders").select("o_orderkey", _diff_text().alias("diff"))
    return readers.parse_diff(texts, "o_orderkey", "diff").fillna(-1, ["old_start", "old_count", "new_start", "new_count"])


@query(f"select 'sha' || o_orderkey as sha, 'au' || (o_orderkey % 9) as author, status, new_start from ({_DIFFS})")
def git_log_patches(spark, d):
    o = table(spark, d, "orders").withColumn("o_orderdate", F.lit("2020-01-01"))
    head = F.concat(F.lit("\u0001sha"), F.col("o_orderkey").cast("string"), F.lit("\u001fau"), (F.col("o_orderkey") % 9).cast("string"), F.lit("\u001f2020-01-01\u0002\n"))
    return readers.parse_patches(o.select(F.concat(head, _diff_text()).alias("log")), "log").select("sha", "author", "status", F.coalesce("new_start", F.lit(-1)).alias("new_start"))


@query("select distinct 'src/f' || p_size || '.go' as path from part order by path")
def git_listing(spark, d):
    """A listing with zero bytes between paths, every path once."""
    files = table(spark, d, "part").groupBy("p_brand").agg(F.array_join(F.collect_list(F.concat(F.lit("src/f"), F.col("p_size").cast("string"), F.lit(".go"))), "\u0000").alias("out"))
    return readers.git_listing(files, "out")


_IGNORE = ["# comment", "*.log", "build/", "/top.txt", "docs/*.md", "!keep.log", "**/tmp"]
_PATHS = ["a/x.log", "a/keep.log", "build/o.c", "src/build/o.c", "top.txt", "a/top.txt", "docs/a.md", "docs/b/a.md", "x/tmp", "x/tmp/y.c", "buildx/o.c"]
_IGNORED = [True, False, True, True, True, False, True, False, True, True, False]


@query(f"select p_partkey, {_PATHS}[1 + p_partkey % {len(_PATHS)}] as path from part where not {[*_IGNORED]}[1 + p_partkey % {len(_PATHS)}]".replace("True", "true").replace("False", "false"))
def ignore_rules(spark, d):
    """Paths that pass ignore rules: by name, by directory, from the top, and taken in again."""
    path = F.element_at(F.array(*[F.lit(p) for p in _PATHS]), (F.col("p_partkey") % len(_PATHS) + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", path.alias("path")).where(readers.not_ignored(F.col("path"), _IGNORE))


@query("""with k as (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_orderkey) - 1 as n from orders)
select 'c' || o_custkey || '.go' as path, 'c' || o_custkey || '.go::T.m' || (o_orderkey % 3) || '#method' || case when r = 1 then '' else '~' || r end as id, cast(o_orderkey % 1000 + 1 as int) as line, 1 as depth
from (select *, row_number() over (partition by o_custkey, o_orderkey % 3 order by o_orderkey % 1000, n) as r from k)""")
def lsp_document_symbols(spark, d):
    """Nested answers of a language server: ids with the container, numbered where they repeat."""
    o = table(spark, d, "orders")
    at = F.struct(F.struct((F.col("o_orderkey") % 1000).alias("line")).alias("start"), F.struct((F.col("o_orderkey") % 1000).alias("line")).alias("end"))
    kid = F.struct(F.col("o_orderkey").alias("o"), F.concat(F.lit("m"), (F.col("o_orderkey") % 3).cast("string")).alias("name"), F.lit(6).alias("kind"), at.alias("range"))
    span = F.struct(F.struct(F.lit(0).alias("line")).alias("start"), F.struct(F.lit(2000).alias("line")).alias("end"))
    answers = o.groupBy("o_custkey").agg(F.sort_array(F.collect_list(kid)).alias("kids"))
    answers = answers.select(F.concat(F.lit("c"), F.col("o_custkey").cast("string"), F.lit(".go")).alias("path"), F.to_json(F.array(F.struct(F.lit("T").alias("name"), F.lit(23).alias("kind"), span.alias("range"), F.col("kids").alias("children")))).alias("answer"))
    return readers.read_symbols(answers, "path", "answer").where("depth = 1").select("path", "id", "line", "depth")


@query("select p_brand, p_name as name, p_type as container, 'function' as kind, '/w/' || p_brand as path, cast(p_size + 1 as int) as line from part where lower(p_name) like '%bolt%'")
def lsp_workspace_symbols(spark, d):
    """Flat answers in the server's order, filtered by name."""
    p = table(spark, d, "part")
    item = F.struct(F.col("p_partkey").alias("k"), F.col("p_name").alias("name"), F.lit(12).alias("kind"), F.col("p_type").alias("containerName"), F.struct(F.concat(F.lit("file:///w/"), "p_brand").alias("uri"), F.struct(F.struct(F.col("p_size").alias("line")).alias("start")).alias("range")).alias("location"))
    answers = p.groupBy("p_brand").agg(F.to_json(F.sort_array(F.collect_list(item))).alias("answer"))
    rows = readers.read_workspace_symbols(answers, "p_brand", "answer").withColumn("id", F.col("line"))
    return search.workspace_symbol(rows, "Bolt").select("p_brand", "name", "container", "kind", "path", "line")


@query("""select p_partkey, 4 as words, p_name as query, '--limit=' || p_size as last from part where p_partkey % 4 <> 3""")
def batch_commands(spark, d):
    """Command lines with quotes; those whose quotes don't close have no words."""
    line = F.concat(F.lit('search --exact "'), F.col("p_name"), F.when(F.col("p_partkey") % 4 == 3, "").otherwise('"'), F.lit(" --limit="), F.col("p_size").cast("string"))
    rows = table(spark, d, "part").select("p_partkey", readers.split_command(line).alias("w")).where("w is not null")
    return rows.select("p_partkey", F.size("w").alias("words"), F.col("w")[2].alias("query"), F.col("w")[3].alias("last"))


# ---- sinks


@query("""select s_suppkey, '{"version":1,"ok":true,"data":{"s_suppkey":' || s_suppkey || ',"s_nationkey":' || s_nationkey || '},"warnings":[' || case when s_nationkey = 3 then '"few"' else '' end || ']}' as json from supplier""")
def json_envelope(spark, d):
    rows = table(spark, d, "supplier").select("s_suppkey", "s_nationkey")
    out = sinks.envelope(rows, F.when(F.col("s_nationkey") == 3, F.lit("few")))
    return out.select(F.get_json_object("json", "$.data.s_suppkey").cast("long").alias("s_suppkey"), "json")


@query("select p_brand || ':' || p_size || ':' || (p_partkey % 80) || ':' || p_name as value from part")
def text_lines(spark, d):
    return sinks.text_lines(table(spark, d, "part").withColumn("c", F.col("p_partkey") % 80), "p_brand", "p_size", "c", "p_name")


@query("select user_id, count(*) as results, count(distinct event_type) as rules, count(*) filter (event_type = 'error') as errors, count(*) filter (event_type <> 'error') as notes from events group by user_id")
def sarif_report(spark, d):
    """A report of each user's diagnostics, counted again from its text."""
    e = table(spark, d, "events").select("user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("path"), F.col("event_id").alias("line"), F.lit(1).alias("col"), F.when(F.col("event_type") == "error", "error").otherwise("hint").alias("severity"), F.col("event_type").alias("rule"), F.lit("m").alias("message"))
    run = F.from_json("sarif", "struct<runs:array<struct<tool:struct<driver:struct<rules:array<struct<id:string>>>>,results:array<struct<ruleId:string,level:string>>>>>")
    r = sinks.sarif(e, ["user_id"]).select("user_id", run.alias("s")).select("user_id", F.col("s.runs")[0].alias("r"))
    level = lambda name: F.size(F.filter("r.results", lambda x: x["level"] == name)).cast("long")
    return r.select("user_id", F.size("r.results").cast("long").alias("results"), F.size("r.tool.driver.rules").cast("long").alias("rules"), level("error").alias("errors"), level("note").alias("notes"))


@query("select p_brand as server, p_partkey as id, case when p_type = 'PROMO' then p_size + 1 else p_size end as v from part")
def index_parts(spark, d):
    """Parts by server written, one server's written anew, and all read back by schema, build and checksum."""
    path = scratch(spark, "parts")
    rows = table(spark, d, "part").select(F.col("p_brand").alias("server"), F.col("p_partkey").alias("id"), F.col("p_size").alias("v"), "p_type")
    sinks.write_parts(rows, path, 2, "b")
    brands = [r[0] for r in rows.where("p_type = 'PROMO'").select("server").distinct().collect()]
    sinks.write_parts(rows.where(F.col("server").isin(brands)).withColumn("v", F.when(F.col("p_type") == "PROMO", F.col("v") + 1).otherwise(F.col("v"))), path, 2, "b")
    return readers.read_parts(spark, path, 2, "b").select("server", "id", "v")


# ---- edits


def _edit_tables(spark, d: str) -> tuple[DataFrame, DataFrame]:
    docs = table(spark, d, "documents").select(F.col("doc_id").alias("uri"), F.col("source").alias("txn"), "text", F.lit(1).alias("version"))
    at = F.when(F.col("uri") % 97 == 5, F.length("text") + 1).otherwise(F.least(F.lit(3), F.length("text")))
    first = docs.select("uri", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("> ").alias("new_text"), F.lit(1).alias("version"))
    second = docs.select("uri", F.least(F.lit(2), F.length("text")).alias("start"), at.alias("end"), F.lit("#").alias("new_text"), F.when(F.col("uri") % 89 == 7, 2).otherwise(1).alias("version"))
    return docs, first.unionByName(second)


_EDITED = "'> ' || substr(text, 1, least(2, length(text))) || '#' || substr(text, least(3, length(text)) + 1)"


@query(f"""with b as (select source, bool_or(doc_id % 97 = 5 or doc_id % 89 = 7) as bad from documents group by source) select doc_id, not bad as applied, sha256(case when bad then text else {_EDITED} end) as text_sha256 from documents join b using (source)""")
def transactional_apply(spark, d):
    """Two edits to each document, and each source a transaction: one bad edit leaves its whole source as it was."""
    docs, edits = _edit_tables(spark, d)
    return diffs.apply_transaction(docs, edits, "txn").select(F.col("uri").alias("doc_id"), "applied", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@query("select doc_id, case when doc_id % 97 = 5 then 'range outside the document' when doc_id % 89 = 7 then 'stale version' end as problem from documents where doc_id % 97 = 5 or doc_id % 89 = 7")
def edit_validation(spark, d):
    docs, edits = _edit_tables(spark, d)
    got = intervals.validate_edits(edits, docs.select("uri", "version", F.length("text").alias("length")))
    return got.where("problem is not null").select(F.col("uri").alias("doc_id"), "problem")


@query("select doc_id, case when text = '' then 1 else 2 end as marks, '+> ' || string_split(text, chr(10))[1] as line from documents where text is not null")
def edit_preview(spark, d):
    """The difference that an edit would make: a line goes and a line comes."""
    docs = table(spark, d, "documents").where("text is not null").select(F.col("doc_id").alias("uri"), "text")
    edits = docs.select("uri", F.lit(0).alias("start"), F.lit(0).alias("end"), F.lit("> ").alias("new_text"))
    lines = F.filter(F.split("diff", "\n"), lambda x: (F.startswith(x, F.lit("-")) & ~F.startswith(x, F.lit("---"))) | F.startswith(x, F.lit("+> ")))
    return diffs.preview(docs, edits).select(F.col("uri").alias("doc_id"), F.size(lines).alias("marks"), F.element_at(lines, -1).alias("line"))


@query("select o_orderkey, case when o_orderkey % 3 = 1 then -1 else case when o_orderkey % 3 = 0 then 2 else 1 end end as edits from orders")
def edit_merge(spark, d):
    """Two lists of edits in one: apart, in conflict, equal."""
    e = lambda a, b, x: F.array(F.struct(F.lit(a).alias("start"), F.lit(b).alias("end"), F.lit(x).alias("new")))
    other = F.when(F.col("o_orderkey") % 3 == 0, e(5, 6, "y")).when(F.col("o_orderkey") % 3 == 1, e(2, 9, "z")).otherwise(e(1, 4, "x"))
    rows = table(spark, d, "orders").select("o_orderkey", diffs.merge_udf(e(1, 4, "x"), other).alias("m"))
    return rows.select("o_orderkey", F.when(F.col("m").isNotNull(), F.size("m")).otherwise(-1).alias("edits"))


# ---- listings of symbols: parts as members of their brand


def _outline(spark, d: str) -> DataFrame:
    """path (maker), ordinal, parent, name, kind, line, depth: brands as classes, parts as their methods."""
    p = table(spark, d, "part")
    top = p.groupBy("p_type", "p_brand").agg(F.min("p_partkey").alias("line")).select(F.col("p_type").alias("path"), (-1 - F.col("line")).alias("ordinal"), F.lit(None).cast("long").alias("parent"), F.col("p_brand").alias("name"), F.lit("class").alias("kind"), (F.col("line") * 2).alias("line"), F.lit(0).alias("depth"))
    up = top.select(F.col("path").alias("p_type"), F.col("name").alias("p_brand"), F.col("ordinal").alias("parent"))
    kids = p.join(up, ["p_type", "p_brand"]).select(F.col("p_type").alias("path"), F.col("p_partkey").alias("ordinal"), "parent", F.col("p_name").alias("name"), F.lit("method").alias("kind"), (F.col("p_partkey") * 2 + 1).alias("line"), F.lit(1).alias("depth"))
    return top.unionByName(kids)


_OUTLINE = """tops as (select p_type, p_brand, min(p_partkey) as l from part group by p_type, p_brand),
o as (select p_type as path, -1 - l as ordinal, cast(null as bigint) as parent, p_brand as name, 'class' as kind, l * 2 as line, 0 as depth from tops
  union all select p.p_type, p.p_partkey, -1 - t.l, p.p_name, 'method', p.p_partkey * 2 + 1, 1 from part p join tops t on t.p_type = p.p_type and t.p_brand = p.p_brand)"""


@query(f"with {_OUTLINE} select kind, count(*) as n from o group by kind")
def symbols_by_kind(spark, d):
    return snapshot.counts(_outline(spark, d))


@query(f"with {_OUTLINE}, m as (select *, count(*) over () as total from o where path = 'ECONOMY') select line, repeat('  ', depth) || kind || ' ' || name as text, total from m order by line, depth limit 40")
def outline_listing(spark, d):
    """The first forty symbols of a file in document order, indented, with the total."""
    return outline.outline(_outline(spark, d), "ECONOMY", 40).select("line", "text", "total")


@query(f"with {_OUTLINE} select ordinal, string_agg(name, '|' order by line, name) as children from (select k.parent as ordinal, k.name, k.line from o k where parent is not null) group by ordinal")
def outline_children(spark, d):
    return outline.children(_outline(spark, d)).where("children is not null").select("ordinal", F.array_join("children", "|").alias("children"))


@query(f"with {_OUTLINE}, n as (select *, row_number() over (partition by path order by line, ordinal) - 1 as new from o) select n.path, n.ordinal, cast(n.new as int) as new, coalesce(cast(p.new as int), -1) as new_parent from n left join n p on p.path = n.path and p.ordinal = n.parent")
def parent_ordinals(spark, d):
    """Ordinals after sorting by place, and the parent's among them."""
    return outline.parent_ordinals(_outline(spark, d)).select("path", "ordinal", "new", F.coalesce("new_parent", F.lit(-1)).alias("new_parent"))


@query(f"with {_OUTLINE} select o.path, o.ordinal, coalesce(p.name, '') as chain from o left join o p on p.path = o.path and p.ordinal = o.parent")
def enclosing_chain(spark, d):
    return outline.enclosing_chain(_outline(spark, d)).select("path", "ordinal", F.array_join("chain", ".").alias("chain"))


@query(f"with {_OUTLINE}, m as (select path, line, name, row_number() over (order by path, line, ordinal) as k, count(*) over () as total from o where kind = 'class') select path, line, name, total, total > 10 as truncated from m where k <= 10")
def symbols_enumerate(spark, d):
    """Symbols of one kind in order of place; kinds go without case."""
    rows = _outline(spark, d).withColumn("id", F.col("ordinal"))
    return outline.enumerate_symbols(rows, search.SearchQuery("", kinds=("CLASS",), limit=10)).select("path", "line", "name", "total", "truncated")


@query("select p_partkey as id, p_name as name, count(*) over () as total from part where p_type || '.' || p_brand || '.' || p_name like '%.Brand#1_.red bolt' or p_type || '.' || p_brand || '.' || p_name = 'Brand#4.blue bolt'".replace("like '%.Brand#1_.red bolt'", "like '%.Brand#4.blue bolt'"))
def dotted_suffix(spark, d):
    """Symbols whose qualified name ends with given segments."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.concat_ws(".", "p_type", "p_brand", "p_name").alias("qualified"))
    rows = verdicts.dotted_suffix(p, "qualified", "Brand#4.blue bolt")
    return rows.crossJoin(F.broadcast(rows.agg(F.count(F.lit(1)).alias("total")))).select("id", "name", "total")


@query("""with s as (select p_partkey as id, p_name as name, p_brand as container, p_type as scope, p_name || case when p_partkey % 2 = 0 then 'x' else '' end as new_name from part)
select a.id, count(b.id) as collisions from s a left join s b on b.name = a.new_name and b.scope = a.scope and b.container = a.container and b.id <> a.id group by a.id""")
def rename_scope(spark, d):
    """What each rename hits in its own container and scope."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_name").alias("name"), F.col("p_brand").alias("container"), F.col("p_type").alias("scope"))
    renames = p.withColumn("new_name", F.concat("name", F.when(F.col("id") % 2 == 0, "x").otherwise(""))).drop("name")
    return verdicts.collisions(p, renames).select("id", "collisions")


@query("""with f as (select distinct p_type as path from part), i as (select p_partkey, p_type as path, case when p_partkey % 3 = 0 then 'old' else p_type end as indexed from part where p_type <> 'SMALL'), h as (select * from f where path <> 'LARGE')
select i.p_partkey, h.path as file_hash, h.path is null or h.path <> indexed as stale from i left join h on h.path = i.path""")
def hit_file_hash(spark, d):
    """Hits with their file's hash of now; changed and vanished files make them stale."""
    p = table(spark, d, "part")
    files = p.where("p_type <> 'LARGE'").select(F.col("p_type").alias("path"), F.col("p_type").alias("hash")).distinct()
    hits = p.where("p_type <> 'SMALL'").select("p_partkey", F.col("p_type").alias("path"), F.when(F.col("p_partkey") % 3 == 0, "old").otherwise(F.col("p_type")).alias("indexed_hash"))
    return snapshot.with_file_hash(hits, files).select("p_partkey", "file_hash", "stale")


@query("select l_orderkey, l_linenumber, cast(l_partkey as int) as col, count(*) over () as total from lineitem where l_suppkey = 3 order by l_orderkey, l_linenumber, col limit 30")
def reference_order(spark, d):
    """References by file, line and column, the first thirty with the total."""
    rows = table(spark, d, "lineitem").where("l_suppkey = 3").select(F.col("l_orderkey").alias("path"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("int").alias("col"))
    return search.reference_rows(rows, 30).select(F.col("path").alias("l_orderkey"), F.col("line").alias("l_linenumber"), "col", "total")


@query("select p_partkey, m.x as method, 'def' || p_size as target from part, (select unnest(['definition', 'hover']) as x) m where p_partkey % 2 = 0 and m.x = 'definition'")
def point_lookup(spark, d):
    """Definitions at positions, from a table of what a server answered."""
    p = table(spark, d, "part")
    answers = p.crossJoin(F.broadcast(spark.createDataFrame([("definition",), ("hover",)], "method string"))).select("method", F.col("p_partkey").alias("path"), F.lit(1).alias("line"), F.lit(4).alias("start_col"), F.lit(8).alias("end_col"), F.concat(F.lit("def"), F.col("p_size").cast("string")).alias("target"))
    asked = p.select(F.col("p_partkey").alias("path"), F.lit(1).alias("line"), F.when(F.col("p_partkey") % 2 == 0, 7).otherwise(8).alias("col"), "p_partkey")
    return search.lookup(asked, answers, "definition").select("p_partkey", F.lit("definition").alias("method"), "target")


# ---- hierarchies: a customer's urgent orders as calls, as in the graph queries


_TREE = "edges as (select distinct p_partkey as src, p_partkey // 3 as dst from part where p_partkey // 3 <> p_partkey and p_partkey // 3 > 0)"


def _tree(spark, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.floor(F.col("p_partkey") / 3).cast("long").alias("dst"))
    return p.where("dst <> src and dst > 0").distinct()


_WALK = """w as (select [cast({root} as bigint)] as path, cast({root} as bigint) as id, 0 as depth union all select list_append(w.path, s.b), s.b, w.depth + 1 from w join steps s on s.a = w.id where w.depth < {depth} and not list_contains(w.path, s.b))"""


@query(f"with recursive {_TREE}, steps as (select dst as a, src as b from edges), {_WALK.format(root=2, depth=4)} select row_number() over (order by path) as place, id, depth from w order by path limit 60")
def call_hierarchy_deep(spark, d):
    """Four levels of callers in depth-first order, sixty rows of them."""
    turned = _tree(spark, d).select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    rows = graph.hierarchy(turned, spark.range(2, 3), 4, 60)
    return rows.select(F.row_number().over(_by_path()).cast("long").alias("place"), "id", "depth")


def _by_path():
    from pyspark.sql import Window

    return Window.orderBy("path")  # of rows that the listing bounds


@query(f"""with recursive {_TREE}, steps as (select dst as a, src as b from edges), {_WALK.format(root=5, depth=3)}, up as (select cast(5 as bigint) as id, 0 as depth union all select e.dst, up.depth + 1 from up join edges e on e.src = up.id where up.depth < 3)
select 'subtype' as direction, id, depth, 'type_hierarchy' as evidence from w where depth > 0 union all select 'supertype', id, depth, 'type_hierarchy' from up where depth > 0""")
def type_hierarchy(spark, d):
    """Supertypes and subtypes, three levels each way."""
    return verdicts.type_hierarchy(_tree(spark, d), spark.range(5, 6), "both", 3).select("direction", "id", "depth", "evidence")


_CALLS = "calls as (select distinct l_partkey % 40 as src, (l_suppkey * 7 + l_linenumber) % 40 as dst from lineitem where l_quantity < 6)"


def _calls(spark, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").where("l_quantity < 6")
    return li.select((F.col("l_partkey") % 40).alias("src"), ((F.col("l_suppkey") * 7 + F.col("l_linenumber")) % 40).alias("dst"))


@query(
    f"""with recursive {_CALLS}, ch as (select src, list(dst order by dst) as kids from calls group by src),
w as (select 0 as place, [[cast(x as bigint)] for x in [1, 2]] as stack, []::bigint[] as met, null::bigint[] as path, false as repeat
  union all select place + 1, list_concat(case when len(p) <= 4 and not list_contains(met, p[-1]) then coalesce(list_transform(kids, lambda k: list_append(p, k)), []) else [] end, stack[2:]), case when len(p) <= 4 then list_append(met, p[-1]) else met end, p, len(p) <= 4 and list_contains(met, p[-1])
  from (select *, stack[1] as p from w where len(stack) > 0 and place < 200) left join ch on ch.src = p[-1])
select cast(place as bigint) as place, path[-1] as id, cast(len(path) - 1 as int) as depth, repeat from w where place > 0"""
)
def call_hierarchy_repeats(spark, d):
    """Four levels of calls in a graph with cycles and diamonds, in depth-first order: what was opened before is not opened again."""
    rows = graph.hierarchy(_calls(spark, d), spark.range(1, 3), 4, 200)
    return rows.select(F.row_number().over(_by_path()).cast("long").alias("place"), "id", "depth", "repeat")


_WALKED = """e as (select src, dst, min(spec) as spec from (select distinct o_custkey as src, o_orderkey % 97 + 1000000 as dst, o_orderpriority as spec from orders union all select distinct o_orderkey % 97 + 1000000, o_custkey % 50, o_orderstatus from orders) group by src, dst),
x as (select distinct o_custkey as src, 'ext' || (o_orderkey % 5) as spec from orders where o_custkey % 2 = 0),
l0 as (select '3' as id, 'file' as kind, 0 as depth, 1 as pos),
c1 as (select id, arg_min(kind, {'p': pos, 'w': way}) as kind, min({'p': pos, 'w': way}) as b from (select cast(dst as varchar) as id, case when dst >= 1000000 then 'package' else 'file' end as kind, pos, 0 as way from e join l0 on l0.id = cast(e.src as varchar) union all select spec, 'external', pos, 1 from x join l0 on l0.id = cast(x.src as varchar)) where id not in (select id from l0) group by id),
l1 as (select id, kind, 1 as depth, 1 + row_number() over (order by b, id) as pos from c1), k1 as (select * from l0 union all select * from l1 where pos <= 50),
c2 as (select id, arg_min(kind, {'p': pos, 'w': way}) as kind, min({'p': pos, 'w': way}) as b from (select cast(dst as varchar) as id, case when dst >= 1000000 then 'package' else 'file' end as kind, pos, 0 as way from e join k1 on k1.id = cast(e.src as varchar) where depth = 1 and kind <> 'external' union all select spec, 'external', pos, 1 from x join k1 on k1.id = cast(x.src as varchar) where depth = 1 and kind <> 'external') where id not in (select id from k1) group by id),
l2 as (select id, kind, 2 as depth, (select count(*) from k1) + row_number() over (order by b, id) as pos from c2), k2 as (select * from k1 union all select * from l2 where pos <= 50),
cut as (select (select count(*) from l1) + 1 > 50 or (select count(*) from l2) + (select count(*) from k1) > 50 as truncated)"""


def _walked(spark, d: str) -> graph.Walk:
    o = table(spark, d, "orders")
    via = F.col("o_orderkey") % 97 + 1000000
    edges = o.select(F.col("o_custkey").alias("src"), via.alias("dst"), F.col("o_orderpriority").alias("spec")).unionByName(o.select(via.alias("src"), (F.col("o_custkey") % 50).alias("dst"), F.col("o_orderstatus").alias("spec")))
    edges = edges.select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), "spec")
    nodes = graph.nodes_of(edges).select("id", F.when(F.col("id").cast("long") >= 1000000, "package").otherwise("file").alias("kind"))
    outer = o.where("o_custkey % 2 = 0").select(F.col("o_custkey").cast("string").alias("src"), F.concat(F.lit("ext"), (F.col("o_orderkey") % 5).cast("string")).alias("spec")).distinct()
    return graph.dependency_graph(nodes, edges, spark.createDataFrame([("3",)], "id string"), 2, "out", outer, 50)


@query(f"with {_WALKED} select id, kind, depth, truncated from k2, cut")
def dependency_graph_nodes(spark, d):
    """Two steps from a node with typed and external nodes, cut at fifty."""
    walk = _walked(spark, d)
    return walk.nodes.withColumn("truncated", F.lit(walk.truncated))


@query(f"""with {_WALKED}, o as (select id from k2 where depth < 2 and kind <> 'external') select cast(src as varchar) as src, cast(dst as varchar) as dst, spec, false as external from e where cast(src as varchar) in (select id from o) and cast(dst as varchar) in (select id from k2)
union all select cast(src as varchar), spec, spec, true from x where cast(src as varchar) in (select id from o) and spec in (select id from k2)""")
def dependency_graph_edges(spark, d):
    """The edges of that walk, external ones marked."""
    return _walked(spark, d).edges


@query("select p_partkey as id, 'implementation' as evidence from part where p_size = 7 order by id limit 300")
def type_hierarchy_fallback(spark, d):
    """Without a hierarchy, what implements the type, one level deep."""
    none = spark.createDataFrame([], "src long, dst long")
    impl = table(spark, d, "part").select(F.col("p_partkey").alias("src"), F.col("p_size").cast("long").alias("dst"))
    return verdicts.type_hierarchy(none, spark.range(7, 8), implementations=impl).select("id", "evidence")
