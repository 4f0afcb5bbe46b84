"""Verdicts and evidence: blast radius, dead code, references, deletion, renaming, related rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.text import is_test_file, round_half_up

#: Exit codes by severity, the least severe first.
SEVERITY = (0, 1, 3, 5, 2, 4)


def severity_rank(exit_code: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(x) for x in SEVERITY]), exit_code), F.lit(0))


def worst_exit(rows: DataFrame, group: list[str], exit_code: str) -> DataFrame:
    return rows.groupBy(*group).agg(F.max_by(exit_code, severity_rank(F.col(exit_code))).alias("exit"), F.count(F.lit(1)).alias("n"))


def fuse(evidence: list[DataFrame], key: str, limit: int | None = None) -> DataFrame:
    """evidence: key, weight, source, in the order of sources. Sums of weights, the sources joined; ties in the order of sources."""
    rows = None
    for k, e in enumerate(evidence):
        part = e.select(key, "weight", "source", F.lit(k).alias("_order"))
        rows = part if rows is None else rows.unionByName(part)
    out = rows.groupBy(key).agg(round_half_up(F.sum("weight")).alias("score"), F.array_join(F.transform(F.sort_array(F.collect_set(F.struct("_order", "source"))), lambda x: x.source), ",").alias("sources"), F.min("_order").alias("first"))
    out = out.orderBy(F.col("score").desc(), "first", key)
    return out.limit(limit) if limit else out


def siblings(rows: DataFrame, key: str, start: str, end: str, subject_start: int, subject_end: int) -> DataFrame:
    """Neighbours in one file weigh 2 and more, the nearer the more; gap 0 inside."""
    gap = F.greatest(F.lit(0), F.col(start) - F.lit(subject_end), F.lit(subject_start) - F.col(end))
    return rows.select(key, (2 + 1 / (1 + gap)).cast("double").alias("weight"), F.lit("sibling").alias("source"))


def exportedness(language: Column, name: Column, declaration: Column, strict: bool = True, nested: Column | None = None) -> Column:
    """yes, no or unknown, by the declaration's line. strict is the rule of the dead-code analysis; the other one counts
    public names in Python as exported and leaves restricted visibility in Rust open. nested: members of a class."""
    line, inner = F.trim(declaration), F.lit(False) if nested is None else nested
    begins = lambda *words: line.rlike("^(" + "|".join(words) + ")")
    under = F.startswith(name, F.lit("_"))
    go = F.when(name.rlike(r"^\p{Lu}"), "yes").otherwise("no")
    python = F.when(under if strict else under & ~name.rlike("^__.*__$"), "no").otherwise("unknown" if strict else "yes")
    hidden = F.when(begins("private", "#") | F.startswith(name, F.lit("#")), "no").otherwise("unknown") if strict else F.lit("unknown")
    script = F.when(begins("export"), "yes").when(inner, hidden).otherwise("no")
    rust = F.when(begins(r"pub\("), "no" if strict else "unknown").when(begins("pub ", "pub$"), "yes").otherwise("no")
    c = F.when(begins("static"), "no").otherwise("unknown")
    lua = F.when(begins("local"), "no").otherwise("unknown")
    scripts = ("typescript", "javascript", "typescriptreact", "javascriptreact")
    return F.when(language == "go", go).when(language == "python", python).when(language.isin(*scripts), script).when(language == "rust", rust).when(language.isin("c", "cpp"), c).when(language == "lua", lua).otherwise("unknown")


#: Methods that runtimes call by themselves, prefixes of test functions, languages that build names from strings.
BUILT_IN = (
    "String", "Error", "GoString", "Format", "Unwrap", "Is", "As", "MarshalJSON", "UnmarshalJSON", "MarshalText", "UnmarshalText", "MarshalBinary", "UnmarshalBinary",
    "Read", "Write", "Close", "Len", "Less", "Swap", "ServeHTTP", "Scan", "Value", "constructor", "toString", "toJSON", "valueOf",
    "fmt", "drop", "deref", "deref_mut", "next", "from", "into", "default", "eq", "cmp", "partial_cmp", "hash", "clone", "try_from", "from_str", "as_ref",
)
TEST_PREFIXES = ("Test", "Benchmark", "Example", "Fuzz")
REFLECTIVE = ("python", "javascript", "typescript", "javascriptreact", "typescriptreact", "ruby", "lua", "php")


def entry_point(language: Column, name: Column, kind: Column) -> Column:
    """Called by a runtime or a test runner."""
    test = name.rlike("^(" + "|".join(TEST_PREFIXES) + r")($|[^\p{Ll}])") & (kind == "function")
    return name.isin("main", "init", "TestMain") | ((language == "go") & test) | ((language == "python") & name.rlike("^__.*__$"))


def exclusion(language: str, name: str, kind: str, path: str, local: Column, exported: Column, include_exported: bool, ignore_names: list[str] = (), ignore_paths: list[str] = ()) -> Column:
    """Why a symbol is no candidate, by the first rule that fits; null if it is one."""
    wild = lambda c, p: c.rlike("^" + ".*".join(map(_escape, p.split("*"))) + "$")
    ignored = F.col(name).isin(*BUILT_IN) & (F.col(kind) == "method")
    for p in ignore_names:
        ignored = ignored | wild(F.col(name), p)
    for p in ignore_paths:
        ignored = ignored | wild(F.col(path), p)
    rule = F.when(is_test_file(F.col(path)), "test_file").when(entry_point(F.col(language), F.col(name), F.col(kind)), "entry_point").when(ignored, "ignored").when(local, "local")
    return rule if include_exported else rule.when(exported == "yes", "exported")


def _escape(text: str) -> str:
    return "".join(c if c.isalnum() or c == "_" else "\\" + c for c in text)


#: Systems and processors that a file's name can be bound to.
BOUND = "aix|android|darwin|dragonfly|freebsd|hurd|illumos|ios|js|linux|nacl|netbsd|openbsd|plan9|solaris|wasip1|windows|zos|386|amd64|arm|arm64|loong64|mips|mipsle|mips64|mips64le|ppc64|ppc64le|riscv64|s390x|wasm"


def build_sensitive(path: Column, text: Column) -> Column:
    """Files that only some builds see: by name, by a constraint before the package line, or by cgo anywhere."""
    head = F.concat(F.lit("\n"), F.split(F.concat(F.lit("\n"), text), r"\n[ \t\r]*package ", 2).getItem(0))
    return path.rlike(rf"_({BOUND})(_[a-z0-9]+)?\.go$") | head.rlike(r"\n[ \t\r]*(//go:build|// \+build)") | F.contains(text, F.lit('import "C"'))


def confidence(exported: Column, sensitive: Column, kind: Column, can_implement: Column, reflective: Column) -> Column:
    """The least of what the reasons allow."""
    low = exported.isin("yes", "unknown") | sensitive | ((kind == "method") & ~can_implement)
    return F.when(low, "low").when((kind == "method") | reflective, "medium").otherwise("high")


def unreferenced(candidates: DataFrame, references: DataFrame, key: str = "id") -> DataFrame:
    """Candidates without a reference from outside their own lines. references: key, path, line. They meet the candidates'
    own references only."""
    own = candidates.select(F.col(key).alias("_k"), F.col("path").alias("_p"), F.col("line").alias("_a"), F.col("end_line").alias("_b"))
    inside = F.col("path").eqNullSafe(F.col("_p")) & F.coalesce(F.col("line").between(F.col("_a"), F.col("_b")), F.lit(False))
    used = references.select(key, "path", "line").join(own, F.col(key) == F.col("_k")).where(~inside)
    return candidates.join(used.select(F.col("_k").alias(key)).distinct(), key, "left_anti")


def with_local(symbols: DataFrame, parent: str = "parent") -> DataFrame:
    """symbols (id, kind, parent: an id) with local: declared inside a function or method, however deep."""
    from corvane.operators.graph import nearest_ancestor

    inside = nearest_ancestor(symbols, "id", parent, F.col("kind").isin("function", "method"))
    return symbols.join(inside, "id", "left").withColumn("local", F.col("ancestor").isNotNull()).drop("ancestor")


def with_sensitive(symbols: DataFrame, files: DataFrame) -> DataFrame:
    """symbols with sensitive: their file (path, text) is one that only some builds see. Only Go has such files."""
    marks = files.select("path", build_sensitive(F.col("path"), F.coalesce("text", F.lit(""))).alias("_s"))
    marked = symbols.join(marks, "path", "left")
    return marked.withColumn("sensitive", (F.col("language") == "go") & F.coalesce("_s", F.lit(False))).drop("_s")


def excluded_counts(symbols: DataFrame, include_exported: bool = False, ignore_names: list[str] = (), ignore_paths: list[str] = ()) -> DataFrame:
    """What a sweep leaves out before it asks for uses: reason (null: what is looked at) and n."""
    reason = exclusion("language", "name", "kind", "path", F.col("local"), F.col("exported"), include_exported, ignore_names, ignore_paths)
    return symbols.groupBy(reason.alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def reference_verdict(ambiguous: Column, semantic: Column, text_only: Column) -> Column:
    return F.when(ambiguous, "ambiguous").when(semantic > 0, "used").when(text_only > 0, "used_only_in_text").otherwise("unused")


def delete_verdict(refs: Column, test_refs: Column, importers: Column, last_of_scope: Column) -> Column:
    return F.when(refs > 0, "in_use").when(test_refs > 0, "used_by_tests_only").when(last_of_scope & (importers > 0), "leaves_importers_dangling").otherwise("unused")


def rename_verdict(same_name: Column, refused: Column, collisions: Column, edits: Column, verified: Column) -> Column:
    return F.when(same_name, "noop").when(refused, "refused").when(collisions > 0, "collision").when(edits == 0, "refused").when(~verified, "unverified").otherwise("ok")


def text_only(hits: DataFrame, semantic: DataFrame, keys: list[str]) -> DataFrame:
    """Text matches at places that no reference covers."""
    return hits.join(semantic.select(*keys).distinct(), keys, "left_anti")


def by_enclosing(references: DataFrame, file: str, symbol: str, line: str) -> DataFrame:
    return references.groupBy(file, symbol).agg(F.count(F.lit(1)).alias("count"), F.min(line).alias("line"))


def blast_summary(rows: DataFrame, file: str, package: Column, evidence: str, depth: str) -> DataFrame:
    """One row over all rows, before any limit."""
    return rows.agg(F.countDistinct(file).alias("files"), F.countDistinct(package).alias("packages"), F.countDistinct(F.when(is_test_file(F.col(file)), F.col(file))).alias("test_files"), *[F.count_if(F.col(evidence) == e).alias(e) for e in ("reference", "caller", "importer")], F.max(depth).alias("depth"))


def dotted_suffix(symbols: DataFrame, qualified: str, query: str) -> DataFrame:
    """Symbols whose qualified name ends with the query's segments; exact ones hide the others."""
    parts = query.split(".")
    rows = symbols.where(F.slice(F.split(F.col(qualified), r"\."), -len(parts), len(parts)) == F.array(*[F.lit(p) for p in parts])) if len(parts) > 1 else symbols.where(F.substring_index(F.col(qualified), ".", -1) == query)
    rows = rows.withColumn("exact", F.col(qualified) == query)
    any_ = rows.agg(F.max("exact").alias("_any"))  # one row
    return rows.crossJoin(F.broadcast(any_)).where(F.col("exact") | ~F.col("_any")).drop("_any")


def repo_map(files: DataFrame, symbols: DataFrame, budget_bytes: int, per_file: int = 8, first: int = 20, later: int = 3) -> DataFrame:
    """files: path, rank; symbols: path, id, name, kind, signature, depth, parent_kind, line, exported. Lines of the map that fit, in order.

    Files go by rank, number of symbols, path; a symbol's cost counts after its file's; the first line that doesn't fit ends the map.
    """
    types = ("class", "struct", "interface", "type", "enum", "module", "namespace", "package")
    kind_rank = F.when(F.col("kind").isin(*types), 0).when(F.col("kind").isin("function", "constructor"), 1).when(F.col("kind") == "method", 2).otherwise(3)
    some = symbols.where((F.col("depth") == 0) | ((F.col("depth") == 1) & F.col("parent_kind").isin(*types)))
    text = F.trim(F.regexp_replace(F.concat_ws(" ", "kind", "name", F.concat(F.lit(" "), F.coalesce("signature", F.lit("")))), r"\s+", " "))
    counts = symbols.groupBy("path").agg(F.count(F.lit(1)).alias("n_symbols"))
    order = [F.col("rank").desc(), F.col("n_symbols").desc(), F.col("path")]
    some_files = files.join(counts, "path").orderBy(*order).limit(budget_bytes // 3 + 1)  # a file's line costs three bytes or more
    ranked = some_files.withColumn("file_rank", F.row_number().over(Window.orderBy(*order)))
    some = some.withColumn("_k", F.row_number().over(Window.partitionBy("path").orderBy(F.col("exported").desc(), kind_rank, "depth", "line", "id")))
    rows = some.join(ranked, "path").where(F.col("_k") <= F.when(F.col("file_rank") <= first, per_file).otherwise(min(per_file, later)))
    listed = rows.select("file_rank", "path", F.row_number().over(Window.partitionBy("path").orderBy("line", "id")).alias("k"), text.alias("text"))
    heads = ranked.select("file_rank", "path", F.lit(0).alias("k"), F.col("path").alias("text"))
    every = heads.unionByName(listed).withColumn("cost", F.octet_length("text") + F.when(F.col("k") == 0, 2).otherwise(3))
    from corvane.operators.budget import first_overflow

    return first_overflow(every, F.col("cost"), [F.col("file_rank"), F.col("k")], budget_bytes, least=3)


def collisions(symbols: DataFrame, renames: DataFrame) -> DataFrame:
    """renames (id, new_name, container, scope) with collisions: symbols (id, name, container, scope) that bear the new name in the same container and scope, the symbol itself left out."""
    keys = ["id", "new_name", "container", "scope"]
    bearers = symbols.where("id is not null").select("id", F.col("name").alias("new_name"), "container", "scope")
    # counted by name first: a name that many bear meets its renames as one row
    here = lambda df: (F.col("new_name") == df["_n"]) & (F.col("scope") == df["_s"]) & F.col("container").eqNullSafe(df["_c"])
    names = [F.col("new_name").alias("_n"), F.col("scope").alias("_s"), F.col("container").alias("_c")]
    every = bearers.groupBy(*names).agg(F.count(F.lit(1)).alias("_every"))
    own = bearers.groupBy(F.col("id").alias("_i"), *names).agg(F.count(F.lit(1)).alias("_own"))
    rows = renames.groupBy(*keys).agg(F.count(F.lit(1)).alias("_times"))
    rows = rows.join(own, (F.col("id") == own["_i"]) & here(own), "left").drop("_i", "_n", "_s", "_c").join(every, here(every), "left").drop("_n", "_s", "_c")
    others = F.coalesce("_every", F.lit(0)) - F.coalesce("_own", F.lit(0))
    return rows.select(*keys, F.when(F.col("id").isNull(), 0).otherwise(F.col("_times") * others).cast("long").alias("collisions"))


def taken_names(symbols: DataFrame, new_name: str, scope: str) -> DataFrame:
    """Per scope, how many symbols bear a name already: for renaming many symbols to one name."""
    return symbols.where(F.col("name") == new_name).groupBy(scope).agg(F.count(F.lit(1)).alias("collisions"))


def counted_unless_ambiguous(candidates: DataFrame, key: str) -> DataFrame:
    """key and ambiguous: whether a name stands for several symbols."""
    return candidates.groupBy(key).agg((F.countDistinct("id") > 1).alias("ambiguous"))


def dead_code(symbols: DataFrame, references: DataFrame, include_exported: bool = False, after: tuple | None = None, limit: int = 50, budget: int = 100, ignore_names: list[str] = (), ignore_paths: list[str] = (), order: tuple[str, ...] = ("path", "line", "id")) -> DataFrame:
    """A page of symbols that nothing refers to. symbols: id, path, language, name, kind, line, end_line, local (see
    with_local), exported, sensitive (see with_sensitive), can_implement, implements; references: id, path, line.

    Exclusions come first, so that the budget is spent on candidates: the first budget of them after the key are looked
    at, those without use from outside their lines remain, with how sure that is. order: the columns that pages go by
    (after has a value for each).
    """
    from corvane.operators.budget import keyset_page

    reason = exclusion("language", "name", "kind", "path", F.col("local"), F.col("exported"), include_exported, ignore_names, ignore_paths)
    kinds = ("function", "method", "class", "struct", "interface", "enum", "constant")
    candidates = symbols.where(F.col("kind").isin(*kinds)).withColumn("excluded", reason).where("excluded is null and not implements")
    page = F.broadcast(keyset_page(candidates, list(order), after, budget))  # budget rows
    free = unreferenced(page, references)
    sure = confidence(F.col("exported"), F.col("sensitive"), F.col("kind"), F.col("can_implement"), F.col("language").isin(*REFLECTIVE))
    return free.withColumn("confidence", sure).orderBy(*order).limit(limit).select("path", "line", "id", "name", "kind", "confidence")


def blast_radius(references: DataFrame, symbols: DataFrame, calls: DataFrame, imports: DataFrame, subject: str, subject_path: str, depth: int = 2, import_depth: int = 1) -> DataFrame:
    """All that depends on a symbol: evidence, path, id, line, count, depth. References (id, path, line) are grouped by the
    symbol that encloses them (symbols: id, path, line, end_line), callers come from calls (src, dst), importers from imports (src, dst)."""
    from corvane.operators.graph import walk
    from corvane.operators.intervals import innermost

    own = references.where(F.col("id") == subject).select(F.col("path"), F.col("line").alias("at"))
    spans = symbols.select("path", F.col("id").alias("inner_id"), "line", "end_line")
    places = own.groupBy("path", "at").agg(F.count(F.lit(1)).alias("n"))
    held = innermost(places, spans, "path", "at", "line", "end_line", ["path", "at"], "inner_id")
    uses = held.groupBy("path", F.col("inner_id").alias("id")).agg(F.sum("n").alias("count"), F.min("at").alias("line"))
    uses = uses.select(F.lit("reference").alias("evidence"), "path", "id", "line", "count", F.lit(1).alias("depth"))
    spark = symbols.sparkSession
    kind = lambda df, name: df.schema[name].dataType
    start = spark.range(1).select(F.lit(subject).cast(kind(calls, "dst")).alias("id"))
    callers = walk(calls, start, depth, "in").where("depth > 0").join(symbols.select("id", "path", "line"), "id", "left")
    callers = callers.select(F.lit("caller").alias("evidence"), "path", "id", "line", F.lit(1).cast("long").alias("count"), "depth")
    origin = spark.range(1).select(F.lit(subject_path).cast(kind(imports, "dst")).alias("id"))
    files = walk(imports, origin, import_depth, "in").where("depth > 0")
    files = files.select(F.lit("importer").alias("evidence"), F.col("id").alias("path"), F.lit(None).cast(kind(symbols, "id")).alias("id"), F.lit(None).cast(kind(symbols, "line")).alias("line"), F.lit(1).cast("long").alias("count"), "depth")
    return uses.unionByName(callers).unionByName(files)


def blast_page(rows: DataFrame, room: int = 50) -> DataFrame:
    """At most room rows, shared fairly by evidence in the order reference, caller, importer."""
    from corvane.operators.budget import fair_cap

    rank = F.array_position(F.array(*[F.lit(e) for e in ("reference", "caller", "importer")]), F.col("evidence"))
    return fair_cap(rows, "evidence", [F.col("depth"), F.col("path"), F.col("line"), F.col("id")], room, rank)


def type_hierarchy(edges: DataFrame, roots: DataFrame, direction: str = "both", depth: int = 5, limit: int = 300, implementations: DataFrame | None = None) -> DataFrame:
    """Super- and subtypes in depth-first order: direction, id, depth, repeat, evidence. edges: src (the subtype), dst (the
    supertype). Without edges of a hierarchy, subtypes are those that implement the root (implementations: src, dst), one level deep."""
    from corvane.operators.graph import hierarchy

    out = None
    if implementations is not None and not edges.limit(1).count():
        rows = implementations.join(roots.select(F.col("id").alias("dst")), "dst").select(F.lit("subtype").alias("direction"), F.col("src").alias("id"), F.lit(1).alias("depth"), F.lit(False).alias("repeat"), F.lit("implementation").alias("evidence"))
        return rows.orderBy("id").limit(limit)
    turned = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    for name, links in (("supertype", edges), ("subtype", turned)):
        if direction in ("both", name + "s"):
            part = hierarchy(links, roots, depth, limit).where("depth > 0").select(F.lit(name).alias("direction"), "id", "depth", "repeat", F.lit("type_hierarchy").alias("evidence"))
            out = part if out is None else out.unionByName(part)
    return out
