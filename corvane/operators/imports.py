"""Import statements of six language families, and their resolution to files by a cascade of joins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from corvane.operators.graph import cut

Found = tuple[str, str, list[str], int]  # spec, kind, names, line

OUT = "path string, language string, spec string, kind string, names array<string>, line int"


def _line_of(text: str, at: int) -> int:
    return text.count("\n", 0, at) + 1


def _blank(text: str, pattern: re.Pattern, keep: Callable[[str], bool]) -> str:
    """Text of equal length in which what the pattern finds is blank, unless keep says to leave it; newlines stay."""
    return pattern.sub(lambda m: m[0] if keep(m[0]) else re.sub(r"[^\n]", " ", m[0]), text)


_C_LIKE = re.compile(r"//[^\n]*|/\*.*?\*/|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`", re.S)
_PY = re.compile(r"#[^\n]*|(?:[rRbBuUfF]{0,2})(?:\"\"\".*?\"\"\"|'''.*?''')|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_LUA = re.compile(r"--\[(=*)\[.*?\]\1\]|--[^\n]*|\[(=*)\[.*?\]\2\]|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", re.S)
_RUST = re.compile(r"//[^\n]*|/\*.*?\*/|b?r(#*)\".*?\"\1|b?\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", re.S)


def _is_string(s: str) -> bool:
    return s[0] in "\"'`"


def go_imports(text: str) -> list[Found]:
    code = _blank(text, _C_LIKE, lambda s: s[0] in "\"`")
    out: list[Found] = []
    one = re.compile(r"(?:([\w.]+)\s+)?([\"`])([^\"`\n]+)\2")
    for m in re.finditer(r"(?m)^\s*import\s*(\(([^)]*)\)|[^\n]*)", code):
        inner_at = m.start(2) if m[2] is not None else m.start(1)
        for n in one.finditer(m[2] if m[2] is not None else m[1]):
            out.append((n[3], "import", [n[1]] if n[1] else [], _line_of(code, inner_at + n.start(3))))
    return out


def python_imports(text: str) -> list[Found]:
    code = _blank(text, _PY, lambda s: False)
    code = re.sub(r"\\\n", "  ", code)
    out: list[Found] = []
    for m in re.finditer(r"(?m)(?:^|;)[ \t]*(?:from[ \t]+(\.*[ \t]*[\w.]*)[ \t]+import[ \t]+(\([^)]*\)|[^\n;]+)|import[ \t]+([^\n;]+))", code):
        line = _line_of(code, m.start(1) if m[1] is not None else m.start(3))
        names = lambda s: [re.split(r"\s+as\s+", x.strip())[0] for x in s.strip("() \t\n").split(",") if x.strip()]
        if m[1] is not None:
            out.append((m[1].replace(" ", ""), "import", names(m[2]), line))
        else:
            out += [(n, "import", [], line) for n in names(m[3]) if re.fullmatch(r"[\w.]+", n)]
    return out


def javascript_imports(text: str) -> list[Found]:
    code = _blank(text, _C_LIKE, lambda s: s[0] in "\"'")
    # a keyword inside a string is no statement: strings that follow none of these words are blanked
    out: list[Found] = []
    q = r"([\"'])([^\"'\n]+)\{n}"
    rules = [
        (r"(?<![\w.$])import\s+(?:type\s+)?([\w$*{},\s]+?)\s+from\s*" + q.format(n=2), "import", 3, 1),
        (r"(?<![\w.$])import\s*" + q.format(n=1), "import", 2, None),
        (r"(?<![\w.$])export\s+(?:type\s+)?([\w$*{},\s]+?)\s+from\s*" + q.format(n=2), "reexport", 3, 1),
        (r"(?<![\w.$])import\s*\(\s*" + q.format(n=1) + r"\s*[,)]", "dynamic", 2, None),
        (r"(?<![\w.$])require\s*\(\s*" + q.format(n=1) + r"\s*\)", "require", 2, None),
    ]
    strings = [m.span() for m in re.finditer(r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'", code)]
    for pattern, kind, spec, names in rules:
        for m in re.finditer(pattern, code):
            if any(a < m.start() < b for a, b in strings):
                continue
            listed = re.findall(r"[\w$]+(?=\s*(?:,|}|$|\s+as\b))", re.sub(r"\s+as\s+[\w$]+", "", m[names])) if names else []
            out.append((m[spec], kind, listed, _line_of(code, m.start())))
    return sorted(out, key=lambda f: f[3])


def rust_imports(text: str) -> list[Found]:
    code = _blank(text, _RUST, lambda s: False)
    out: list[Found] = []

    def flat(tree: str, prefix: str = "") -> list[str]:
        tree = tree.strip()
        if "{" not in tree:
            return [prefix + re.split(r"\s+as\s+", tree)[0].strip()] if tree else []
        head, _, rest = tree.partition("{")
        inner, depth, start, parts = rest.rsplit("}", 1)[0], 0, 0, []
        for i, c in enumerate(inner + ","):
            depth += (c == "{") - (c == "}")
            if c == "," and depth == 0:
                parts.append(inner[start:i])
                start = i + 1
        return [x for p in parts for x in flat(p, prefix + head.strip())]

    for m in re.finditer(r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?(use\s+([^;]+);|mod\s+(\w+)\s*;|extern\s+crate\s+(\w+))", code):
        line = _line_of(code, m.start(1))
        if m[2]:
            out += [(re.sub(r"\s+", "", x).removesuffix("::self"), "use", [], line) for x in flat(m[2])]
        elif m[3]:
            out.append((m[3], "mod", [], line))
        else:
            out.append((m[4], "extern", [], line))
    return out


def c_imports(text: str) -> list[Found]:
    code = _blank(text, _C_LIKE, lambda s: s[0] == '"')
    return [(m[2], "system" if m[1] == "<" else "include", [], _line_of(code, m.start(1))) for m in re.finditer(r"(?m)^[ \t]*#[ \t]*include[ \t]*([<\"])([^>\"\n]+)[>\"]", code)]


def lua_imports(text: str) -> list[Found]:
    code = _blank(text, _LUA, _is_string)
    return [(m[2], "require", [], _line_of(code, m.start())) for m in re.finditer(r"(?<![\w.:])require\s*\(?\s*([\"'])([^\"'\n]+)\1", code)]


#: One extractor for each language; more can be put in.
EXTRACTORS: dict[str, Callable[[str], list[Found]]] = {"go": go_imports, "python": python_imports, "javascript": javascript_imports, "javascriptreact": javascript_imports, "typescript": javascript_imports, "typescriptreact": javascript_imports, "rust": rust_imports, "c": c_imports, "cpp": c_imports, "lua": lua_imports}


def extract(files: DataFrame) -> DataFrame:
    """files: path, language, content. One row per import; languages without an extractor give none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(p, g, *f) for p, g, c in zip(batch["path"], batch["language"], batch["content"]) if g in EXTRACTORS and c for f in EXTRACTORS[g](c)]
            yield pd.DataFrame(rows, columns=["path", "language", "spec", "kind", "names", "line"])

    return files.select("path", "language", "content").mapInPandas(run, OUT)


#: Endings that a script import may leave out, in order, and first segments of standard libraries.
SCRIPT_ENDINGS = ("", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".json", ".mts", ".cts", "/index.ts", "/index.tsx", "/index.js", "/index.jsx")
NODE = "assert buffer child_process crypto events fs http https net os path process readline stream url util zlib worker_threads".split()
PYTHON = """__future__ abc argparse asyncio base64 collections contextlib copy csv dataclasses datetime enum functools hashlib http inspect
io itertools json logging math operator os pathlib random re shutil socket sqlite3 string struct subprocess sys
tempfile textwrap threading time traceback typing unittest urllib uuid warnings""".split()
LUA = "string table os io math coroutine debug utf8 package bit jit ffi".split()


def _join(base: str, rel: str) -> str | None:
    """base/rel with . and .. taken away; None above the top."""
    out: list[str] = [p for p in base.split("/") if p and p != "."]
    for p in rel.split("/"):
        if p == "..":
            if not out:
                return None
            out.pop()
        elif p and p != ".":
            out.append(p)
    return "/".join(out)


def candidates_of(path: str, language: str, spec: str, kind: str, names: list[str]) -> list[str]:
    """Files that an import may mean, the first choice first. Go packages are resolved by directory instead."""
    here = path.rsplit("/", 1)[0] if "/" in path else ""
    out: list[str | None] = []
    if language == "python":
        dots = len(spec) - len(spec.lstrip("."))
        rest = spec.lstrip(".").replace(".", "/")
        if dots:
            base = _join(here, "/".join([".."] * (dots - 1)))
            bases = [base] if base is not None else []
        else:
            parts = here.split("/") if here else []
            bases = ["/".join(parts[:k]) for k in range(len(parts), -1, -1)] + ["src"]
        for b in bases:
            full = "/".join(x for x in (b, rest) if x)
            out += [f"{full}/{n}.py".lstrip("/") for n in names or []] if dots and not rest else []
            out += [f"{full}.py", f"{full}/__init__.py"] if full else ["__init__.py"]
    elif language.startswith(("javascript", "typescript")):
        if spec.startswith("."):
            full = _join(here, spec)
            if full is not None:
                swapped = [re.sub(r"\.(m|c)?js(x?)$", r".\1ts\2", full)] if re.search(r"\.[mc]?jsx?$", full) else []
                out += [full, *swapped, *[full + e for e in SCRIPT_ENDINGS[1:]]]
    elif language == "rust":
        stem = path.rsplit("/", 1)[-1]
        mod_dir = here if stem in ("mod.rs", "lib.rs", "main.rs") else path.removesuffix(".rs")
        if kind == "mod":
            out += [f"{mod_dir}/{spec}.rs".lstrip("/"), f"{mod_dir}/{spec}/mod.rs".lstrip("/")]
        else:
            parts = spec.split("::")
            top = path.split("src/")[0] + "src" if "src/" in path else here
            base = {"crate": top, "self": mod_dir, "super": _join(mod_dir, "..")}.get(parts[0])
            if base is not None:
                for k in range(len(parts), 1, -1):
                    full = "/".join(x for x in [base, *parts[1:k]] if x)
                    out += [f"{full}.rs", f"{full}/mod.rs"]
                if parts[0] == "self":
                    out.append(path)
    elif language in ("c", "cpp") and kind == "include":
        out += [_join(here, spec), _join("", spec), _join("include", spec)]
    elif language == "lua":
        rel = spec.replace(".", "/")
        parts = here.split("/") if here else []
        for k in range(len(parts), -1, -1):
            full = "/".join([*parts[:k], rel])
            out += [f"{full}.lua", f"{full}/init.lua"]
    return list(dict.fromkeys(x for x in out if x))


@F.udf(ArrayType(StringType()), useArrow=True)
def _candidates(path, language, spec, kind, names):
    return candidates_of(path, language or "", spec or "", kind or "", list(names) if names is not None else [])


def category(language: Column, spec: Column, kind: Column) -> Column:
    """Where an import that is no workspace file belongs."""
    head = F.regexp_extract(spec, r"^([^/.:]+)", 1)
    first = F.substring_index(spec, "/", 1)
    go = F.when(F.contains(first, F.lit(".")), "third-party").otherwise("stdlib")
    python = F.when(F.startswith(spec, F.lit(".")), "unresolved").when(head.isin(*PYTHON), "stdlib").otherwise("third-party")
    script = F.when(F.startswith(spec, F.lit(".")), "unresolved").when(F.startswith(spec, F.lit("node:")) | spec.isin(*NODE), "stdlib").otherwise("third-party")
    rust = F.when(head.isin("crate", "self", "super") | (kind == "mod"), "unresolved").when(head.isin("std", "core", "alloc"), "stdlib").otherwise("third-party")
    return F.when(kind == "system", "system").when(language == "go", go).when(language == "python", python).when(F.startswith(language, F.lit("javascript")) | F.startswith(language, F.lit("typescript")), script).when(language == "rust", rust).when(language == "lua", F.when(head.isin(*LUA), "stdlib").otherwise("third-party")).otherwise("unresolved")


def resolve(imports: DataFrame, files: DataFrame, modules: DataFrame | None = None) -> DataFrame:
    """imports with target (a file; for Go a directory) and category. files: path. modules: module, dir (of Go).

    Candidates are exploded with their priority and joined to the files; the first that exists wins. C includes that
    find nothing so far take the only file that ends with them. The files of a workspace are many, and a plan made from
    columns of another table takes them for few: they meet imports by sorting, never as a broadcast through the driver.
    """
    files = files.select("path")
    rows = cut(imports).withColumn("_id", F.struct("path", "line", "spec", "kind"))  # read from the texts once
    asked = rows.withColumn("_c", F.explode(F.transform(_candidates("path", "language", "spec", "kind", "names"), lambda x, i: F.struct(i.alias("rank"), x.alias("target")))))
    found = asked.select("_id", "_c.rank", "_c.target").join(files.select(F.col("path").alias("target")).distinct().hint("merge"), "target").groupBy("_id").agg(F.min_by("target", "rank").alias("target"))
    found = cut(found)
    base = F.substring_index(F.col("path"), "/", -1)
    inc = rows.where("kind = 'include'").join(found.hint("merge"), "_id", "left_anti").select("_id", "spec", F.substring_index("spec", "/", -1).alias("_base"))
    tails = inc.join(files.select(F.col("path").alias("target"), base.alias("_base")).hint("merge"), "_base").where(F.endswith("target", F.concat(F.lit("/"), F.col("spec")))).groupBy("_id").agg(F.min("target").alias("target"), F.count(F.lit(1)).alias("n")).where("n = 1").drop("n")
    every = found.unionByName(tails)
    if modules is not None:
        modules = modules.select("module", "dir")
        dirs = files.where(F.endswith("path", F.lit(".go"))).select(F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("").alias("target")).distinct()
        go = rows.where("language = 'go'").select("_id", "spec", F.split("spec", "/").alias("_p"))
        heads = go.withColumn("module", F.explode(F.transform(F.sequence(F.lit(1), F.size("_p")), lambda i: F.array_join(F.slice("_p", F.lit(1), i), "/"))))
        best = heads.join(modules, "module").groupBy("_id", "spec").agg(F.max_by(F.struct("module", "dir"), F.length("module")).alias("m"))
        inside = best.select("_id", F.trim(F.concat_ws("/", F.nullif("m.dir", F.lit("")), F.nullif(F.substring("spec", F.length("m.module") + 2, F.length("spec")), F.lit(""))), F.lit("/")).alias("target"))
        every = every.unionByName(inside.join(dirs.hint("merge"), "target").select("_id", "target"))
    out = rows.join(every.hint("merge"), "_id", "left").drop("_id")
    own = (F.col("target") == F.col("path")) & (F.col("language") != "go")
    return out.withColumn("category", F.when(own, "self").when(F.col("target").isNotNull(), "workspace").otherwise(category(F.col("language"), F.col("spec"), F.col("kind")))).withColumn("target", F.when(~F.coalesce(own, F.lit(False)), F.col("target"))).withColumn("external", F.when(F.col("category").isin("stdlib", "third-party", "system"), F.col("spec")))


def go_modules(files: DataFrame, work: DataFrame | None = None) -> DataFrame:
    """module and dir of every go.mod (files: path, content), and of their replacements by local directories; with a go.work
    (work: path, content) only modules that it uses. The nearest statement wins where a module has several."""
    base = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise("")
    text = F.regexp_replace("content", r"//[^\n]*", "")
    mods = files.where(F.substring_index("path", "/", -1) == "go.mod").select(base.alias("at"), text.alias("text"))
    own = mods.select(F.regexp_extract("text", r"(?m)^\s*module\s+(\S+)", 1).alias("module"), F.col("at").alias("dir"), F.lit(1).alias("rank"))
    line = r"(?m)^\s*(?:replace\s+)?(\S+)(?:[ \t]+v\S+)?[ \t]*=>[ \t]*(\.{1,2}/\S*|\.{1,2})[ \t]*$"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(line), 1).alias("module"), F.regexp_extract_all("text", F.lit(line), 2).alias("to"))
    replaced = mods.select("at", F.explode(pairs).alias("p")).select(F.col("p.module").alias("module"), clean_path(F.concat_ws("/", "at", "p.to")).alias("dir"), F.lit(0).alias("rank"))
    rows = own.where("module <> ''")
    if work is not None:
        at = work.select(base.alias("at"), text.alias("text"))
        used = at.select("at", F.explode(F.regexp_extract_all("text", F.lit(r"(?m)^\s*(?:use\s+)?(\.{1,2}(?:/\S*)?)\s*$"), 1)).alias("to"))
        rows = rows.join(used.select(clean_path(F.concat_ws("/", "at", "to")).alias("dir")).distinct(), "dir", "left_semi").select("module", "dir", "rank")
    return rows.unionByName(replaced).groupBy("module").agg(F.min_by("dir", F.struct("rank", "dir")).alias("dir"))


def clean_path(path: Column) -> Column:
    """A path without . and empty segments, each .. taking the segment before it."""
    step = lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, F.lit(1), F.size(acc) - 1)).otherwise(F.concat(acc, F.array(p)))
    return F.array_join(F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), step), "/")


def package_edges(resolved: DataFrame) -> DataFrame:
    """Edges of the graph: importing node to target, the least spec of each, in order. A Go file's node is its directory."""
    here = F.when(F.contains("path", F.lit("/")), F.regexp_replace("path", r"/[^/]*$", "")).otherwise(F.lit("."))
    rows = resolved.where("target is not null").select(F.when(F.col("language") == "go", here).otherwise(F.col("path")).alias("src"), F.col("target").alias("dst"), "spec")
    return rows.groupBy("src", "dst").agg(F.min("spec").alias("spec")).orderBy("src", "dst", "spec")


def imports_of(resolved: DataFrame, path: str, limit: int | None = None) -> DataFrame:
    """The imports of one file in order of line, each with target, category and what it is outside."""
    out = resolved.where(F.col("path") == path).select("line", "spec", "kind", "target", "category", "external").orderBy("line", "spec", "kind")
    return out.limit(limit) if limit else out


def page_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """Hrefs of a page with comments and scripts taken away first: key, pos, href."""
    plain = F.regexp_replace(F.regexp_replace(F.col(html), r"(?s)<!--.*?-->", ""), r"(?is)<script.*?</script>", "")
    return pages.select(key, F.posexplode(F.regexp_extract_all(plain, F.lit(r'href="([^"]*)"'), 1)).alias("pos", "href"))
