"""Scalar text functions: built-in expressions where they suffice, Arrow-batched functions where not."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: An identifier's parts: runs of capitals, capitalised words, letters without case, digits.
PARTS = r"(\p{Lu}+(?!\p{Ll})|\p{Lu}?\p{Ll}+|[\p{Lt}\p{Lm}\p{Lo}]+|\p{Nd}+)"


#: For bytes.translate: A-Z to a-z.
LOWER_BYTES = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def tokenize(c: Column) -> Column:
    """Camel, snake, acronym, digit and script parts, lower-cased."""
    return F.transform(F.regexp_extract_all(c, F.lit(PARTS), 1), F.lower)


def normalise(c: Column) -> Column:
    """Letters and digits only, lower-cased."""
    return F.lower(F.regexp_replace(c, r"[^\p{L}\p{Nd}]", ""))


def last_segment(c: Column) -> Column:
    """What follows the last dot, unless nothing does."""
    return F.when(F.endswith(c, F.lit(".")), c).otherwise(F.substring_index(c, ".", -1))


def trigrams(c: Column) -> Column:
    """Distinct windows of three characters; a shorter text is its own; an empty one has none."""
    n = F.length(c)
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, F.lit(3))))
    return F.when(n == 0, F.array().cast("array<string>")).when(n < 3, F.array(c)).otherwise(windows)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two sets; 0 if either is empty."""
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b)))


def osa_distance(a: Column, b: Column) -> Column:
    """Edit distance in which a swap of neighbours counts once and no part is edited twice; null if either is.

    Without two neighbours of one text that stand swapped in the other it is the built-in distance; else the table of
    distances is folded row by row, with the two rows before and the letter before at hand.
    """
    xs, ys = (F.regexp_extract_all(c, F.lit("(?s)(.)"), 1) for c in (a, b))
    n, m = F.size(xs), F.size(ys)
    pairs = lambda zs, k, swapped: F.when(k < 2, F.array().cast("array<string>")).otherwise(F.transform(F.sequence(F.lit(1), F.greatest(k - 1, F.lit(1))), lambda i: F.concat(F.get(zs, i), F.get(zs, i - 1)) if swapped else F.concat(F.get(zs, i - 1), F.get(zs, i))))
    swaps = F.arrays_overlap(F.filter(pairs(xs, n, True), lambda p: F.left(p, F.lit(1)) != F.right(p, F.lit(1))), pairs(ys, m, False))

    def cell(acc, x, row, j):
        ordinary = F.least(F.get(row, j - 1) + 1, F.get(acc.old, j) + 1, F.get(acc.old, j - 1) + (x != F.get(ys, j - 1)).cast("int"))
        swapped = (F.get(acc.old, F.lit(0)) >= 1) & (j >= 2) & (x == F.get(ys, j - 2)) & (acc.before == F.get(ys, j - 1))
        return F.concat(row, F.array(F.when(swapped, F.least(ordinary, F.get(acc.older, j - 2) + 1)).otherwise(ordinary)))

    def row_of(acc, x):
        return F.aggregate(F.sequence(F.lit(1), m), F.array(F.get(acc.old, F.lit(0)) + 1), lambda row, j: cell(acc, x, row, j))

    first = F.sequence(F.lit(0), m)
    start = F.struct(first.alias("older"), first.alias("old"), F.lit("").alias("before"))
    folded = F.aggregate(xs, start, lambda acc, x: F.struct(acc.old.alias("older"), row_of(acc, x).alias("old"), x.alias("before")), lambda acc: F.element_at(acc.old, -1))
    return F.when((n > 1) & (m > 1) & swaps, folded).otherwise(F.levenshtein(a, b))


def fuzzy_score(distance: Column, similarity: Column, a: Column, b: Column) -> Column:
    """0 if not alike: a distance of a quarter of a at most, or 0.3 of similarity; else the mean of both measures."""
    longest = F.greatest(F.length(a), F.length(b), F.lit(1))
    alike = (distance <= F.greatest(F.lit(1), F.floor(F.length(a) / 4))) | (similarity >= 0.3)
    return F.when(alike, F.greatest(F.lit(0.001), ((1 - distance / longest) + similarity) / 2)).otherwise(0.0)


def nearest_ok(distance: Column, similarity: Column, query: Column, name: Column) -> Column:
    """A near name: by distance, by similarity, or one holds the other (three bytes at least)."""
    holds = (F.octet_length(query) >= 3) & (F.octet_length(name) >= 3) & (F.contains(name, query) | F.contains(query, name))
    return (distance <= F.greatest(F.lit(2), F.floor(F.length(query) / 2))) | (similarity >= 0.3) | holds


def word_pattern(query: str) -> str:
    """The query, standing between characters that are no letters, digits or underscores."""
    return r"(?<![\p{L}\p{Nd}_])" + quoted(query) + r"(?![\p{L}\p{Nd}_])"


def quoted(query: str) -> str:
    """A literal as a pattern, valid in Java."""
    return re.sub(r"([^\w\s]|_)", lambda m: "\\" + m[0] if m[0] != "_" else "_", query)


def byte_column(line: Column, char_index: Column) -> Column:
    """1-based byte column of a 0-based character offset."""
    return F.octet_length(F.substring(line, F.lit(1), char_index)) + 1


def utf16_column(line: Column, char_index: Column) -> Column:
    """0-based UTF-16 column of a 0-based character offset."""
    return (F.octet_length(F.encode(F.substring(line, F.lit(1), char_index), "UTF-16BE")) / 2).cast("int")


def estimate_tokens(c: Column) -> Column:
    return F.ceil(F.octet_length(c) / 4)


def squash(x: Column) -> Column:
    """Into [0, 1), with the order kept."""
    return F.least(x / (1 + x), F.lit(0.999999))


def round_half_up(x: Column, places: int = 3) -> Column:
    scale = float(10**places)
    return F.floor(x.cast("double") * scale + 0.5) / scale


def content_hash(c: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(c.cast("binary"), 256))


def clip_bytes(text: str, most: int, mark: str = "...") -> str:
    """At most so many bytes, the mark included, and no cut inside a character."""
    raw = text.encode()
    if len(raw) <= most:
        return text
    room = max(0, most - len(mark.encode()))
    return raw[:room].decode("utf-8", "ignore") + mark


def clip_around(line: str, start: int, end: int, most: int = 240) -> str:
    """A window of bytes around a match (byte offsets); what is cut shows as counts."""
    raw = line.encode()
    if len(raw) <= most:
        return line
    size = min(most, max(end - start, 0))
    lead = (most - size) // 2
    lo = max(0, min(start - lead, len(raw) - most))
    hi = min(len(raw), lo + most)
    while lo > 0 and raw[lo] & 0xC0 == 0x80:
        lo += 1
    while hi < len(raw) and raw[hi] & 0xC0 == 0x80:
        hi -= 1
    left = f"[+{lo}B]…" if lo else ""
    right = f"…[+{len(raw) - hi}B]" if hi < len(raw) else ""
    return left + raw[lo:hi].decode("utf-8", "ignore") + right


@F.pandas_udf(StringType())
def clip_line(lines: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
    return pd.Series([None if x is None else clip_around(x, int(s), int(e)) for x, s, e in zip(lines, starts, ends)])


def clip_window(most: int):
    """clip_line with another width."""

    @F.pandas_udf(StringType())
    def clip(lines: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.Series:
        return pd.Series([None if x is None else clip_around(x, int(s), int(e), most) for x, s, e in zip(lines, starts, ends)])

    return clip


def clipped(most: int):
    @F.pandas_udf(StringType())
    def clip(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: None if t is None else clip_bytes(t, most))

    return clip


def cap_source(c: Column, lines: int, most_bytes: int) -> Column:
    """The first lines, then the first bytes."""
    some = F.array_join(F.slice(F.split(c, "\n"), 1, lines), "\n")
    return F.when(F.octet_length(some) <= most_bytes, some).otherwise(clipped(most_bytes)(some))


def first_sentence(c: Column, most: int = 200) -> Column:
    """Up to the first full stop before a space, or the end of the paragraph."""
    paragraph = F.regexp_replace(F.split(F.trim(c), r"\n\s*\n").getItem(0), r"\s+", " ")
    found = F.regexp_extract(paragraph, r"^(.*?\.)(?:\s|$)", 1)
    return F.substring(F.when(found == "", paragraph).otherwise(found), 1, most)


def package_of(path: Column) -> Column:
    """The directory of a path; "." at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit("."))


def file_base(path: Column) -> Column:
    """The name of a file without its directories and its last ending."""
    name = F.substring_index(path, "/", -1)
    return F.when(name.rlike(r"^.+\.[^.]*$"), F.regexp_replace(name, r"\.[^.]*$", "")).otherwise(name)


def identifier_at(line: Column, byte_col: Column) -> Column:
    """The word of letters, digits and underscores around a byte column (from 1); "" if there is none."""
    head = F.substring(line.cast("binary"), F.lit(1), byte_col - 1).cast("string")
    tail = F.substring(line.cast("binary"), byte_col, F.octet_length(line)).cast("string")
    word = r"[\p{L}\p{Nd}_]"
    return F.concat(F.regexp_extract(head, f"({word}*)$", 1), F.regexp_extract(tail, f"^({word}*)", 1))


def ancestors(path: Column) -> Column:
    """"." and every directory above a path, from the top."""
    parts = F.split(path, "/")
    above = F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts) - 1, F.lit(1))), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    return F.when(F.size(parts) < 2, F.array(F.lit("."))).otherwise(F.concat(F.array(F.lit(".")), above))


#: Endings of stems, marks inside names, and directories that tests have.
TEST_NAMES = r"(^|/)test_[^/]*\.py$|(^|/)conftest\.py$|_(test|spec)(\.[^./]*)?$|(^|/)[^/]*\.(test|spec)\.[^/]*$|tests?\.(java|kt)$"
TEST_DIRECTORIES = r"(^|/)(test|tests|spec|specs|__tests__)/"


def is_test_file(path: Column) -> Column:
    return F.lower(path).rlike(TEST_NAMES) | F.lower(path).rlike(TEST_DIRECTORIES)


#: Languages by whole name, and by ending.
NAMES = {
    "go.mod": "gomod", "go.work": "gowork", "go.sum": "gosum", "go.work.sum": "gosum", "Dockerfile": "dockerfile", "Makefile": "make",
    "GNUmakefile": "make", "CMakeLists.txt": "cmake", "Gemfile": "ruby", "Rakefile": "ruby",
}
LANGUAGES = {
    "go": "go", "gotmpl": "gotmpl", "tmpl": "gotmpl", "tpl": "gotmpl", "rs": "rust", "py": "python", "pyi": "python", "pyw": "python",
    "c": "c", "h": "c", "cc": "cpp", "cpp": "cpp", "cxx": "cpp", "hh": "cpp", "hpp": "cpp", "hxx": "cpp", "m": "objective-c", "mm": "objective-cpp",
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "typescriptreact", "js": "javascript", "mjs": "javascript", "cjs": "javascript", "jsx": "javascriptreact",
    "java": "java", "kt": "kotlin", "kts": "kotlin", "scala": "scala", "sbt": "scala", "rb": "ruby", "php": "php", "cs": "csharp", "fs": "fsharp", "swift": "swift", "dart": "dart", "lua": "lua", "zig": "zig",
    "hs": "haskell", "ml": "ocaml", "mli": "ocaml", "ex": "elixir", "exs": "elixir", "erl": "erlang", "nix": "nix", "tf": "terraform", "tfvars": "terraform", "proto": "proto", "sql": "sql",
    "sh": "shellscript", "bash": "shellscript", "zsh": "shellscript", "fish": "fish", "ps1": "powershell", "vim": "vim", "el": "lisp", "clj": "clojure", "toml": "toml", "json": "json", "jsonc": "jsonc", "yaml": "yaml", "yml": "yaml", "xml": "xml",
    "html": "html", "htm": "html", "css": "css", "scss": "scss", "less": "less", "vue": "vue", "svelte": "svelte", "md": "markdown", "mdx": "mdx", "rst": "restructuredtext", "tex": "latex",
    "r": "r", "jl": "julia", "pl": "perl", "pm": "perl", "groovy": "groovy", "gradle": "groovy", "dockerfile": "dockerfile",
}
#: Languages of prose, data and configuration.
PROSE = ("", "markdown", "mdx", "restructuredtext", "latex", "json", "jsonc", "yaml", "toml", "xml", "gomod", "gosum", "gowork")


def language_id(path: Column) -> Column:
    """By the whole name, then the ending; "" where neither is known or the name begins with its only dot."""
    base = F.substring_index(path, "/", -1)
    pick = lambda d, k: F.element_at(F.create_map(*[F.lit(x) for kv in d.items() for x in kv]), k)
    ending = F.when(base.rlike(r"^[^.].*\.[^.]+$|^\..*\.[^.]+$"), F.lower(F.substring_index(base, ".", -1)))
    return F.coalesce(pick(NAMES, base), pick(LANGUAGES, ending), F.lit(""))


def is_code(language: Column) -> Column:
    return ~language.isin(*PROSE)


def parse_id(c: Column) -> Column:
    """path::Container.Name#kind~N in its parts: the path ends at the first ::, the kind begins at the last #."""
    path = F.substring_index(c, "::", 1)
    rest = F.substring(c, F.length(path) + 3, F.length(c))
    ordinal = F.coalesce(F.nullif(F.regexp_extract(rest, r"~(\d+)$", 1), F.lit("")).cast("int"), F.lit(1))
    plain = F.regexp_replace(rest, r"~\d+$", "")
    kind = F.substring_index(plain, "#", -1)
    return F.struct(path.alias("path"), F.substring(plain, F.lit(1), F.length(plain) - F.length(kind) - 1).alias("name"), kind.alias("kind"), ordinal.alias("ordinal"))


def id_name(c: Column) -> Column:
    """A receiver written (*T).M or (T[X]).M as T.M."""
    return F.regexp_replace(c, r"^\(\*?([\p{L}\p{Nd}_]+)(?:\[[^\]]*\])?\)\.", "$1.")


def eol_kind(c: Column) -> Column:
    crlf, lf, cr = F.contains(c, F.lit("\r\n")), c.rlike(r"(?<!\r)\n"), c.rlike(r"\r(?!\n)")
    n = crlf.cast("int") + lf.cast("int") + cr.cast("int")
    return F.when(n > 1, "mixed").when(crlf, "crlf").when(cr, "cr").when(lf, "lf").otherwise("none")


def to_lf(c: Column) -> Column:
    return F.regexp_replace(c, r"\r\n|\r", "\n")


def rule_id(source: Column, code: Column, default: str = "diagnostic") -> Column:
    """source/code, or what there is of it."""
    given = lambda x: F.nullif(x, F.lit(""))
    return F.coalesce(F.nullif(F.concat_ws("/", given(source), given(code)), F.lit("")), F.lit(default))


def is_empty_result(c: Column) -> Column:
    return F.coalesce(F.trim(c), F.lit("")).isin("", "null", "[]", "{}", '""')


#: DuckDB forms of two functions above, for the comparison queries.
def sql_tokens(x: str) -> str:
    steps = [(r"[^\p{L}\p{Nd}]+", " "), (r"(\p{L})(\p{Nd})", r"\1 \2"), (r"(\p{Nd})(\p{L})", r"\1 \2"), (r"([\p{Lu}\p{Ll}])([\p{Lt}\p{Lm}\p{Lo}])", r"\1 \2"), (r"([\p{Lt}\p{Lm}\p{Lo}])([\p{Lu}\p{Ll}])", r"\1 \2"), (r"(\p{Ll})(\p{Lu})", r"\1 \2"), (r"(\p{Lu})(\p{Lu}\p{Ll})", r"\1 \2")]
    for pattern, to in steps:
        x = f"regexp_replace({x}, '{pattern}', '{to}', 'g')"
    return f"list_filter(string_split(lower({x}), ' '), lambda t: t <> '')"


def sql_normalise(x: str) -> str:
    return rf"lower(regexp_replace({x}, '[^\p{{L}}\p{{Nd}}]', '', 'g'))"
