"""Declarations in source text: signatures, leading comments, docstrings, import headers. Arrow-batched, one file at a time."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from corvane.functions.text import clip_bytes

SIGNATURE_LINES, SIGNATURE_BYTES, HEADER_LINES = 6, 240, 80
_COMMENT = re.compile(r"^\s*(//+!?|#+(?!\[)|--+|;+)\s?(.*)$")
#: Lines that tools read and people don't.
_DIRECTIVE = re.compile(r"^\s*(//go:|//nolint|//lint:|// \+build|#!|# type:|# noqa|# pylint|//\s*eslint|@\w|#\[)")
_IMPORT = re.compile(r"^\s*(import\b|from\s+\S+\s+import\b|package\b|use\b|extern\s+crate\b|mod\s+\w+;|#\s*include\b|local\s+\w+\s*=\s*require\b|(const|let|var)\s.*\brequire\(|export\s.*\bfrom\b|['\"]use strict)")


def signature_at(lines: list[str], line: int) -> str:
    """The declaration that begins at a line (from 1): until its brackets balance, without an open brace at the end."""
    depth, out = 0, []
    for text in lines[line - 1 : line - 1 + SIGNATURE_LINES]:
        out.append(text.strip())
        for c in re.sub(r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\])*'", "", text):
            depth += (c in "([") - (c in ")]")
        if depth <= 0:
            break
    found = re.sub(r"\s*[{:]\s*$", "", " ".join(out))
    return clip_bytes(found, SIGNATURE_BYTES)


def comment_above(lines: list[str], line: int) -> str:
    """The comment that ends right above a line, without its marks; decorators and directives in between are passed over."""
    at, out = line - 2, []
    while at >= 0 and (_DIRECTIVE.match(lines[at]) and not out):
        at -= 1
    if at >= 0 and lines[at].rstrip().endswith("*/"):
        end = at
        while at >= 0 and "/*" not in lines[at]:
            at -= 1
        body = "\n".join(lines[max(at, 0) : end + 1])
        body = re.sub(r"^.*?/\*+!?|\*+/\s*$", "", body, flags=re.S)
        return "\n".join(re.sub(r"^\s*\*? ?", "", x) for x in body.split("\n")).strip()
    while at >= 0 and (m := _COMMENT.match(lines[at])):
        if not _DIRECTIVE.match(lines[at]):
            out.append(m[2])
        at -= 1
    return "\n".join(reversed(out)).strip()


def docstring_below(lines: list[str], line: int) -> str:
    """The string that opens the body of a declaration."""
    at = line - 1
    while at < len(lines) and not lines[at].rstrip().endswith(":"):
        at += 1
    body = "\n".join(lines[at + 1 :]).lstrip()
    m = re.match(r"[rRuU]?(\"\"\"|''')(.*?)\1", body, re.S) or re.match(r"[rRuU]?([\"'])((?:\\.|(?!\1)[^\\\n])*)\1", body)
    return "\n".join(x.strip() for x in m[2].strip().split("\n")) if m else ""


def import_header(lines: list[str]) -> int:
    """The last line (from 1) of the imports at the head of a file; 0 without any."""
    last, open_ = 0, 0
    for k, text in enumerate(lines[:HEADER_LINES], 1):
        if _IMPORT.match(text) or open_ > 0:
            last = k
            open_ += text.count("(") + text.count("{") - text.count(")") - text.count("}")
    return last


def _per_row(f):
    def run(contents: pd.Series, at: pd.Series) -> pd.Series:
        return pd.Series([None if c is None else f(c.split("\n"), int(k)) for c, k in zip(contents, at)])

    return F.pandas_udf(run, StringType())


def signature(content, line):
    return _per_row(signature_at)(content, line)


def doc_above(content, line):
    return _per_row(comment_above)(content, line)


def docstring(content, line):
    return _per_row(docstring_below)(content, line)


def header_of(content, most):
    """The lines up to the last import at the head of a file; "" without any."""
    return _per_row(lambda lines, most_: "\n".join(lines[: import_header(lines[:most_])]))(content, most)
