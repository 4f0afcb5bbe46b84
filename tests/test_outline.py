from pyspark.sql import functions as F

from corvane.functions import doc
from corvane.operators import outline
from corvane.operators.search import SearchQuery

GO = """package p

import (
	"fmt"
)

// Run does it.
// Twice.
//go:noinline
func Run(
	a int,
	b []string,
) error {
	return nil
}

/*
 * Block text.
 */
type T struct {
""".split("\n")
PY = ['@deco', 'def f(a,', '      b=")"):', '    """Does f.', '', '    More.', '    """', "    return 1", "class C:", "    'One line.'"]


def test_signatures():
    assert doc.signature_at(GO, 10) == "func Run( a int, b []string, ) error"
    assert doc.signature_at(GO, 20) == "type T struct" and doc.signature_at(PY, 2) == 'def f(a, b=")")'
    assert len(doc.signature_at(["x" * 500], 1).encode()) <= 240


def test_comments_and_docstrings():
    assert doc.comment_above(GO, 10) == "Run does it.\nTwice."
    assert doc.comment_above(GO, 20) == "Block text." and doc.comment_above(GO, 1) == ""
    assert doc.docstring_below(PY, 2) == "Does f.\n\nMore." and doc.docstring_below(PY, 9) == "One line."
    assert doc.import_header(GO) == 5 and doc.import_header(["x = 1"]) == 0


def test_columns(spark):
    df = spark.createDataFrame([("\n".join(GO), 10), (None, 1)], "c string, l int")
    got = df.select(doc.signature(F.col("c"), F.col("l")).alias("s"), doc.doc_above(F.col("c"), F.col("l")).alias("d")).collect()
    assert got[0]["s"].startswith("func Run") and got[0]["d"] == "Run does it.\nTwice." and got[1]["s"] is None


def test_listings(spark):
    rows = spark.createDataFrame([("i1", "a.go", "T", "struct", 0, 1, 0, None), ("i2", "a.go", "M", "method", 1, 2, 1, 0), ("i3", "a.go", "N", "method", 1, 5, 2, 0), ("i4", "b.go", "f", "function", 0, 1, 0, None)], "id string, path string, name string, kind string, depth int, line int, ordinal int, parent int")
    got = outline.outline(rows, "a.go", 2).collect()
    assert [r["text"] for r in got] == ["struct T", "  method M"] and got[0]["total"] == 3 and got[0]["truncated"]
    assert [r["id"] for r in outline.enumerate_symbols(rows, SearchQuery("", kinds=("Method",), limit=0)).orderBy("id").collect()] == ["i2", "i3"]
    assert {r["id"]: r["children"] for r in outline.children(rows).collect()}["i1"] == ["M", "N"]
    assert {r["id"]: (r["new"], r["new_parent"]) for r in outline.parent_ordinals(rows).collect()}["i3"] == (2, 0)
    files = spark.createDataFrame([("a.go", "one\ntwo\nthree\n"), ("b.go", "x")], "path string, t string")
    spans = spark.createDataFrame([("a.go", "i1", 2, 3)], "path string, id string, line int, end_line int")
    assert outline.source_slices(files, spans, "path", "t").first()["source"] == "two\nthree"
    diags = spark.createDataFrame([("a", "hint"), ("b", "error")], "p string, s string")
    assert [r["has_errors"] for r in outline.diagnostics(diags, "s", [F.col("p")], 1).collect()] == [True]
