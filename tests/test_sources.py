import json

from corvane.operators import imports
from corvane.sources import readers, segments, sinks


def specs(found, kind=None):
    return [f[0] for f in found if kind is None or f[1] == kind]


def test_python_traps():
    text = '"""doc\nimport no1\n"""\nimport os, sys as s\nimport a.b.c  # import no2\nfrom collections import (deque,\n    OrderedDict)\nfrom . import x\nfrom ..pkg.mod import y as z\nx = "import no3"; import semi\ndef f():\n    import inner.mod\nfrom __future__ import annotations\n\'\'\'\nfrom no4 import q\n\'\'\'\n'
    got = imports.python_imports(text)
    assert specs(got) == ["os", "sys", "a.b.c", "collections", ".", "..pkg.mod", "semi", "inner.mod", "__future__"]
    assert got[3][2] == ["deque", "OrderedDict"] and got[4][2] == ["x"] and got[0][3] == 4 and got[6][3] == 10


def test_go():
    text = 'package p\n// import "no1"\nimport (\n\t"fmt"\n\tx "a/b" // c\n\t_ "side"\n)\nimport `raw`\nvar s = "import \\"no2\\""\n'
    assert [(f[0], f[2]) for f in imports.go_imports(text)] == [("fmt", []), ("a/b", ["x"]), ("side", ["_"]), ("raw", [])]


def test_javascript():
    text = "import a, {b as c} from './a'\nimport 'side'\nexport * from \"./r\"\nconst q = require('fs'); // require('no1')\nconst z = await import('./lazy')\nconst s = \"import x from 'no2'\"\n`require('no3')`\nimport type {T} from './t'\nobj.require('no4')\n"
    got = imports.javascript_imports(text)
    assert {(f[0], f[1]) for f in got} == {("./a", "import"), ("side", "import"), ("./r", "reexport"), ("fs", "require"), ("./lazy", "dynamic"), ("./t", "import")}


def test_rust_c_lua():
    rust = 'use std::{io::{self, Read}, fs};\nmod child;\nextern crate serde;\n// use no1;\nlet s = "use no2;";\npub(crate) use crate::a::b as c;\n'
    assert {(f[0], f[1]) for f in imports.rust_imports(rust)} == {("std::io", "use"), ("std::io::Read", "use"), ("std::fs", "use"), ("child", "mod"), ("serde", "extern"), ("crate::a::b", "use")}
    c = '#include <stdio.h>\n  #  include "x/y.h"\n// #include "no1"\n/* #include "no2" */\n'
    assert [(f[0], f[1]) for f in imports.c_imports(c)] == [("stdio.h", "system"), ("x/y.h", "include")]
    lua = 'local a = require("a.b")\n-- require("no1")\n--[[ require("no2") ]]\nlocal b = require \'c\'\nx.require("no3")\n'
    assert specs(imports.lua_imports(lua)) == ["a.b", "c"]


def test_resolution(spark):
    files = {
        "go.mod": "", "cmd/app/main.go": 'package main\nimport (\n"fmt"\n"example.com/app/internal/core"\n"github.com/x/y"\n"example.com/app/none"\n)', "internal/core/core.go": "package core",
        "py/a.py": "import b\nimport os\nimport numpy\nfrom . import c\nimport a\n", "py/b.py": "", "py/c.py": "", "web/m.ts": "import './n.js'\nimport './dir'\nimport 'node:fs'\nimport 'react'\nimport './gone'\n", "web/n.ts": "", "web/dir/index.ts": "",
        "src/lib.rs": "mod child;\nuse crate::child::T;\nuse std::fs;\n", "src/child.rs": "", "c/m.c": '#include "near.h"\n#include "far.h"\n#include <stdio.h>\n', "c/near.h": "", "deep/down/far.h": "", "lua/m.lua": 'require("u.v")', "lua/u/v/init.lua": "",
    }
    from corvane.functions.text import language_id
    from pyspark.sql import functions as F

    df = spark.createDataFrame(list(files.items()), "path string, content string").withColumn("language", language_id(F.col("path")))
    mods = spark.createDataFrame([("example.com/app", "")], "module string, dir string")
    got = {(r["path"], r["spec"]): (r["target"], r["category"]) for r in imports.resolve(imports.extract(df), df, mods).collect()}
    assert got[("cmd/app/main.go", "fmt")] == (None, "stdlib")
    assert got[("cmd/app/main.go", "example.com/app/internal/core")] == ("internal/core", "workspace")
    assert got[("cmd/app/main.go", "github.com/x/y")] == (None, "third-party")
    assert got[("py/a.py", "b")] == ("py/b.py", "workspace") and got[("py/a.py", "os")] == (None, "stdlib") and got[("py/a.py", "numpy")] == (None, "third-party")
    assert got[("py/a.py", ".")] == ("py/c.py", "workspace") and got[("py/a.py", "a")] == (None, "self")
    assert got[("web/m.ts", "./n.js")] == ("web/n.ts", "workspace") and got[("web/m.ts", "./dir")] == ("web/dir/index.ts", "workspace")
    assert got[("web/m.ts", "node:fs")][1] == "stdlib" and got[("web/m.ts", "react")][1] == "third-party" and got[("web/m.ts", "./gone")][1] == "unresolved"
    assert got[("src/lib.rs", "child")] == ("src/child.rs", "workspace") and got[("src/lib.rs", "crate::child::T")] == ("src/child.rs", "workspace") and got[("src/lib.rs", "std::fs")][1] == "stdlib"
    assert got[("c/m.c", "near.h")] == ("c/near.h", "workspace") and got[("c/m.c", "far.h")] == ("deep/down/far.h", "workspace") and got[("c/m.c", "stdio.h")][1] == "system"
    assert got[("lua/m.lua", "u.v")] == ("lua/u/v/init.lua", "workspace")


DIFF = """diff --git a/m.go b/m.go
--- a/m.go
+++ b/m.go
@@ -3 +3,2 @@ func
-x
+y
+z
@@ -10 +11,0 @@
-q
diff --git a/new.go b/new.go
new file mode 100644
@@ -0,0 +1,3 @@
diff --git a/old.go b/old.go
deleted file mode 100644
@@ -1,2 +0,0 @@
diff --git a/from.go b/to.go
rename from from.go
rename to to.go
diff --git a/b.bin b/b.bin
Binary files a/b.bin and b/b.bin differ
"""


def test_diff(spark):
    got = [tuple(r)[1:] for r in readers.parse_diff(spark.createDataFrame([("c", DIFF)], "k string, t string"), "k", "t").collect()]
    assert ("m.go", "m.go", "M", False, 3, 1, 3, 2) in got and ("m.go", "m.go", "M", False, 10, 1, 11, 0) in got
    assert ("new.go", "new.go", "A", False, 0, 0, 1, 3) in got and ("old.go", "old.go", "D", False, 1, 2, 0, 0) in got
    assert ("from.go", "to.go", "R", False, None, None, None, None) in got and ("b.bin", "b.bin", "M", True, None, None, None, None) in got


def test_log(spark):
    text = "\x01s1\x1fann\x1f2024-01-02T03:04:05+00:00\x02\n3\t1\ta.go\n-\t-\tb.png\n\x01s2\x1fbob\x1f2024-01-03T00:00:00+02:00\x02\n"
    got = [(r["sha"], r["author"], r["path"], r["added"], r["removed"], r["binary"]) for r in readers.parse_log(spark.createDataFrame([(text,)], "t string"), "t").collect()]
    assert got == [("s1", "ann", "a.go", 3, 1, False), ("s1", "ann", "b.png", 0, 0, True)]


def test_symbols(spark):
    span = lambda a, b: {"start": {"line": a, "character": 0}, "end": {"line": b, "character": 0}}
    answer = [{"name": "T", "kind": 23, "range": span(0, 9), "children": [{"name": "(*T).M", "kind": 6, "range": span(2, 3)}]}, {"name": "f", "kind": 12, "range": span(11, 12)}, {"name": "f", "kind": 12, "range": span(20, 21)}, {"name": "odd", "kind": 99, "range": span(30, 30)}]
    got = [(r["id"], r["line"], r["depth"], r["parent"]) for r in readers.read_symbols(spark.createDataFrame([("a.go", json.dumps(answer)), ("b.go", "null")], "p string, j string"), "p", "j").orderBy("line").collect()]
    assert got == [("a.go::T#struct", 1, 0, None), ("a.go::T.M#method", 3, 1, 0), ("a.go::f#function", 12, 0, None), ("a.go::f#function~2", 21, 0, None), ("a.go::odd#kind-99", 31, 0, None)]


def test_files_and_commands(spark, tmp_path):
    (tmp_path / "a" / "node_modules").mkdir(parents=True)
    for name in ("a/x.go", "a/node_modules/y.js", ".hidden", "b.py"):
        (tmp_path / name).write_text("hi")
    got = {r["path"]: r["language"] for r in readers.read_files(spark, str(tmp_path)).collect()}
    assert got == {"a/x.go": "go", "b.py": "python"}
    (tmp_path / "cmds.txt").write_text("search 'two words' x\n\n# note\nbad \"quote\n")
    assert [r["words"] for r in readers.read_commands(spark, str(tmp_path / "cmds.txt")).collect()] == [["search", "two words", "x"], None]


def test_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("a.go", 1, 2, "error", "go/x", "bad"), ("a.go", 3, 1, "hint", "go/x", "odd")], "path string, line int, col int, severity string, rule string, message string")
    run = json.loads(sinks.sarif(rows).first()["sarif"])["runs"][0]
    assert [r["id"] for r in run["tool"]["driver"]["rules"]] == ["go/x"] and [r["level"] for r in run["results"]] == ["error", "note"]
    assert json.loads(sinks.envelope(rows).first()["json"])["data"]["path"] == "a.go"
    assert sinks.text_lines(rows, "path", "line", "col", "message").first()["value"] == "a.go:1:2:bad"
    parts = rows.withColumnRenamed("rule", "server")
    sinks.write_parts(parts, str(tmp_path / "ix"), 1, "b1")
    assert readers.read_parts(spark, str(tmp_path / "ix"), 1, "b1").count() == 2 and readers.read_parts(spark, str(tmp_path / "ix"), 2, "b1").count() == 0


def test_parts_of_other_servers_stay_and_damaged_ones_fall_out(spark, tmp_path):
    path = str(tmp_path / "index")
    put = lambda rows: spark.createDataFrame(rows, "server string, id int, v string")
    sinks.write_parts(put([("a", 1, "x"), ("a", 2, "y"), ("b", 3, "z")]), path, 1, "k")
    sinks.write_parts(put([("c", 4, "w"), ("b", 5, "n")]), path, 1, "k")
    got = sorted((r["server"], r["id"], r["v"]) for r in readers.read_parts(spark, path, 1, "k").collect())
    assert got == [("a", 1, "x"), ("a", 2, "y"), ("b", 5, "n"), ("c", 4, "w")]
    assert readers.read_parts(spark, path, 2, "k").count() == 0
    # a row more than the checksum knows of
    spark.createDataFrame([(9, "?", 1, 0, 1, "k", "a")], "id int, v string, part_rows long, part_sum long, schema_version int, build string, server string").write.mode("append").partitionBy("server").parquet(f"{path}/{segments.manifest(spark, path)['segments'][0]}/parts")
    assert {r["server"] for r in readers.read_parts(spark, path, 1, "k").collect()} == {"b", "c"}


def test_a_large_log_is_split(spark, tmp_path):
    """Records are rows, in more tasks than files."""
    records = [f"\x01sha{k}\x1fau{k % 5}\x1f2024-01-02\x02\n" + "".join(f"{j}\t1\tdir/f{j}.go\n" for j in range(k % 7)) for k in range(20_000)]
    (tmp_path / "log").write_text("".join(records))
    (tmp_path / "listing").write_bytes(b"\0".join(f"d/f{k % 700}.go".encode() for k in range(1500)) + b"\0")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200000")
    try:
        rows = readers.read_log(spark, str(tmp_path / "log"))
        assert rows.rdd.getNumPartitions() > 4 and rows.count() == len(records)
        whole = spark.createDataFrame([("".join(records),)], "t string")
        assert readers.parse_log(rows, "value").exceptAll(readers.parse_log(whole, "t")).count() == 0
        assert readers.parse_log(rows, "value").count() == sum(k % 7 for k in range(20_000))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert [r["path"] for r in readers.read_listing(spark, str(tmp_path / "listing")).collect()] == sorted(f"d/f{k}.go" for k in range(700))
