"""Streams: a readiness gate with state and timers, settling of pushed rows, incremental upkeep of an index."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.stateful_processor import ExpiredTimerInfo, TimerValues

from corvane.sources import segments

#: Fixed values, in milliseconds: a result is stable after SETTLE; GRACE without any progress; TIMEOUT in all.
SETTLE, GRACE, TIMEOUT = 750, 500, 30_000

VIEW = "first long, changed long, result string, known boolean, failed boolean, seen boolean, progress_at long, last_at long, clock long"
READY = "key string, result string, rule string, reason string, at_ms long"
#: What answers count as empty.
EMPTY = ("", "null", "[]", "{}")


@dataclass
class View:
    """What the events of a key have said so far. known: an answer is in force; failed: the last word was an error."""

    first: int
    changed: int
    result: str | None = None
    known: bool = False
    failed: bool = False
    seen: bool = False
    progress_at: int = 0
    last_at: int = 0
    clock: int = 0

    def rule(self, now: int, active: bool, settle: int = SETTLE, grace: int = GRACE, timeout: int = TIMEOUT) -> str | None:
        """The first rule that makes the answer in force final: R1 drained and not empty; R2 drained and stable; R3 stable,
        no progress ever and the grace over; R4 stable, not empty and progress quiet; not_ready at the timeout; None
        before. Without an answer in force (none yet, or an error since) only the timeout ends the wait."""
        filled, drained, stable = self.result not in EMPTY, self.seen and not active, now - self.changed >= settle
        if self.known:
            if drained and filled:
                return "R1"
            if drained and stable:
                return "R2"
            if stable and not self.seen and now - self.first >= grace:
                return "R3"
            if stable and filled and self.seen and now - self.progress_at >= settle:
                return "R4"
        return "not_ready" if now - self.first >= timeout else None

    def reason(self, active: bool) -> str:
        """Why nothing became final in time: indexing (work goes on, or an error stands), empty, or unstable."""
        return "indexing" if active or self.failed else "empty" if self.known and self.result in EMPTY else "unstable"

    def take(self, now: int, kind: str, result: str | None) -> None:
        """One event: a result, an error that may be tried again, or progress."""
        if kind == "result":
            if not self.known or result != self.result:
                self.result, self.changed = result, now
            self.known, self.failed = True, False
        elif kind == "error":
            self.result, self.known, self.failed, self.changed = None, False, True, now
        else:
            self.seen, self.progress_at = True, now

    def next_look(self, now: int, settle: int = SETTLE, grace: int = GRACE, timeout: int = TIMEOUT) -> int:
        """Milliseconds until time alone can make a rule true: the nearest bound that lies ahead."""
        ahead = (self.changed + settle, self.first + grace, self.progress_at + settle, self.first + timeout)
        return max(1, min((t - now for t in ahead if t > now), default=1))


class _Gate(StatefulProcessor):
    """One key's gate: a value of what is known, a map of the tokens at work, a mark of what is settled that lives for a
    timeout, and one timer at a time."""

    def __init__(self, settle: int, grace: int, timeout: int, tie: str | None):
        self.bounds, self.tie = (settle, grace, timeout), tie

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.view = handle.getValueState("view", VIEW)
        self.tokens = handle.getMapState("tokens", "token string", "active boolean")
        self.done = handle.getValueState("done", "at_ms long", ttlDurationMs=self.bounds[2])

    def _read(self) -> tuple[View | None, set[str]]:
        return (View(*self.view.get()) if self.view.exists() else None), {k[0] for k in self.tokens.keys()}

    def _timer(self, at: int | None) -> None:
        for old in list(self.handle.listTimers()):
            self.handle.deleteTimer(old if isinstance(old, int) else old[0])
        if at is not None:
            self.handle.registerTimer(at)

    def _close(self, key: tuple, view: View, active: bool, rule: str, now: int) -> Iterator[pd.DataFrame]:
        self.view.clear()
        self.tokens.clear()
        self.done.update((now,))
        self._timer(None)
        late = rule == "not_ready"
        yield pd.DataFrame([(key[0], None if late else view.result, rule, view.reason(active) if late else None, now)], columns=["key", "result", "rule", "reason", "at_ms"])

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues: TimerValues) -> Iterator[pd.DataFrame]:
        view, tokens = self._read()
        closed = self.done.exists()
        for batch in rows:
            order = ["at_ms", self.tie] if self.tie else ["at_ms"]
            for e in batch.sort_values(order, kind="stable").itertuples() if not closed else ():
                now = int(e.at_ms)
                if view is None:
                    view = View(now, now)
                elif rule := view.rule(now, bool(tokens), *self.bounds):  # it became final before this event
                    yield from self._close(key, view, bool(tokens), rule, now)
                    closed = True
                    break
                view.take(now, e.kind, e.result if isinstance(e.result, str) else None)
                view.last_at = now
                if e.kind in ("begin", "create"):
                    tokens.add(e.token)
                    self.tokens.updateValue((e.token,), (True,))
                elif e.kind == "end":
                    tokens.discard(e.token)
                    self.tokens.removeKey((e.token,))
                if (rule := view.rule(now, bool(tokens), *self.bounds)) in ("R1", "not_ready"):
                    yield from self._close(key, view, bool(tokens), rule, now)
                    closed = True
                    break
        if not closed and view is not None:
            view.clock = timerValues.getCurrentProcessingTimeInMs()
            self.view.update(astuple(view))
            self._timer(view.clock + view.next_look(view.last_at, *self.bounds))

    def handleExpiredTimer(self, key: tuple, timerValues: TimerValues, expiredTimerInfo: ExpiredTimerInfo) -> Iterator[pd.DataFrame]:
        view, tokens = self._read()
        if view is None:
            return
        clock = timerValues.getCurrentProcessingTimeInMs()
        now = view.last_at + max(0, clock - view.clock)
        if rule := view.rule(now, bool(tokens), *self.bounds):
            yield from self._close(key, view, bool(tokens), rule, now)
        else:
            self._timer(clock + view.next_look(now, *self.bounds))

    def close(self) -> None:
        pass


def gate(events: DataFrame, settle: int = SETTLE, grace: int = GRACE, timeout: int = TIMEOUT, tie: str | None = None) -> DataFrame:
    """A stream of events (key, at_ms, kind: result, error, begin, report, end or create; token; result) to one final row per key.

    A token is active from its creation or begin until its end; progress is drained once something was seen and none is
    active. An error that can be tried again forgets the result before it, and until the next result there is no answer.
    Rules run when events come and, between them, on processing-time timers, up to the timeout, whose row has no result but
    a reason. A key whose row is out stays settled for a timeout; what comes for it until then is passed over. Events of a
    key come in order of time and tie (a column), batch by batch. State that lives and dies needs the RocksDB provider.
    """
    processor = _Gate(settle, grace, timeout, tie)
    return events.groupBy("key").transformWithStateInPandas(statefulProcessor=processor, outputStructType=READY, outputMode="append", timeMode="processingTime")


def gate_rules(events: DataFrame, key: str, order: list[str], settle: int = SETTLE, grace: int = GRACE, timeout: int = TIMEOUT) -> DataFrame:
    """The same offline, over a log with key, at_ms, kind, token and result: key, rule, at_ms, result and reason.

    Between two events nothing changes but the clock, so each rule's first moment in the gap is an expression over what
    the events so far have left; the earliest of a key is its row. order: what settles the order of equal times.
    """
    upto = Window.partitionBy(key).orderBy("at_ms", *order).rowsBetween(Window.unboundedPreceding, 0)
    token = Window.partitionBy(key, "token").orderBy("at_ms", *order)
    progress = F.col("kind").isin("create", "begin", "report", "end")
    step = F.when(F.col("kind").isin("create", "begin"), 1).when(F.col("kind") == "end", 0)
    rows = events.withColumn("_on", F.last(step, ignorenulls=True).over(token.rowsBetween(Window.unboundedPreceding, 0)))
    rows = rows.withColumn("_was", F.coalesce(F.lag("_on").over(token), F.lit(0)))
    rows = rows.withColumn("_active", F.sum(F.when(progress, F.coalesce("_on", F.lit(0)) - F.col("_was")).otherwise(0)).over(upto))
    # the last word of the server: an answer or an error, and when it last became another
    word = F.when(F.col("kind") == "result", F.struct(F.lit(True).alias("known"), F.coalesce("result", F.lit("")).alias("text"))).when(F.col("kind") == "error", F.struct(F.lit(False).alias("known"), F.lit("").alias("text")))
    before = Window.partitionBy(key).orderBy("at_ms", *order)
    rows = rows.withColumn("_word", F.last(word, ignorenulls=True).over(upto))
    fresh = (F.col("kind") == "error") | ((F.col("kind") == "result") & ~F.lag("_word").over(before).eqNullSafe(F.col("_word")))
    first = F.min("at_ms").over(upto)
    rows = rows.withColumn("_fresh", fresh).withColumns(
        {
            "_first": first,
            "_changed": F.coalesce(F.max(F.when(F.col("_fresh"), F.col("at_ms"))).over(upto), first),
            "_seen": F.coalesce(F.max(progress.cast("int")).over(upto), F.lit(0)) == 1,
            "_moved": F.max(F.when(progress, F.col("at_ms"))).over(upto),
            "_next": F.coalesce(F.lead("at_ms").over(before), F.lit(2**62)),
        }
    )
    known = F.coalesce(F.col("_word.known"), F.lit(False))
    filled = known & ~F.col("_word.text").isin(*EMPTY)
    drained_ = known & F.col("_seen") & (F.col("_active") == 0)
    stable = F.col("_changed") + settle
    out = {
        "R1": F.when(drained_ & filled, F.col("at_ms")),
        "R2": F.when(drained_, F.greatest("at_ms", stable)),
        "R3": F.when(known & ~F.col("_seen"), F.greatest("at_ms", stable, F.col("_first") + grace)),
        "R4": F.when(F.col("_seen") & filled, F.greatest("at_ms", stable, F.col("_moved") + settle)),
        "not_ready": F.greatest(F.col("at_ms"), F.col("_first") + timeout),
    }
    least = F.array_min(F.filter(F.array(*[F.struct(c.alias("at"), F.lit(k).alias("k"), F.lit(name).alias("rule")) for k, (name, c) in enumerate(out.items())]), lambda x: x["at"].isNotNull()))
    rows = rows.withColumn("_hit", least).where((F.col("_hit.at") <= F.col("_next")) & F.col("_hit.at").isNotNull())
    late = F.col("_hit.rule") == "not_ready"
    failed = F.coalesce(~F.col("_word.known"), F.lit(False))
    reason = F.when(late, F.when((F.col("_active") > 0) | failed, "indexing").when(known & ~filled, "empty").otherwise("unstable"))
    best = rows.groupBy(key).agg(F.min(F.struct("_hit.at", "_hit.k", "_hit.rule", F.when(~late, F.col("_word.text")).alias("result"), reason.alias("reason"))).alias("b"))
    return best.select(key, F.col("b.rule").alias("rule"), F.col("b.at").alias("at_ms"), F.col("b.result").alias("result"), F.col("b.reason").alias("reason"))


def settled(events: DataFrame, key: str, at: str, settle_ms: int, tie: str = "event_id") -> DataFrame:
    """Offline: the events after which a key stays quiet for long enough (the last one always), with the gap in ms. tie: orders equal times."""
    after = F.lead(F.unix_micros(F.col(at))).over(Window.partitionBy(key).orderBy(at, tie))
    gap = ((after - F.unix_micros(F.col(at))) / 1000).cast("long")
    return events.withColumn("gap_ms", gap).where(F.col("gap_ms").isNull() | (F.col("gap_ms") >= settle_ms))


def drained(progress: DataFrame, server: str, token: str, at: str, kind: str) -> DataFrame:
    """Per server: whether something was seen and every token's last begin or end is an end."""
    last = progress.where(F.col(kind).isin("create", "begin", "end")).groupBy(server, token).agg(F.max_by(kind, at).alias("_last"))
    return last.groupBy(server).agg(F.count(F.lit(1)).alias("tokens"), F.bool_and(F.col("_last") == "end").alias("drained"))


def diagnostics_settled(published: DataFrame, opened: DataFrame, now_ms: int, settle_ms: int = SETTLE) -> DataFrame:
    """published: server, uri, at_ms; opened: server, uri. Per server: missing files, quiet, and complete."""
    last = published.groupBy("server", "uri").agg(F.max("at_ms").alias("at_ms"))
    rows = opened.join(last, ["server", "uri"], "left").groupBy("server").agg(F.count_if(F.col("at_ms").isNull()).alias("missing"), F.max("at_ms").alias("last"))
    quiet = F.lit(now_ms) - F.col("last") >= settle_ms
    return rows.select("server", "missing", F.coalesce(quiet, F.lit(False)).alias("quiet"), ((F.col("missing") == 0) & F.coalesce(quiet, F.lit(False))).alias("complete"))


def maintain(snapshots: DataFrame, table_path: str, checkpoint: str, build: Callable[[DataFrame], DataFrame], keep: int = 3, ratio: float = 0.5):
    """A query that keeps an index table up to date from a stream of file versions (path, size, mtime_ns, hash, content, removed).

    Every batch takes the last version of each path, leaves out those whose hash the table has, and writes the rows of the
    rest as a segment that takes the place of what the table says of these paths: a batch writes what changed. Readers see
    whole versions, a batch that comes again does nothing, and segments are merged when they outgrow a share (ratio) of
    the first. The last keep versions stay. A batch without changes writes nothing.
    """

    def step(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        newest = Window.partitionBy("path").orderBy(F.col("mtime_ns").desc())
        last = batch.withColumn("_n", F.row_number().over(newest)).where("_n = 1").drop("_n").persist()
        before = current(spark, table_path)
        if before is not None:
            paths = last.select(F.col("path").alias("_path"))
            old = before.join(paths, before["path"] == paths["_path"], "left_semi").select("path", F.col("hash").alias("_hash")).distinct()
            changed = last.join(old, "path", "left").where("case when removed then _hash is not null else _hash is null or _hash <> hash end").drop("_hash").persist()
            if changed.isEmpty():
                return
        else:
            changed = last
        segments.commit(spark, table_path, number, {"rows": build(changed.where("not removed"))}, changed.select("path"), ratio=ratio, keep=keep)

    return snapshots.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append")


def current(spark, table_path: str) -> DataFrame | None:
    """The newest whole version of a maintained table; None before the first."""
    if segments.manifest(spark, table_path) is None:
        return None
    return segments.live(spark, table_path, "rows", "path").drop("_segment")


def stream_results(requests: DataFrame, answer: Callable[[DataFrame], DataFrame], path: str, checkpoint: str):
    """A query that answers requests as they come: every micro-batch appends one JSON envelope a row, so results are out before all requests are in."""
    from corvane.sources.sinks import envelope

    def step(batch: DataFrame, number: int) -> None:
        envelope(answer(batch)).write.mode("overwrite").text(f"{path}/batch={number}")  # a batch that is tried again replaces itself

    return requests.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).outputMode("append")
