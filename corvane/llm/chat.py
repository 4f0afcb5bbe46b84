"""Chat formatting by a finite-state machine over roles and a declarative template.

Rows are dealt by conversation and sorted by turn inside their task; the machine walks them as a stream and writes three
segments for every turn (mark, text, end), each with a loss flag. It holds one turn at a time, so a conversation of any
length needs no more memory, and a digest over it is a running one. Turns out of order are reported, never dropped.

Defined cases: null text and null role are empty; a null conversation is one of its own; turns with equal numbers go by
role, then text; unknown roles get a mark of their own and break the order; control strings inside texts are escaped and
come back exactly; conversations may be numbered or named by strings; very long texts are held one at a time; other
columns of the input are not read; empty tables give empty results.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ident, ident_type

#: What the format is made of: the mark before a text, what ends it, the roles that carry loss, and the allowed moves.
TEMPLATE = {
    "mark": "<|{role}|>\n",
    "end": "</s>\n",
    "loss": ("assistant",),
    "moves": {
        "start": {"system": "instructed", "user": "asked"},
        "instructed": {"user": "asked"},
        "asked": {"assistant": "answered"},
        "answered": {"user": "asked"},
    },
    "final": ("answered",),
    # in this order; read back in the reverse order. & comes first, so that written escapes are never escaped again
    "escapes": (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ("|", "&bar;"), ("[", "&lsb;"), ("]", "&rsb;")),
}
PROBE = "</s>[INST] ok [/INST]"
SEGMENT = "turn long, part int, text string, loss boolean, state string"


def _arrow(kind: str) -> pa.DataType:
    return pa.int64() if kind == "long" else pa.string()


def escape(text: str, template=TEMPLATE) -> str:
    for plain, written in template["escapes"]:
        text = text.replace(plain, written)
    return text


def unescape(text: str, template=TEMPLATE) -> str:
    for plain, written in reversed(template["escapes"]):
        text = text.replace(written, plain)
    return text


def _segments(template, kind: str):
    """Sorted rows (conv_id, turn, role, text) to segments; state is the machine's state after the turn, or "broken"."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, state, begun = None, "start", False
        for batch in batches:
            out: list[tuple] = []
            for ident, turn, role, text in zip(*(batch.column(k).to_pylist() for k in range(4))):
                if not begun or ident != conv:
                    conv, state, begun = ident, "start", True
                role, text = role or "", text or ""
                state = template["moves"].get(state, {}).get(role, "broken")
                out.append((ident, turn, 0, template["mark"].format(role=escape(role, template)), False, state))
                out.append((ident, turn, 1, escape(text, template), role in template["loss"], state))
                out.append((ident, turn, 2, template["end"], False, state))
            kinds = [_arrow(kind), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.string()]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", "turn", "part", "text", "loss", "state"])

    return run


def segments(conversations: DataFrame, template=TEMPLATE) -> DataFrame:
    """Segments in order within each conversation: mark, text and end of every turn, with loss flags. Joined, they are the formatted text."""
    kind = ident_type(conversations, "conv_id")
    rows = conversations.select(ident(conversations, "conv_id").alias("conv_id"), F.col("turn").cast("long"), F.col("role").cast("string"), F.col("text").cast("string"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", F.coalesce("role", F.lit("")), F.coalesce("text", F.lit("")))
    return rows.mapInArrow(_segments(template, kind), f"conv_id {kind}, {SEGMENT}")


def parse_turn(formatted: str, template=TEMPLATE) -> tuple[str, str]:
    """Role and text of one formatted turn."""
    before, after = template["mark"].split("{role}")
    end = template["end"]
    if not formatted.startswith(before) or not formatted.endswith(end):
        raise ValueError("not a formatted turn")
    role, mark, rest = formatted[len(before) : len(formatted) - len(end)].partition(after)
    if not mark or before in rest or end in rest:
        raise ValueError("not one formatted turn")
    return unescape(role, template), unescape(rest, template)


DIGEST = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"


def _read_back(template, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now: dict | None = None

        def closed() -> tuple:
            return (now["id"], now["n"], now["turns"].hexdigest(), now["chars"], now["loss"].hexdigest(), now["all"], now["ok"] and now["state"] in template["final"])

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [_arrow(kind), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            columns = list(zip(*rows)) if rows else [[]] * 7
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["conv_id", *[c.split()[0] for c in DIGEST.split(", ")]])

        turn: list[str] = []
        for batch in batches:
            done: list[tuple] = []
            for ident, part, text, loss, state in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3, 4, 5))):
                if now is None or (part == 0 and ident != now["id"]):
                    if now is not None:
                        done.append(closed())
                    now = {"id": ident, "n": 0, "turns": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "all": 0, "ok": True, "state": "start"}
                turn.append(text)
                if loss:
                    plain = unescape(text, template)
                    now["chars"] += len(plain)
                    now["loss"].update(plain.encode("utf-8"))
                if part == 2:
                    formatted = "".join(turn)
                    turn = []
                    role, plain = parse_turn(formatted, template)
                    now["turns"].update(f"{role}\n{plain}\n".encode("utf-8"))
                    now["n"] += 1
                    now["all"] += len(formatted)
                    now["state"] = state
                    now["ok"] &= state != "broken"
            yield batch_of(done)
        if now is not None:
            yield batch_of([closed()])

    return run


def read_back(parts: DataFrame, template=TEMPLATE) -> DataFrame:
    """Digests of what segments() wrote, parsed again; in the same tasks and order."""
    kind = ident_type(parts, "conv_id")
    return parts.mapInArrow(_read_back(template, kind), f"conv_id {kind}, {DIGEST}")


def query(spark, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return read_back(segments(rows.unionByName(probe)))
