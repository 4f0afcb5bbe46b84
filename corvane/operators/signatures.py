"""Stored signatures of texts: which three-byte runs a text holds, as a bitmap, so a search reads the texts that may match.

A pattern becomes a condition over runs that every match holds: all runs of its plain stretches, and one side of each
choice. What the parser does not know asks for nothing, so no match is lost. Texts and signatures are tables of segments
(`sources/segments.py`), dealt into buckets by key; the buckets of candidates alone are opened.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.functions.text import LOWER_BYTES
from corvane.operators import grep
from corvane.sources import segments

BUCKETS = 64
#: A bitmap has eight bits for each run of a text, and so many bits in all.
PER_RUN, LEAST_BITS, MOST_BITS = 8, 1 << 9, 1 << 20
MIX = 0x9E3779B1
#: Letters that other letters fold to without case (long s, Kelvin sign, Turkish i).
FOLDED = frozenset(b"ksi")


def _hash(runs: np.ndarray) -> np.ndarray:
    mixed = (runs.astype(np.uint64) * np.uint64(MIX)) & np.uint64(0xFFFFFFFF)
    return (mixed ^ (mixed >> np.uint64(15))).astype(np.int64)


def signature(text: bytes) -> np.ndarray:
    """The bitmap of a text in words of 64 bits; its number of bits is a power of two."""
    raw = np.frombuffer(text.translate(LOWER_BYTES), dtype=np.uint8).astype(np.int64)
    runs = np.unique(raw[:-2] << 16 | raw[1:-1] << 8 | raw[2:]) if len(raw) > 2 else np.zeros(0, dtype=np.int64)
    bits = min(MOST_BITS, max(LEAST_BITS, 1 << (max(1, len(runs) * PER_RUN) - 1).bit_length()))
    at = _hash(runs) & (bits - 1)
    words = np.zeros(bits // 64, dtype=np.uint64)
    np.bitwise_or.at(words, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return words.view(np.int64)


def with_signature(df: DataFrame, key: str, text: str) -> DataFrame:
    """key and signature (array of longs) of each text; null counts as empty."""
    kind = df.schema[key].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            maps = [signature(t.as_py() or b"") for t in batch.column(1)]
            offsets = np.concatenate([[0], np.cumsum([len(m) for m in maps])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(maps) if maps else np.zeros(0, dtype=np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], [key, "signature"])

    return df.select(key, F.col(text).cast("binary").alias("_t")).mapInArrow(run, f"`{key}` {kind.simpleString()}, signature array<bigint>")


def _both(parts: list) -> tuple | None:
    parts = [p for p in parts if p is not None]
    return None if not parts else parts[0] if len(parts) == 1 else ("and", tuple(parts))


def _plain(run: bytes, case: bool) -> tuple | None:
    """All three-byte runs of a plain stretch; without case, only those that no other letters fold to."""
    low = run.translate(LOWER_BYTES)
    found = {low[k : k + 3] for k in range(len(low) - 2)}
    if not case:
        found = {r for r in found if max(r) < 128 and not FOLDED & set(r)}
    return _both([("run", r) for r in sorted(found)])


def _tree(nodes, case: bool) -> tuple | None:
    parts, run = [], b""
    for op, arg in nodes:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).encode("utf-8", "replace")
            continue
        if name in ("AT", "ASSERT", "ASSERT_NOT"):  # of no width: neighbours stay neighbours
            continue
        parts.append(_plain(run, case))
        run = b""
        if name == "SUBPATTERN":
            parts.append(_tree(arg[3], case))
        elif name == "ATOMIC_GROUP":
            parts.append(_tree(arg, case))
        elif name == "BRANCH":
            sides = [_tree(side, case) for side in arg[1]]
            parts.append(None if None in sides else ("or", tuple(sides)))
        elif name in ("MAX_REPEAT", "MIN_REPEAT", "POSSESSIVE_REPEAT") and arg[0] >= 1:
            parts.append(_tree(arg[2], case))
    parts.append(_plain(run, case))
    return _both(parts)


def needed(pattern: str, case: bool) -> tuple | None:
    """What every match of a pattern holds: ("run", bytes), ("and" | "or", parts), or None where nothing is sure."""
    if re.search(r"\\Q|\(\?[a-zA-Z-]*x", pattern):
        return None
    try:
        nodes = re._parser.parse(re.sub(r"\\[pP](\{\^?\w+\}|\w)", ".", pattern))
    except (re.error, OverflowError, RecursionError):
        return None
    return _tree(nodes, case and not re.search(r"\(\?[a-zA-Z]*[iu]", pattern))


def may_match(signatures: Column, tree: tuple | None) -> Column:
    if tree is None:
        return F.lit(True)
    kind, arg = tree
    if kind == "run":
        at = F.lit(int(_hash(np.array([arg[0] << 16 | arg[1] << 8 | arg[2]]))[0])).bitwiseAND(F.size(signatures).cast("long") * 64 - 1)
        word = F.get(signatures, F.shiftright(at, 6).cast("int"))
        return F.call_function("shiftrightunsigned", word, at.bitwiseAND(F.lit(63)).cast("int")).bitwiseAND(F.lit(1)) == 1
    out = may_match(signatures, arg[0])
    for part in arg[1:]:
        out = out & may_match(signatures, part) if kind == "and" else out | may_match(signatures, part)
    return out


def store(df: DataFrame, key: str, text: str, path: str, number: int = 0, gone: DataFrame | None = None, buckets: int = BUCKETS) -> bool:
    """Texts with their signatures as a segment; gone: keys that it replaces or takes away (its own, if not given)."""
    bucket = F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")
    texts = df.select(key, F.col(text).alias("text"))
    dealt = lambda rows: rows.withColumn("_b", bucket).repartition("_b")
    tables = {"texts": dealt(texts), "signatures": with_signature(texts, key, "text").withColumn("_b", bucket)}
    return segments.commit(df.sparkSession, path, number, tables, df.select(key) if gone is None else gone.select(key), ("_b",) if buckets else ())


def candidates(spark: SparkSession, path: str, key: str, query: str, regex: bool = False, case: bool = False) -> DataFrame:
    """key and _b of texts that may match, by their signatures alone."""
    tree = needed(query, case) if regex else _plain(query.encode(), case)
    return segments.live(spark, path, "signatures", key).where(may_match(F.col("signature"), tree)).select(key, "_b")


def search(spark: SparkSession, path: str, key: str, query: str, regex: bool = False, word: bool = False, case: bool = False) -> DataFrame:
    """What `grep.search_text` gives over the stored texts, of which it opens the buckets of candidates."""
    some = candidates(spark, path, key, query, regex, case)
    texts = segments.live(spark, path, "texts", key).drop("_segment").join(some, ["_b", key], "left_semi")
    return grep.search_text(texts, key, "text", query, regex, word, case)
