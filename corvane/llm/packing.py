"""Packing documents into fixed-length token sequences by the sum-of-squares rule.

Documents become token pieces in Arrow batches; a piece of full length is a sequence of its own. The others are dealt at
random (by a hash of identifier and piece) into shards of about SHARD pieces, whose number grows with the input. A shard
is packed in decreasing length: each piece goes where the sum of squared counts of open bins per residual gap becomes
smallest. Bins that end with a large gap are dissolved, and their pieces are packed again in fewer shards.

Defined cases: null text is an empty text, which is the end token alone; a special token's string inside a text is that
token, as the tokenizer has it; repeated rows are packed as often as they occur, and dealt apart; pieces of equal length
(ties) go by identifier; identifiers may be numbers, strings or null; very long texts are cut in pieces, none is left out,
runs of millions of equal characters included; columns of the input may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, ident, ident_type, texts_of

CAPACITY = 1024
END_ID = 2
SHARD = 4096
#: Bins whose gap is larger than this part of the capacity are dissolved in the next round.
LOOSE = 1 / 64
ROUNDS = 3
PIECE = "piece int, start long, length long, ids_crc32 long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """Text to an array of ids. Where the file's merges come in the order of their ids, the ids are the ranks of a
    byte-pair encoder, which gives the same ids faster; otherwise the file's own tokenizer does it. It also takes the
    texts that the faster one refuses: its expression runs out of stack on some 10^6 white-space characters in a row."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
    pairs = [m if isinstance(m, list) else m.split(" ") for m in merges]
    first = [vocab.get(a + b) for a, b in pairs]
    in_order = len(first) > 0 and first == list(range(first[0], first[0] + len(first))) and first[0] == 256
    if in_order and spec.get("normalizer") is None and spec["pre_tokenizer"]["type"] == "ByteLevel" and not spec["pre_tokenizer"].get("add_prefix_space"):
        import public_tokenizers
        import tiktoken

        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        letters = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in plain)}
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        coding = tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)

        def encode(text: str) -> np.ndarray:
            try:
                return coding.encode_to_numpy(text, allowed_special="all")
            except ValueError:
                return _own_encoder(path)(text)

        return encode
    return _own_encoder(path)


@functools.lru_cache(maxsize=2)
def _own_encoder(path: str):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    return lambda text: np.array(tokenizer.encode(text, add_special_tokens=False).ids, dtype=np.uint32)


def cuts(n: int, capacity: int) -> list[tuple[int, int]]:
    """Starts and ends of the pieces of n ids: full ones, but for the first."""
    if n <= capacity:
        return [(0, n)]
    first = n % capacity
    starts = ([0] if first else []) + list(range(first, n, capacity))
    return [(s, min(s + capacity, n) if s or not first else first) for s in starts]


def _pieces(path: str, capacity: int, end_id: int, kind: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            out: list[tuple] = []
            for ident, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encode(text.as_py() or ""), end_id).astype("<u4")
                out += [(ident, k, s, e - s, zlib.crc32(ids[s:e].tobytes())) for k, (s, e) in enumerate(cuts(len(ids), capacity))]
            columns = list(zip(*out)) if out else [[]] * 5
            kinds = [pa.int64() if kind == "long" else pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    kind = ident_type(docs, id_col)
    rows = docs.select(ident(docs, id_col).alias("_id"), texts_of(text_col).alias("t"))
    return rows.mapInArrow(_pieces(path or default_path(), capacity, end_id, kind), f"_id {kind}, {PIECE}")


def sum_of_squares(sizes: list[int], capacity: int) -> list[int]:
    """The bin of each item, in the items' order. Ties go to the smallest gap, and to an open bin before a new one."""
    counts = np.zeros(capacity + 1, dtype=np.int64)  # of open bins by gap; gap 0 is never counted
    stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
    out, bins = [], 0
    for size in sizes:
        # from gap g to g - size: the sum of squares changes by -2 N(g) + 1 and, unless it closes, 2 N(g - size) + 1
        change = 1 - 2 * counts[size:capacity]
        change[1:] += 2 * counts[1 : capacity - size] + 1
        change[counts[size:capacity] == 0] = np.iinfo(np.int64).max
        best = int(change.argmin()) if len(change) else -1
        fresh = 2 * counts[capacity - size] + 1 if size < capacity else 0
        if best >= 0 and change[best] <= fresh and change[best] != np.iinfo(np.int64).max:
            gap = size + best
            own = stacks[gap].pop()
            counts[gap] -= 1
        else:
            own, gap = bins, capacity
            bins += 1
        out.append(own)
        if gap > size:
            counts[gap - size] += 1
            stacks[gap - size].append(own)
    return out


def _pack(capacity: int):
    """One shard's pieces with their bin, offset and the bin's gap. Arrow tables keep null identifiers and large ones exact."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
        sizes = rows["length"].to_numpy()
        bins = np.array(sum_of_squares(sizes.tolist(), capacity), dtype=np.int64)
        order = np.argsort(bins, kind="stable")
        sums = np.cumsum(sizes[order]) - sizes[order]
        offset = np.empty(len(bins), dtype=np.int64)
        offset[order] = sums - np.repeat(sums[np.searchsorted(bins[order], np.arange(bins.max() + 1))], np.bincount(bins))
        gap = capacity - np.bincount(bins, weights=sizes).astype(np.int64)[bins]
        for name, column in (("bin", bins), ("offset", offset), ("gap", gap)):
            rows = rows.append_column(name, pa.array(column))
        return rows.select(["_id", "piece", "start", "length", "ids_crc32", "_n", "shard", "bin", "offset", "gap"])

    return run


def pack(items: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, rounds: int = ROUNDS) -> DataFrame:
    """Pieces with sequence_id and offset."""
    kind = ident_type(items, "_id")
    items = cut(items.withColumn("_n", F.monotonically_increasing_id()))
    full = items.where(F.col("length") >= capacity)
    done = full.select("_id", "piece", "start", "length", "ids_crc32", (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # rows that repeat are dealt apart by a number of their own, fixed once it is written
    rest = items.where(F.col("length") < capacity)
    n = rest.count()
    for turn in range(rounds):
        shards = max(1, -(-n // shard))
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("_id", "piece", "ids_crc32", "_n", F.lit(turn)), F.lit(shards)))
        packed = cut(dealt.groupBy("shard").applyInArrow(_pack(capacity), f"_id {kind}, {PIECE}, _n long, shard long, bin long, offset long, gap long"))
        loose = packed.where(F.col("gap") > F.lit(capacity * LOOSE))
        last = turn == rounds - 1 or shards == 1
        ready = packed if last else packed.where(F.col("gap") <= F.lit(capacity * LOOSE))
        number = (F.lit(turn).cast("long") * F.lit(1 << 58)) + F.col("shard") * F.lit(1 << 26) + F.col("bin")
        done = done.unionByName(ready.select("_id", "piece", "start", "length", "ids_crc32", number.alias("sequence_id"), "offset"))
        if last or not (n := loose.count()):
            break
        rest = loose.select("_id", "piece", "start", "length", "ids_crc32", "_n")
    return done


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(pieces(docs)).withColumnRenamed("_id", "doc_id")
