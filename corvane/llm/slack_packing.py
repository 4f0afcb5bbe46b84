"""Packing documents into token sequences by minimum bin slack.

Documents become ids in Arrow batches. Pieces of full length are sequences of their own; what remains of a document is an
item. Items are dealt by a hash into shards of about SHARD, whose number grows with the input. In a shard, a sequence
starts with the longest item left, and a subset-sum program over a bitset finds which multiset of remaining lengths fills
the window exactly or, failing that, most closely; counts by length are read back from the bitsets. A sequence of a
length that is a power of two needs no padding, so a window is closed only when it is full:

- where no multiset fills it and the shard is nearly used up, the shard's last items go to the next round's fewer shards;
- otherwise the longest other item is cut where the binary digits of its length end (2,048, 1,024, ...) and the parts
  join the multiset. Their checksums are made with the ids, so cutting reads no text again;
- the last items of the last shard are less than one window: they fill sequences of the binary digits of their sum in
  the same way.

So no token of padding is left, documents are cut only where they are longer than a window or an exact fill needs it.

Defined cases: null text is an empty text, which is the end token alone; a special token's string inside a text is that
token, as the tokenizer has it; repeated rows are packed as often as they occur, and dealt apart; ties (equal lengths) go
by identifier; identifiers may be numbers, strings or null; very long texts are cut in pieces, none is left out; columns of
the input may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import functools
import json
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import cut, ident, ident_type, texts_of

CAPACITY = 4096
END_ID = 2
SHARD = 4096
#: A shard with fewer items than this hands them on rather than cut one.
FEW = 64
#: A shard has so many windows of tokens at least.
WINDOWS = 8
#: Spellings of words whose ids a task keeps, and the longest that it keeps.
KEPT_WORDS, LONGEST_WORD = 500_000, 64
ITEM = "start long, length long, ids_crc32 long, doc_tokens long"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


#: The one normalisation and the one split into words that `_pieces_of` follows; files with others go through their tokenizer.
NORMALIZER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Letters up to here have the same classes and small forms in every edition of Unicode; words with others go through the tokenizer.
LATIN = "\u024f"
#: A byte that no UTF-8 text holds: it stands for a word's end.
WORD_END = b"\xff"


def _pieces_of(path: str):
    """A function from a word of Latin script to its ids, or None for files that need their tokenizer.

    Words end in a mark of their own, and the tokens that join it to one byte come before all merges, so ids are the ranks
    of a byte-pair encoder in which the mark is one more byte.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, steps = spec["model"], (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    suffix, vocab = model.get("end_of_word_suffix"), model.get("vocab", {})
    plain = model.get("type") == "BPE" and suffix and not model.get("continuing_subword_prefix") and not model.get("dropout") and not model.get("ignore_merges")
    known = (spec.get("normalizer") or {}).get("normalizers") == NORMALIZER and len(steps) == 2 and steps[0].get("pattern") == {"Regex": SPLIT} and steps[1] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}
    if not (plain and known and [vocab.get(a + b) for a, b in pairs] == list(range(512, 512 + len(pairs)))):
        return None
    import regex
    import tiktoken

    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in shown)}
    special = {t["content"] for t in spec["added_tokens"]}
    bytes_of = lambda t: bytes(letters[c] for c in t.removesuffix(suffix)) + WORD_END * t.endswith(suffix)
    ranks = {bytes_of(t): i for t, i in vocab.items() if t not in special}
    if len(ranks) != len(vocab) - len(special & set(vocab)) or {ranks[bytes([b]) + WORD_END] >> 8 for b in range(256)} != {1}:
        return None
    coding = tiktoken.Encoding("words", pat_str=".", mergeable_ranks=ranks, special_tokens={})
    ascii_pieces = re.compile(SPLIT.replace(r"\p{L}", "a-z").replace(r"\p{N}", "0-9").encode()).findall
    latin_pieces = regex.compile(SPLIT.replace(r"\s", r"\t\n\x0b\x0c\r \x85\xa0")).findall
    encode = coding._core_bpe.encode_single_piece

    def ids(word: bytes) -> list[int] | None:
        if b"<|" in word:
            return None
        if word.isascii():
            pieces = ascii_pieces(word.lower())
        else:
            said = word.decode()
            if max(said) > LATIN:
                return None
            pieces = [p.encode() for p in latin_pieces(unicodedata.normalize("NFC", said).lower())]
        return encode(pieces[0] + WORD_END) if len(pieces) == 1 else [i for p in pieces for i in encode(p + WORD_END)]

    return ids


class Words(dict):
    """Ids, as bytes, of what stands between ASCII white space; no id of this kind of tokenizer spans white space."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.fast = Tokenizer.from_file(path), _pieces_of(path)

    def ids(self, text: bytes) -> bytes:
        found = self.fast(text) if self.fast and len(text) <= LONGEST_WORD else None
        if found is None:
            found = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(found)}I", *found)

    def __missing__(self, word: bytes) -> bytes:
        got = self.ids(word)
        if len(word) <= LONGEST_WORD:
            if len(self) >= KEPT_WORDS:
                self.clear()
            self[word] = got
        return got


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """UTF-8 text to its ids as little-endian bytes. Where the file's tokenizer drops white space before it looks for
    tokens, words are looked up one by one; otherwise it sees the whole text."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    words = Words(path)
    steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}])
    drops = steps[0].get("behavior") == "Removed" and steps[0].get("invert") and r"[^\s" in steps[0].get("pattern", {}).get("Regex", "") and not any(t.get("lstrip") or t.get("rstrip") for t in spec["added_tokens"])
    if not drops:
        words.fast = None
        return words.ids
    return lambda text: b"".join(map(words.__getitem__, text.split()))


def digits(n: int) -> list[int]:
    """The powers of two that sum to n, largest first."""
    return [1 << k for k in range(n.bit_length() - 1, -1, -1) if n >> k & 1]


def _items(path: str, capacity: int, end_id: int, kind: str):
    end = np.array([end_id], dtype="<u4").tobytes()
    key = pa.int64() if kind == "long" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            names, starts, lengths, crcs, totals, parts = [], [], [], [], [], []
            for name, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = memoryview(encode(text or b"") + end)
                n = len(ids) // 4
                for s in range(0, n, capacity):
                    e = min(s + capacity, n)
                    names.append(name)
                    starts.append(s)
                    lengths.append(e - s)
                    crcs.append(zlib.crc32(ids[4 * s : 4 * e]))
                    totals.append(n)
                    at, own = s, []
                    if e - s < capacity:
                        for d in digits(e - s):
                            own.append(zlib.crc32(ids[4 * at : 4 * (at + d)]))
                            at += d
                    parts.append(own)
            columns = [pa.array(names, key), *(pa.array(c, pa.int64()) for c in (starts, lengths, crcs, totals)), pa.array(parts, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["_id", "start", "length", "ids_crc32", "doc_tokens", "parts"])

    return run


def items(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """_id, start, length, ids_crc32, doc_tokens of full pieces and of what remains of each document; parts: checksums of
    the pieces of an item if it is cut at its length's binary digits."""
    kind = ident_type(docs, id_col)
    rows = docs.select(ident(docs, id_col).alias("_id"), texts_of(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(_items(path or default_path(), capacity, end_id, kind), f"_id {kind}, {ITEM}, parts array<long>")


def fill(counts: dict[int, int], order: list[int], room: int) -> dict[int, int]:
    """Of counts items of each length, those whose sum comes closest to room without passing it: how many of each length.

    Bit s of reach: sum s can be made. Lengths come in the given order (the largest first, so small ones are left for
    later), each in doubling handfuls; the program ends as soon as room itself is reached.
    """
    mask, reach, trail = (1 << (room + 1)) - 1, 1, []
    for size in order:
        left, take = min(counts[size], room // size), 1
        while left > 0:
            take = min(take, left)
            more = (reach | reach << size * take) & mask
            if more != reach:
                trail.append((size, take, reach))
                reach = more
                if reach >> room & 1:
                    break
            left -= take
            take *= 2
        if reach >> room & 1:
            break
    at, out = reach.bit_length() - 1, {}
    for size, take, before in reversed(trail):
        if not before >> at & 1:
            out[size] = out.get(size, 0) + take
            at -= size * take
    return out


def bins_of(sizes: list[int], capacity: int, last: bool, few: int = FEW) -> tuple[list[list[tuple[int, int]]], list[int]]:
    """Windows as lists of (item, part), and the items handed on. Part -1 is the whole item, k its k-th binary digit.

    last: nothing is handed on; the windows of what is left are powers of two.
    """
    stock: dict[int, list[tuple[int, int]]] = {}
    for i in range(len(sizes) - 1, -1, -1):  # the first of equal ones is taken first
        stock.setdefault(sizes[i], []).append((i, -1))
    counts = {s: len(v) for s, v in stock.items()}
    order = sorted(counts, reverse=True)
    left, n, out, torn = sum(sizes), len(sizes), [], 0

    def cut_one(size: int) -> None:
        nonlocal n, order, torn
        i, _ = stock[size].pop()
        counts[size] -= 1
        for k, d in enumerate(digits(size)):
            stock.setdefault(d, []).append((i, k))
            counts[d] = counts.get(d, 0) + 1
        n += len(digits(size)) - 1
        torn += len(digits(size))
        order = sorted((s for s in counts if counts[s]), reverse=True)

    while left:
        if not last and not torn and (left < capacity or n < few):
            return out, [i for v in stock.values() for i, _ in v]
        if len(order) != len(counts):
            counts = {s: counts[s] for s in order}
        room = capacity if left >= capacity else 1 << left.bit_length() - 1
        seed = order[0] if left >= capacity else 0
        took = {seed: 1} if seed else {}
        if seed < room:
            if seed:
                counts[seed] -= 1
            for s, c in fill(counts, [s for s in order if s <= room - seed and counts[s]], room - seed).items():
                took[s] = took.get(s, 0) + c
            if seed:
                counts[seed] += 1
        if sum(s * c for s, c in took.items()) < room:
            # the longest item that a cut changes, other than the seed where there is one; powers of two always fit in the end
            cut_one(next((s for s in order if s & (s - 1) and (s != seed or counts[s] > 1)), seed))
            continue
        window = []
        for s, c in took.items():
            window += [stock[s].pop() for _ in range(c)]
            counts[s] -= c
            n -= c
        torn -= sum(part >= 0 for _, part in window)
        left -= room
        out.append(window)
        if any(not counts[s] for s in took):
            order = [s for s in order if counts[s]]
    return out, []


def _pack(capacity: int, last: bool, few: int):
    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("_id", "ascending"), ("ids_crc32", "ascending"), ("_n", "ascending")])
        sizes, start, crc = (rows[c].to_pylist() for c in ("length", "start", "ids_crc32"))
        windows, on = bins_of(sizes, capacity, last, few)
        parts = rows["parts"]
        take, starts, lengths, crcs, bins, offsets = [], [], [], [], [], []
        for b, window in enumerate(windows):
            offset = 0
            for i, part in window:
                if part < 0:
                    s, n, c = start[i], sizes[i], crc[i]
                else:
                    own = digits(sizes[i])
                    s, n, c = start[i] + sum(own[:part]), own[part], parts[i][part].as_py()
                for column, value in ((take, i), (starts, s), (lengths, n), (crcs, c), (bins, b), (offsets, offset)):
                    column.append(value)
                offset += n
        for i in on:
            for column, value in ((take, i), (starts, start[i]), (lengths, sizes[i]), (crcs, crc[i]), (bins, -1), (offsets, 0)):
                column.append(value)
        out = rows.take(pa.array(take, pa.int64()))
        own = {"start": starts, "length": lengths, "ids_crc32": crcs, "bin": bins, "offset": offsets}
        none = pa.array([None] * len(bins), pa.list_(pa.int64()))
        kept = pa.compute.if_else(pa.compute.less(pa.array(bins, pa.int64()), 0), out["parts"].combine_chunks(), none)
        columns = {c: out[c] for c in ("_id", "doc_tokens", "_n", "shard")} | {c: pa.array(v, pa.int64()) for c, v in own.items()} | {"parts": kept}
        return pa.table({c: columns[c] for c in ("_id", "start", "length", "ids_crc32", "doc_tokens", "parts", "_n", "shard", "bin", "offset")})

    return run


def pack(rows: DataFrame, capacity: int = CAPACITY, shard: int = SHARD, few: int = FEW) -> DataFrame:
    """Pieces with sequence_id and offset. Every sequence has capacity tokens, or a power of two fewer.

    A shard has about `shard` items and WINDOWS windows of tokens at least; it hands on fewer than few items or less than
    one window, so there are fewer shards in each round, and the round of one shard is the last.
    """
    kind = ident_type(rows, "_id")
    rows = cut(rows.withColumn("_n", F.monotonically_increasing_id()))
    own = ["_id", "start", "length", "ids_crc32", "doc_tokens"]
    full = rows.where(F.col("length") >= capacity)
    done = full.select(*own, (F.monotonically_increasing_id() + F.lit(1 << 62)).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    rest, turn, shards = rows.where(F.col("length") < capacity), 0, 1 << 26
    while True:
        n, tokens = rest.agg(F.count(F.lit(1)), F.sum("length")).first()
        if not n:
            break
        shards = max(1, min(-(-n // shard), tokens // (WINDOWS * capacity), shards // 2))
        last = shards == 1
        dealt = rest.withColumn("shard", F.pmod(F.xxhash64("_id", "start", "ids_crc32", "_n", F.lit(turn)), F.lit(shards)))
        packed = cut(dealt.groupBy("shard").applyInArrow(_pack(capacity, last, few), f"_id {kind}, {ITEM}, parts array<long>, _n long, shard long, bin long, offset long"))
        number = F.lit(turn).cast("long") * F.lit(1 << 58) + F.col("shard") * F.lit(1 << 26) + F.col("bin")
        done = done.unionByName(packed.where("bin >= 0").select(*own, number.alias("sequence_id"), "offset"))
        if last:
            break
        rest, turn = packed.where("bin < 0").select(*own, "parts", "_n"), turn + 1
    return done


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pack(items(docs)).withColumnRenamed("_id", "doc_id")
