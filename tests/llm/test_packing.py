import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from corvane.llm import packing
from tests.llm.helpers import SCHEMA, edge_rows, random_rows


def reference_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(reference_ids, "t"):
        reference_ids.t = Tokenizer.from_file(packing.default_path())
    return reference_ids.t.encode(text or "", add_special_tokens=False).ids + [2]


def test_encoder_gives_the_tokenizers_ids():
    rng = random.Random(3)
    letters = "abcXYZ  \n\t0123456789.,!?'sétllüñß漢字😀  \u0000<|>endoftext"
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b", "don't we'll", "x" * 3000, "  \n\n  "] + ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    encode = packing.encoder(packing.default_path())
    for text in texts:
        assert encode(text).tolist() + [2] == reference_ids(text)


def test_runs_of_two_million_characters(spark):
    """The faster encoder refuses long runs of white space; the ids are the tokenizer's all the same."""
    texts = ["x" + " " * 2_000_000 + "y", "\n" * 2_000_000, "a" * 2_000_000]
    got = packing.pieces(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    for k, text in enumerate(texts):
        ids = np.array(reference_ids(text), dtype="<u4")
        want = [(s, e - s, zlib.crc32(ids[s:e].tobytes())) for s, e in packing.cuts(len(ids), 1024)]
        assert sorted((g["start"], g["length"], g["ids_crc32"]) for g in got if g["_id"] == k) == want


def test_cuts():
    assert packing.cuts(1024, 1024) == [(0, 1024)]
    assert packing.cuts(1025, 1024) == [(0, 1), (1, 1025)]
    assert packing.cuts(2048, 1024) == [(0, 1024), (1024, 2048)]
    for n in range(1, 60):
        parts = packing.cuts(n, 7)
        assert parts[0][0] == 0 and parts[-1][1] == n
        assert all(a[1] == b[0] for a, b in zip(parts, parts[1:]))
        assert all(e - s == 7 for s, e in parts[1:]) and 1 <= parts[0][1] <= 7


def plain_choice(counts, size, capacity):
    """The least sum of squares over all places, by trying each."""
    best = None
    for gap in [*range(size, capacity), capacity]:
        if gap < capacity and not counts[gap]:
            continue
        c = counts.copy()
        if gap < capacity:
            c[gap] -= 1
        if gap > size:
            c[gap - size] += 1
        total = int((c[1:capacity] ** 2).sum())
        if best is None or total < best:
            best = total
    return best


def test_sum_of_squares_takes_the_best_place():
    rng = random.Random(5)
    capacity, counts, fills = 12, np.zeros(13, dtype=np.int64), {}
    sizes = [rng.randint(1, 12) for _ in range(150)]
    bins = packing.sum_of_squares(sizes, capacity)
    for size, b in zip(sizes, bins):
        want = plain_choice(counts, size, capacity)
        old = capacity - fills.get(b, 0)
        if b in fills and old < capacity:
            counts[old] -= 1
        fills[b] = fills.get(b, 0) + size
        assert fills[b] <= capacity
        if fills[b] < capacity:
            counts[capacity - fills[b]] += 1
        assert int((counts[1:capacity] ** 2).sum()) == want


@pytest.mark.parametrize("shard", [50, 4096])
def test_query_rows(spark, shard):
    rows = edge_rows() + random_rows() + [(9000 + k, "long text " * (400 + 13 * k), "en", "a", 0, 0, "", None) for k in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = packing.pack(packing.pieces(df), shard=shard).collect()
    want = []
    for r in rows:
        ids = reference_ids(r[1])
        for k, (s, e) in enumerate(packing.cuts(len(ids), 1024)):
            want.append((r[0], k, s, e - s, zlib.crc32(np.array(ids[s:e], dtype="<u4").tobytes())))
    assert sorted(map(str, ((g["_id"], g["piece"], g["start"], g["length"], g["ids_crc32"]) for g in got))) == sorted(map(str, want))
    bins = defaultdict(list)
    for g in got:
        bins[g["sequence_id"]].append((g["offset"], g["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    least = -(-sum(g["length"] for g in got) // 1024)
    assert len(bins) <= 1.03 * least + 2


def test_good_packing_at_size():
    rng = np.random.default_rng(1)
    sizes = sorted(rng.integers(1, 700, 8000).tolist(), reverse=True)
    n = max(packing.sum_of_squares(sizes, 1024)) + 1
    assert n <= 1.02 * sum(sizes) / 1024


def test_empty(spark):
    assert packing.pack(packing.pieces(spark.createDataFrame([], SCHEMA))).count() == 0
