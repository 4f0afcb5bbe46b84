import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from corvane.llm import slack_packing as sp
from tests.llm.helpers import SCHEMA, edge_rows, random_rows


def reference_ids(text):
    from tokenizers import Tokenizer

    if not hasattr(reference_ids, "t"):
        reference_ids.t = Tokenizer.from_file(sp.default_path())
    return reference_ids.t.encode(text or "", add_special_tokens=False).ids


def test_ids_are_the_tokenizers():
    rng = random.Random(3)
    letters = "abcXYZ  \n\t0123456789.,!?'sétllüñß漢字😀  \u0085\x1ćéΣςİK<|>endoftext"
    texts = ["", " ", "<|endoftext|>", "a<|endoftext|>b", "a <|startoftext|> b", "don't we'll", "x" * 3000, " ́a", "ΣΑΣ ΣΑΣ"]
    texts += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(400)]
    encode = sp.encoder(sp.default_path())
    assert encode.__name__ == "<lambda>"  # word by word
    for text in texts:
        assert np.frombuffer(encode(text.encode()), "<u4").tolist() == reference_ids(text)


def test_words_without_the_tokenizer(data):
    """All words of a table, and words of all Latin letters and signs, by the faster way."""
    import duckdb

    words = {w for (t,) in duckdb.sql(f"select text from '{data}/sf0.01/documents.parquet' where text is not null").fetchall() for w in t.split()}
    rng = random.Random(7)
    letters = [chr(c) for c in range(33, 0x250) if not chr(c).isspace()]
    words |= {"".join(rng.choices(letters, k=rng.randint(1, 9))) for _ in range(20_000)} | set(letters) | {"e\u0301a"}
    fast, taken = sp.Words(sp.default_path()).fast, 0
    from tokenizers import Tokenizer

    words = sorted(words)
    for word, want in zip(words, Tokenizer.from_file(sp.default_path()).encode_batch(words, add_special_tokens=False)):
        got = fast(word.encode())
        taken += got is not None
        assert got is None or got == want.ids, word
    assert taken > 0.98 * len(words)


def test_fill_is_the_closest_sum():
    rng = random.Random(4)
    for _ in range(200):
        sizes = [rng.randint(1, 30) for _ in range(rng.randint(0, 9))]
        room, counts = rng.randint(1, 60), Counter(sizes)
        best = max(sum(c) for k in range(len(sizes) + 1) for c in itertools.combinations(sizes, k) if sum(c) <= room)
        took = sp.fill(counts, sorted(counts, reverse=True), room)
        assert sum(s * c for s, c in took.items()) == best
        assert all(0 < c <= counts[s] for s, c in took.items())


@pytest.mark.parametrize("last", [True, False])
@pytest.mark.parametrize("sizes", [[3000] * 40, [4095] * 9, [1] * 9000, [2048] * 5, [2049, 2049, 2049], [7], [], list(range(1, 400)), [3, 4093, 5, 4091] * 20])
def test_windows_need_no_padding(sizes, last):
    windows, on = sp.bins_of(sizes, 4096, last)
    length = lambda i, part: sizes[i] if part < 0 else sp.digits(sizes[i])[part]
    assert all((n := sum(length(*x) for x in w)) <= 4096 and n & (n - 1) == 0 for w in windows)
    seen, parts = Counter(x for w in windows for x in w), defaultdict(list)
    for i, part in seen:
        parts[i].append(part)
    for i in range(len(sizes)):
        own = parts[i]
        assert own == [-1] or sorted(own) == list(range(len(sp.digits(sizes[i])))) or (i in on and not own)
    assert set(seen.values()) <= {1} and len(set(on)) == len(on) and not (last and on)
    if not on:
        assert sum(sum(length(*x) for x in w) == 4096 for w in windows) == sum(sizes) // 4096


@pytest.mark.parametrize("shard, capacity", [(40, 64), (4096, 4096)])
def test_rows(spark, shard, capacity):
    rows = edge_rows() + random_rows() + [(9000 + k, "long text " * (1800 + 13 * k), "en", "a", 0, 0, "", None) for k in range(9)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = sp.pack(sp.items(df, capacity=capacity), capacity, shard, few=8).collect()
    texts = defaultdict(list)
    for r in rows:
        texts[r[0]].append(reference_ids(r[1]) + [2])
    # every id of every document lies in one piece, with its checksum
    for name, docs in texts.items():
        want = Counter((s, len(ids)) for ids in docs for s in range(len(ids)))
        own = [g for g in got if g["_id"] == name]
        assert Counter((s, g["doc_tokens"]) for g in own for s in range(g["start"], g["start"] + g["length"])) == want
        for g in own:
            assert any(zlib.crc32(np.array(ids[g["start"] : g["start"] + g["length"]], dtype="<u4").tobytes()) == g["ids_crc32"] for ids in docs if len(ids) == g["doc_tokens"])
    bins = defaultdict(list)
    for g in got:
        bins[g["sequence_id"]].append((g["offset"], g["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= capacity and at & (at - 1) == 0
    total = sum(g["length"] for g in got)
    assert sum(sum(n for _, n in p) == capacity for p in bins.values()) >= total // capacity - 40
    if shard == 4096:  # few documents that fit are cut
        pieces = Counter((g["_id"], g["doc_tokens"]) for g in got if g["doc_tokens"] <= 4096)
        assert sum(c > 1 for c in pieces.values()) < 20


def test_empty_and_odd_names(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert sp.pack(sp.items(empty)).count() == 0
    odd = spark.createDataFrame([("a", None, 1), ("b", "x y", 2), (None, "", 3)], "`doc.id` string, `te``xt` string, _n long")
    assert sum(r["length"] for r in sp.pack(sp.items(odd, "doc.id", "te`xt")).collect()) == 5
