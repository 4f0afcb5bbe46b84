import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import importance as im
from tests.llm.helpers import SCHEMA, edge_rows, lower, random_rows


def features(text, most):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    return len(words), [" ".join(words[k : k + n]) for n in range(1, most + 1) for k in range(len(words) - n + 1)]


def plain(rows, target, most, buckets, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    s = Counter(bucket(f) for _, t in rows for f in features(t, most)[1])
    t = Counter(bucket(f) for x in target for f in features(x, most)[1])
    S, T = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets))))
    out = []
    for name, text in rows:
        n, found = features(text, most)
        weight = sum(gain(bucket(f)) for f in found)
        h = int(hashlib.sha256(f"2024:{'null' if name is None else name}".encode()).hexdigest()[:8], 16)
        out.append([name, len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n >= least])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: share * len(fit) // 100]):
        r[4] = k + 1
    return Counter(tuple(r[:5]) for r in out)


@pytest.mark.parametrize("most, buckets, share, least", [(1, 10_000, 10, 20), (3, 97, 50, 2), (4, 1000, 100, 0)])
def test_against_plain(spark, most, buckets, share, least, monkeypatch):
    rows = edge_rows() + random_rows(200)
    target = ["the thing here", None, "", "Über ÜBER letter the the the", "number of number"]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    tf = spark.createDataFrame([(t,) for t in target], "text string")
    got = im.resample(df, tf, most=most, buckets=buckets, share=share, least_words=least).collect()
    want = plain([r[:2] for r in rows], target, most, buckets, share, least)
    assert Counter((r["_id"], r["n_features"], r["weight"], r["score"], r["rank"]) for r in got) == want


@pytest.mark.parametrize("depth", [1, 2, 3, 5])
def test_suffix_array(depth):
    rng = np.random.default_rng(depth)
    for n in (1, 2, 7, 200):
        ids = rng.integers(0, 4, n).astype(np.int32)
        order, common = im.suffix_array(ids, depth)
        keys = [tuple(ids[p : p + depth]) for p in order]
        assert sorted(order.tolist()) == list(range(n)) and keys == sorted(keys)
        for a, b, c in zip(order, order[1:], common[1:]):
            k = 0
            while k < depth and max(a, b) + k < n and ids[a + k] == ids[b + k] != 0:
                k += 1
            assert c == k


def test_each_repeated_ngram_is_hashed_once(monkeypatch):
    seen = []
    real = zlib.crc32
    monkeypatch.setattr(im.zlib, "crc32", lambda x: seen.append(x) or real(x))
    text = b"a b a b a c a b"
    words = sorted(set(text.split()))
    ids = np.array([words.index(w) + 1 for w in text.split()] + [0], dtype=np.int32)
    places = [(n + 1, p.tolist()) for n, (p, _) in enumerate(im.bucket_places(ids, words, 2, 100))]
    assert sorted(seen) == [b"a", b"a b", b"a c", b"b", b"b a", b"c", b"c a"]
    assert [len(p) for _, p in places] == [8, 7]


def test_small_blocks_give_the_same(spark):
    texts = [b"the a the b", b"", b"b b b the", b"long " * 50]
    import pyarrow as pa

    whole = [(a, b) for a, b, *_ in im._blocks(pa.array(texts))]
    small = [(a, b) for a, b, *_ in im._blocks(pa.array(texts), 3)]
    assert whole == [(0, 4)] and small == [(0, 1), (1, 3), (3, 4)]


def test_empty_and_odd_names(spark):
    empty, target = spark.createDataFrame([], SCHEMA), spark.createDataFrame([("x",)], "text string")
    assert im.resample(empty, target).count() == 0
    odd = spark.createDataFrame([("a", "one two", 1), (None, None, 2)], "`doc.id` string, `te``xt` string, rank long")
    got = im.resample(odd, empty, "doc.id", "te`xt", least_words=1, share=100).collect()
    assert sorted((str(r["_id"]), r["n_features"], r["rank"]) for r in got) == [("None", 0, None), ("a", 2, 1)]


def test_drawn_documents_look_like_the_target(spark):
    rng = random.Random(1)
    mine, other = [f"good{k}" for k in range(50)], [f"poor{k}" for k in range(50)]
    rows = [(k, " ".join(rng.choice(mine if k % 5 == 0 else other) for _ in range(60))) for k in range(500)]
    target = [(" ".join(rng.choice(mine) for _ in range(60)),) for _ in range(20)]
    got = im.resample(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(target, "text string"))
    drawn = [r["_id"] for r in got.where("rank is not null").collect()]
    assert len(drawn) == 50 and all(x % 5 == 0 for x in drawn)
