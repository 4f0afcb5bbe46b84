"""Every stage against a plain version over its own input."""

import collections

import pytest

import corpus_pipeline
from corvane.llm import toxicity
from tests.llm.helpers import lower
from tests.llm.test_simhash import shingles


@pytest.fixture(scope="module")
def stages(spark, data, tmp_path_factory):
    d, folder = f"{data}/sf0.01", tmp_path_factory.mktemp("stages")
    docs, out = spark.read.parquet(f"{d}/documents.parquet"), []
    for name, f in corpus_pipeline.STAGES:
        f(spark, docs, d).write.parquet(f"{folder}/{name}")
        got = spark.read.parquet(f"{folder}/{name}")
        out.append((name, docs, got))
        docs = got
    return out


def test_all_but_the_last_return_the_columns(stages):
    assert 4 <= len(stages) <= 5
    for _, docs, got in stages[:-1]:
        assert got.columns == docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]


def test_toxicity(stages, spark, data):
    _, docs, got = stages[0]
    d = f"{data}/sf0.01"
    model = toxicity.fit(docs, spark.read.parquet(f"{d}/labels.parquet").select("doc_id", "toxic"))
    rows = docs.collect()
    bad = toxicity.scores(model, [r["text"] for r in rows]) >= 0.5
    want = {r["doc_id"] for r, b in zip(rows, bad) if not b}
    kept = [r["doc_id"] for r in got.select("doc_id").collect()]
    assert set(kept) == want and len(kept) == len(want) < len(rows)
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    clean = [i for i, y in labels.items() if y == 0]
    assert sum(i in want for i in clean) >= 0.97 * len(clean)


def test_exact_dedup(stages):
    _, docs, got = stages[1]
    best = {}
    for r in docs.collect():
        best[lower(r["text"])] = max(best.get(lower(r["text"]), -1), r["doc_id"])
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(best.values())


def test_near_dedup(stages):
    """Components of texts with 0.8 of their distinct 5-word shingles in common, found through all shared shingles."""
    _, docs, got = stages[2]
    rows = [(r["doc_id"], shingles(r["text"])) for r in docs.collect()]
    having = collections.defaultdict(list)
    for k, (_, own) in enumerate(rows):
        for x in own:
            having[x].append(k)
    shared = collections.Counter((j, k) for own in having.values() for n, k in enumerate(own) for j in own[:n])
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    pairs = [(a, b) for (a, b), n in shared.items() if n >= 0.8 * (len(rows[a][1]) + len(rows[b][1]) - n)]
    empty = [k for k, (_, own) in enumerate(rows) if not own]
    for a, b in pairs + list(zip(empty, empty[1:])):
        parent[root(b)] = root(a)
    least = {}
    for k, (i, _) in enumerate(rows):
        least[root(k)] = min(least.get(root(k), i), i)
    assert pairs
    assert sorted(r["doc_id"] for r in got.collect()) == sorted(least.values())


def test_mixing(stages):
    _, docs, got = stages[3]
    sizes = {r["doc_id"]: (r["source"], len(r["text"].split())) for r in docs.collect()}
    times = collections.Counter(r["doc_id"] for r in got.collect())
    assert set(times) <= set(sizes) and max(times.values()) <= 2
    total = sum(n for _, n in sizes.values())
    taken = sum(sizes[i][1] * k for i, k in times.items())
    assert abs(taken - 1.5 * total) <= 0.05 * total


def test_packing(stages):
    _, docs, got = stages[4]
    rows = got.collect()
    firsts = collections.Counter(r["doc_id"] for r in rows if r["piece"] == 0)
    assert firsts == collections.Counter(r["doc_id"] for r in docs.select("doc_id").collect())
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= 1.05 * sum(r["length"] for r in rows) / 1024 + 2


def test_run_is_the_stages_in_a_row(stages, spark, data):
    want = stages[-1][2].select("doc_id", "piece", "start", "length", "ids_crc32")
    got = corpus_pipeline.run(spark, f"{data}/sf0.01").select(*want.columns)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
