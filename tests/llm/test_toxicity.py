import numpy as np
import pytest

from corvane.llm import toxicity
from tests.llm.helpers import SCHEMA, edge_rows


def test_gradients():
    rng = np.random.default_rng(0)
    w = toxicity.start_weights(rng)
    x = rng.normal(size=(6, toxicity.INPUT))
    x[-1] = 0
    at = rng.integers(0, 6, (3, 5))
    at[1, 3:] = 5
    at[2] = 5
    y, weight = np.array([1.0, 0.0, 1.0]), np.array([1.0, 3.0, 1.0])
    _, g, dx = toxicity.gradients(w, x, at, y, weight)
    eps = 1e-6
    for name in (n for n in w if n != "chars"):
        for spot in [tuple(rng.integers(0, n) for n in w[name].shape) for _ in range(4)]:
            old = w[name][spot]
            w[name][spot] = old + eps
            up = toxicity.gradients(w, x, at, y, weight)[0]
            w[name][spot] = old - eps
            down = toxicity.gradients(w, x, at, y, weight)[0]
            w[name][spot] = old
            assert g[name][spot] == pytest.approx((up - down) / (2 * eps), abs=1e-6), name
    for spot in [(0, 0), (2, 3), (4, 7)]:
        old = x[spot]
        x[spot] = old + eps
        up = toxicity.gradients(w, x, at, y, weight)[0]
        x[spot] = old - eps
        down = toxicity.gradients(w, x, at, y, weight)[0]
        x[spot] = old
        assert dx[spot] == pytest.approx((up - down) / (2 * eps), abs=1e-6)


def test_windows_hold_every_word():
    lengths = np.array([0, 1, 63, 64, 65, 112, 113, 500])
    spots, owner = toxicity.windows_of(lengths)
    starts = np.cumsum(lengths) - lengths
    for n, (length, start) in enumerate(zip(lengths, starts)):
        own = spots[owner == n]
        assert len(own) >= 1
        assert set(own[own >= 0]) == set(range(start, start + length))


def test_trigrams_stay_inside_words():
    words = ["", "a", "ab", "abc", "é", "word"]
    hashed, starts = toxicity.trigrams(words)
    sizes = np.diff(np.append(starts, len(hashed)))
    assert sizes.tolist() == [1 if len(w.encode()) < 1 else len(w.encode()) for w in words]
    alone = [toxicity.trigrams([w])[0].tolist() for w in words]
    assert sum(alone, []) == hashed.tolist()


def test_groups_do_not_change_scores(monkeypatch):
    texts = ["you are an awful fool " * 3, "a fine day " * 90, "", "fool", "nice words here"] * 8
    labels = np.array([1, 0, 0, 1, 0] * 8)
    model = toxicity.train(texts, labels)
    a = toxicity.scores(model, texts)
    monkeypatch.setattr(toxicity, "TOGETHER", 10)
    assert np.allclose(a, toxicity.scores(model, texts), atol=1e-5)
    assert ((a >= 0.5) == (labels == 1)).all()


def test_held_out_accuracy(spark, data):
    d = f"{data}/sf0.01"
    got = toxicity.query(spark, d).toPandas()
    labels = spark.read.parquet(f"{d}/labels.parquet").toPandas()
    rows = got.merge(labels, on="doc_id")
    rows = rows[rows.held_out]
    ranks, ones = rows.score.rank(), rows.toxic == 1
    auc = (ranks[ones].sum() - ones.sum() * (ones.sum() + 1) / 2) / (ones.sum() * (~ones).sum())
    assert auc >= 0.9
    assert got.score.between(0, 1).all() and len(got) == spark.read.parquet(f"{d}/documents.parquet").count()


def test_defined_cases(spark):
    rows = edge_rows()
    df = spark.createDataFrame(rows, SCHEMA)
    labels = "doc_id long, toxic int"
    none = toxicity.fit(df, spark.createDataFrame([], labels))
    assert [r["score"] for r in toxicity.scored(df, none).collect()] == [0.5] * len(rows)
    one = toxicity.fit(df, spark.createDataFrame([(k, 0) for k in range(10)] + [(None, 1), (4, None)], labels))
    assert {r["score"] for r in toxicity.scored(df, one).collect()} == {0.0}
    both = toxicity.fit(df, spark.createDataFrame([(k, k % 2) for k in range(11)] + [(3, 1)], labels))
    out = toxicity.scored(df, both).collect()
    assert len(out) == len(rows) and all(0 <= r["score"] <= 1 for r in out)
    assert toxicity.scored(spark.createDataFrame([], SCHEMA), both).count() == 0
    kept = toxicity.clean(df, spark.createDataFrame([(k, k % 2) for k in range(11)], labels))
    assert kept.columns == df.columns


def test_training_keeps_a_word_once(monkeypatch):
    """Memory of training follows the texts' words by a few numbers each, not by a string each."""
    import tracemalloc

    monkeypatch.setattr(toxicity, "EPOCHS", 1)
    monkeypatch.setattr(toxicity, "LEAST_UPDATES", 1)
    rng = np.random.default_rng(2)
    texts = [" ".join(f"word{k}x" for k in rng.integers(0, 300, 4000)) for _ in range(100)]
    labels = np.array([1, 0] * 50)
    tracemalloc.start()
    toxicity.train(texts, labels)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60 * 100 * 4000, peak


def test_log_odds_are_those_of_plain_counts():
    texts = ["bad words, here", "good words here here", "", "bad (badly) words", "badness goodness", "good goodly", "bad", "awfully bad"] * 3
    labels = np.array([1, 0, 0, 1, 1, 0, 1, 1] * 3)
    some = np.arange(len(texts)) % 5 != 1
    sample = toxicity.Sample(texts)
    got = sample.tables(sample.log_odds(labels, some))
    for n, table in zip((None, *toxicity.HEADS), got):
        sets = [{w[:n] for w in toxicity.words_of(t) if n is None or len(w) > n} for t in texts]
        a, b = (int((labels[some] == y).sum()) for y in (1, 0))
        want = {}
        for w in set().union(*sets) - {""}:
            x, y = (sum(w in s for s, l, o in zip(sets, labels, some) if o and l == z) for z in (1, 0))
            odds = np.log((x + 0.5) / (a + 1)) - np.log((y + 0.5) / (b + 1))
            if x + y >= toxicity.LEAST_DOCS and abs(odds) > 0.7:
                want[w] = max(-4.0, min(4.0, odds))
        assert table == pytest.approx(want)
