import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corvane.llm import lm
from pyspark.sql import functions as F
from tests.llm.helpers import SCHEMA, edge_rows, lower, random_rows


def tokens(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text)) + [""]


def held(ident):
    return zlib.crc32(("" if ident is None else str(ident)).encode()) % 7 == 2


@pytest.mark.parametrize("block", [200, 1 << 20])
def test_base_scores_and_counts(spark, block):
    rows = edge_rows() + random_rows()
    got = lm.score(spark.createDataFrame(rows, SCHEMA).repartition(3), block=block).collect()
    counts = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    want = sorted(str((r[0], held(r[0]), len(tokens(r[1])), sum(counts[w] > 0 for w in tokens(r[1])), n, f"{sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(r[1])):.3e}")) for r in rows)
    assert sorted(str((g["doc_id"], g["held_out"], g["n_tokens"], g["n_known"], g["train_tokens"], f"{g['base_score']:.3e}")) for g in got) == want
    assert all(g["score"] < 0 for g in got)


def test_score_of_texts_sums_to_one(spark):
    """The empty text, and all texts of one word: P(end | start) plus, over words w, P(w | start) is 1, the unknown word among them."""
    rows = random_rows(120)
    words = sorted({w for r in rows for w in tokens(r[1]) if w}) + ["neverseenword"]
    asked = [(10_000, "")] + [(20_000 + k, w) for k, w in enumerate(words)] + [(30_000 + k, f"{w} {w}") for k, w in enumerate(words)]
    df = spark.createDataFrame(rows + [(i, t, "en", "a", 0, 0, "", None) for i, t in asked], SCHEMA)
    got = {g["doc_id"]: g["score"] for g in lm.score(df, held=F.col("doc_id") >= 10_000).collect()}
    # texts with an end: all are disjoint, so their probabilities stay below 1
    assert sum(10 ** got[i] for i, _ in asked) < 1
    assert 10 ** got[10_000] + sum(10 ** got[20_000 + k] for k in range(len(words))) < 1


def test_predictive_sums_to_one_by_the_model():
    """In one partition: over all known words and the unknown one, for every class."""
    rng = np.random.default_rng(0)
    words = 40
    key = np.unique(rng.integers(0, words, 300) * lm.CONTEXTS + rng.integers(0, 6, 300))
    key = np.unique(np.concatenate([key, np.arange(words) * lm.CONTEXTS]))
    count = rng.integers(1, 50, len(key))
    cls = key % lm.CONTEXTS
    customers = np.bincount(cls, weights=count, minlength=lm.CONTEXTS)
    model = lm.Model(int(count.sum()), words, customers, np.bincount(cls, minlength=lm.CONTEXTS).astype(float), 0.6)
    for s in range(1, lm.SWEEPS + 1):
        for _, pairs, guests, tables in model.run(0, words, key, count, s):
            pass
        model.totals.append((np.bincount(cls, weights=pairs, minlength=lm.CONTEXTS), guests.sum(), tables.sum(), 0.5))
    for s, pairs, guests, tables in model.run(0, words, key, count, lm.SWEEPS):
        up = np.append(model.parent(s, guests, tables), model.parent(s, 0.0, 0.0))
        assert up.sum() == pytest.approx(1.0)
        for c in range(6):
            own = np.zeros(words + 1)
            np.add.at(own, key[cls == c] // lm.CONTEXTS, (count - model.discount * pairs)[cls == c])
            p = own / (lm.STRENGTH + customers[c]) + model.weight(s)[c] * up
            assert p.sum() == pytest.approx(1.0) and (p > 0).all()


def test_seats():
    rng = np.random.default_rng(1)
    customers = np.array([1, 1, 2, 5, 1000, 200_000])
    t = lm.seated(customers, np.full(6, 0.5), 0.5, rng)
    assert (t >= 1).all() and (t <= customers).all() and t[0] == t[1] == 1
    many = np.mean([lm.seated(np.full(2000, 2), np.full(2000, 1.0), 0.5, rng).mean() for _ in range(5)])
    assert many == pytest.approx(1 + 1 / 1.5, abs=0.02)  # the second customer: 1 / (1 + 1 - 0.5)


def test_seats_are_those_of_customers_one_by_one():
    """Waits drawn at once give the same numbers of tables as single customers."""
    rng = np.random.default_rng(5)
    for c, a, d in ((3000, 0.4, 0.3), (2000, 5.0, 0.7), (5000, 0.01, 0.1)):
        at_once = lm.seated(np.full(400, c), np.full(400, a), d, rng)
        tables = np.ones(400)
        for n in range(1, c):
            tables += rng.random(400) < a / (a + n - d * tables)
        spread = math.sqrt((at_once.var() + tables.var()) / 400) + 1e-9
        assert abs(at_once.mean() - tables.mean()) < 5 * spread, (c, a, d, at_once.mean(), tables.mean())


class Direct:
    """Single customers moved one at a time through word, class and parent restaurants with their tables."""

    def __init__(self, rng, words, discounts):
        self.rng, self.words, self.d = rng, words, discounts
        self.tables = {}  # restaurant -> dish -> sizes of its tables

    def up(self, r):
        return None if r == () else (r[1],) if len(r) == 2 else ()

    def p(self, r, w):
        if r is None:
            return 1.0 / (self.words + 1)
        own = self.tables.get(r, {})
        n, t = sum(map(sum, own.values())), sum(map(len, own.values()))
        mine, d = own.get(w, []), self.d[len(r)]
        return (sum(mine) - d * len(mine) + (lm.STRENGTH + d * t) * self.p(self.up(r), w)) / (lm.STRENGTH + n)

    def add(self, r, w):
        if r is None:
            return
        own = self.tables.setdefault(r, {})
        d, mine = self.d[len(r)], own.setdefault(w, [])
        t = sum(map(len, own.values()))
        new = (lm.STRENGTH + d * t) * self.p(self.up(r), w)
        at = self.rng.random() * (sum(mine) - d * len(mine) + new)
        for k, size in enumerate(mine):
            at -= size - d
            if at < 0:
                mine[k] += 1
                return
        mine.append(1)
        self.add(self.up(r), w)

    def take(self, r, w):
        if r is None:
            return
        mine = self.tables[r][w]
        at = self.rng.integers(sum(mine))
        for k, size in enumerate(mine):
            at -= size
            if at < 0:
                break
        mine[k] -= 1
        if not mine[k]:
            del mine[k]
            self.take(self.up(r), w)


def test_scores_are_near_those_of_a_sampler_of_single_customers(spark):
    rng = np.random.default_rng(3)
    vocabulary = [f"{x}{y}" for x in "abcd" for y in ("ing", "er")]
    texts = []
    for k in range(160):
        at, words = int(rng.integers(8)), []
        for _ in range(int(rng.integers(3, 9))):
            at = (at * 3 + int(rng.choice([1, 1, 1, 2, 5]))) % 8
            words.append(vocabulary[at])
        texts.append(" ".join(words))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["score"] for r in lm.score(df.repartition(3), held=F.col("doc_id") >= 120).collect()}
    pairs = [(b, w) for t in texts[:120] for b, w in zip([""] + tokens(t), tokens(t))]
    counts, classes = Counter(pairs), Counter()
    name = lambda b: (b, lm.context_class(b.encode()))
    for (b, w), n in counts.items():
        classes[lm.context_class(b.encode()), w] += 1
    discount = lambda c: lm._discount(sum(v == 1 for v in c.values()), sum(v == 2 for v in c.values()))
    direct = Direct(rng, len({w for _, w in pairs}), {2: discount(counts), 1: discount(classes), 0: 0.5})
    for b, w in pairs:
        direct.add(name(b), w)
    total, kept = np.zeros(40), 0
    for sweep in range(14):
        for i in rng.permutation(len(pairs)):
            b, w = pairs[i]
            direct.take(name(b), w)
            direct.add(name(b), w)
        if sweep >= 4:
            kept += 1
            total += [math.prod(direct.p(name(b), w) for b, w in zip([""] + tokens(t), tokens(t))) for t in texts[120:]]
    per = [(got[120 + k] - math.log10(total[k] / kept)) / len(tokens(texts[120 + k])) for k in range(40)]
    assert abs(float(np.mean(per))) < 0.02 and float(np.abs(per).max()) < 0.08, (np.mean(per), np.abs(per).max())


def test_held_out_perplexity_beats_the_base(spark, data):
    got = lm.query(spark, f"{data}/sf0.01").where("held_out").toPandas()
    assert got.score.sum() / got.n_tokens.sum() > got.base_score.sum() / got.n_tokens.sum()


def test_empty(spark):
    assert lm.score(spark.createDataFrame([], SCHEMA)).count() == 0
    only_held = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    row = lm.score(only_held, held=F.lit(True)).first()
    assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (3, 0, 0)


def test_a_context_is_the_whole_word(spark):
    """Two words of one ending, of which each has its own follower."""
    rows = [(k, "qab one" if k % 2 else "rab two") for k in range(60)] + [(100, "qab one"), (101, "qab two"), (102, "rab one"), (103, "rab two")]
    assert lm.context_class(b"qab") == lm.context_class(b"rab")
    got = {g["doc_id"]: g["score"] for g in lm.score(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), held=F.col("doc_id") >= 100).collect()}
    assert got[100] > got[101] + 0.5 and got[103] > got[102] + 0.5


def test_pairs_seen_once_by_hand(spark):
    """Nothing is drawn: every customer has a table in each of the three levels."""
    rows = [(1, "a b c d"), (2, "b d"), (3, "zz")]
    got = {g["doc_id"]: g["score"] for g in lm.score(spark.createDataFrame(rows, "doc_id long, text string"), held=F.col("doc_id") > 1).collect()}
    d = 0.95
    parent = lambda known: (known * (1 - d) + (1 + 5 * d) / 6) / 6
    level = lambda here, up: (here * (1 - d) + (1 + d) * up) / 2
    p = lambda here, known=1: level(here, level(here, parent(known)))
    assert got[1] == pytest.approx(5 * math.log10(p(1)))
    assert got[2] == pytest.approx(math.log10(p(0) * p(0) * p(1)))
    assert got[3] == pytest.approx(math.log10(p(0, 0) * parent(1)))  # an unknown word is a context without customers, and so is its class


def test_waits_are_found_in_few_steps(monkeypatch):
    """The least number of customers at which no table has opened is as likely as drawn, and few gamma functions are taken for it."""
    rng, taken = np.random.default_rng(3), [0]
    x, a, room = 10 ** rng.uniform(-1, 4, 2000), 10 ** rng.uniform(-6, 1, 2000), np.floor(10 ** rng.uniform(1.2, 5, 2000))
    a = np.minimum(a, x / 16)
    plain = lm._lgamma
    monkeypatch.setattr(lm, "_lgamma", lambda v: (taken.__setitem__(0, taken[0] + v.size), plain(v))[1])
    m = lm._wait(x, a, room, np.random.default_rng(4))
    assert taken[0] <= 12 * len(x)
    draw = np.log(1.0 - np.random.default_rng(4).random(len(x)))
    none = lambda k: plain(x + k) - plain(x + a + k) + plain(x + a) - plain(x)
    assert ((m >= 1) & (m <= room + 1)).all()
    assert (none(np.minimum(m, room))[m <= room] <= draw[m <= room] + 1e-9).all()
    assert (none(m - 1) >= draw - 1e-9).all()


def test_keys_hold_the_class():
    words = [b"", b"a", b"ab", b"abc", "é".encode(), b"xyz"]
    keys = lm.context_keys(words)
    assert [int(k) & 0xFF for k in keys] == [lm.context_class(w) for w in words]


def test_counts_answer_what_training_has_not():
    """Words, pairs and kinds that only held-out rows have are past the end; the others are numbered as without them."""
    block = lm._Block(0)
    for k, (held, text) in enumerate([(False, b"a b a b c"), (True, b"b a z z a"), (False, b"c a b"), (True, b"q")]):
        block.add(k, held, text)
    asks = [b for _, (kind, _, b) in block.rows(1, 0) if kind == "ask"]
    few, all_ = lm.Counts(asks), lm.Counts(asks, every=True)
    for name in ("count", "word", "place", "contexts", "kinds", "kind", "many", "shared", "many_place"):
        assert np.array_equal(getattr(few, name), getattr(all_, name)), name
    assert few.words == all_.words == 4
    _, pair, kind = all_.asked[0]
    assert {n for n, at in zip(all_.names, all_.word_at) if at == 4} == {b"z", b"q"}
    assert few.count.sum() == 10 and all_.count[np.unique(pair[pair < len(few.count)])].sum() == 10
    assert (pair == len(few.count)).sum() == 7 and (kind <= len(few.kinds)).all()  # of 15 pairs of the block


def test_dishes_alone_are_seated_alike(monkeypatch):
    """Few dishes and many dishes have the same distribution of tables."""
    rng = np.random.default_rng(5)
    for c, a, d in ((60, 0.3, 0.5), (3000, 0.05, 0.7), (300, 20.0, 0.3)):
        many = lm.seated(np.full(3000, c), np.full(3000, a), d, rng)
        monkeypatch.setattr(lm, "ALONE", 3000)
        alone = lm.seated(np.full(3000, c), np.full(3000, a), d, rng)
        monkeypatch.undo()
        assert abs(many.mean() - alone.mean()) < 5 * (many.var() / 3000 + alone.var() / 3000) ** 0.5
        assert 0.85 < many.std() / alone.std() < 1.18
