"""Toxicity by a bidirectional gated recurrent network with attention pooling, trained in numpy.

A word's input is its log odds of toxic against other training documents, whether it is known, the log odds of its
first characters, and the mean of learned vectors of its character trigrams. All windows of WINDOW words, which overlap by WINDOW - STRIDE, are scored; a text's
score is that of its highest window. In training the highest window of each document carries the label, so the network
learns which window of a toxic document matters. Log odds for training come from the other folds of the documents.

The classifier is fitted on a bounded sample of labelled rows: at most TRAIN_TOXIC and TRAIN_OTHER documents, the first
in the order of a hash, with TRAIN_CHARS characters in all; the loss is weighted back to the real share. Held-out rows (CRC-32 of the identifier's digits,
modulo 5, is 0) are never in it. Inputs are texts alone.

Defined cases: null text is empty and has a score like any other text; without labels of both kinds every score is the
share of toxic labels (0.5 without any); repeated rows and ties score alike; of an identifier with several labels the
toxic one counts, of one with several texts the least; identifiers may be numbers or strings, null ones never train; very
long texts are scored in full; columns of the input may have any name; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.llm.common import ident, ident_type, texts_of

TRAIN_TOXIC, TRAIN_OTHER = 800, 1600
#: Characters of training texts in all; half of them for each label, and a sixteenth for one text.
TRAIN_CHARS = 32 << 20
WINDOW, STRIDE = 64, 48
TRIGRAMS, CHARS, HIDDEN, ATTEND = 4096, 8, 8, 8
#: Lengths of the first characters of a word that have log odds of their own.
HEADS = (4, 5, 6)
KNOWN = 2 + len(HEADS)
INPUT = KNOWN + CHARS
LEAST_DOCS, SEED = 3, 3
#: Parts of the training documents, each of which takes its log odds from the others; epochs, and updates at least (small samples see more epochs).
FOLDS, EPOCHS, LEAST_UPDATES = 5, 8, 400
EDGES = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum()) + "«»“”„‘’…¿¡–—"


def words_of(text: str) -> list[str]:
    return [w.strip(EDGES) for w in text.lower().split()]


class Sample:
    """Training texts as numbers of words: a text's words stand once in memory, however often they come."""

    def __init__(self, texts: list[str]):
        known: defaultdict[str, int] = defaultdict(itertools.count().__next__)
        each = []
        for text in texts:
            own = words_of(text)
            each.append(np.fromiter(map(known.__getitem__, own), np.int32, len(own)))
        self.words, self.docs = list(known), len(texts)
        self.lengths = np.array([len(x) for x in each], dtype=np.int64)
        self.tokens = np.concatenate(each) if each else np.zeros(0, np.int32)
        # each text's distinct words, and its distinct heads of words by length; -1: no longer than the head
        self.heads, self.sets = [], [self._sets(each)]
        for n in HEADS:
            known = defaultdict(itertools.count().__next__)
            head_of = np.fromiter((known[w[:n]] if len(w) > n else -1 for w in self.words), np.int32, len(self.words))
            self.heads.append((list(known), head_of))
            self.sets.append(self._sets(head_of[x] for x in each))

    @staticmethod
    def _sets(each) -> tuple[np.ndarray, np.ndarray]:
        """Texts and their distinct members from zero up."""
        sets = [np.unique(x) for x in each]
        doc = np.repeat(np.arange(len(sets), dtype=np.int32), [len(x) for x in sets])
        member = np.concatenate(sets) if sets else np.zeros(0, np.int32)
        return doc[member >= 0], member[member >= 0]

    def log_odds(self, labels: np.ndarray, some: np.ndarray) -> list[np.ndarray]:
        """Of whole words, then of their heads by length, in some of the texts; 0 for those in fewer than LEAST_DOCS of
        them and for small ones."""
        n, m = int(labels[some].sum()), int((1 - labels[some]).sum())
        out = []
        for names, (doc, member) in zip([self.words, *[h for h, _ in self.heads]], self.sets):
            toxic, other = (np.bincount(member[some[doc] & (labels[doc] == y)], minlength=len(names)) for y in (1, 0))
            odds = np.zeros(len(names))
            for i in np.flatnonzero(toxic + other >= LEAST_DOCS).tolist():
                x = math.log((int(toxic[i]) + 0.5) / (n + 1)) - math.log((int(other[i]) + 0.5) / (m + 1))
                if names[i] and abs(x) > 0.7:
                    odds[i] = max(-4.0, min(4.0, x))
            out.append(odds)
        return out

    def of_words(self, words: np.ndarray, odds: list[np.ndarray]) -> np.ndarray:
        """One row per word (by number), one column per table."""
        out = np.zeros((len(words), 1 + len(HEADS)), dtype=np.float32)
        out[:, 0] = odds[0][words]
        for k, (_, head_of) in enumerate(self.heads):
            out[:, k + 1] = np.append(odds[k + 1], 0.0)[head_of[words]]
        return out

    def tables(self, odds: list[np.ndarray]) -> list[dict[str, float]]:
        """By name, without those that are 0."""
        return [{names[i]: float(x[i]) for i in np.flatnonzero(x).tolist()} for names, x in zip([self.words, *[h for h, _ in self.heads]], odds)]


def odds_of(words, tables: list[dict[str, float]]) -> np.ndarray:
    """One row per word, one column per table; a word that is no longer than a head has none there."""
    whole, out = tables[0].get, np.zeros((len(words), 1 + len(HEADS)), dtype=np.float32)
    out[:, 0] = [whole(w, 0.0) for w in words]
    for k, n in enumerate(HEADS):
        get = tables[k + 1].get
        out[:, k + 1] = [get(w[:n], 0.0) if len(w) > n else 0.0 for w in words]
    return out


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all trigrams of the words' bytes with a mark on both sides, and where each word's begin."""
    raw = [b"\x02" + (w.encode("utf-8", "replace") or b"\x03") + b"\x03" for w in words]
    flat = np.frombuffer(b"".join(raw) + b"\x00\x00", dtype=np.uint8).astype(np.uint32)
    lengths = np.array([len(r) for r in raw], dtype=np.int64)
    ends = np.cumsum(lengths)
    hashed = ((flat[:-2] * 961 + flat[1:-1] * 31 + flat[2:]) * np.uint32(2654435761)) >> np.uint32(20)
    keep = np.ones(len(hashed), dtype=bool)  # but for those that would leave their word
    keep[ends - 1] = keep[ends - 2] = False
    return hashed[keep].astype(np.int32), np.cumsum(lengths - 2) - (lengths - 2)


def char_means(table: np.ndarray, hashed: np.ndarray, starts: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """Mean vector of each word's trigrams, a block of words at a time."""
    out = np.empty((len(starts), CHARS), table.dtype)
    ends = np.append(starts[1:], len(hashed))
    for at in range(0, len(starts), block):
        own, last = starts[at : at + block], ends[min(at + block, len(starts)) - 1]
        sums = np.add.reduceat(table[hashed[own[0] : last]], own - own[0], axis=0)
        out[at : at + block] = sums / (ends[at : at + block] - own)[:, None]
    return out


def windows_of(lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions (window, WINDOW) in the joined words, -1 past a text's end, and the text of each window; one at least for every text."""
    counts = np.maximum(1, -(-(lengths - (WINDOW - STRIDE)) // STRIDE))
    owner = np.repeat(np.arange(len(lengths)), counts)
    first = (np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)) * STRIDE
    within = first[:, None] + np.arange(WINDOW)
    starts = np.cumsum(lengths) - lengths
    return np.where(within < lengths[owner][:, None], within + starts[owner][:, None], -1), owner


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    r = lambda *s: rng.normal(0, 0.3, s)
    w = {"chars": r(TRIGRAMS, CHARS), "wa": r(2 * HIDDEN, ATTEND), "va": r(ATTEND), "out": r(2 * HIDDEN), "bias": np.zeros(1)}
    for d in "fb":
        w |= {f"x{d}": r(INPUT, 3 * HIDDEN), f"h{d}": r(HIDDEN, 3 * HIDDEN), f"b{d}": np.zeros(3 * HIDDEN)}
    return w


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _gru(gates: np.ndarray, wh: np.ndarray, keep: bool):
    """gates: input part (time, rows, 3 * HIDDEN): update, reset, new."""
    t, n, _ = gates.shape
    h = np.zeros((n, HIDDEN), gates.dtype)
    out, saved = np.empty((t, n, HIDDEN), gates.dtype), []
    for k in range(t):
        inner = h @ wh
        zr = _sigmoid(gates[k][:, : 2 * HIDDEN] + inner[:, : 2 * HIDDEN])
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        new = np.tanh(gates[k][:, 2 * HIDDEN :] + r * inner[:, 2 * HIDDEN :])
        before = h
        h = new + z * (h - new)
        out[k] = h
        if keep:
            saved.append((z, r, new, before, inner[:, 2 * HIDDEN :]))
    return out, saved


def _gru_back(dout: np.ndarray, wh: np.ndarray, saved):
    t, n, _ = dout.shape
    dgates, dwh, dh = np.empty((t, n, 3 * HIDDEN), dout.dtype), np.zeros_like(wh), np.zeros((n, HIDDEN), dout.dtype)
    for k in range(t - 1, -1, -1):
        z, r, new, before, inner = saved[k]
        dh = dh + dout[k]
        dnew = dh * (1 - z) * (1 - new * new)
        dz, dr = dh * (before - new) * z * (1 - z), dnew * inner * r * (1 - r)
        dinner = np.concatenate([dz, dr, dnew * r], axis=1)
        dgates[k] = np.concatenate([dz, dr, dnew], axis=1)
        dwh += before.T @ dinner
        dh = dh * z + dinner @ wh.T
    return dgates, dwh


def forward(w: dict, x: np.ndarray, at: np.ndarray, keep: bool = False):
    """Logits of windows; x: inputs of distinct words, the last row of which is padding; at: (rows, time) into x."""
    steps = at.T
    mask = steps != len(x) - 1
    mask[0] |= ~mask.any(axis=0)  # an empty window looks at its padding
    runs = {}
    for d in "fb":
        runs[d] = _gru((x @ w[f"x{d}"] + w[f"b{d}"])[steps if d == "f" else steps[::-1]], w[f"h{d}"], keep)
    h = np.concatenate([runs["f"][0], runs["b"][0][::-1]], axis=2)
    looked = np.tanh(h @ w["wa"])
    pull = np.where(mask, looked @ w["va"], -1e9)
    share = np.exp(pull - pull.max(axis=0))
    share /= share.sum(axis=0)
    pooled = (share[:, :, None] * h).sum(axis=0)
    return pooled @ w["out"] + w["bias"][0], (h, looked, share, pooled, runs, mask)


def gradients(w: dict, x: np.ndarray, at: np.ndarray, y: np.ndarray, weight: np.ndarray):
    """Weighted logistic loss, its gradients, and the gradient of x."""
    logit, (h, looked, share, pooled, runs, mask) = forward(w, x, at, keep=True)
    p, total = _sigmoid(logit), weight.sum()
    loss = float((weight * (np.logaddexp(0, logit) - y * logit)).sum() / total)
    dlogit = weight * (p - y) / total
    g = {"out": pooled.T @ dlogit, "bias": np.array([dlogit.sum()])}
    dpooled = dlogit[:, None] * w["out"][None]
    dshare = (h * dpooled[None]).sum(axis=2)
    dpull = np.where(mask, share * (dshare - (share * dshare).sum(axis=0)), 0.0)
    dlooked = dpull[:, :, None] * w["va"] * (1 - looked * looked)
    g["va"] = (looked * dpull[:, :, None]).sum(axis=(0, 1))
    g["wa"] = h.reshape(-1, 2 * HIDDEN).T @ dlooked.reshape(-1, ATTEND)
    dh = share[:, :, None] * dpooled[None] + dlooked @ w["wa"].T
    steps, dx = at.T, np.zeros_like(x)
    for d, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[::-1, :, HIDDEN:])):
        dgates, g[f"h{d}"] = _gru_back(part, w[f"h{d}"], runs[d][1])
        by_word = np.zeros((len(x), 3 * HIDDEN))
        np.add.at(by_word, (steps if d == "f" else steps[::-1]).reshape(-1), dgates.reshape(-1, 3 * HIDDEN))
        g[f"x{d}"], g[f"b{d}"] = x.T @ by_word, by_word.sum(axis=0)
        dx += by_word @ w[f"x{d}"].T
    dx[-1] = 0.0
    return loss, g, dx


def _inputs(odds: np.ndarray, means: np.ndarray) -> np.ndarray:
    """Rows for distinct words, and a row of zeros for padding."""
    x = np.zeros((len(odds) + 1, INPUT), dtype=means.dtype)
    x[:-1, 0], x[:-1, 1], x[:-1, 2:KNOWN], x[:-1, KNOWN:] = odds[:, 0] / 2, odds[:, 0] != 0, odds[:, 1:] / 2, means
    return x


def train(texts: list[str], labels: np.ndarray, other_weight: float = 1.0, batch: int = 64, rate: float = 0.01, seed: int = SEED) -> dict:
    """Weights and log odds; labels are 0 or 1, and both occur."""
    rng = np.random.default_rng(seed)
    sample = Sample(texts)
    fold = rng.permutation(len(texts)) % FOLDS
    # a word in one fold is another row than in the other folds; rows in the order in which they come
    both = sample.tokens.astype(np.int64) * FOLDS + np.repeat(fold, sample.lengths)
    known, begin, joined = np.unique(both, return_index=True, return_inverse=True)
    order = np.argsort(begin)
    place = np.empty(len(order), dtype=np.int32)
    place[order] = np.arange(len(order), dtype=np.int32)
    word, of_fold = np.divmod(known[order], FOLDS)
    joined = np.append(place[joined], np.int32(len(known)))  # -1 finds the padding
    del both, begin, order, place
    odds = np.zeros((len(known), 1 + len(HEADS)), dtype=np.float32)
    for k in range(FOLDS):
        own = np.flatnonzero(of_fold == k)
        odds[own] = sample.of_words(word[own], sample.log_odds(labels, fold != k))
    every = [sample.words[i] for i in word.tolist()]
    tables = sample.tables(sample.log_odds(labels, np.ones(len(texts), dtype=bool)))
    lengths = sample.lengths
    del sample, word, of_fold
    hashed, starts = trigrams(every)
    per = np.diff(np.append(starts, len(hashed)))
    del every
    spots, owner = windows_of(lengths)
    at = joined[spots]
    del spots, joined
    first = np.searchsorted(owner, np.arange(len(texts)))
    best_odds = np.append(odds.max(axis=1), 0.0)[at].max(axis=1)
    w = start_weights(rng)
    m, v, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    each = max(1, (2 * len(texts)) // batch)
    for epoch in range(max(EPOCHS, -(-LEAST_UPDATES // each))):
        if epoch == 0:
            height = best_odds + 1e-3 * rng.random(len(at))
        else:
            x = _inputs(odds, char_means(w["chars"].astype(np.float32), hashed, starts))
            narrow = {k: z.astype(np.float32) for k, z in w.items()}
            height = np.concatenate([forward(narrow, x, at[k : k + 1024])[0] for k in range(0, len(at), 1024)])
        order = np.lexsort((-height, owner))
        chosen = order[first]  # the highest window of each document
        more = rng.choice(len(at), size=min(len(at), len(texts)), replace=False)
        more = more[labels[owner[more]] == 0]
        rows = rng.permutation(np.concatenate([chosen, more]))
        for some in np.array_split(rows, max(1, len(rows) // batch)):
            y = labels[owner[some]].astype(float)
            used, back = np.unique(at[some], return_inverse=True)
            used_words = used[used < len(known)]
            pick = np.concatenate([np.arange(starts[i], starts[i] + per[i]) for i in used_words]) if len(used_words) else np.zeros(0, np.int64)
            own_starts = np.cumsum(per[used_words]) - per[used_words]
            x = _inputs(odds[used_words], char_means(w["chars"], hashed[pick], own_starts))
            local = back.reshape(at[some].shape)
            _, g, dx = gradients(w, x, local, y, np.where(y == 1, 1.0, other_weight))
            g["chars"] = np.zeros_like(w["chars"])
            np.add.at(g["chars"], hashed[pick], np.repeat(dx[:-1, KNOWN:] / per[used_words][:, None], per[used_words], axis=0))
            norm = math.sqrt(sum(float((z * z).sum()) for z in g.values()))
            step += 1
            for k in w:
                z = g[k] * min(1.0, 5.0 / (norm + 1e-9)) + (1e-4 * w[k] if k != "chars" else 0.0)
                m[k], v[k] = 0.9 * m[k] + 0.1 * z, 0.99 * v[k] + 0.01 * z * z
                w[k] = w[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return {"net": {k: z.astype(np.float32) for k, z in w.items()}, "odds": tables}


#: Words that go through the network together.
TOGETHER = 200_000


def scores(model: dict, texts: list[str]) -> np.ndarray:
    """Score of each text: its highest window's."""
    out = np.empty(len(texts))
    if model.get("net") is None:
        out[:] = model["share"]
        return out
    at = 0
    while at < len(texts):
        known: dict[str, int] = {}
        put, ids, lengths, begin = known.setdefault, [], [], at
        while at < len(texts) and (at == begin or len(ids) < TOGETHER):
            before = len(ids)
            ids += [put(w, len(known)) for w in words_of(texts[at])]
            lengths.append(len(ids) - before)
            at += 1
        out[begin:at] = _group_scores(model, known, ids, np.array(lengths))
    return out


def _group_scores(model: dict, known: dict[str, int], ids: list[int], lengths: np.ndarray) -> np.ndarray:
    w, odds = model["net"], odds_of(list(known), model["odds"])
    means = char_means(w["chars"], *trigrams(list(known))) if known else np.zeros((0, CHARS), np.float32)
    x = _inputs(odds, means.astype(np.float32))
    joined = np.append(np.array(ids, dtype=np.int64), len(known))
    spots, owner = windows_of(lengths)
    high = np.full(len(lengths), -np.inf)
    for k in range(0, len(owner), 4096):
        logit, _ = forward(w, x, joined[spots[k : k + 4096]])
        np.maximum.at(high, owner[k : k + 4096], logit.astype(float))
    return _sigmoid(high)


def held_out(ident: Column) -> Column:
    return F.pmod(F.crc32(F.coalesce(ident.cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", most_toxic: int = TRAIN_TOXIC, most_other: int = TRAIN_OTHER, most_chars: int = TRAIN_CHARS) -> dict:
    """labels: doc_id and toxic, one row kept for each identifier; held-out identifiers and unlabelled rows are left out."""
    own = labels.select(F.col("doc_id").cast(ident_type(docs, id_col)).alias("_l"), F.col("toxic").alias("_y"))
    known = own.where("_y is not null and _l is not null").groupBy("_l").agg(F.max("_y").alias("_y")).where(~held_out(F.col("_l")))
    n = {r["_y"]: r["count"] for r in known.groupBy("_y").count().collect()}
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic or not other:
        return {"net": None, "share": toxic / (toxic + other) if toxic + other else 0.5}
    some = [known.where(F.col("_y") == y).orderBy(F.xxhash64("_l")).limit(most) for y, most in ((1, most_toxic), (0, most_other))]
    wanted = F.broadcast(some[0].unionByName(some[1]))  # at most most_toxic + most_other rows
    rows = docs.select(ident(docs, id_col).alias("_i"), texts_of(text_col).alias("_t")).join(wanted, F.col("_i") == F.col("_l"))
    # one text for each identifier, whichever rows bear it, and no more characters than the bound
    rows = rows.where(F.length("_t") <= most_chars // 16).groupBy("_l", "_y").agg(F.min("_t").alias("_t"))
    upto = F.sum(F.length("_t")).over(Window.partitionBy("_y").orderBy(F.xxhash64("_l")))  # of bounded rows
    rows = sorted(rows.withColumn("_upto", upto).where(F.col("_upto") <= most_chars // 2).select("_l", "_y", "_t").collect(), key=lambda r: r["_l"])
    labels_ = np.array([r["_y"] for r in rows], dtype=np.int64)
    a, b = int(labels_.sum()), int((1 - labels_).sum())
    if not a or not b:
        return {"net": None, "share": toxic / (toxic + other)}
    return train([r["_t"] for r in rows], labels_, other_weight=max(1.0, (other / b) / (toxic / a)))


def _scorer(model: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = scores(model, [t.as_py() or "" for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(got)], ["_id", "score"])

    return run


def scored(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """_id and score for every row."""
    rows = docs.select(ident(docs, id_col).alias("_id"), texts_of(text_col).alias("t"))
    return rows.mapInArrow(_scorer(model), f"_id {ident_type(docs, id_col)}, score double")


def clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows whose text isn't judged toxic, with the input's own columns; all rows without labels of both kinds."""
    model = fit(docs, labels, id_col, text_col)
    if model["net"] is None:  # nothing to judge by
        return docs

    @F.pandas_udf("double")
    def toxic(texts):
        import pandas as pd

        return pd.Series(scores(model, texts.fillna("").tolist()))

    return docs.where(toxic(texts_of(text_col)) < 0.5)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic")
    out = scored(docs, fit(docs, labels)).withColumnRenamed("_id", "doc_id")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
