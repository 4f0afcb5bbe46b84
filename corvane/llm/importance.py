"""Importance resampling towards a target distribution, over hashed n-grams.

A document's features are its runs of 1 to `most` consecutive words. Both corpora give counts for each bucket of features;
a bucket's gain is the log ratio of the two, a document's weight the sum of its features' gains, and documents are drawn
without replacement by the largest weights plus Gumbel noise that hangs on seed and identifier alone.

In a task, texts go by blocks of about BLOCK words. Words become ids, documents are divided by marks, and the suffixes of
the id sequence are sorted by their first `most` ids (ranks are doubled until they reach that far). Neighbours' common
prefixes cut the suffix array into runs of one n-gram each, for every length; the n-gram of a run is hashed once, and its
bucket goes to all places of the run. Counts of a task leave it as one histogram; places are summed by document.

Ranks over all drawn documents come from a range partition: the number in its range plus what the ranges before hold.

Defined cases: null and empty texts have no features, weight 0 and no rank; repeated rows take part as often as they
occur; equal scores go by the smaller identifier (null last); identifiers may be numbers, strings or null (as
text "null" in the noise); very long texts are whole blocks of their own; other columns do not matter, whatever their
names; empty tables give empty results, an empty target gains computed from zero counts.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER_BYTES, cut, ident, ident_type, partitions, texts_of

BUCKETS = 10_000
MOST = 1
SHARE = 10
LEAST_WORDS = 20
SEED = 2024
BLOCK = 1 << 20
#: Words that a task knows by number before it starts anew with the next block.
KNOWN = 1 << 20
#: In UTF-8 all letters beyond ASCII are bytes beyond 127, so the class can be read by bytes.
WORDS = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class Numbers(dict):
    """Words by number, from 1; 0 divides documents."""

    def __missing__(self, word: bytes) -> int:
        self[word] = n = len(self) + 1
        return n


def suffix_array(ids: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Places sorted by their first `depth` ids, and how many of these each shares with the place before it in the order.
    A common prefix ends at a divider."""
    n, reach = len(ids), 1
    rank = ids.astype(np.int64)
    while reach < depth:  # rank orders by the first `reach` ids
        step = min(reach, depth - reach)
        later = np.zeros(n, dtype=np.int64)
        later[: n - step] = rank[step:] + 1 if step < n else 0
        _, rank = np.unique(rank * (int(later.max(initial=0)) + 1) + later, return_inverse=True)
        reach += step
    order = np.argsort(rank, kind="stable")
    common = np.zeros(n, dtype=np.int32)
    going = np.ones(max(n - 1, 0), dtype=bool)
    for k in range(depth):
        a, b = order[:-1] + k, order[1:] + k
        inside = (a < n) & (b < n)
        x, y = ids[np.minimum(a, n - 1)], ids[np.minimum(b, n - 1)]
        going &= inside & (x == y) & (x != 0)
        common[1:] += going
    return order, common


def bucket_places(ids: np.ndarray, words: list[bytes], most: int, buckets: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length up to most: places at which an n-gram of that length starts, and its bucket. Each n-gram is hashed once."""
    order, common = suffix_array(ids, most)
    whole = np.ones(len(ids), dtype=bool)
    for length in range(1, most + 1):
        whole[: len(ids) - length + 1] &= ids[length - 1 :] != 0
        whole[len(ids) - length + 1 :] = False
        kept = whole[order]
        heads = common < length
        run = (np.cumsum(heads) - 1)[kept]
        places = order[kept]
        if not len(places):
            continue
        first = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        at = places[first]
        hashed = np.fromiter((zlib.crc32(b" ".join(words[i - 1] for i in ids[p : p + length].tolist())) % buckets for p in at.tolist()), np.int64, len(at))
        yield places, np.repeat(hashed, np.diff(np.r_[first, len(run)]))


def _blocks(texts: pa.Array, block: int = BLOCK) -> Iterator[tuple[int, int, np.ndarray, list[bytes], np.ndarray]]:
    """Runs of rows [a, b) with their ids, the words by number, and each place's row less a."""
    numbers, ids, sizes, a, total = Numbers(), [], [], 0, 0
    for k, text in enumerate(texts):
        found = WORDS.findall((text.as_py() or b"").translate(LOWER_BYTES))
        ids.append(np.fromiter(map(numbers.__getitem__, found), np.int32, len(found)))
        ids.append(np.zeros(1, dtype=np.int32))
        sizes.append(len(found))
        total += len(found)
        if total >= block or len(numbers) >= KNOWN or k + 1 == len(texts):
            yield a, k + 1, np.concatenate(ids), list(numbers), np.repeat(np.arange(k + 1 - a), np.array(sizes) + 1)
            numbers, ids, sizes, a, total = Numbers(), [], [], k + 1, 0


def histogram(texts: DataFrame, text_col: str = "text", most: int = MOST, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: how many features of all texts each bucket holds; at most `buckets` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for _, _, ids, words, _ in _blocks(batch.column(0)):
                for _, hashed in bucket_places(ids, words, most, buckets):
                    counts += np.bincount(hashed, minlength=buckets)
        held = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(counts[held], pa.int64())], ["bucket", "n"])

    rows = texts.select(texts_of(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def counts_of(texts: DataFrame, text_col: str = "text", most: int = MOST, buckets: int = BUCKETS) -> np.ndarray:
    """The histogram on the driver, an array of `buckets` numbers whatever the input's size."""
    out = np.zeros(buckets, dtype=np.int64)
    for bucket, n in histogram(texts, text_col, most, buckets).collect():
        out[bucket] = n
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of smoothed shares, rounded down."""
    k, s, t = len(raw), int(raw.sum()), int(target.sum())
    return np.array([math.floor(1000 * math.log((int(b) + 1) * (s + k) / ((int(a) + 1) * (t + k)))) for a, b in zip(raw, target)], dtype=np.int64)


def noise(name: object, seed: int) -> int:
    """Gumbel noise in thousandths, rounded down, from seed and identifier."""
    h = int(hashlib.sha256(f"{seed}:{'null' if name is None else name}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, id_col: str = "doc_id", text_col: str = "text", most: int = MOST, seed: int = SEED) -> DataFrame:
    """_id, n_words, n_features, weight and score of every row."""
    kind = ident_type(docs, id_col)
    key, buckets = pa.int64() if kind == "long" else pa.string(), len(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            words_of, features, weight = (np.zeros(n, dtype=np.int64) for _ in range(3))
            for a, b, ids, words, row in _blocks(batch.column(1)):
                words_of[a:b] = np.bincount(row[ids != 0], minlength=b - a)
                for places, hashed in bucket_places(ids, words, most, buckets):
                    features[a:b] += np.bincount(row[places], minlength=b - a)
                    sums = np.zeros(b - a, dtype=np.int64)
                    np.add.at(sums, row[places], gain[hashed])
                    weight[a:b] += sums
            names = batch.column(0).to_pylist()
            score = weight + np.fromiter((noise(x, seed) for x in names), np.int64, n)
            yield pa.RecordBatch.from_arrays([pa.array(names, key), *(pa.array(c) for c in (words_of, features, weight, score))], ["_id", "n_words", "n_features", "weight", "score"])

    rows = docs.select(ident(docs, id_col).alias("_id"), texts_of(text_col).cast("binary").alias("t"))
    return rows.mapInArrow(run, f"_id {kind}, n_words long, n_features long, weight long, score long")


def ranked(rows: DataFrame, share: int = SHARE, least_words: int = LEAST_WORDS) -> DataFrame:
    """rows with rank: 1, 2, 3... over the floor(share * N / 100) highest scores of the N rows with words enough; others null.

    Rows are dealt by ranges of score and identifier and sorted there; the offsets are one number for each range.
    """
    spark, rows = rows.sparkSession, cut(rows)  # ranges are sampled from rows that are there
    fit = F.col("n_words") >= least_words
    order = [F.when(fit, 0).otherwise(1), F.col("score").desc(), F.col("_id").asc_nulls_last()]
    keyed = rows.withColumns({"_late": order[0], "_down": -F.col("score")})
    dealt = keyed.repartitionByRange(partitions(spark), F.col("_late"), F.col("_down"), order[2]).sortWithinPartitions(F.col("_late"), F.col("_down"), order[2])
    placed = cut(dealt.withColumn("_at", F.monotonically_increasing_id()).drop("_late", "_down"))
    part = F.shiftright("_at", 33)
    sizes = sorted(placed.where(fit).groupBy(part.alias("p")).count().collect())
    total = sum(c for _, c in sizes)
    starts, seen = {}, 0
    for p, c in sizes:
        starts[p] = seen
        seen += c
    offsets = F.broadcast(spark.createDataFrame(list(starts.items()) or [(-1, 0)], "_part long, _start long"))
    rank = F.when(fit, F.col("_start") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1)
    out = placed.withColumn("_part", part).join(offsets, "_part", "left")
    return out.withColumn("rank", F.when(rank <= share * total // 100, rank)).drop("_at", "_part", "_start")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_text: str = "text", most: int = MOST, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """_id, n_features, weight, score and rank (null: not drawn) of every row of docs."""
    gain = gains(counts_of(docs, text_col, most, buckets), counts_of(target, target_text, most, buckets))
    return ranked(weigh(docs, gain, id_col, text_col, most, seed), share, least_words).drop("n_words")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return resample(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("text")).withColumnRenamed("_id", "doc_id")
