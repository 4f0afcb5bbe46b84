"""Near duplicates by 64-bit SimHash and BK-trees.

Fingerprints are computed in Arrow batches, then only distinct ones go on. A pair within RADIUS bits agrees on one whole
block at least when the bits are cut into RADIUS + 1 blocks, so every fingerprint is sent to one shard for each of its
blocks. A shard of more than SHARD fingerprints is cut again by the blocks of its other bits, which keeps the argument
and bounds every shard: after LEVELS cuts so few bits are free that a shard can't hold more than 2^13 fingerprints. Each
shard builds a BK-tree (children keyed by their integer Hamming distance to the parent) and searches it along the edges
within the radius only. Shards hold links as stars, never as all pairs, and components are found by star contraction.

The trees are not broadcast: a broadcast passes through the driver, which must not hold the fingerprints of all
documents, and all trees together grow with the corpus. Each is built in the task to which the shuffle brings its shard,
together with the queries that can have an answer in it.

similar_groups links by Jaccard similarity instead (SIMILAR of the distinct shingles of SIMILAR_SHINGLE words). At that
similarity fingerprints differ in far more bits than blocks can tell apart, so shards come from least hashes of the
shingles: a pair at the threshold misses all BANDS of them with probability (1 - SIMILAR) ** BANDS, 1 in 3,125, and a
pair at 0.9 with 1 in 100,000. A shard of more than SIMILAR_SHARD texts is cut again by the next BANDS least hashes; what is still larger after
SIMILAR_LEVELS cuts is compared block by block. In each shard a BK-tree over the fingerprints is searched within WIDE
bits; what it finds must agree in AGREE least hashes and in length. A pair counts in the first shard that it shares, and
only texts with such a neighbour send their shingles there, where links are decided by exact similarity.

Defined cases: null and empty texts have fingerprint zero and no shingles, and link like any other; null identifiers
never are a component's identifier unless it has no other; repeated rows stay repeated in groups, and dedup keeps one of
them; identifiers may be numbers or strings; very long texts are read in full; columns of the input may have any name;
an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER_BYTES, attach, bounded, cut, ident, ident_type, join_frequent, texts_of
from corvane.llm.components import connected

RADIUS = 2
SHARD = 1024
LEVELS = 4
SHINGLE = 3
#: Of similar_groups: words of a shingle, similarity, least hashes per level, levels, texts of a shard.
SIMILAR_SHINGLE, SIMILAR, BANDS, SIMILAR_LEVELS, SIMILAR_SHARD = 5, 0.8, 5, 2, 2048
#: Least hashes in all; bits within which pairs at the threshold lie, and least hashes in which they agree, but for about 1 in 100,000.
SKETCH, WIDE, AGREE = 15, 26, 5
#: Hashes of texts that are broadcast at most, to fetch or to leave out these texts; more go by shuffle.
HASHES, HASH_BYTES = 2_000_000, 64 << 20


def shingle_hashes(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """XXH64 of the word shingles, repeats included; words are split at ASCII white space, A-Z lower-cased. Of fewer words, of the whole sequence."""
    import xxhash

    words = text.translate(LOWER_BYTES).split()
    if not words:
        return np.zeros(0, dtype="<u8")
    if len(words) < shingle:
        parts, n = iter([b" ".join(words)]), 1
    else:
        parts, n = map(b" ".join, zip(*(words[i:] for i in range(shingle)))), len(words) - shingle + 1
    return np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(42)), dtype="<u8", count=n)


def majority(hashes: np.ndarray) -> int:
    """A bit is 1 if more than half of the hashes have it; 0 without any."""
    if not len(hashes):
        return 0
    ones = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        ones += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    return majority(shingle_hashes(text, shingle))


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.array([fingerprint(t.as_py() or b"", shingle) for t in batch.column(2)], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(values)], ["_id", "_t", "_fp"])

    return run


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = texts_of(text_col)
    return docs.select(ident(docs, id_col).alias("_id"), F.xxhash64(text).alias("_t"), text.cast("binary").alias("t"))


def with_fingerprint(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """_id, _t (a hash of the text) and _fp for every row."""
    return _rows(docs, id_col, text_col).mapInArrow(_fingerprints(shingle), f"_id {ident_type(docs, id_col)}, _t long, _fp long")


class BKTree:
    """Children are keyed by their Hamming distance to the parent."""

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def add(self, value: int) -> int:
        """The node of value, which may be there already."""
        if not self.values:
            self.values.append(value)
            self.children.append({})
            return 0
        at = 0
        while distance := (self.values[at] ^ value).bit_count():
            below = self.children[at].get(distance)
            if below is None:
                self.children[at][distance] = len(self.values)
                self.values.append(value)
                self.children.append({})
                return len(self.values) - 1
            at = below
        return at

    def within(self, value: int, radius: int) -> list[int]:
        """The nodes within radius of value. By the triangle inequality only edges of distance +- radius can lead to one."""
        found, open_ = [], [0] if self.values else []
        while open_:
            at = open_.pop()
            distance = (self.values[at] ^ value).bit_count()
            if distance <= radius:
                found.append(at)
            for edge, below in self.children[at].items():
                if distance - radius <= edge <= distance + radius:
                    open_.append(below)
        return found


def shard_links(values: list[int], radius: int) -> list[tuple[int, int]]:
    """(member, smallest member) of every component of a shard that has two members or more."""
    tree, parent = BKTree(), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for value in sorted(set(values)):
        near = tree.within(value & (2**64 - 1), radius)
        own = tree.add(value & (2**64 - 1))
        parent.append(own)
        for other in near:
            a, b = sorted((root(own), root(other)))
            parent[b] = a
    back = sorted(set(values))
    return [(back[i], back[root(i)]) for i in range(len(back)) if root(i) != i]


def _links(radius: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = [p for values in batch.column(0) for p in shard_links(values.as_py(), radius)]
            yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], ["a", "b"])

    return run


def blocks(mask: int, n: int) -> list[int]:
    """The bits of mask in n runs of nearly equal length."""
    bits = [1 << i for i in range(64) if mask >> i & 1]
    return [sum(bits[len(bits) * k // n : len(bits) * (k + 1) // n]) for k in range(n)]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def links(distinct: DataFrame, radius: int = RADIUS, shard: int = SHARD, levels: int = LEVELS) -> DataFrame:
    """Links a, b between the fingerprints of distinct (_fp): all that are within radius bits are connected by them."""
    masks = {k: m for k, m in enumerate(blocks(2**64 - 1, radius + 1))}
    rows = distinct.select("_fp", F.explode(F.array(*[F.lit(k) for k in masks])).alias("_path"))
    found = None
    for level in range(levels):
        mask_of = F.element_at(F.create_map(*[F.lit(x) for k, m in masks.items() for x in (k, _signed(m))]), F.col("_path"))
        keyed = rows.withColumn("_key", F.struct("_path", F.col("_fp").bitwiseAND(mask_of).alias("bits")))
        if level < levels - 1:
            hot = cut(keyed.groupBy("_key").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > shard).select("_key", F.lit(True).alias("_hot")))
            keyed = attach(keyed, hot, "_key", F.col("_fp"))
            some = keyed.where("_hot is null")
        else:
            hot, some = None, keyed
        lists = some.groupBy("_key").agg(F.collect_list("_fp").alias("fps")).where(F.size("fps") > 1).select("fps")
        pairs = lists.mapInArrow(_links(radius), "a long, b long")
        found = pairs if found is None else found.unionByName(pairs)
        if hot is None or not hot.limit(1).count():
            break
        # the other bits of a hot shard, cut again
        inner = {k: [m | b for b in blocks(~m & (2**64 - 1), radius + 1)] for k, m in masks.items()}
        masks = {k * (radius + 1) + j + 1000 * (level + 1): m for k, parts in inner.items() for j, m in enumerate(parts)}
        rows = keyed.where("_hot").select("_fp", F.explode(F.array(*[F.col("_path") * (radius + 1) + j + 1000 * (level + 1) for j in range(radius + 1)])).alias("_path"))
    return found


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """_id, _t, _fp and component_id (the smallest identifier reachable) for every row."""
    rows = cut(with_fingerprint(docs, id_col, text_col, shingle))
    distinct = cut(rows.groupBy("_fp").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_times")))
    return _with_least(rows, distinct, "_fp", links(distinct.select("_fp"), radius))


def _with_least(rows: DataFrame, distinct: DataFrame, node: str, edges: DataFrame) -> DataFrame:
    """rows with component_id, the least identifier of all whose node is connected by edges (a, b). distinct: node, _least, _times."""
    roots = connected(edges).withColumnRenamed("node", "_n")
    linked = cut(roots.join(distinct, roots["_n"] == distinct[node]).select(F.col(node), "root", "_least"))
    least = cut(linked.groupBy("root").agg(F.min("_least").alias("component_id")))
    known = linked.join(least, "root").select(F.col(node).alias("_f"), "root", "component_id")
    found = distinct.join(known, distinct[node] == known["_f"], "left")
    groups = cut(found.select(node, "_times", F.coalesce("component_id", "_least").alias("component_id"), F.coalesce("root", node).alias("_root")))
    return join_frequent(rows, groups, node, "_times")


def _one_each(docs: DataFrame, groups: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """One row of each group: the one with the component's identifier (of several, the one with the least text hash).

    What goes is named by identifier and text hash, and taken out of docs; docs are shuffled only if it is too much to broadcast.
    """
    own = "_own" + "_" * max((len(c) for c in docs.columns), default=0)  # no name that the input has
    groups = cut(groups.select("_id", "_t", "component_id", "_root"))
    best = F.col("_id").eqNullSafe(F.col("component_id"))
    several = groups.where(best).groupBy("_root").agg(F.min("_t").alias("_m"), F.max("_t").alias("_x")).where("_m <> _x").select(F.col("_root").alias("_r"), "_m")
    others = groups.where(best).join(several, F.col("_root") == F.col("_r")).where("_t <> _m").select("_id", "_t")
    gone = cut(groups.where(~best).select("_id", "_t").unionByName(others).distinct().select(F.col("_id").alias(own), F.col("_t").alias(own + "t")))
    gone = bounded(gone, HASHES, HASH_BYTES) or gone
    text = F.xxhash64(texts_of(text_col))
    out = docs.join(gone, ident(docs, id_col).eqNullSafe(F.col(own)) & (text == F.col(own + "t")), "left_anti")
    if not groups.groupBy("_id", "_t").count().where("count > 1").limit(1).count():
        return out
    # rows equal in identifier and text: one of them
    kept = out.withColumns({own: ident(docs, id_col), own + "t": text})
    return kept.dropDuplicates([own, own + "t"]).drop(own, own + "t")


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = RADIUS, shingle: int = SHINGLE) -> DataFrame:
    """One document of each group of linked fingerprints, with the input's own columns."""
    return _one_each(docs, near_groups(docs, id_col, text_col, radius, shingle), id_col, text_col)


# ---- links by similarity

MIXERS = np.random.default_rng(29).integers(1, 2**63, SKETCH, dtype=np.uint64) | np.uint64(1)


def sketch(text: bytes, shingle: int) -> tuple[str, int, int, list[int], np.ndarray]:
    """Of the distinct shingle hashes: a name, the fingerprint, how many, the least after each mixing, and themselves, sorted."""
    import xxhash

    hashes = shingle_hashes(text, shingle)
    own = np.unique(hashes)
    name = xxhash.xxh3_128_hexdigest(own.tobytes())
    if not len(own):
        return name, 0, 0, [0] * len(MIXERS), own
    least = [int(((own * m) ^ ((own * m) >> np.uint64(31))).min()) for m in MIXERS]
    return name, majority(own), len(own), least, own


def _signed64(values) -> np.ndarray:
    return np.array(values, dtype=np.uint64).view(np.int64)


def _sketches(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sketch(t.as_py() or b"", shingle)[:4] for t in batch.column(2)]
            least = pa.FixedSizeListArray.from_arrays(pa.array(_signed64([x for g in got for x in g[3]])), len(MIXERS)).cast(pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array(_signed64([g[1] for g in got])), pa.array([g[2] for g in got], pa.int64()), least], ["_id", "_t", "node", "fp", "n", "least"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [sketch(t.as_py() or b"", shingle) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.string()), pa.array([g[4].tobytes() for g in got], pa.binary())], ["node", "set"])

    return run


def _earlier(path: str) -> list[tuple[int, int]]:
    """Ranges of least hashes that come before a shard's own at each level; a pair that agrees there meets in another shard."""
    own = [int(part.split(":")[0]) for part in path.split("+")[0].split("/")[1:]]
    return [(k // BANDS * BANDS, k) for k in own]


def _neighbours(similar: float):
    """Shards (key, members) to their members that have a likely neighbour there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, nodes = [], []
            column = batch.column(1)
            ends, flat = column.offsets.to_numpy(), column.values
            sizes, fps, names = flat.field("n").to_numpy(), flat.field("fp").to_numpy().view(np.uint64).tolist(), flat.field("node")
            least = flat.field("least").values.to_numpy().reshape(-1, len(MIXERS))
            for s, key in enumerate(batch.column(0).to_pylist()):
                begin, end = int(ends[s]), int(ends[s + 1])
                tree, at, found, before = BKTree(), {}, set(), _earlier(key)
                for k in range(begin, end):
                    near = [j for own in tree.within(fps[k], WIDE) for j in at[own]]
                    if near:
                        same = least[near] == least[k]
                        alike = same.sum(axis=1) >= AGREE
                        for a, b in before:
                            alike &= ~same[:, a:b].any(axis=1)
                        alike &= np.minimum(sizes[near], sizes[k]) >= similar * np.maximum(sizes[near], sizes[k])
                        if alike.any():
                            found.update([k, *np.array(near)[alike].tolist()])
                    at.setdefault(tree.add(fps[k]), []).append(k)
                keys += [key] * len(found)
                nodes += [names[k].as_py() for k in sorted(found)]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array(nodes, pa.string())], ["shard", "node"])

    return run


def shared(sets: list[np.ndarray], columns: int = 1 << 12) -> np.ndarray:
    """How many elements every two of some sets have in common; elements that only one has are left out, the others go in blocks."""
    every = np.concatenate(sets) if sets else np.zeros(0, dtype="<u8")
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, place, times = np.unique(every, return_inverse=True, return_counts=True)
    often = times > 1
    column = (np.cumsum(often) - 1)[place]
    keep = often[place]
    owner, column = owner[keep], column[keep]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(sets), len(sets)), dtype=np.float64)
    for at in range(0, int(column[-1]) + 1 if len(column) else 0, columns):
        begin, end = np.searchsorted(column, [at, at + columns])
        block = np.zeros((len(sets), min(columns, int(column[end - 1]) + 1 - at)), dtype=np.float32)
        block[owner[begin:end], column[begin:end] - at] = 1.0
        out += block @ block.T
    return out


def set_links(names: list[str], sets: list[np.ndarray], similar: float) -> list[tuple[str, str]]:
    """(member, first member) of every component of a shard, by exact similarity."""
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    both, sizes = shared(sets), np.array([len(s) for s in sets], dtype=np.float64)
    linked = both >= similar * (sizes[:, None] + sizes[None] - both) - 1e-9
    for i, j in zip(*np.nonzero(np.triu(linked, 1))):
        if root(i) != root(j):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    return [(names[i], names[root(i)]) for i in range(len(sets)) if root(i) != i]


def _set_links(similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pairs = []
            for members in batch.column(0):
                some = {m["node"].as_py(): np.frombuffer(m["set"].as_py(), dtype="<u8") for m in members}
                pairs += set_links(list(some), list(some.values()), similar)
            yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.string()) for k in (0, 1)], ["a", "b"])

    return run


def _shards(sketches: DataFrame, most: int) -> DataFrame:
    """shard and node of sketches, in shards of at most most rows; only shards of two or more."""
    rows, out = sketches.select("node", "least").withColumn("shard", F.lit("")), None
    for level in range(SIMILAR_LEVELS):
        keys = F.transform(F.sequence(F.lit(level * BANDS), F.lit((level + 1) * BANDS - 1)), lambda k: F.concat(F.col("shard"), F.lit("/"), k.cast("string"), F.lit(":"), F.hex(F.element_at("least", k + 1))))
        rows = rows.select("node", "least", F.explode(keys).alias("shard"))
        counts = cut(rows.groupBy("shard").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1"))
        some = rows.select("node", "shard").join(counts.where(F.col("_m") <= most).select("shard"), "shard", "left_semi")
        out = some if out is None else out.unionByName(some)
        hot = counts.where(F.col("_m") > most)
        if not hot.limit(1).count():
            return out
        rows = rows.join(bounded(hot) or hot, "shard")
        rows = rows if level == SIMILAR_LEVELS - 1 else cut(rows.drop("_m"))
    # still larger: blocks of half the size, and every two blocks together
    blocks = F.ceil(2 * F.col("_m") / most)
    mine = F.pmod(F.xxhash64("node"), blocks)
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), blocks - 1), lambda b: F.concat_ws("+", F.col("shard"), F.least(b, F.col("_b")), F.greatest(b, F.col("_b"))))
    return out.unionByName(rows.withColumn("_b", mine).select(F.explode(pairs).alias("shard"), "node"))


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, shingle: int = SIMILAR_SHINGLE, most: int = SIMILAR_SHARD) -> DataFrame:
    """_id, _t, node (a name of the set of shingles) and component_id for every row; texts without words are one node."""
    rows = cut(_rows(docs, id_col, text_col).mapInArrow(_sketches(shingle), f"_id {ident_type(docs, id_col)}, _t long, node string, fp long, n long, least array<long>"))
    sketches = rows.where("n > 0").groupBy("node").agg(*[F.first(c).alias(c) for c in ("fp", "n", "least")])
    sketches = cut(sketches)
    lists = _shards(sketches, most).join(sketches, "node").groupBy("shard").agg(F.sort_array(F.collect_list(F.struct("n", "node", "fp", "least"))).alias("members"))
    wanted = cut(lists.mapInArrow(_neighbours(similar), "shard string, node string"))
    texts = cut(rows.select("node", "_t").join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(F.min("_t").alias("_w")).select("_w"))
    texts = bounded(texts, HASHES, HASH_BYTES) or texts
    some = docs.select(texts_of(text_col).alias("t")).join(texts, F.xxhash64("t") == F.col("_w"), "left_semi").select(F.col("t").cast("binary").alias("t"))
    sets = some.mapInArrow(_sets(shingle), "node string, set binary").dropDuplicates(["node"])
    full = wanted.join(sets, "node").groupBy("shard").agg(F.collect_list(F.struct("node", "set")).alias("members")).select("members")
    distinct = cut(rows.groupBy("node").agg(F.min("_id").alias("_least"), F.count(F.lit(1)).alias("_times")))
    return _with_least(rows.select("_id", "_t", "node"), distinct, "node", full.mapInArrow(_set_links(similar), "a string, b string"))


def dedup_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similar: float = SIMILAR, shingle: int = SIMILAR_SHINGLE) -> DataFrame:
    """One document of each group of similar texts, with the input's own columns."""
    return _one_each(docs, similar_groups(docs, id_col, text_col, similar, shingle), id_col, text_col)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_groups(docs).select(F.col("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), "component_id")
