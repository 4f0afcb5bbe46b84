"""Scores of texts by a hierarchical Pitman-Yor model over all training documents.

A token's context is the word before it; the start of a document is the context of the end. Every word that comes before
another is a restaurant over words. Its parent is the restaurant of its class (its last two bytes, hashed to CONTEXTS
classes, the end apart), whose customers are the tables of its words' restaurants; the classes share one parent, whose
base is uniform over the V known words and one unknown word. Gibbs sweeps seat all customers of the training counts in
Chinese restaurants with the totals of the sweep before; the predictive probabilities of the last KEPT sweeps are
averaged.

Nothing that grows is on the driver or in a broadcast: documents are read in blocks of about BLOCK bytes; each block
sums its pairs (context, word) and sends its distinct words, with their training counts by context, to the home of the
word, a partition by hash; a context goes by its 64-bit key, whose last byte is its class. Homes sum counts, draw seats
and answer; every block gets its own words' answers back and scores its documents. The tables of a context are summed
at the context's home after each sweep and sent back to the homes of its words. All this goes through keyed RDDs that
share one partitioner, so that what the first shuffle wrote is read again and not written again. What the driver
gathers is one row of totals, a few for each class.

A sweep takes all customers of a dish out of a restaurant and seats them anew, one after another, given what the sweep
before left elsewhere: a Gibbs sampler whose blocks are the dishes of a restaurant. Blocks of one restaurant are drawn
side by side, so that homes need not wait for each other; a test holds the scores against a sampler that moves single
customers. Pairs seen once have one table whatever is drawn, so only the others take part in sweeps.

Defined cases: null text is empty and scores one end token; null identifiers are in training; repeated rows count as
often as they occur; identifiers may be numbers or strings; very long texts are a block of their own; ties don't arise;
columns of the input may have any name; an empty table gives an empty result; without training rows every word is unknown.
"""

from __future__ import annotations

import itertools
import math
import pickle
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import LOWER_BYTES, ident, ident_type, partitions, texts_of

CONTEXTS = 256
BLOCK = 12 << 20
SWEEPS, KEPT, SEED = 4, 2, 7
STRENGTH = 1.0
#: Customers for each table opened, and customers left, from which the wait for the next table is drawn at once.
RARE, ROOM = 16, 12
#: Dishes left, below which each one is seated by itself: arrays of a few numbers cost more than the numbers.
ALONE = 24
END = b""


def _pack(*arrays) -> bytes:
    """Compressed, after the plain size in eight bytes."""
    plain = pickle.dumps(arrays, protocol=5)
    return len(plain).to_bytes(8, "little") + pa.compress(plain, codec="zstd", asbytes=True)


def _unpack(blob: bytes):
    return pickle.loads(pa.decompress(blob[8:], decompressed_size=int.from_bytes(blob[:8], "little"), codec="zstd", asbytes=True))


def _thin(x: np.ndarray) -> np.ndarray:
    """Whole numbers from zero up as rows of bytes, as many as the largest one needs."""
    x = np.ascontiguousarray(x, dtype=np.int64)
    wide = max(1, (int(x.max()).bit_length() + 7) // 8) if len(x) else 1
    return np.ascontiguousarray(x.view(np.uint8).reshape(-1, 8)[:, :wide].T)


def _full(rows: np.ndarray) -> np.ndarray:
    out = np.zeros((rows.shape[1], 8), dtype=np.uint8)
    out[:, : len(rows)] = rows.T
    return out.view(np.int64).reshape(-1)


def context_class(word: bytes) -> int:
    """The class of a word as a context; the end, and so the start, is class 0."""
    return 1 + (word[-1] * 193 + (word[-2] if len(word) > 1 else 0) * 31) % (CONTEXTS - 1) if word else 0


def context_keys(words: list[bytes]) -> np.ndarray:
    """56 bits of each word's hash, then its class, the same as context_class says."""
    import xxhash

    hashes = np.fromiter(map(xxhash.xxh64_intdigest, words, itertools.repeat(42)), np.uint64, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    flat = np.frombuffer(b"\0\0" + b"".join(words), dtype=np.uint8).astype(np.int64)
    ends = np.cumsum(lengths) + 2
    classes = 1 + (flat[ends - 1] * 193 + np.where(lengths > 1, flat[ends - 2], 0) * 31) % (CONTEXTS - 1)
    return hashes & ~np.uint64(0xFF) | np.where(lengths > 0, classes, 0).astype(np.uint64)


def home(keys: np.ndarray, n: int) -> np.ndarray:
    return ((keys >> np.uint64(8)) % np.uint64(n)).astype(np.int64)


def _runs(where: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The order by place, and where each of n places begins in it."""
    order = np.argsort(where, kind="stable")
    return order, np.searchsorted(where[order], np.arange(n + 1))


def pairs_of(tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words and contexts of the distinct pairs of a block, and each token's pair."""
    before = np.append(0, tokens[:-1])
    pairs, at = np.unique(tokens << 32 | before, return_inverse=True)
    return pairs >> 32, pairs & 0xFFFFFFFF, at


class _Block:
    """Documents whose distinct words go out together."""

    def __init__(self, number: int):
        self.number, self.words, self.parts, self.ids, self.held, self.bytes = number, defaultdict(itertools.count().__next__), [], [], [], 0
        self.words[END]  # is 0; every new word takes the next number

    def add(self, ident, held: bool, text: bytes) -> None:
        own = text.translate(LOWER_BYTES).split()
        own.append(END)
        self.parts.append(np.fromiter(map(self.words.__getitem__, own), np.int32, len(own)))
        self.ids.append(ident)
        self.held.append(held)
        self.bytes += len(text)

    def rows(self, n: int, own_home: int) -> Iterator[tuple]:
        words = list(self.words)
        lengths = np.array([len(p) for p in self.parts])
        tokens = np.concatenate(self.parts).astype(np.int64)
        word, before, at = pairs_of(tokens)
        counts = np.bincount(at[np.repeat(~np.array(self.held), lengths)], minlength=len(word))
        keys = context_keys(words)
        where = home(keys, n)
        each = np.bincount(word, minlength=len(words))
        (order, cuts), (pair_order, pair_cuts) = _runs(where, n), _runs(where[word], n)
        for q in range(n):
            own, own_pairs = order[cuts[q] : cuts[q + 1]], pair_order[pair_cuts[q] : pair_cuts[q + 1]]
            if len(own):
                yield q, ("ask", (self.number, own_home), _pack(b"\n".join([words[i] for i in own]), _thin(each[own]), keys[before[own_pairs]], _thin(counts[own_pairs])))
        classes = (keys & np.uint64(0xFF)).astype(np.uint8)
        yield own_home, ("docs", (self.number, own_home), _pack(self.ids, self.held, lengths, _thin(tokens), classes, _thin(where)))


def _blocks(n: int, inputs: int, limit: int):
    def run(task: int, rows: Iterator) -> Iterator[tuple]:
        k, block = 0, _Block(task << 24)
        for ident, held, text in rows:
            block.add(ident, bool(held), bytes(text))
            if block.bytes >= limit:
                yield from block.rows(n, (task + k * inputs) % n)
                k += 1
                block = _Block((task << 24) + k)
        if block.parts:
            yield from block.rows(n, (task + k * inputs) % n)

    return run


def _read_request(blob: bytes):
    joined, each, keys, counts = _unpack(blob)
    return joined.split(b"\n"), _full(each), keys, _full(counts)


def _numbers(live: np.ndarray) -> np.ndarray:
    """Places among those that live; the number of those for the others."""
    return np.where(live, np.cumsum(live) - 1, live.sum())


class Counts:
    """The training counts at one home: pairs by word and then by context, and their pairs of word and class.

    every: what is asked of pairs that training has not is answered too. names are all asked words and word_at their
    words here; for each ask, asked has its words' places in names, and its pairs' places in count and in kinds. What
    training has not is past the end.
    """

    def __init__(self, asks: list[bytes], every: bool = False):
        number = defaultdict(itertools.count().__next__)
        own, parts = [], [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64))]
        for blob in asks:
            words, each, keys, n = _read_request(blob)
            ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
            of, some = np.repeat(ids, each), slice(None) if every else n > 0
            parts.append((of[some], keys[some], n[some]))
            own.append(ids)
        word, keys, n = (np.concatenate(x) for x in zip(*parts))
        ends = np.cumsum([len(p[0]) for p in parts])
        del parts
        contexts, place = np.unique(keys, return_inverse=True)
        pair, at = np.unique(word * max(1, len(contexts)) + place, return_inverse=True)
        count = np.bincount(at, weights=n, minlength=len(pair)).astype(np.int64)
        word, place = np.divmod(pair, max(1, len(contexts)))
        kinds, kind = np.unique(word * CONTEXTS + (contexts & np.uint64(0xFF)).astype(np.int64)[place], return_inverse=True)
        seen = count > 0
        live = lambda of, size: _numbers(np.bincount(of[seen], minlength=size) > 0)
        word_at, context_at, kind_at = live(word, len(number)), live(place, len(contexts)), live(kind, len(kinds))
        self.words = int((np.bincount(word[seen], minlength=1) > 0).sum())
        self.count, self.word, self.place, self.kind = count[seen], word_at[word[seen]], context_at[place[seen]], kind_at[kind[seen]]
        self.contexts = contexts[np.bincount(place[seen], minlength=len(contexts)) > 0]
        kinds = kinds[np.bincount(kind[seen], minlength=len(kinds)) > 0]
        self.kinds = word_at[kinds // CONTEXTS] * CONTEXTS + kinds % CONTEXTS
        self.many = self.count > 1
        self.shared, self.many_place = np.unique(self.place[self.many], return_inverse=True)  # contexts of pairs seen more than once
        if every:
            self.names, self.word_at = list(number), word_at
            spot = _numbers(seen)
            self.asked = [(ids, spot[x], kind_at[kind[x]]) for ids, x in zip(own, (at[i:j] for i, j in zip(ends, ends[1:])))]


def _lgamma(x: np.ndarray) -> np.ndarray:
    """Log of the gamma function above zero: eight steps up, then Stirling's series."""
    y = x + 8.0
    low = np.log(x * (x + 1) * (x + 2) * (x + 3)) + np.log((x + 4) * (x + 5) * (x + 6) * (x + 7))
    return (y - 0.5) * np.log(y) - y + 0.9189385332046727 + (1 / 12 - (1 / 360 - 1 / (1260 * y * y)) / (y * y)) / y - low


def _none(x: np.ndarray, a: np.ndarray, m: np.ndarray) -> np.ndarray:
    """Log of gamma(x + m) / gamma(x + a + m)."""
    both = _lgamma(np.stack([x + m, x + a + m]))
    return both[0] - both[1]


def _wait(x: np.ndarray, a: np.ndarray, room: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Customers up to the next that opens a table, room + 1 if none of them does. The chance that the first m open none
    is the product of (x + i) / (x + a + i), i below m, which gamma functions say at once. It is near
    (1 + m / (x + (a - 1) / 2)) ** -a, so the search begins where that says; what it misses is halved in."""
    none = _none(x, a, np.zeros(len(x)))
    draw = none + np.log(1.0 - rng.random(len(x)))
    low, high = np.zeros(len(x)), room + 1.0  # none at low is above the draw, at high it isn't, or high is past the room
    middle = np.maximum(x + (a - 1) / 2, x / 2)
    at = np.clip(np.ceil(middle * np.expm1(np.minimum((none - draw) / a, 100.0))), 1.0, room)
    for _ in range(2):
        under = _none(x, a, at) <= draw
        low, high = np.where(under, low, at), np.where(under, at, high)
        at = np.maximum(np.where(under, high - 1, low + 1), 1.0)
    rest = np.flatnonzero(high - low > 1)
    while len(rest):
        mid = np.floor((low[rest] + high[rest]) / 2)
        under = _none(x[rest], a[rest], mid) <= draw[rest]
        high[rest[under]], low[rest[~under]] = mid[under], mid[~under]
        rest = rest[high[rest] - low[rest] > 1]
    return high


def _wait_one(x: float, a: float, room: float, chance: float) -> float:
    """The same for one dish."""
    none = lambda m: math.lgamma(x + m) - math.lgamma(x + a + m)
    base = none(0.0)
    draw = base + math.log(1.0 - chance)
    low, high = 0.0, room + 1.0
    at = min(max(math.ceil(max(x + (a - 1) / 2, x / 2) * math.expm1(min((base - draw) / a, 100.0))), 1.0), room)
    tries = 0
    while high - low > 1:
        under = none(at) <= draw
        low, high = (low, at) if under else (at, high)
        tries += 1
        at = (high - 1 if under else low + 1) if tries == 1 else math.floor((low + high) / 2)
    return high


def _tables_one(c: float, a: float, discount: float, tables: float, there: float, rng: np.random.Generator) -> float:
    chances: list[float] = []
    while there < c:
        if not chances:
            chances = rng.random(64).tolist()
        x, room, chance = there - discount * tables, c - there, chances.pop()
        p = a / (a + x)
        if p < 1 / RARE and room > ROOM:
            m = _wait_one(x, a, room, chance)
            tables += m <= room
            there += min(m, room)
        else:
            tables += chance < p
            there += 1
    return tables


def seated(customers: np.ndarray, fresh: np.ndarray, discount: float, rng: np.random.Generator) -> np.ndarray:
    """Tables of each dish after its customers came one after another: the next opens a table with probability
    fresh / (fresh + seated - discount * tables), fresh being the pull of the parent. Where tables are opened rarely, the
    number of customers up to the next one is drawn instead of each of them; the process is the same."""
    out = np.minimum(customers, 1).astype(np.float64)
    alive = np.flatnonzero(customers > 1)
    c, a = customers[alive].astype(np.float64), np.maximum(fresh[alive], 1e-300)
    tables, there = np.ones(len(alive)), np.ones(len(alive))
    while len(alive) > ALONE:
        x, room = there - discount * tables, c - there
        p = a / (a + x)
        opened, came = rng.random(len(alive)) < p, np.ones(len(alive))
        far = np.flatnonzero((p < 1 / RARE) & (room > ROOM))
        if len(far):
            m = _wait(x[far], a[far], room[far], rng)
            opened[far], came[far] = m <= room[far], np.minimum(m, room[far])
        tables += opened
        there += came
        live = there < c
        if not live.all():
            out[alive[~live]] = tables[~live]
            alive, c, a, tables, there = alive[live], c[live], a[live], tables[live], there[live]
    out[alive] = [_tables_one(*dish, rng) for dish in zip(c.tolist(), a.tolist(), itertools.repeat(discount), tables.tolist(), there.tolist())]
    return out


class Model:
    """Restaurants under one parent, and the totals of each sweep done so far."""

    def __init__(self, tokens: int, kinds: int, customers: np.ndarray, first_tables: np.ndarray, discount: float):
        self.tokens, self.kinds, self.customers, self.discount = tokens, kinds, customers, discount
        self.base = 1.0 / (kinds + 1)
        # tables by class, customers and tables of the parent, its discount
        self.totals = [(first_tables, float(kinds), float(kinds), 0.5)]

    def below(self, sweep: int) -> tuple[np.ndarray, float]:
        """Customers of each class after a sweep, and their discount."""
        return self.customers, self.discount

    def parent(self, sweep: int, guests: np.ndarray | float, tables: np.ndarray | float) -> np.ndarray | float:
        """Probability of words in the parent restaurant after a sweep."""
        _, all_guests, all_tables, d = self.totals[sweep]
        return (guests - d * tables + (STRENGTH + d * all_tables) * self.base) / (STRENGTH + all_guests)

    def weight(self, sweep: int) -> np.ndarray:
        """What each class leaves to the parent."""
        customers, d = self.below(sweep)
        return (STRENGTH + d * self.totals[sweep][0]) / (STRENGTH + customers)

    def step(self, rng, sweep: int, word: np.ndarray, cls: np.ndarray, count: np.ndarray, guests: np.ndarray, tables: np.ndarray):
        """Seats of count customers after the sweep before: (tables by pair, guests and tables in the parent by word)."""
        up, last, d = self.parent(sweep - 1, guests, tables), self.totals[sweep - 1], self.below(sweep - 1)[1]
        pairs = seated(count, (STRENGTH + d * last[0][cls]) * up[word], d, rng)
        guests = np.bincount(word, weights=pairs, minlength=len(guests))
        return pairs, guests, seated(guests.astype(np.int64), np.full(len(guests), (STRENGTH + last[3] * last[2]) * self.base), last[3], rng)

    def run(self, q: int, words: int, key: np.ndarray, count: np.ndarray, sweeps: int):
        """Sweeps 1 to sweeps over customers that stay the same."""
        guests = tables = np.ones(words)
        for s in range(1, sweeps + 1):
            pairs, guests, tables = self.step(np.random.default_rng([SEED, q, s]), s, key // CONTEXTS, key % CONTEXTS, count, guests, tables)
            yield s, pairs, guests, tables


class WordModel(Model):
    """The same, with the words' restaurants below the classes: a class's customers are their tables, and change."""

    def __init__(self, first: np.ndarray):
        t = Totals(first)
        super().__init__(int(t.tokens), int(t.words), t.customers, t.tables, _discount(t.class_ones, t.class_twos))
        self.seats, self.own = [(self.customers, self.discount)], _discount(t.ones, t.twos)

    def below(self, sweep: int) -> tuple[np.ndarray, float]:
        return self.seats[sweep]

    def done(self, sums: np.ndarray) -> None:
        t = Totals(sums)
        self.totals.append((t.tables, t.guests, t.parent_tables, _discount(t.parent_ones, t.parent_twos)))
        self.seats.append((t.customers, _discount(t.class_ones, t.class_twos)))

    def by_class(self, sweep: int, cls: np.ndarray, customers: np.ndarray, tables: np.ndarray, up: np.ndarray) -> np.ndarray:
        """Probability of words in the restaurants of classes, up being that in the parent."""
        all_, d = self.below(sweep)
        return (customers - d * tables) / (STRENGTH + all_[cls]) + self.weight(sweep)[cls] * up


class Totals:
    """What the driver gathers, as one row of numbers."""

    NAMES = "tokens words ones twos class_ones class_twos guests parent_tables parent_ones parent_twos".split()

    def __init__(self, sums: np.ndarray):
        self.customers, self.tables = sums[:CONTEXTS], sums[CONTEXTS : 2 * CONTEXTS]
        self.__dict__.update(zip(self.NAMES, sums[2 * CONTEXTS :].tolist()))

    @classmethod
    def row(cls, classes: np.ndarray, customers: np.ndarray, tables: np.ndarray, **other) -> np.ndarray:
        other |= {"class_ones": (customers == 1).sum(), "class_twos": (customers == 2).sum()}
        by = lambda x: np.bincount(classes, weights=x, minlength=CONTEXTS)
        return np.concatenate([by(customers), by(tables), [float(other.get(k, 0.0)) for k in cls.NAMES]])


def _discount(ones: float, twos: float) -> float:
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def _same(home: int) -> int:
    """The one partition function; RDDs that share it are read side by side."""
    return home


def _kept(records: Iterator) -> dict[str, list]:
    """Records of a partition by kind, in the order of who sent them."""
    out: dict[str, list] = {}
    for _, (kind, sender, blob) in records:
        out.setdefault(kind, []).append((sender, blob))
    return {k: sorted(v, key=lambda x: x[0]) for k, v in out.items()}


def _first(n: int):
    """Homes count. The contexts of a home go to their own homes with their numbers of pairs: first those that some pair
    seen more than once has, whose order all sweeps keep, then the others."""

    def run(q: int, records: Iterator) -> Iterator[tuple]:
        got = _kept(records)
        if "ask" not in got:
            return
        c = Counts([b for _, b in got["ask"]])
        ones = np.bincount(c.kind[~c.many], minlength=len(c.kinds))
        once = np.bincount(c.place[~c.many], minlength=len(c.contexts))
        often = np.bincount(c.place[c.many], minlength=len(c.contexts))
        to = home(c.contexts, n)
        inner = np.zeros(len(to), dtype=bool)
        inner[c.shared] = True
        for p in np.unique(to).tolist():
            a, b = np.flatnonzero(inner & (to == p)), np.flatnonzero(~inner & (to == p))
            yield p, ("list", q, _pack(c.contexts[a], _thin(once[a]), _thin(often[a]), c.contexts[b], _thin(once[b])))
        yield q, ("slim", q, _pack(c.words, np.unique(to), _thin(c.kinds), _thin(ones), _thin(c.kind[c.many]), _thin(c.many_place), _thin(c.count[c.many]), _thin(to[c.shared])))
        every = np.bincount(c.kind, minlength=len(c.kinds))
        yield q, ("sums", q, Totals.row(c.kinds % CONTEXTS, every, np.ones(len(every)), tokens=c.count.sum(), words=c.words, ones=(c.count == 1).sum(), twos=(c.count == 2).sum()))

    return run


def context_tables(lists: list, seats: list[dict[int, bytes] | None]):
    """At a context's home: all keys in order, and, for each of some sweeps, their tables and those of each sender's list.
    seats has what each sender seated for its list in a sweep; None before the first one, when every pair has one table."""
    if not lists:
        return np.zeros(0, np.uint64), [(np.zeros(0), {}) for _ in seats]
    read = [(q, *_unpack(blob)) for q, blob in lists]
    keys, at = np.unique(np.concatenate([x for _, a, _, _, b, _ in read for x in (a, b)]), return_inverse=True)
    out = []
    for parts in seats:
        numbers, ends, begin = [], {}, 0
        for q, a, once, often, b, rest in read:
            numbers += [_full(once) + (_full(often) if parts is None else _full(_unpack(parts[q])[0])), _full(rest)]
            ends[q] = at[begin : begin + len(a)]
            begin += len(a) + len(b)
        tables = np.bincount(at, weights=np.concatenate(numbers), minlength=len(keys))
        out.append((tables, {q: tables[x] for q, x in ends.items()}))
    return keys, out


def _back(sweep: int):
    """The contexts' tables to those who seat customers in them."""

    def run(p: int, records: Iterator) -> Iterator[tuple]:
        got = _kept(records)
        parts = dict(got.get(f"part{sweep}", [])) if sweep else None
        for q, tables in context_tables(got.get("list", []), [parts])[1][0][1].items():
            if len(tables):
                yield q, (f"back{sweep}", p, _pack(_thin(tables)))

    return run


def _sweep(model: WordModel, sweep: int):
    def run(q: int, records: Iterator) -> Iterator[tuple]:
        got = _kept(records)
        if "slim" not in got:
            return
        words, lists, kinds, ones, kind, place, count, to = _unpack(got["slim"][0][1])
        kinds, ones, kind, place, count, to = map(_full, (kinds, ones, kind, place, count, to))
        word, cls = kinds // CONTEXTS, kinds % CONTEXTS
        tables = np.zeros(len(to))
        for p, blob in got.get(f"back{sweep - 1}", []):
            tables[to == p] = _full(_unpack(blob)[0])
        if sweep > 1:
            customers, of_class, guests, of_parent, _ = map(_full, _unpack(got[f"state{sweep - 1}"][0][1]))
        else:
            customers, of_class, guests, of_parent = ones + np.bincount(kind, minlength=len(kinds)), np.ones(len(kinds)), np.ones(words), np.ones(words)
        up = model.by_class(sweep - 1, cls, customers, of_class, model.parent(sweep - 1, guests, of_parent)[word])
        rng = np.random.default_rng([SEED, q, sweep])
        seats = seated(count, (STRENGTH + model.own * tables[place]) * up[kind], model.own, rng)
        customers = (ones + np.bincount(kind, weights=seats, minlength=len(kinds))).astype(np.int64)
        of_class, guests, of_parent = model.step(rng, sweep, word, cls, customers, guests, of_parent)
        mine = np.bincount(place, weights=seats, minlength=len(to))
        for p in lists.tolist():
            yield p, (f"part{sweep}", q, _pack(_thin(mine[to == p])))
        yield q, (f"state{sweep}", q, _pack(*map(_thin, (customers, of_class, guests, of_parent, seats))))
        yield q, ("sums", q, Totals.row(cls, customers, of_class, guests=guests.sum(), parent_tables=of_parent.sum(), parent_ones=(guests == 1).sum(), parent_twos=(guests == 2).sum()))

    return run


def _answers(model: WordModel):
    kept = range(SWEEPS - KEPT + 1, SWEEPS + 1)

    def run(q: int, records: Iterator) -> Iterator[tuple]:
        got = _kept(records)
        if "ask" not in got:
            return
        c = Counts([b for _, b in got["ask"]], every=True)
        states = [[np.append(_full(x), 0) for x in _unpack(got[f"state{s}"][0][1])] for s in kept]
        keys, both = context_tables(got.get("list", []), [dict(got.get(f"part{s}", [])) for s in kept])
        own = _placed_keys(keys, context_keys(c.names))
        seats = np.append(np.full(len(c.count), KEPT), 0)
        seats[:-1][c.many] = sum(x[4][:-1] for x in states)
        count = np.append(c.count, 0)
        total = np.append(np.bincount(c.word, weights=c.count, minlength=c.words).astype(np.int64), 0)
        by_word = [total[c.word_at], *[np.append(x, 0).astype(np.int64)[own] for x, _ in both], *[x[k][c.word_at] for x in states for k in (2, 3)]]
        for ((number, to), blob), (ids, pair, kind) in zip(got["ask"], c.asked):
            _, each, contexts, _ = _unpack(blob)
            of = np.repeat(np.arange(len(ids)), _full(each))
            _, one = np.unique(of * CONTEXTS + (contexts & np.uint64(0xFF)).astype(np.int64), return_index=True)  # a pair of each kind
            yield to, ("answer", (number, q), _pack([_thin(x[ids]) for x in by_word], [_thin(x[k][kind[one]]) for x in states for k in (0, 1)], _thin(count[pair]), _thin(seats[pair])))

    return run


def _placed_keys(of: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    at = np.searchsorted(of, wanted)
    return np.where((at < len(of)) & (np.append(of, np.uint64(0))[at] == wanted), at, len(of))


OUT = "held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _scored(model: WordModel, n: int, docs: bytes, answers: list[tuple[int, bytes]]) -> Iterator[tuple]:
    ids, held, lengths, tokens, classes, where = _unpack(docs)
    tokens, where, cls = _full(tokens), _full(where), classes.astype(np.int64)
    word, before, at = pairs_of(tokens)
    kinds, kind = np.unique(word * CONTEXTS + cls[before], return_inverse=True)
    by_word, by_kind, by_pair = np.zeros((1 + 3 * KEPT, len(where)), np.int64), np.zeros((2 * KEPT, len(kinds)), np.int64), np.zeros((2, len(word)), np.int64)
    runs = [_runs(w, n) for w in (where, where[kinds // CONTEXTS], where[word])]
    for q, blob in answers:
        one, two, count, seats = _unpack(blob)
        for out, (order, cuts), parts in zip((by_word, by_kind, by_pair), runs, (one, two, (count, seats))):
            for k, part in enumerate(parts):
                out[k, order[cuts[q] : cuts[q + 1]]] = _full(part)
    total = by_word[0]
    there = STRENGTH + total[before]
    p = (by_pair[0] - model.own * by_pair[1] / KEPT) / there
    for k in range(KEPT):
        s = SWEEPS - KEPT + 1 + k
        up = model.parent(s, by_word[1 + KEPT + 2 * k], by_word[2 + KEPT + 2 * k])[kinds // CONTEXTS]
        of_class = model.by_class(s, kinds % CONTEXTS, by_kind[2 * k], by_kind[2 * k + 1], up)
        p += (STRENGTH + model.own * by_word[1 + k][before]) / there * of_class[kind] / KEPT
    base = np.log10((total + 1) / (model.tokens + 1.0 * (model.kinds + 1)))
    starts = np.cumsum(lengths) - lengths
    add = lambda x: np.add.reduceat(x, starts).tolist()
    known, bases, scores = add((total > 0)[tokens].astype(np.int64)), add(base[tokens]), add(np.log10(p)[at])
    return zip(ids, held, lengths.tolist(), known, [model.tokens] * len(ids), bases, scores)


def _scores(model: WordModel, n: int):
    def run(_: int, records: Iterator) -> Iterator[tuple]:
        got = _kept(records)
        answers: dict[int, list] = {}
        for (number, q), blob in got.get("answer", []):
            answers.setdefault(number, []).append((q, blob))
        for (number, _), blob in got.get("docs", []):
            yield from _scored(model, n, blob, answers[number])

    return run


def score(docs: DataFrame, held: F.Column | None = None, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """Scores of all documents; held says which rows are kept from training."""
    spark = docs.sparkSession
    own, out = ident(docs, id_col), f"doc_id {ident_type(docs, id_col)}, {OUT}"
    held = F.pmod(F.crc32(F.coalesce(own.cast("string"), F.lit("")).cast("binary")), F.lit(7)) == 2 if held is None else held
    docs = docs.select(own.alias("i"), held.alias("h"), texts_of(text_col).cast("binary").alias("t"))
    if docs.isEmpty():  # also the one look at the input that the event log shows as a query
        return spark.createDataFrame([], out)
    rows = docs.rdd
    inputs = max(1, rows.getNumPartitions())
    n = max(partitions(spark), inputs)
    deal = lambda rdd, f: rdd.mapPartitionsWithIndex(f).partitionBy(n, _same)
    sums = lambda rdd: rdd.filter(lambda r: r[1][0] == "sums").map(lambda r: r[1][2]).treeAggregate(np.zeros(2 * CONTEXTS + len(Totals.NAMES)), np.add, np.add)
    asked = deal(rows, _blocks(n, inputs, block))
    first = deal(asked, _first(n))
    model = WordModel(sums(first))
    last, back, states = first, deal(first, _back(0)), []
    for s in range(1, SWEEPS + 1):
        both = first.union(back) if s == 1 else first.union(back).union(last)
        last = deal(both, _sweep(model, s))
        model.done(sums(last))
        states.append(last)
        back = deal(first.union(last), _back(s)) if s < SWEEPS else None
    seen = asked.union(first)
    for state in states[-KEPT:]:
        seen = seen.union(state)
    answers = deal(seen, _answers(model))
    return spark.createDataFrame(asked.union(answers).mapPartitionsWithIndex(_scores(model, n)), out)


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return score(docs)
