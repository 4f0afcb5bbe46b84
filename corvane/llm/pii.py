"""Personal data: fixed base patterns, and a character-level bidirectional LSTM with a CRF that adds spans to them.

The network is trained in numpy on the driver, from labelled spans: made ones (with spaces, without country code, with
other separators, spelled out or taken apart, and look-alikes that are none) and the base spans of TRAIN_PIECES pieces from
anywhere in documents. At scoring, a text is covered by overlapping windows; the emissions of every character are averaged
over its windows and one Viterbi pass runs over each covered stretch as a whole, so windows are reconciled globally. Every
kind needs a digit (of any script), an @, or a written "at" with a mark or a "dot" after it; added spans without are thrown
away, so windows with none of these are not run (README: what running them would cost). Added spans must pass the same
checks as base ones (Luhn, parts, digits) once separators are read plainly, must be sure (a mean posterior of SURE) and
never touch a base span; base spans always stay.

Defined cases: null text is empty; empty texts have no spans; spans count code points; repeated rows and ties stay repeated;
identifiers may be numbers, strings or null; very long texts are read in full; columns of the input may have any name; an
empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import random
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corvane.llm.common import ident, ident_type, texts_of

KINDS = ("email", "ip", "card", "phone")
#: Pieces of documents (PIECE characters from anywhere) that the training adds to the made spans; made windows; seed.
TRAIN_PIECES, PIECE, MADE, SEED = 64, 300, 1600, 5
WINDOW, STRIDE = 96, 48
SURE = 0.9

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# a run of digits that fails from its start fails from anywhere inside, so only starts of runs are tried
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CANDIDATE = re.compile(r"[0-9@]")
#: What every span that the network may add has.
TRIGGER = re.compile(r"[\d@]|[\[(]\s?at\s?[\])]|\bat\b(?=[^\n]{1,40}\bdot\b)", re.I)
NOT_DIGIT = re.compile(r"[^0-9]")


#: An address from the word before its at to the last label after a dot; words beside it are no part of it.
ADDRESS = re.compile(r"[^\s@]+(?:\s*@\s*|\s*[\[(]\s?at\s?[\])]\s*|\s+at\s+)[\w-]+(?:(?:\s*[\[(]\s?(?:\.|dot)\s?[\])]\s*|\s+dot\s+|\s+\.\s+|\.)[\w-]+)+", re.I)


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if k % 2:
            d = 2 * d - 9 if d > 4 else 2 * d
        total += d
    return total % 10 == 0


def valid(kind: str, found: str) -> bool:
    if kind == "ip":
        return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in found.split("."))
    digits = NOT_DIGIT.sub("", found)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 9 <= len(digits) <= 15
    return True


def _emails(text: str) -> list[tuple[int, int]]:
    """What a left-to-right search finds, in time linear in the text: each @ takes the run of local characters before it."""
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        if start < at and (m := DOMAIN.match(text, at + 1)):
            found.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", last)
    return found


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end), leftmost and not overlapping within a kind."""
    if not CANDIDATE.search(text):
        return []
    out = [(0, s, e) for s, e in _emails(text)] if "@" in text else []
    for kind, pattern in ((1, IP), (2, CARD), (3, PHONE)):
        out += [(kind, m.start(), m.end()) for m in pattern.finditer(text) if valid(KINDS[kind], m.group())]
    return out


# ---- the network

CHARS = 130  # ASCII, other letters, anything else
PAD = 129
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
EMBED, HIDDEN = 12, 16
ALLOWED = np.array([[b == 0 or b % 2 == 1 or (a in (b - 1, b)) for b in range(TAGS)] for a in range(TAGS)])
NEVER = -1e4


def char_ids(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(points < 128, points, 128 + (points > 0x2FF)).astype(np.uint8)


def _sigmoid(x):
    return 1.0 / (1.0 + np.exp(-x))


def _lstm(x: np.ndarray, wh: np.ndarray, keep: bool):
    """x: input part of the gates, (time, rows, 4 * HIDDEN). Gates: in, forget, out, new."""
    t, n, _ = x.shape
    h, c = np.zeros((n, HIDDEN), x.dtype), np.zeros((n, HIDDEN), x.dtype)
    out, saved = np.empty((t, n, HIDDEN), x.dtype), []
    for k in range(t):
        z = x[k] + h @ wh
        gates, new = _sigmoid(z[:, : 3 * HIDDEN]), np.tanh(z[:, 3 * HIDDEN :])
        i, f, o = gates[:, :HIDDEN], gates[:, HIDDEN : 2 * HIDDEN], gates[:, 2 * HIDDEN :]
        before, h_before = c, h
        c = f * c + i * new
        tc = np.tanh(c)
        h = o * tc
        out[k] = h
        if keep:
            saved.append((i, f, o, new, before, tc, h_before))
    return out, saved


def _lstm_back(dout: np.ndarray, wh: np.ndarray, saved):
    t, n, _ = dout.shape
    dx, dwh = np.empty((t, n, 4 * HIDDEN), dout.dtype), np.zeros_like(wh)
    dh, dc = np.zeros((n, HIDDEN), dout.dtype), np.zeros((n, HIDDEN), dout.dtype)
    for k in range(t - 1, -1, -1):
        i, f, o, new, before, tc, h_before = saved[k]
        dh = dh + dout[k]
        dc = dc + dh * o * (1 - tc * tc)
        dz = np.concatenate([dc * new * i * (1 - i), dc * before * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - new * new)], axis=1)
        dx[k] = dz
        dwh += h_before.T @ dz
        dh, dc = dz @ wh.T, dc * f
    return dx, dwh


def start_weights(rng: np.random.Generator) -> dict[str, np.ndarray]:
    r = lambda *s: rng.normal(0, 0.25, s)
    w = {"emb": r(CHARS, EMBED), "wo": r(2 * HIDDEN, TAGS), "bo": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
    for d in "fb":
        w |= {f"wx{d}": r(EMBED, 4 * HIDDEN), f"wh{d}": r(HIDDEN, 4 * HIDDEN), f"b{d}": np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)])}
    return w


def emissions(w: dict, ids: np.ndarray, keep: bool = False):
    """ids (time, rows) to scores of tags (time, rows, TAGS)."""
    runs = {}
    for d in "fb":
        gates = (w["emb"] @ w[f"wx{d}"] + w[f"b{d}"])[ids if d == "f" else ids[::-1]]
        runs[d] = _lstm(gates, w[f"wh{d}"], keep)
    h = np.concatenate([runs["f"][0], runs["b"][0][::-1]], axis=2)
    return h @ w["wo"] + w["bo"], (h, runs)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis=axis))


def _sums(emit: np.ndarray, trans: np.ndarray):
    """Logs of the forward and backward sums, and of the whole."""
    t = len(emit)
    a, b = np.empty_like(emit), np.zeros_like(emit)
    a[0] = emit[0]
    for k in range(1, t):
        a[k] = emit[k] + _lse(a[k - 1][:, :, None] + trans[None], 1)
    for k in range(t - 2, -1, -1):
        b[k] = _lse(trans[None] + (emit[k + 1] + b[k + 1])[:, None, :], 2)
    return a, b, _lse(a[-1], 1)


def crf_loss(emit: np.ndarray, trans: np.ndarray, gold: np.ndarray):
    """Mean negative log-likelihood of a row, and its gradients for emit and trans, by forward and backward sums."""
    t, n, _ = emit.shape
    a, b, z = _sums(emit, trans)
    demit = np.exp(a + b - z[None, :, None])
    rows, times = np.arange(n), np.arange(t)[:, None]
    score = emit[times, rows[None], gold].sum(0) + trans[gold[:-1], gold[1:]].sum(0)
    dtrans = np.zeros_like(trans)
    for k in range(1, t):
        dtrans += np.exp(a[k - 1][:, :, None] + trans[None] + (emit[k] + b[k])[:, None, :] - z[:, None, None]).sum(0)
    np.add.at(dtrans, (gold[:-1], gold[1:]), -1.0)
    demit[times, rows[None], gold] -= 1.0
    return (z - score).mean(), demit / n, dtrans / n


def gradients(w: dict, ids: np.ndarray, gold: np.ndarray):
    emit, (h, runs) = emissions(w, ids, keep=True)
    loss, demit, dtrans = crf_loss(emit, np.where(ALLOWED, w["trans"], NEVER), gold)
    flat = demit.reshape(-1, TAGS)
    g = {"trans": np.where(ALLOWED, dtrans, 0.0), "wo": h.reshape(-1, 2 * HIDDEN).T @ flat, "bo": flat.sum(0), "emb": np.zeros_like(w["emb"])}
    dh = demit @ w["wo"].T
    for d, part in (("f", dh[:, :, :HIDDEN]), ("b", dh[::-1, :, HIDDEN:])):
        dx, g[f"wh{d}"] = _lstm_back(part, w[f"wh{d}"], runs[d][1])
        dtable = np.zeros((CHARS, 4 * HIDDEN))
        np.add.at(dtable, (ids if d == "f" else ids[::-1]).reshape(-1), dx.reshape(-1, 4 * HIDDEN))
        g[f"wx{d}"], g[f"b{d}"] = w["emb"].T @ dtable, dtable.sum(0)
        g["emb"] += dtable @ w[f"wx{d}"].T
    return loss, g


def train(samples: list[tuple[str, list[tuple[int, int, int]]]], epochs: int = 16, batch: int = 16, rate: float = 0.02, seed: int = SEED) -> dict:
    """Adam with a falling rate over labelled windows (text, spans); each is cut or padded to WINDOW."""
    rng = np.random.default_rng(seed)
    w = start_weights(rng)
    ids, gold = np.full((WINDOW, len(samples)), PAD), np.zeros((WINDOW, len(samples)), dtype=np.int64)
    for k, (text, spans) in enumerate(samples):
        got = char_ids(text)[:WINDOW]
        ids[: len(got), k] = got
        for kind, s, e in spans:  # what a window's edge cuts off is inside all the same
            gold[max(s, 0) : e, k] = 2 + 2 * kind
            if 0 <= s < WINDOW:
                gold[s, k] = 1 + 2 * kind
    m, v, step = {k: 0.0 for k in w}, {k: 0.0 for k in w}, 0
    for epoch in range(epochs):
        now = rate * (1.05 - epoch / epochs)
        for some in np.array_split(rng.permutation(len(samples)), max(1, len(samples) // batch)):
            _, g = gradients(w, ids[:, some], gold[:, some])
            norm = np.sqrt(sum(float((x * x).sum()) for x in g.values()))
            step += 1
            for k in w:
                x = g[k] * min(1.0, 5.0 / (norm + 1e-9))
                m[k], v[k] = 0.9 * m[k] + 0.1 * x, 0.99 * v[k] + 0.01 * x * x
                w[k] = w[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
    return {k: x.astype(np.float32) for k, x in w.items()}


def made_samples(n: int = MADE, words: list[str] | None = None, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Windows with made spans, their variants, and look-alikes that carry no label."""
    rng = random.Random(seed)
    words = words or ["the", "and", "con", "mit", "la", "here", "reach", "lichung", "entre", "of", "after,", "then."]
    num = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    name = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyzaeioulnrst") for _ in range(rng.randint(3, 9)))

    def card() -> str:
        body = rng.choice("3456") + num(14)
        full = next(body + d for d in "0123456789" if luhn(body + d))
        return full if rng.random() < 0.3 else rng.choice([" ", "-", "-", "  ", ".", "/", "_", " - "]).join(full[i : i + 4] for i in range(0, 16, 4))

    def email() -> str:
        left = name() + rng.choice(["", ".", "_", "-"]) + rng.choice([name(), num(2), ""])
        right = name() + rng.choice([".example.com", ".com", ".org", ".net", ".co.uk", "." + name()[:2], "." + name()[:3], "." + name()[:4]])
        at = rng.choice(["@", "@", " @ ", "[at]", " [at] ", "(at)", " (at) ", " at "])
        if at == " at ":
            return f"{left.strip('._-')} at {right.replace('.', ' dot ')}"
        return left.strip("._-") + at + (right if rng.random() < 0.75 else right.replace(".", rng.choice(["[.]", " dot ", "(.)", " . "])))

    def ip() -> str:
        return rng.choice([".", ".", "[.]", " . ", "(.)"]).join(str(rng.randint(0, 255)) for _ in range(4))

    def phone() -> str:
        area, a, b = num(3), num(3), num(4)
        return rng.choice([f"+1 ({area}) {a}-{b}", f"+49 {area} {a}{b}", f"({area}) {a}-{b}", f"+1-{area}-{a}-{b}", f"{area}-{a}-{b}", f"{area} {a} {b}", f"{area}.{a}.{b}", f"0{area} {a}{b}", f"0{num(2)}/{a}{b}", f"00{num(2)} {area} {a}{b}", f"({area}) {a} {b}", f"0{area}-{a}{b}"])

    def whole(kind: int) -> str:
        part = makers[kind]()
        return "".join(chr(ord(c) + 0xFEE0) if c.isdigit() else c for c in part) if kind and rng.random() < 0.04 else part

    makers = {0: email, 1: ip, 2: card, 3: phone}
    others = [lambda: num(rng.randint(1, 8)), lambda: f"20{num(2)}-0{num(1)}-1{num(1)}", lambda: f"v{num(1)}.{num(1)}.{num(2)}", lambda: f"{num(2)}:{num(2)}", lambda: f"${num(2)}.{num(2)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(32)), lambda: f"@{name()}", lambda: f"{num(1)}.{num(3)}.{num(3)}", lambda: f"at {name()}", lambda: f"{num(4)}/{num(2)}", lambda: f"{num(2)}.{num(2)}.{num(4)}", lambda: f"{name()} at the dot", lambda: f"(v{num(1)}.{num(1)}.{num(1)})", lambda: f"({num(2)})", lambda: f"{num(2)} %", lambda: f"({name()}) {num(4)}", lambda: f"{name()} {num(1)}:", lambda: f"see {num(1)}.{num(1)}"]
    out = []
    for _ in range(n):
        text, spans = "", []
        while len(text) < WINDOW:
            roll = rng.random()
            if roll < 0.16:
                kind = rng.randrange(4)
                part = whole(kind)
                spans.append((kind, len(text), len(text) + len(part)))
            elif roll < 0.30:
                part = rng.choice(others)()
            else:
                part = rng.choice(words)
            text += part + rng.choice([" ", " ", " ", " ", ", ", ". ", "\n", "### ", "; ", ": ", " (", ") "])
        cut = rng.randint(0, 20)  # windows may begin within a word
        spans = [(k, s - cut, e - cut) for k, s, e in spans if e > cut]
        out.append((text[cut:], spans))
    return out


# ---- scoring

#: Places that one Viterbi pass holds at once, and characters of texts that are decoded together (one text at least).
CELLS, TOGETHER = 1 << 19, 4 << 20


def stretches(text: str) -> list[tuple[int, int]]:
    """Maximal stretches covered by windows that hold a trigger, on the grid of STRIDE."""
    hot: set[int] = set()
    for m in TRIGGER.finditer(text):
        last = m.start() // STRIDE
        hot.update(k for k in range(last - WINDOW // STRIDE + 1, last + 1) if k >= 0)
    out: list[tuple[int, int]] = []
    for k in sorted(hot):
        s, e = k * STRIDE, min(k * STRIDE + WINDOW, len(text))
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], e)
        else:
            out.append((s, e))
    return out


def viterbi(emit: np.ndarray, trans: np.ndarray) -> np.ndarray:
    """Best tags (time, rows) under the transitions; a row can't begin inside a span."""
    t, n, k = emit.shape
    best = emit[0] + np.where(np.arange(k) % 2 == 0, NEVER, 0.0) * (np.arange(k) > 0)
    back = np.empty((t, n, k), dtype=np.int8)
    for i in range(1, t):
        all_ = best[:, :, None] + trans[None]
        back[i] = all_.argmax(1)
        best = all_.max(1) + emit[i]
    path = np.empty((t, n), dtype=np.int64)
    path[-1] = best.argmax(1)
    for i in range(t - 1, 0, -1):
        path[i - 1] = back[i][np.arange(n), path[i]]
    return path


def decode(w: dict, texts: list[tuple[int, str]], rows: int = 2048) -> dict[int, list[tuple[int, int, int]]]:
    """Sure spans by the network for numbered texts."""
    trans = np.where(ALLOWED, w["trans"], NEVER).astype(np.float32)
    parts = [(n, s, e) for n, text in texts for s, e in stretches(text)]
    codes = {n: char_ids(text) for n, text in texts}
    sums = [np.zeros((e - s, TAGS), dtype=np.float32) for _, s, e in parts]
    seen = [np.zeros(e - s, dtype=np.float32) for _, s, e in parts]
    windows = [(p, a) for p, (_, s, e) in enumerate(parts) for a in range(0, max(1, e - s - (WINDOW - STRIDE)), STRIDE)]
    for at in range(0, len(windows), rows):
        some = windows[at : at + rows]
        ids = np.full((WINDOW, len(some)), PAD)
        for k, (p, a) in enumerate(some):
            n, s, e = parts[p]
            got = codes[n][s + a : min(s + a + WINDOW, e)]
            ids[: len(got), k] = got
        emit, _ = emissions(w, ids)
        for k, (p, a) in enumerate(some):
            m = min(WINDOW, len(seen[p]) - a)
            sums[p][a : a + m] += emit[:m, k]
            seen[p][a : a + m] += 1
    found: dict[int, list[tuple[int, int, int]]] = {}
    # stretches of nearly one length go through Viterbi together
    order = sorted(range(len(parts)), key=lambda p: len(seen[p]))
    at = 0
    while at < len(order):
        longest, group = max(len(seen[order[at]]) * 3 // 2, WINDOW), []
        while at < len(order) and len(seen[order[at]]) <= longest and (not group or (len(group) + 1) * longest <= CELLS):
            group.append(order[at])
            at += 1
        t = max(len(seen[p]) for p in group)
        emit = np.full((t, len(group), TAGS), 0.0, dtype=np.float32)
        emit[:, :, 1:] = NEVER
        for k, p in enumerate(group):
            emit[: len(seen[p]), k] = sums[p] / seen[p][:, None]
        path = viterbi(emit, trans)
        a, b_, z = _sums(emit, trans)
        sure = np.exp(a + b_ - z[None, :, None])
        for k, p in enumerate(group):
            n, s, _ = parts[p]
            tags = path[: len(seen[p]), k]
            probs = sure[np.arange(len(tags)), k, tags]
            for b in np.flatnonzero(tags % 2 == 1):
                e = b + 1
                while e < len(tags) and tags[e] == tags[b] + 1:
                    e += 1
                if probs[b:e].mean() >= SURE:
                    found.setdefault(n, []).append(((int(tags[b]) - 1) // 2, s + int(b), s + int(e)))
    return found


def plain(found: str) -> str:
    """A span with its digits, separators, at and dots as the base patterns have them."""
    found = unicodedata.normalize("NFKC", found)
    found = re.sub(r"\s*[\[(]\s*(?:\.|dot)\s*[\])]\s*|\s+dot\s+|\s+\.\s+", ".", found, flags=re.I)
    return re.sub(r"\s*[\[(]\s*at\s*[\])]\s*|\s+at\s+|\s*@\s*", "@", found, flags=re.I)


def added_ok(kind: int, found: str) -> bool:
    """Added spans pass the base checks once read plainly, and have the shape of their kind."""
    read = plain(found)
    if kind == 0:
        return _emails(read) == [(0, len(read))]
    if kind == 1:
        return bool(IP.fullmatch(read)) and valid("ip", read)
    if kind == 2:
        return bool(re.fullmatch(r"[0-9](?:[ ./_-]{0,3}[0-9])+", read)) and valid("card", read)
    return bool(re.fullmatch(r"\+?[(0-9][\x20()./0-9-]+[0-9]", read)) and valid("phone", read)


def all_spans(w: dict | None, texts: list[str]) -> list[tuple[list, list]]:
    """Base spans and all spans of each text, ordered by kind and start."""
    base = [base_spans(t) for t in texts]
    extra = decode(w, [(n, t) for n, t in enumerate(texts) if TRIGGER.search(t)]) if w else {}
    out = []
    for n, (text, own) in enumerate(zip(texts, base)):
        held, more = [(s, e) for _, s, e in own], []
        for kind, s, e in extra.get(n, []):
            if kind == 0 and (m := ADDRESS.search(text, s, e)):
                s, e = m.span()
            if added_ok(kind, text[s:e]) and not (s > 0 and text[s - 1].isalnum()) and not (e < len(text) and text[e].isalnum()) and all(e <= a or s >= b for a, b in held):
                more.append((kind, s, e))
                held.append((s, e))
        out.append((sorted(own), sorted(own + more)))
    return out


def written(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for k, s, e in spans)


OUT = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string"


def _scorer(w: dict):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both, some, size = [], [], 0
            for t in batch.column(1):
                some.append(t.as_py() or "")
                size += len(some[-1])
                if size >= TOGETHER:
                    both, some, size = both + all_spans(w, some), [], 0
            both += all_spans(w, some)
            counts = np.array([[sum(k == kind for k, _, _ in own) for kind in range(4)] for own, _ in both], dtype=np.int64).reshape(-1, 4)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(counts[:, k]) for k in range(4)], pa.array([hashlib.sha256(written(own).encode()).hexdigest() for own, _ in both], pa.string()), pa.array([written(every) for _, every in both], pa.string())],
                ["_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"],
            )

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", pieces: int = TRAIN_PIECES) -> dict:
    """The network, from made windows over the words of a bounded number of document pieces, and from their base spans."""
    own, text = ident(docs, id_col), texts_of(text_col)
    start = F.pmod(F.xxhash64(own, text), F.greatest(F.length(text) - PIECE, F.lit(0)) + 1) + 1
    rows = docs.where(F.length(text) > 0).select(F.xxhash64(own, text).alias("h"), F.substring(text, start.cast("int"), F.lit(PIECE)).alias("t"))
    texts = [r["t"] for r in rows.orderBy("h", "t").limit(pieces).collect()]
    words = [x for t in texts for x in t.split() if not TRIGGER.search(x)]
    real = [(t[a : a + WINDOW], base_spans(t[a : a + WINDOW])) for t in texts for a in range(0, max(1, len(t) - WINDOW), WINDOW)]
    return train(made_samples(words=words or None) + real)


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", weights: dict | None = None) -> DataFrame:
    w = weights or fit(docs, id_col, text_col)
    rows = docs.select(ident(docs, id_col).alias("_id"), texts_of(text_col).alias("t"))
    return rows.mapInArrow(_scorer(w), f"_id {ident_type(docs, id_col)}, {OUT}")


def query(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return find(docs).withColumnRenamed("_id", "doc_id")
