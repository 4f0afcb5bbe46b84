import hashlib
import random
import re

import numpy as np
import pytest

from corvane.llm import pii
from tests.llm.helpers import SCHEMA, edge_rows, random_rows

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain(text):
    out = []
    for k, kind in enumerate(pii.KINDS):
        for m in re.finditer(PATTERNS[kind], text):
            digits = re.sub("[^0-9]", "", m[0])
            ok = True
            if kind == "ip":
                ok = all(int(p) <= 255 for p in m[0].split("."))
            elif kind == "card":
                double = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(digits))]
                ok = 13 <= len(digits) <= 19 and sum(d - 9 if d > 9 else d for d in double) % 10 == 0
            elif kind == "phone":
                ok = 9 <= len(digits) <= 15
            if ok:
                out.append((k, m.start(), m.end()))
    return sorted(out)


def test_base_spans_are_what_the_patterns_find():
    rng = random.Random(7)
    for alphabet in ("a@.b", "a1@.-", "0123.", "4 -1", "+1 ().-a", "@a.%+1 9", "é1@x.😀"):
        for _ in range(400):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 40)))
            assert sorted(pii.base_spans(text)) == plain(text), text
    for text in ("4111 1111 1111 1111", "a@b.c@d.e", "1.2.3.4.5.6.7.8", "001.2.3.0255", "+49 (30) 1234567", "x@y.z.@q.r"):
        assert sorted(pii.base_spans(text)) == plain(text)


def test_long_runs_are_linear():
    for text in ("1" * 300_000, "a" * 300_000 + "@", "@" * 100_000, "1." * 100_000, "+1" * 100_000, "a@" * 100_000):
        pii.base_spans(text)


def test_gradients():
    rng = np.random.default_rng(0)
    w = pii.start_weights(rng)
    ids, gold = rng.integers(0, 128, (7, 3)), np.zeros((7, 3), dtype=np.int64)
    gold[2, 0], gold[3:5, 0], gold[4, 1] = 1, 2, 5
    _, g = pii.gradients(w, ids, gold)
    for name in w:
        for at in [tuple(rng.integers(0, n) for n in w[name].shape) for _ in range(4)] + [tuple(0 for _ in w[name].shape)]:
            old, eps = w[name][at], 1e-5
            w[name][at] = old + eps
            up = pii.gradients(w, ids, gold)[0]
            w[name][at] = old - eps
            down = pii.gradients(w, ids, gold)[0]
            w[name][at] = old
            assert g[name][at] == pytest.approx((up - down) / (2 * eps), abs=1e-6), name


def test_viterbi_is_the_best_path():
    import itertools

    rng = np.random.default_rng(1)
    k = 4
    emit, trans = rng.normal(size=(5, 2, k)), rng.normal(size=(k, k))
    path = pii.viterbi(emit, trans)
    for n in range(2):
        best = max((p for p in itertools.product(range(k), repeat=5) if p[0] != 2), key=lambda p: sum(emit[i, n, t] for i, t in enumerate(p)) + sum(trans[a, b] for a, b in zip(p, p[1:])))
        assert tuple(path[:, n]) == best


@pytest.fixture(scope="module")
def weights(spark, data):
    """Fitted as the query fits."""
    return pii.fit(spark.read.parquet(f"{data}/sf0.01/documents.parquet"))


TEMPLATES = ["Please write to {} before Friday, as the office closes then.", "My number is {} in case of need.", "Der Kontakt lautet {} und gilt bis Montag.", "Contact: {}", "on {} you will reach the team, 24 hours a day since 2019", "{} was seen on 2021-03-04 at 10:30 with 55 others.", "La dirección es {} para todo.", "see {} (v2.3.1)"]


def sentences(seed, n=400):
    """(text, kind, start, end): spans that the patterns miss, in sentences of another origin than the training's."""
    rng = random.Random(seed)
    d = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    first, last = "anna bruno carla dieter elena fabian greta hugo ines jonas".split(), "meyer rossi lopez schmidt durand keller novak silva".split()
    hosts, ends = "mail post office contact server web".split(), ["com", "org", "net", "info", "de", "fr"]

    def email():
        f, l_, h, t = rng.choice(first), rng.choice(last), rng.choice(hosts), rng.choice(ends)
        return rng.choice([f"{f}.{l_} @ {h}.{t}", f"{f}_{l_}[at]{h}.{t}", f"{f} (at) {h}.{t}", f"{f}{d(2)} at {h} dot {t}", f"{f}.{l_} [at] {h}[.]{t}"])

    def card():
        body = rng.choice("45") + d(14)
        c = next(body + x for x in "0123456789" if pii.luhn(body + x))
        return rng.choice([".", "/", "  ", "_"]).join(c[i : i + 4] for i in range(0, 16, 4))

    def phone():
        return rng.choice([f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"0{d(3)} {d(7)}", f"00{d(2)} {d(3)} {d(6)}", f"0{d(2)}/{d(7)}"])

    def ip():
        return rng.choice(["[.]", " . ", "(.)"]).join(str(rng.randint(1, 255)) for _ in range(4))

    for k in range(n):
        part = (email, ip, card, phone)[k % 4]()
        before, after = rng.choice(TEMPLATES).split("{}")
        text = " ".join(rng.choice("the of here Straße élan two words over".split()) for _ in range(rng.randint(0, 30))) + ". " + before
        yield text + part + after + " " + " ".join(rng.choice("and so it goes on then".split()) for _ in range(rng.randint(0, 20))), k % 4, len(text), len(text) + len(part)


def test_recall_of_each_kind_on_sentences_of_another_origin(weights):
    rows = list(sentences(7)) + list(sentences(8))
    hit, every_one, false = [0] * 4, [0] * 4, 0
    for (_, kind, s, e), (base, every) in zip(rows, pii.all_spans(weights, [r[0] for r in rows])):
        if (kind, s, e) not in base:
            every_one[kind] += 1
            hit[kind] += (kind, s, e) in every
            false += len(set(every) - set(base) - {(kind, s, e)})
    assert all(h >= 0.9 * n for h, n in zip(hit, every_one)), (hit, every_one)
    assert false <= 0.02 * len(rows)


def test_training_labels_what_a_window_cuts():
    """Windows may begin and end inside of a span; what is left of it is labelled."""
    samples = pii.made_samples(200)
    assert any(s < 0 < e for _, spans in samples for _, s, e in spans)
    assert any(s < pii.WINDOW < e for _, spans in samples for _, s, e in spans)


def test_spelled_out_forms_are_read_plainly():
    for found, read in (("a.b [at] host[.]org", "a.b@host.org"), ("a at host dot org", "a@host.org"), ("a (at) b.de", "a@b.de"), ("10[.]0[.]0[.]1", "10.0.0.1"), ("\uff11\uff10.0.0.1", "10.0.0.1")):
        assert pii.plain(found) == read
    assert pii.added_ok(0, "a at host dot org") and not pii.added_ok(0, "look at it") and not pii.added_ok(1, "10[.]0[.]0[.]256")


def test_stretches_cover_all_candidates():
    rng = random.Random(4)
    for _ in range(200):
        text = "".join(rng.choice("aaaaaaaaaaaaaaaa 1@") if rng.random() < 0.1 else "a" for _ in range(rng.randint(1, 600)))
        parts = pii.stretches(text)
        assert all(a[1] < b[0] for a, b in zip(parts, parts[1:]))
        for m in pii.TRIGGER.finditer(text):
            assert any(s <= m.start() < e for s, e in parts)


def test_the_network_adds_what_the_patterns_miss(weights):
    held_out = pii.made_samples(300, seed=99)
    found, missed = [0] * 4, [0] * 4
    for (text, spans), (base, every) in zip(held_out, pii.all_spans(weights, [t for t, _ in held_out])):
        assert set(base) <= set(every)
        for span in spans:
            if span not in base and 0 <= span[1] and span[2] <= len(text):
                found[span[0]] += span in every
                missed[span[0]] += span not in every
    assert all(f >= 0.85 * (f + m) for f, m in zip(found, missed)), (found, missed)


def test_clean_texts_stay_clean(weights):
    clean = ["On 2024-01-05 at 12:30 we paid $20.50 for 3 of 1200 items.", "Version v1.2.33 of 7 modules.", "token = e03422dad6b454724135a384f69ba12c", "@someone wrote this", "Nothing here at all.", ""]
    assert [every for _, every in pii.all_spans(weights, clean)] == [[] for _ in clean]


def test_rows(spark, weights):
    rows = edge_rows() + random_rows(50) + [(7000, "mail a.b@c.example.org " * 200, "en", "a", 0, 0, "", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    got = {}
    for r in pii.find(df, weights=weights).collect():
        got.setdefault(r["_id"], []).append(r)
    assert sum(map(len, got.values())) == len(rows)
    for r in rows:
        want = plain(r[1] or "")
        text = ",".join(f"{pii.KINDS[k]}:{s}:{e}" for k, s, e in want)
        assert any(g["base_sha256"] == hashlib.sha256(text.encode()).hexdigest() and [g["n_email"], g["n_ip"], g["n_card"], g["n_phone"]] == [sum(k == x for x, _, _ in want) for k in range(4)] for g in got[r[0]])
    assert pii.find(spark.createDataFrame([], SCHEMA), weights=weights).count() == 0
