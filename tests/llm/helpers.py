"""Rows that every operator of the subpackage must bear: nulls, empties, long texts, ties, repeats, clashing names."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, kept string, _row string"
WORDS = "the of and thing letter number Über élan señor Straße here there where idiot".split()


def edge_rows():
    long_ = "word " * 40_000
    texts = [
        (1, "Hello World again and again"),
        (2, "hello WORLD again and again"),
        (3, None),
        (4, ""),
        (None, "hello world AGAIN and again"),
        (None, None),
        (5, long_),
        (5, long_),
        (6, " \t\n\x0b\x0c\r "),
        (7, "a"),
        (8, "tail\u0000zero"),
        (9, "😀 é 漢字 \u00a0 x"),
        (-(2**63), "lowest"),
        (2**63 - 1, "LOWEST"),
        (11, "x" + " " * 1_100_000 + "y"),
        (10, "+1 (743) 555-3824 and ab.12@mail.example.com, 10.0.0.1"),
    ]
    sources = ["s1", None, "", "s2", "s1"]
    return [(i, t, "en", sources[k % 5], None if t is None else len(t), k, "x", None) for k, (i, t) in enumerate(texts)]


def random_rows(n=300, seed=1):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        if out and rng.random() < 0.3:
            text = rng.choice(out)[1]
            if rng.random() < 0.5:
                text = text.upper() if rng.random() < 0.5 else text + " " + rng.choice(WORDS)
        else:
            text = " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, 60)))
        out.append((i * 7 % 1009, text, "en", rng.choice(["a", "b", "c", None]), len(text), 1, "y", None))
    return out


def lower(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
