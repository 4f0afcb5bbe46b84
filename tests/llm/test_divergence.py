import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from corvane.llm import divergence as dv
from tests.llm.helpers import SCHEMA, edge_rows, lower, random_rows


def plain(rows, least, top):
    """rows: text, lang, source."""
    groups, held, lang_n = defaultdict(Counter), defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        groups[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
        lang_n[lang or ""].update(found)
    out = []
    for (lang, source), own in groups.items():
        kept = [t for t, n in held[lang].items() if n >= least]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[x] for x in kept) + 5 * len(kept)) for t in kept}
        mine, q = p(own), p(lang_n[lang])
        pairs = [(sum(abs(mine[t] - v) for t, v in p(c).items()), s) for (o, s), c in groups.items() if o == lang and s != source]
        terms = [(mine[t] - q[t], t) for t in kept if own[t] and mine[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, k + 1) for k, (v, item) in enumerate(found) if part == "pair" or k < top]
    return sorted(out)


def made(seed=1, n=400, sources=9):
    rng = random.Random(seed)
    words = [f"w{'abcdefghij'[k % 10]}{'klmno'[k % 5]}{chr(97 + k % 26)}" for k in range(60)] + ["É", "ß", "漢字", "Zoë"]
    return [(" ".join(rng.choices(words, k=rng.randint(0, 30))) if rng.random() < 0.95 else None, rng.choice(["en", "de", None]), rng.choice([*[f"s{k}" for k in range(sources)], None, ""])) for _ in range(n)]


@pytest.mark.parametrize("tile, block", [(4096, 256), (7, 3), (5, 2), (50, 4)])
def test_against_plain(spark, tile, block):
    rows = made() + [(None, "xx", "only"), ("", "yy", "a"), ("rare words", "yy", "b")]
    df = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    got = sorted(map(tuple, dv.audit(df, least=20, top=5, tile=tile, block=block).collect()))
    assert got == plain(rows, 20, 5)


def test_edge_rows(spark):
    rows = edge_rows() + random_rows(100)
    got = sorted(map(tuple, dv.audit(spark.createDataFrame(rows, SCHEMA), least=2, top=50).collect()))
    assert got == plain([(r[1], r[2], r[3]) for r in rows], 2, 50)


def test_sql(spark, tmp_path):
    rows = [r for r in made(3, 900)]
    spark.createDataFrame(rows, "text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    assert sorted(con.sql(dv.ORACLE).fetchall()) == plain(rows, 30, 50) == sorted(map(tuple, dv.query(spark, str(tmp_path)).collect()))


@pytest.mark.parametrize("light", [0.0, 0.5, 1.0])
def test_tile_sums(light, monkeypatch):
    rng = np.random.default_rng(2)
    monkeypatch.setattr(dv, "HEAVY", 8)
    base, full = rng.integers(1, 50, 7), np.zeros((7, 30), dtype=np.int64)
    full[:] = base[:, None]
    term, group, p = [], [], []
    for t in range(30):
        for g in rng.choice(7, rng.integers(1, 8), replace=False):
            term.append(t)
            group.append(g)
            p.append(int(base[g] + rng.integers(0, 90)))
            full[g, t] = p[-1]
    term = np.array(term)
    heavy = ~np.isin(term, rng.permutation(30)[: int(30 * light)])
    got = dv.tile_sums(base, np.zeros(7, dtype=np.int64), term, np.array(group), np.array(p), heavy)
    for a in range(7):
        for b in range(a + 1, 7):
            assert got[a, b] == (np.abs(full[a] - full[b]) - abs(base[a] - base[b])).sum()


def test_shares_are_exact_at_any_count(spark):
    n, total, v = 9 * 10**12, 10**14, 10**6
    got = spark.range(1).select(dv.share_of(*[dv.F.lit(x).cast("long") for x in (n, total, v)])).first()[0]
    assert got == 1 + 10**9 * (n + 5) // (total + 5 * v)


def test_empty_and_odd_names(spark):
    assert dv.audit(spark.createDataFrame([], SCHEMA)).count() == 0
    odd = spark.createDataFrame([("a b", "x", "s", 1), ("a", "x", "t", 2)], "`te``xt` string, `la.ng` string, `so urce` string, term long")
    assert dv.audit(odd, "te`xt", "la.ng", "so urce", least=1).where("part = 'pair'").count() == 2
