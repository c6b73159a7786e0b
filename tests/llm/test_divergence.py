"""Divergence audit against SQL in whole numbers and against a brute-force version."""
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from riskgraph.llm import divergence

TERM = re.compile("[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, min_docs=10, top=10):
    docs, counts = defaultdict(Counter), defaultdict(Counter)
    groups = set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = TERM.findall((text or "").translate(LOWER))
        counts[lang, source].update(terms)
        docs[lang].update(set(terms))
    out = set()
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        v, mine = len(kept), sorted((s for g, s in groups if g == lang), key=lambda s: s.encode())

        def prices(count):
            n = sum(count[t] for t in kept)
            return {t: 1 + (10 ** 9 * (count[t] + 2)) // (n + 2 * v) for t in kept}

        own = {s: prices(counts[lang, s]) for s in mine}
        whole = prices(sum((counts[lang, s] for s in mine), Counter()))
        for s in mine:
            pair = [(-sum((own[s][t] - own[o][t]) ** 2 // (own[s][t] + own[o][t]) for t in kept), o.encode(), o) for o in mine if o != s]
            term = [(-((own[s][t] - whole[t]) ** 2 // (own[s][t] + whole[t])), t.encode(), t) for t in kept
                    if counts[lang, s][t] > 0 and own[s][t] > whole[t]]
            out |= {(lang, s, "pair", o, -f, r) for r, (f, _, o) in enumerate(sorted(pair), 1)}
            out |= {(lang, s, "term", t, -f, r) for r, (f, _, t) in enumerate(sorted(term)[:top], 1)}
    return out


def result(df):
    rows = [tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


SCHEMA = "text string, lang string, source string, id long, n long, i long, term long, rank string, v double"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, 2, 3, 4, "x", 0.5) for r in rows], SCHEMA)


def made(seed, n=400):
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcÉé漢😀ñZ") for _ in range(rng.randint(1, 3))) for _ in range(150)]
    rows = []
    for _ in range(n):
        lang = rng.choice(["en", "en", "en", "de", "", None])
        source = rng.choice(["s1"] * 4 + ["s2", "S2", "é", "", None])
        own = vocabulary[:100] if source == "s1" else vocabulary[50:]
        text = rng.choice([None, "", " 12 _\x00", *(rng.choice([" ", "-", "\n", "9", " "]).join(rng.choices(own, k=rng.randint(1, 60))) for _ in range(8))])
        rows.append((text, lang, source))
    return [*rows, ("only once", "xx", "a"), (None, "xx", "b"), ("x", "yy", "alone"), *[("tie a b c", "tt", s) for s in "pqr" for _ in range(4)]]


@pytest.mark.parametrize("seed", [1])
def test_equals_brute_force(spark, monkeypatch, seed):
    monkeypatch.setattr(divergence, "BLOCK", 16)
    monkeypatch.setattr(divergence, "SLICE", 2000)
    monkeypatch.setattr(divergence, "BUCKET", 5000)
    rows = made(seed)
    got, want = result(divergence.audit(frame(spark, rows))), brute(rows)
    assert got == want
    assert ("xx", "a", "pair", "b", 0, 1) in got and not [r for r in got if r[0] == "yy" and r[2] == "pair"]


def test_sql_equals_brute_force():
    rows = made(3, 150)
    con = duckdb.connect()
    con.execute("create table documents (text varchar, lang varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(t.replace("\x00", " ") if t else t, g, s) for t, g, s in rows])
    got = {(r[0], r[1], r[2], r[3], r[4], r[5]) for r in con.execute(divergence.ORACLE_DIVERGENCE).fetchall()}
    assert got == brute(rows)


def test_edges(spark):
    assert divergence.audit(frame(spark, []).limit(0)).collect() == []
    same = [("a b", "en", "x")] * 12 + [("a b", "en", "y")] * 12
    assert result(divergence.audit(frame(spark, same))) == {("en", "x", "pair", "y", 0, 1), ("en", "y", "pair", "x", 0, 1)}
    none = [(None, None, None), ("", "", "b")]
    assert result(divergence.audit(frame(spark, none))) == {("", "", "pair", "b", 0, 1), ("", "b", "pair", "", 0, 1)}


def test_terms_of_a_slice():
    rng = random.Random(4)
    for _ in range(100):
        texts = ["".join(rng.choice("ab éZ1-\x00\n") for _ in range(rng.randint(0, 30))) for _ in range(rng.randint(1, 9))]
        groups = [rng.randint(0, 2) for _ in texts]
        terms, code, group, n, docs = divergence.count_slice([t.encode() for t in texts], np.array(groups))
        terms, want = terms.to_pylist(), defaultdict(lambda: [0, 0])
        for g, t in zip(groups, texts, strict=True):
            for w, k in Counter(TERM.findall(t.translate(LOWER))).items():
                want[w, g][0] += k
                want[w, g][1] += 1
        got = {(terms[c], g): [k, d] for c, g, k, d in zip(code.tolist(), group.tolist(), n.tolist(), docs.tolist(), strict=True)}
        assert got == dict(want)


def test_gallop_and_prices():
    rng = np.random.default_rng(5)
    for _ in range(200):
        large = np.unique(rng.integers(0, 3000, rng.integers(0, 600)))
        small = np.unique(rng.integers(-5, 3010, rng.integers(0, 200)))
        assert (divergence.gallop(small, large) == np.searchsorted(large, small)).all()
    for c, n, v in [(0, 0, 1), (5, 7, 3), (10 ** 12, 10 ** 13, 10 ** 9), (9 * 10 ** 14, 9 * 10 ** 14, 1), (0, 1, 1)]:
        assert divergence.price(np.array([c]), n, v)[0] == 1 + (10 ** 9 * (c + 2)) // (n + 2 * v)


def test_prices_on_columns(spark):
    from pyspark.sql import functions as F

    rows = [(0, 0, 1), (5, 7, 3), (10 ** 12, 10 ** 13, 10 ** 9), (9 * 10 ** 14, 9 * 10 ** 14, 1)]
    df = spark.createDataFrame(rows, "c long, n long, v long")
    got = df.select("c", "n", "v", divergence.price_column(F.col("c"), F.col("n"), F.col("v")).alias("p")).collect()
    assert all(r.p == 1 + (10 ** 9 * (r.c + 2)) // (r.n + 2 * r.v) for r in got)
