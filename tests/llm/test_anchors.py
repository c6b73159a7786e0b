"""Repeated passages against a brute-force version over all windows."""
import hashlib
import random
from collections import Counter

import pyarrow.parquet as pq
import pytest

from riskgraph.llm import anchors

SF = "/root/testdata/sf0.001"
W = anchors.WINDOW


def brute(rows):
    words = [(text or "").encode().split() for _, text in rows]
    seen = Counter(tuple(w[i:i + W]) for w in words for i in range(len(w) - W + 1))
    out = []
    for (i, _), w in zip(rows, words, strict=True):
        gone = {k for s in range(len(w) - W + 1) if seen[tuple(w[s:s + W])] > 1 for k in range(s, s + W)}
        out.append((i, len(w), len(gone), hashlib.sha256(b" ".join(x for k, x in enumerate(w) if k not in gone)).hexdigest()))
    return out


def result(df):
    return [tuple(r) for r in df.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()]


def same(got, want):
    assert sorted(got, key=str) == sorted(want, key=str)


def made(seed, n=250):
    rng = random.Random(seed)
    word = lambda: rng.choice(["a", "b", "é", "漢字", "x" * 30, str(rng.randint(0, 400))])
    passages = [[word() for _ in range(k)] for k in (34, 35, 36, 52, 53, 70, 200)]
    hot = [word() for _ in range(60)]
    texts = []
    for _ in range(n):
        t = [word() for _ in range(rng.randint(0, 90))]
        for _ in range(rng.randint(0, 2)):
            p = rng.choice(passages)
            a = rng.randint(0, 3)
            at = rng.randint(0, len(t))
            t[at:at] = p[a:]
        if rng.random() < 0.33:
            at = rng.randint(0, len(t))
            t[at:at] = hot
        texts.append("".join(w + rng.choice([" ", "  ", "\n", "\t", " \r\n"]) for w in t))
    texts += [None, "", " \n ", "z " * 34, "y " * 35, "y " * 36, "q " * 200, *rng.sample(texts, 20)]
    rows = [(rng.choice([k, None, 7]) if rng.random() < 0.1 else k, t) for k, t in enumerate(texts)]
    return [*rows, rows[3], rows[3]]


@pytest.mark.parametrize("small", [False, True])
def test_equals_brute_force(spark, monkeypatch, small):
    if small:  # several messages a task, many buckets, texts in pieces
        for name, value in (("PIECE", 300), ("BATCH", 2000), ("WINDOWS", 100), ("PROBE_BUCKET", 9000), ("WINDOW_BUCKET", 500)):
            monkeypatch.setattr(anchors, name, value)
    rows = made(1 + small)
    df = spark.createDataFrame([(*r, "x", 1, 2) for r in rows], "doc_id long, text string, row string, start int, runs int").repartition(5)
    docs = anchors.remove_copies(df).collect()
    same([(r.doc_id, r.n_words, r.n_removed, r.kept_sha256) for r in docs], brute(rows))
    for r in docs:
        assert hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 and sum(s.end - s.start for s in r.spans) == r.n_removed
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_table_equals_brute_force(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    same(result(anchors.op11_anchors(spark, SF)), brute(rows))


def test_empty_table(spark):
    assert anchors.remove_copies(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_pieces_hold_all_words(monkeypatch):
    monkeypatch.setattr(anchors, "PIECE", 16)
    rng = random.Random(5)
    for _ in range(300):
        text = "".join(rng.choice(["a", "bc", "漢", " ", " ", "\n", "x" * 40]) for _ in range(rng.randint(0, 60))).encode()
        for overlap in (0, 2, 5):
            words, at = text.split(), 0
            for body, first in anchors.parts(text, overlap):
                some = body.split()
                assert first == max(0, at - overlap) and words[first:first + len(some)] == some
                at = first + len(some)
            assert at == len(words)


def test_packed_numbers():
    import numpy as np

    rng = np.random.default_rng(6)
    arrays = [rng.integers(0, 1 << int(b), 50, dtype=np.uint64) for b in (1, 8, 9, 40, 63)] + [np.empty(0, np.uint64), np.zeros(3, np.uint64)]
    assert all((a == b).all() and len(a) == len(b) for a, b in zip(arrays, anchors.unpack(anchors.pack(*arrays)), strict=True))
