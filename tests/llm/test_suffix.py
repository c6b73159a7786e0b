import hashlib
import random

import numpy as np
import pyarrow.parquet as pq

from riskgraph.llm import suffix

SF = "/root/testdata/sf0.001"


def brute(rows):
    """Digest columns from a dictionary of all windows in order of (doc_id, start)."""
    seen, out = set(), {}
    for i, text in sorted(rows, key=lambda r: r[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = True
            seen.add(w)
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        spans = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest())
    return out


def result(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(df).collect()}


def made(rng):
    def text(n):
        return "".join(rng.choice("abcdefg ") for _ in range(n))

    line = text(130)
    rows = []
    for _ in range(40):
        t = text(rng.randint(0, 900))
        if rng.random() < 0.5:
            p = rng.randint(0, len(t))
            t = t[:p] + line + t[p:]
        rows.append(t)
        if rng.random() < 0.5:
            c = list(t)
            for _ in range(rng.randint(0, 3)):
                if c:
                    c[rng.randrange(len(c))] = "é"
            rows.append("".join(c))
    rows += ["a" * 500, "a" * 350, "ab" * 300, "the " * 200, None, "", "x" * 99, "x" * 100, "x" * 101, line * 4, "é" * 200]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    rows = list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()))
    assert result(spark, rows) == brute(rows)


def test_made(spark):
    rows = made(random.Random(1))
    assert result(spark, rows) == brute(rows)


def test_scattered_and_pieces(spark, monkeypatch):
    rows = made(random.Random(2))
    monkeypatch.setattr(suffix, "HOT", 1)
    monkeypatch.setattr(suffix, "PIECE", 150)
    monkeypatch.setattr(suffix, "BATCH", 600)
    monkeypatch.setattr(suffix, "BUCKET", 500)
    monkeypatch.setattr(suffix, "FETCH", 500)
    assert result(spark, rows) == brute(rows)


def test_edges(spark):
    long = "".join(random.Random(3).choices("abc", k=300))
    df = spark.createDataFrame([(2, long, 1), (2, long, 1), (None, long, 2), (3, None, 3)], "doc_id long, text string, pos long")
    got = {(r.doc_id, r.n_removed, len(r.kept)) for r in suffix.remove_repeats(df).collect()}
    assert got == {(None, 0, 300), (2, 300, 0), (3, 0, 0)}
    assert suffix.remove_repeats(df.limit(0)).collect() == []


def test_longest_previous_factors():
    """The rank rule against previous and next smaller values in a full suffix order."""
    rng = random.Random(4)
    b = bytes(rng.choice(b"ab") for _ in range(400)) * 2
    at = np.arange(len(b) - 99)
    ranks = suffix.suffix_ranks(np.frombuffer(b, np.uint8), np.full(len(b), len(b)), at)
    got = suffix.later_copies(ranks, at)
    order = sorted(at.tolist(), key=lambda i: b[i:])

    def common(i, j):
        n = 0
        while max(i, j) + n < len(b) and b[i + n] == b[j + n]:
            n += 1
        return n

    for x, i in enumerate(order):
        before = next((j for j in reversed(order[:x]) if j < i), None)
        after = next((j for j in order[x + 1:] if j < i), None)
        lpf = max([0, *(common(i, j) for j in (before, after) if j is not None)])
        assert got[i] == (lpf >= 100)


def brute_with_ties(rows):
    """As brute(), for null and repeated ids: null first, texts of one id by CRC-32 and MD5, equal rows once."""
    import zlib
    order = sorted({(i is not None, i or 0, zlib.crc32((t or "").encode()), hashlib.md5((t or "").encode()).hexdigest(), t or "") for i, t in rows})
    seen, out = set(), {}
    for has, i, _, _, t in order:
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for p in range(len(b) - 99):
            w = b[p:p + 100]
            if w in seen:
                gone[p:p + 100] = True
            seen.add(w)
        out[i if has else None, hashlib.sha256(b).hexdigest()] = (len(b), int(gone.sum()))
    return [(i, *out[i, hashlib.sha256((t or "").encode()).hexdigest()]) for i, t in rows]


def equal_crc(a: bytes, b: bytes) -> bytes:
    """``b`` with four bytes at its end so that both have one CRC-32 (the CRC is linear in them)."""
    import zlib
    base, want = zlib.crc32(b + b"\0\0\0\0"), zlib.crc32(a)
    rows = []
    for k in range(32):
        x = (1 << k).to_bytes(4, "little")
        rows.append((zlib.crc32(b + x) ^ base, 1 << k))
    target, answer = base ^ want, 0
    for bit in range(31, -1, -1):  # elimination over two elements
        pivot = next((r for r in rows if r[0].bit_length() - 1 == bit), None)
        if pivot is None:
            continue
        rows = [r if r is pivot or not r[0] >> bit & 1 else (r[0] ^ pivot[0], r[1] ^ pivot[1]) for r in rows if r is not pivot]
        if target >> bit & 1:
            target, answer = target ^ pivot[0], answer ^ pivot[1]
    assert target == 0
    return b + answer.to_bytes(4, "little")


def test_null_and_repeated_ids(spark):
    import zlib
    rng = random.Random(7)
    rows = [(i, t) for i, t in made(rng)]
    rows = [(rng.choice([None, None, 3, i]), t) for i, t in rows]
    one, other = "".join(rng.choices("abcd", k=404)), "".join(rng.choices("efgh", k=404))
    while True:  # two texts of one CRC that have no string in common
        try:
            twin = equal_crc(one.encode(), other.encode()).decode()
            break
        except UnicodeDecodeError:
            other = "".join(rng.choices("efgh", k=404))
    assert zlib.crc32(one.encode()) == zlib.crc32(twin.encode())
    rows += [(None, one), (None, twin), (3, one + one[:150]), rows[2], rows[2]]
    got = [(r.doc_id, r.n_bytes, r.n_removed) for r in suffix.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted(brute_with_ties(rows), key=str)
    assert [r for r in got if r[0] is None and r[1] in (404, 408)] and not any(r[2] for r in got if r[0] is None and r[1] in (404, 408))


def test_previous_factors():
    """The array of factors against all pairs of suffixes, up to 100."""
    rng = random.Random(8)
    for alphabet, n in ((b"a", 260), (b"ab", 330), (b"abcdefgh", 300)):
        text = bytes(rng.choice(alphabet) for _ in range(n))
        b = (text + text[40:200] + bytes(rng.choice(b"xyz") for _ in range(60)) + text[100:])[:700]
        at = np.arange(len(b) - 99)
        places = np.array(rng.sample(range(10 * len(at)), len(at)))  # any order of places
        ranks = suffix.ranks_by_depth(np.frombuffer(b, np.uint8), np.full(len(b), len(b)))
        got = suffix.previous_factors(ranks, np.frombuffer(b, np.uint8), at, places)
        for i in rng.sample(range(len(at)), 120):
            want = 0
            for j in np.flatnonzero(places < places[i]).tolist():
                k = 0
                while k < 100 and b[i + k] == b[j + k]:
                    k += 1
                want = max(want, k)
            assert got[i] == want


def test_nearest_smaller():
    rng = np.random.default_rng(9)
    for n in (0, 1, 2, 50, 300):
        for x in (rng.permutation(n), np.arange(n), np.arange(n)[::-1]):
            want = [next((j for j in range(i - 1, -1, -1) if x[j] < x[i]), -1) for i in range(n)]
            assert suffix.nearest_smaller(x).tolist() == want
