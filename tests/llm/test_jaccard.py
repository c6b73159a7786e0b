import random

import numpy as np
import pyarrow.parquet as pq

from riskgraph.llm import jaccard

SF = "/root/testdata/sf0.001"


def brute(rows):
    """{doc_id: (n_shingles, component_id)} from all pairs."""
    sets = {}
    for i, text in rows:
        w = (text or "").encode().lower().split()
        sets[i] = {tuple(w[j:j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x, i in enumerate(ids):
        for j in ids[x + 1:]:
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                up[max(a, b)] = min(a, b)
    return {i: (len(sets[i]), find(i)) for i in ids}


def check(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.jaccard_join(df).collect()}
    assert got == brute(rows)
    return got


def words(rng, n):
    return [f"w{rng.randrange(3000)}" for _ in range(n)]


def near(rng, w, edits):
    w = list(w)
    for _ in range(edits):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10 ** 6)}"
    return w


def made(rng, texts=60):
    rows = []
    boiler = words(rng, 40)
    for _ in range(texts):
        w = words(rng, rng.randint(1, 160))
        if rng.random() < 0.4:
            w += boiler
        for _ in range(rng.choice([1, 1, 2, 5])):
            rows.append(" ".join(near(rng, w, rng.randint(0, max(1, len(w) // 15)))))
    rows += ["", None, "  \n", "a b", "A  b", "a b c", rows[0].upper()]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_table_against_all_pairs(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    check(spark, list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())))


def test_made_texts_against_all_pairs(spark):
    got = check(spark, made(random.Random(5)))
    assert len({c for _, c in got.values()}) < len(got)


def test_split_families_and_frequent_shingles(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FAMILY_TOKENS", 200)
    monkeypatch.setattr(jaccard, "FREQUENT", 4)
    monkeypatch.setattr(jaccard, "BUCKET_TOKENS", 500)
    rng = random.Random(7)
    w = words(rng, 60)
    rows = [t for _, t in made(rng, 25)] + [" ".join(near(rng, w, rng.randint(0, 2))) for _ in range(60)]
    check(spark, list(enumerate(rows)))


def test_edges_of_the_table(spark):
    df = spark.createDataFrame([(1, "a b c d e f", "k"), (1, "a b c d e f", "k"), (None, "a b c d e f", "k"), (None, None, "n")],
                               "doc_id long, text string, key string")
    got = sorted(map(tuple, jaccard.jaccard_join(df).collect()), key=str)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (None, 0, None)], key=str)
    assert jaccard.jaccard_join(df.limit(0)).collect() == []


def test_tree_links_equal_all_pairs():
    rng = np.random.default_rng(3)
    base = [rng.integers(0, 2 ** 63, 80, dtype=np.uint64) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[rng.permutation(80)[:rng.integers(66, 81)]], rng.integers(0, 2 ** 63, 3, dtype=np.uint64)]))
            for b in base for _ in range(25)]
    s = jaccard.Sets(list(range(len(sets))), [len(x) for x in sets], sets)
    rows = {i: set(x.tolist()) for i, x in enumerate(sets)}

    def classes(links):
        up = {i: i for i in rows}

        def find(x):
            while up[x] != x:
                x = up[x]
            return x

        for a, b in links:
            up[find(a)] = find(b)
        return {frozenset(j for j in rows if find(j) == find(i)) for i in rows}

    want = [(i, j) for i in rows for j in rows if i < j and 100 * len(rows[i] & rows[j]) >= 75 * len(rows[i] | rows[j])]
    assert classes(jaccard.tree_links(s, s)) == classes(want)


def test_clashing_column_names(spark):
    text = " ".join(f"w{i}" for i in range(30))
    df = spark.createDataFrame([(1, text, 5, 6, 7, 8), (2, text, 5, 6, 7, 8), (3, "a", 5, 6, 7, 8)], "doc_id long, text string, __key long, __NTH long, __kept_id long, __kept_key_ long")
    got = jaccard.one_per_group(df)
    assert got.columns == df.columns and sorted(r.doc_id for r in got.collect()) == [1, 3]


def test_tokens_of_any_number_of_buckets():
    """Tokens come back from a bucket, or at least stay apart with fewer buckets than their low bits have values."""
    rng = np.random.default_rng(1)
    toks = np.unique(np.concatenate([np.array([5 << 32 | 77 << 16 | x for x in range(1 << 16)], dtype=np.uint64), rng.integers(0, 1 << 63, 50_000, dtype=np.uint64)]))
    for buckets in (1, 7, 1 << 16, 100_003, 1 << 17, 3_000_000):
        b = jaccard._bucket_of(toks, buckets)
        assert b.min() >= 0 and b.max() < buckets
        back = np.concatenate([jaccard._token(toks[i:i + 1] >> np.uint64(16), int(b[i]), buckets) for i in rng.integers(0, len(toks), 3000)])
        if buckets >= 1 << 16:
            assert np.isin(back, toks).all()
    b = jaccard._bucket_of(toks, 100_003)
    assert all(jaccard._token(toks[i:i + 1] >> np.uint64(16), int(b[i]), 100_003)[0] == toks[i] for i in range(0, len(toks), 17))
