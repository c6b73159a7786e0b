import random

import numpy as np
import pyarrow.parquet as pq
import pytest

from riskgraph.llm import decontaminate as d

SF = "/root/testdata/sf0.01"


def held(docs, items):
    """(doc_id, item_id) where the item's words stand in the document's, one after the other."""
    flat = {i: f" {' '.join((t or '').lower().split())} " for i, t in docs}
    return {(i, k) for k, t in items for i, x in flat.items() if t and f" {' '.join(t.lower().split())} " in x}


def test_every_whole_item_of_the_table_is_found(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    rows = d.leaks(docs, bench).collect()
    got = {(r.doc_id, r.item_id) for r in rows}
    t, b = (pq.read_table(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    want = held(zip(t["doc_id"].to_pylist(), t["text"].to_pylist()), list(zip(b["item_id"].to_pylist(), b["text"].to_pylist())))
    assert want and want <= got
    assert len(got - want) <= 0.1 * len(want)  # items with a word changed
    assert all(r.lcs >= d.LCS * r.item_words for r in rows)


@pytest.fixture(scope="module")
def made():
    rng = random.Random(4)
    common = [f"c{i}" for i in range(40)]
    text = lambda n: [rng.choice(common) if rng.random() < 0.4 else f"w{rng.randrange(4000)}" for _ in range(n)]
    items = [(k, text(rng.randint(12, 70))) for k in range(30)]
    docs, want = [], set()
    for i in range(600):
        w = text(rng.randint(1, 400))
        if i % 3 == 0:  # one item is in a third of all documents
            k = 7 if i % 9 else i // 9 % 30
            it = list(items[k][1])
            for _ in range(len(it) // 8):  # a paraphrase: words changed, dropped, added
                p = rng.randrange(len(it))
                it[p:p + 1] = rng.choice([[], ["z"], [it[p], "z"]])
            at = rng.randint(0, len(w))
            w[at:at] = it
            want.add((i, k))
        docs.append((i, " ".join(w)))
    return docs, [(k, " ".join(t)) for k, t in items], want


def test_paraphrases_and_a_frequent_item(spark, made):
    docs, items, want = made
    got = {(r.doc_id, r.item_id) for r in d.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                                  spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.95 * len(want)
    assert not got - want


def test_candidate_recall_against_brute_force(spark, made):
    """Pairs that pass the check anywhere in the text, found without the space, against those found with it."""
    docs, items, _ = made
    ids = d.word_ids(spark.createDataFrame(docs, "doc_id long, text string"))
    n, df = d.document_frequencies(ids)
    block = next(d.item_blocks(spark.createDataFrame(items, "item_id long, text string")))
    space = d.fit(ids, n, df, block)
    texts = [np.frombuffer(r.ids, np.uint16) for r in ids.collect()]
    found = {(t, i) for t, i, *_ in space.search(texts)}
    brute = {(t, block[k][0]) for t, x in enumerate(texts) for k in range(len(block))
             if any(space.check(k, x[a:a + 2 * len(block[k][1])].tolist()) for a in range(0, len(x), 5))}
    assert len(found & brute) >= 0.9 * len(brute)


def test_blocks_of_items_give_the_same(spark, made, monkeypatch):
    docs, items, _ = made
    a, b = (spark.createDataFrame(x, s) for x, s in ((docs[:150], "doc_id long, text string"), (items, "item_id long, text string")))
    one = {(r.doc_id, r.item_id) for r in d.leaks(a, b).collect()}
    monkeypatch.setattr(d, "ITEMS", 11)
    monkeypatch.setattr(d.item_blocks, "__defaults__", ("text", "item_id", 11))
    assert {(r.doc_id, r.item_id) for r in d.leaks(a, b).collect()} == one


def test_edges(spark):
    item = " ".join(f"q{i}" for i in range(20))
    docs = spark.createDataFrame([(1, f"a {item} b", "x"), (1, f"a {item} b", "x"), (None, item, "y"), (2, None, "z"), (3, "", "z"), (4, "a b", "z")],
                                 "doc_id long, text string, item_id string")
    bench = spark.createDataFrame([(5, item, "t"), (6, None, "t"), (7, "", "t"), (None, "a b", "t")], "item_id long, text string, doc_id string")
    rows = d.leaks(docs, bench).collect()
    assert sorted(((r.doc_id, r.item_id) for r in rows), key=str) == [(1, 5), (1, 5), (None, 5)]
    assert sorted(map(tuple, d.decontaminated(docs, bench).collect()), key=str) == [(2, None, "z"), (3, "", "z"), (4, "a b", "z")]
    assert d.leaks(docs.limit(0), bench).count() == 0 and d.leaks(docs, bench.limit(0)).count() == 0
    assert d.decontaminated(docs, bench.limit(0)).count() == 6


def found_in_rare_words(spark, items, want_words):
    """(pairs found, pairs made): each item in a third of 400 documents whose other words stand in few documents."""
    rng = random.Random(6)
    docs, want = [], set()
    for i in range(400):
        w = [[f"r{rng.randrange(100_000)}"] for _ in range(rng.randint(40, 200))]
        for k, t in enumerate(items):
            if rng.random() < 1 / 3:
                w.insert(rng.randint(0, len(w)), want_words(rng, t))
                want.add((i, k))
        docs.append((i, " ".join(x for some in w for x in some)))
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                  spark.createDataFrame([(k, " ".join(t)) for k, t in enumerate(items)], "item_id long, text string")).collect()
    return {(r.doc_id, r.item_id) for r in got}, want


@pytest.mark.parametrize("sample", [d.SAMPLE, 40])
def test_frequent_items_among_rare_words(spark, monkeypatch, sample):
    """Word for word, items of 1 to 40 words; the sample is the whole table or a tenth of it."""
    monkeypatch.setattr(d, "SAMPLE", sample)
    items = [[f"i{k}x{j}" for j in range(n)] for k, n in enumerate((1, 2, 3, 5, 8, 10, 15, 24, 25, 40))]
    got, want = found_in_rare_words(spark, items, lambda rng, t: t)
    assert want <= got


def test_changed_frequent_items_among_rare_words(spark):
    """One word in nine is another one, the same in all documents and the first one among them: these words of the
    items stand in no document, and no first piece stands there word for word."""
    items = [[f"i{k}x{j}" for j in range(18)] for k in range(3)]
    got, want = found_in_rare_words(spark, items, lambda rng, t: [f"r{rng.randrange(100_000)}" if j % 9 == 0 else x for j, x in enumerate(t)])
    assert len(got & want) >= 0.95 * len(want)


def test_runs_find_first_pieces():
    rng = np.random.default_rng(5)
    texts = [rng.integers(0, 4, rng.integers(0, 60)).astype(np.uint16) for _ in range(50)]
    firsts = [rng.integers(0, 4, n).astype(np.uint16) for n in (1, 2, 3, 3, 4, 5, 7)] + [t[1:25] for t in texts if len(t) > 24]
    flat, ends = np.concatenate(texts), np.cumsum([len(t) for t in texts])
    want = {(int(e - len(t) + a), k) for t, e in zip(texts, ends, strict=True) for k, p in enumerate(firsts) for a in range(len(t) - len(p) + 1)
            if (t[a:a + len(p)] == p).all()}
    assert set(d.Runs(firsts).find(flat, ends)) == want


def test_all_words_of_the_items_are_in_the_space(spark, monkeypatch):
    monkeypatch.setattr(d, "VOCABULARY", 16)
    items = [(k, " ".join(f"i{k}x{j}" for j in range(20))) for k in range(40)]
    docs = [(i, " ".join(x for x in items[i][1].split() if not x.endswith("x0"))) for i in range(40)]
    got = d.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.item_id) for r in got} == {(k, k) for k in range(40)}


def colliding(word):
    """Another word whose hash has the same 16 bits."""
    want = d.short(d.hashed([word.encode()])[0])[0]
    for lo in range(0, 1 << 20, 1 << 14):
        words = [f"x{i}" for i in range(lo, lo + (1 << 14))]
        at = np.flatnonzero(d.short(d.hashed([" ".join(words).encode()])[0]) == want)
        if len(at):
            return words[at[0]]
    raise AssertionError


def test_words_that_share_16_bits_are_different(spark):
    a, b = colliding("zebra"), colliding("okapi")
    docs = spark.createDataFrame([(1, f"some words about {a} {b} and more text"), (2, "a zebra okapi here"), (3, "zebra"), (4, f"{a} okapi")], "doc_id long, text string")
    items = spark.createDataFrame([(5, "zebra okapi")], "item_id long, text string")
    assert [(r.doc_id, r.item_id) for r in d.leaks(docs, items).collect()] == [(2, 5)]
    assert sorted(r.doc_id for r in d.decontaminated(docs, items).collect()) == [1, 3, 4]


def test_paraphrases_in_a_table_of_many_samples(spark, made, monkeypatch):
    """The sample that shapes the space is a twelfth of the table or less."""
    monkeypatch.setattr(d, "SAMPLE", 50)
    docs, items, want = made
    got = {(r.doc_id, r.item_id) for r in d.leaks(spark.createDataFrame(docs, "doc_id long, text string"),
                                                  spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(got & want) >= 0.9 * len(want) and not got - want


def test_the_space_comes_from_all_documents(spark, monkeypatch):
    """The matrix that the first round sums is that of every passage of every document, in whatever steps."""
    monkeypatch.setattr(d, "SAMPLE", 7)
    rng = np.random.default_rng(3)
    texts = [" ".join(f"w{x}" for x in rng.integers(0, 60, rng.integers(1, 130))) for _ in range(90)]
    items = [(1, *(f(d.hashed([texts[0].encode()])[0][:20]) for f in (d.short, np.copy)))]
    ids = d.word_ids(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    n, df = d.document_frequencies(ids)
    monkeypatch.setattr(d, "ROUNDS", 1)
    space = d.fit(ids, n, df, items)
    short = [d.short(h) for h in d.hashed([t.encode() for t in texts])]
    passages = [x[a:a + 2 * d.BLOCK] for x in short for a in range(0, len(x), 2 * d.BLOCK)]
    q = np.random.Generator(np.random.PCG64(8)).standard_normal((len(space.rows), d.RANK)).astype(np.float32)
    boost = max(1.0, sum(len(x) for x in short) / (2 * d.BLOCK))
    g = d._gram_times(*d._unit_rows(passages, space.weight, space.at), q)
    g += np.float32(boost) * d._gram_times(*d._unit_rows(d.pieces(items[0][1]), space.weight, space.at), q)
    have = g - space.rows @ (space.rows.T @ g)  # nothing of it lies outside the space
    assert np.abs(have).max() < 1e-3 * np.abs(g).max()


@pytest.mark.parametrize("passages, dense", [(512, 1024), (7, 5), (3, 40)])
def test_products_in_steps_are_those_of_the_whole_matrix(monkeypatch, passages, dense):
    """Frequent words by matrix products, the others row by row: words that repeat in a passage and in many of them."""
    monkeypatch.setattr(d, "PASSAGES", passages)
    monkeypatch.setattr(d, "DENSE", dense)
    rng = np.random.default_rng(11)
    texts = [(rng.zipf(1.3, rng.integers(0, 60)) % 97).astype(np.uint16) for _ in range(50)]
    weight, at = rng.random(d.IDS).astype(np.float32), np.full(d.IDS, -1, dtype=np.int32)
    at[:90] = rng.permutation(90)  # some words are not in the space
    word, of, w = d._unit_rows(texts, weight, at)
    a = np.zeros((len(texts), 90))
    np.add.at(a, (of, word), w)
    q = rng.standard_normal((90, 8)).astype(np.float32)
    assert d._gram_times(word, of, w, q) == pytest.approx(a.T @ (a @ q), abs=1e-4)
    space = d.Space(weight, at, q, [])
    sizes = [len(t) for t in texts]
    got = space.project_all(np.concatenate(texts), np.cumsum(sizes) - sizes, np.cumsum(sizes))
    assert got == pytest.approx(np.array([space.project(t) for t in texts]), abs=1e-4)
