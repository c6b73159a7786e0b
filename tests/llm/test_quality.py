import base64
import random

import pyarrow.parquet as pq
import zstandard

from riskgraph.llm import quality

SF = "/root/testdata/sf0.01"


def brute(text):
    text = text or ""
    words, at = [], ""
    for c in text + " ":
        if c in " \t\n\v\f\r":
            if at:
                words.append(at)
            at = ""
        else:
            at += c
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    covered = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 8)}
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered),
            n < 20 or 100 * len(covered) > 30 * n)


def rows_of(df):
    return {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in df.collect()}


def test_base_columns(spark):
    rng = random.Random(1)
    rows = []
    for i in range(60):
        w = [rng.choice(["a", "bé", "c#", "d\xa0e", " ", "x|y"]) for _ in range(rng.randint(0, 60))]
        w = w[:10] * rng.randint(1, 4) + w
        rows.append((i, "".join(x + rng.choice([" ", "\n", "\t", "\n\n", "\x0b", "\x1c ", "  "]) for x in w)))
    rows += [(100, None), (101, ""), (102, " \n \n"), (103, "a\r\na\r\n a\n"), (104, "\U0001f600 x\n" * 30)]
    got = rows_of(quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got == {i: brute(t) for i, t in rows}


def test_labels(spark):
    """Good documents stay; of the poor ones those that repeat themselves go."""
    got = {r.doc_id: r for r in quality.quality_rules(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    labels = pq.read_table(f"{SF}/labels.parquet").to_pydict()
    good = [got[i] for i, q in zip(labels["doc_id"], labels["quality"]) if q == 1]
    assert all(r.kept for r in good if not r.base_failed)
    poor = [got[i] for i, q in zip(labels["doc_id"], labels["quality"]) if q == 0]
    assert sum(not r.kept for r in poor) >= 0.3 * len(poor)
    assert all(r.ratio > 2.5 and not r.kept for r in got.values() if r.ratio > 4)


def test_bands():
    z = zstandard.ZstdCompressor(level=quality.LEVEL)
    rng = random.Random(2)
    prose = " ".join("".join(rng.choice(["th", "er", "on", "an", "re", "he", "in"]) for _ in range(rng.randint(1, 4))) for _ in range(900))
    assert quality.judge(prose.encode(), z)[6]
    assert not quality.judge((prose[:200] + " ").encode() * 40, z)[6]
    noise = " ".join(base64.b64encode(rng.randbytes(60)).decode() for _ in range(150)).encode()
    assert not quality.judge(noise, z)[6]
    half = prose.encode() + b" " + noise  # the whole may pass, the chunks do not
    assert not quality.judge(half, z)[6]
    assert quality.compression(b"", z) == (0.0, 0, 0, False)


def test_filter_keeps_the_columns(spark):
    text = "".join(f"w{i * i % 97}x{i} " for i in range(60))
    df = spark.createDataFrame([(1, text, "a"), (1, text, "a"), (None, text, None), (2, None, "a"), (3, "", "a")], "doc_id long, text string, kept string")
    assert sorted(map(tuple, quality.quality_filter(df).collect()), key=str) == sorted([(1, text, "a"), (1, text, "a"), (None, text, None)], key=str)
    assert quality.quality_filter(df).columns == df.columns
    assert quality.quality_filter(df.limit(0)).collect() == [] == quality.quality_rules(df.limit(0)).collect()
    assert quality.quality_rules(df).count() == 5
