"""Alignment of two tokenizers against the libraries on whole texts and a byte-by-byte version."""
import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
import sentencepiece
from tokenizers import Tokenizer

from riskgraph.llm import alignment

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def libraries():
    a = Tokenizer.from_file(alignment.MODEL_A)
    a.encode_special_tokens = True
    return a, sentencepiece.SentencePieceProcessor(model_file=alignment.MODEL_B)


BYTE_OF = alignment.byte_characters()


def bytes_a(token):
    return bytes(BYTE_OF[c] for c in token)


def bytes_b(piece):
    if len(piece) == 6 and piece.startswith("<0x"):
        return bytes([int(piece[3:5], 16)])
    return piece.replace("▁", " ").encode()


def brute(libraries, rows):
    """doc_id and the columns of the contract, from whole texts and one owner per byte."""
    a, b = libraries
    found, held = [], Counter()
    for i, text in rows:
        links, groups, n = [], [], (0, 0)
        if text:
            body, ids = (" " + text).encode(), (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text))
            parts = [bytes_a(a.id_to_token(x)) for x in ids[0]], [bytes_b(b.id_to_piece(x)) for x in ids[1]]
            if b"".join(parts[0]) == body == b"".join(parts[1]):
                owner = [[k for k, p in enumerate(side) for _ in p] for side in parts]
                links = sorted(set(zip(*owner, strict=True)))
                cuts = [k for k in range(1, len(body)) if all(o[k] != o[k - 1] for o in owner)]
                groups = [tuple([ids[s][k] for k in sorted(set(owner[s][lo:hi]))] for s in (0, 1))
                          for lo, hi in zip([0, *cuts], [*cuts, len(body)], strict=True)]
                n = len(ids[0]), len(ids[1])
                links = [(ids[0][x], ids[1][y]) for x, y in links]
        found.append((i, n, groups, links))
        held.update(set(links))
    best = defaultdict(int)
    for (x, _), n in held.items():
        best[x] = max(best[x], n)
    out = []
    for i, n, groups, links in found:
        line = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        out.append((i, *n, len(groups), len(links), sum(held[x] == best[x[0]] for x in links), sum(held[x] for x in links),
                    hashlib.sha256(line.encode()).hexdigest() if groups else ""))
    return out, held


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
ODD = [None, "", " ", "  ", "a", " a", "a ", "a  b", "▁", "x ▁a", "a▁b c", "\n\n", "x\ty\r\n z", "é\U0001f600一 漢字 かな", "<s> <0x41> <unk> </s>",
       "<|endoftext|> x", "a" * 3000, "\U0001f600" * 200, "a\x00b", "don't we'll it's", "x y z w", "é ́x", "﻿bom", "1 234 5678",
       "漢字" * 300, " \n x", "a \n b", "a\n b", "tab\t x", "x \u0085 y", "x  y", "end. ", "s 's 're", "\x1c x \x1c"]


def key(r):
    return str(r)


def test_rows_equal_brute_force(spark, libraries):
    rng = random.Random(1)
    bits = ["the", "Haus", "naïve", "don't", " ", "  ", "\n", "12", "漢", "é", "_x", "...", "▁", "\U0001f600", "\t", "a" * 20]
    texts = [*ODD, *("".join(rng.choice([*bits, " ", " "]) for _ in range(rng.randint(1, 40))) for _ in range(150))]
    rows = [*enumerate(texts), (1, "again the same"), (1, "again the same"), (None, "no id")]
    df = spark.createDataFrame([(i, t, "x", 5, 6) for i, t in rows], "doc_id long, text string, slice string, pair int, n int")
    docs, links = alignment.aligned(df, keep_groups=True)
    got, (want, held) = docs.collect(), brute(libraries, rows)
    assert sorted((tuple(r[c] for c in COLUMNS) for r in got), key=key) == sorted(want, key=key)
    assert all((hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "") == r.groups_sha256 for r in got)
    assert {(r.a, r.b): r.n for r in links.collect()} == dict(held)


def test_table_equals_brute_force(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "SLICE_BYTES", 1 << 16)  # several slices
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/documents.parquet", columns=["doc_id", "text"]).to_pylist()]
    got = [tuple(r) for r in alignment.op12_alignment(spark, SF).select(*COLUMNS).collect()]
    assert sorted(got, key=key) == sorted(brute(libraries, rows)[0], key=key)


def test_empty_table(spark):
    docs, links = alignment.aligned(spark.createDataFrame([], "doc_id long, text string"))
    assert docs.collect() == [] and links.collect() == []


@pytest.fixture(scope="module")
def own():
    with open(alignment.MODEL_A, "rb") as a, open(alignment.MODEL_B, "rb") as b:
        return alignment.Aligner(alignment.ByteLevel(a.read()), alignment.Pieces(b.read()))


def test_memory_is_bounded(own, monkeypatch):
    """A task that forgets and asks again finds the same."""
    texts = ["one two three " * 5, "漢字 " * 4 + "x" * 500, "four five", "漢" * 900]

    def lines():
        got = own.slice(texts)
        return [[own.text[p] for p in got["places"][lo:hi]] for lo, hi in zip([0, *got["bounds"][:-1]], got["bounds"], strict=True)], got["n_a"].tolist(), got["n_b"].tolist()

    first = lines()
    assert lines() == first
    monkeypatch.setattr(alignment, "REMEMBERED", 0)
    monkeypatch.setattr(alignment, "LONGEST", 3)
    monkeypatch.setattr(alignment, "LOOKED_UP", 2)
    assert lines() == first and lines() == first
    own.split = False
    own.forget()
    try:
        assert [";".join(x) for x in lines()[0]] == [";".join(x) for x in first[0]]
    finally:
        own.split = True
        own.forget()


def test_links_follow_from_the_ends(own):
    """As many links as tokens less shared ends; windows worked out together are those worked out alone."""
    texts = [t for t in ODD if t] + ["the quick brown fox, naïve 漢字 12.5"]
    alone = []
    for t in texts:
        own.forget()
        got = own.slice([t])
        links = [np.frombuffer(own.links[p], "<i8") for p in got["places"]]
        groups = sum(own.n_groups[p] for p in got["places"])
        assert sum(map(len, links)) == got["n_a"].sum() + got["n_b"].sum() - groups and all(len(set(x.tolist())) <= len(x) for x in links)
        alone.append([own.text[p] for p in got["places"]])
    own.forget()
    got = own.slice(texts)
    assert [[own.text[p] for p in got["places"][lo:hi]] for lo, hi in zip([0, *got["bounds"][:-1]], got["bounds"], strict=True)] == alone


def test_units_by_rank_equal_the_library(own, libraries):
    assert own.a.ranks is not None
    rng = random.Random(3)
    units = [" " + "".join(rng.choices("abcdeéñüß'ſ0123.,-ÀÿŸ¿ tshrelm", k=rng.randint(1, 25))) for _ in range(3000)]
    assert own.a.encode(units) == [e.ids for e in libraries[0].encode_batch(units, add_special_tokens=False)]
