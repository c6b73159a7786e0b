"""Counts against the tokenizer library's own unigram model."""
import random

import pyarrow.parquet as pq
import pytest
from tokenizers import Tokenizer, models, pre_tokenizers

from riskgraph.llm import tokens

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def vocabulary():
    return tokens.load_vocabulary()


def library(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always", split=True)
    return t


def test_counts_equal_the_library_on_the_table(vocabulary):
    lib, own = library(vocabulary), tokens.Counter(vocabulary)
    for t in pq.read_table(f"{SF}/documents.parquet")["text"].to_pylist():
        assert own.text(t)[1] == len(lib.encode(t, add_special_tokens=False).ids)


@pytest.mark.parametrize("text", ["", " ", "  ", "a", " a", "a ", "a  b", "▁", "▁a▁▁b", "\n\n", "x\ty\r\n", "é\U0001f600一",
                                  "<s> <0x41> <unk>", "a" * 5000, "\U0001f600" * 300])
def test_odd_texts(vocabulary, text):
    lib, own = library(vocabulary), tokens.Counter(vocabulary)
    assert own.text(text)[1] == len(lib.encode(text, add_special_tokens=False).ids)


def test_ties_follow_the_library():
    rng = random.Random(1)
    for _ in range(200):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 14))}
        vocab = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *((p, -float(rng.randint(1, 3))) for p in sorted(pieces))]
        lib, own = library(vocab), tokens.Counter(vocab)
        for _ in range(20):
            text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 14)))
            assert own.text(text)[1] == len(lib.encode(text, add_special_tokens=False).ids), (text, vocab[257:])


def test_rows(spark, vocabulary):
    rows = [(1, None, "x"), (2, "", "x"), (3, "the end", None), (3, "the end", "y"), (None, "the", "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = sorted(tokens.count_tokens(df, vocabulary).collect(), key=str)
    assert len(got) == 5
    n = {t: len(library(vocabulary).encode(t).ids) for t in ("", "the end", "the")}
    assert {(r.doc_id, r.n_tokens) for r in got} == {(1, 0), (2, 0), (3, n["the end"]), (None, n["the"])}
    assert tokens.count_tokens(df.limit(0), vocabulary).collect() == []


def test_cache_bound(vocabulary, monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_WORDS", 3)
    own = tokens.Counter(vocabulary)
    text = "one two three four five six one"
    assert own.text(text)[1] == len(library(vocabulary).encode(text, add_special_tokens=False).ids)


def whole(vocabulary):
    t = Tokenizer(models.Unigram(vocabulary, 0, True))
    t.pre_tokenizer = pre_tokenizers.Metaspace(replacement=tokens.MARK, prepend_scheme="always", split=False)
    return t


def test_runs_of_spaces(spark, vocabulary):
    """Pieces of several marks match: rows as the library counts the text without a split."""
    rng = random.Random(3)
    texts = ["a" + " " * 16 + "a", "def f():\n        return 1", " ", "  ", "   a", "a   ", "a  b", "▁▁a ▁b", " " * 40, "\n    x = 1\n\n    y",
             *("".join(rng.choice(["a", "the", "\n", " ", "  ", " " * 7]) for _ in range(30)) for _ in range(40))]
    lib = whole(vocabulary)
    got = {r.doc_id: r.n_tokens for r in tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), vocabulary).collect()}
    want = {i: len(lib.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}
    assert got == want
    assert want[0] == 3


def test_pieces_across_words_without_split():
    rng = random.Random(2)
    for _ in range(100):
        pieces = {"".join(rng.choice("abc▁") for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(2, 14))}
        vocab = [("<unk>", 0.0), *((f"<0x{i:02X}>", 0.0) for i in range(256)), *((p, -float(rng.randint(1, 3))) for p in sorted(pieces))]
        lib, own = whole(vocab), tokens.Counter(vocab, split=False)
        for _ in range(20):
            text = "".join(rng.choice("abc ") for _ in range(rng.randint(0, 14)))
            assert own.text(text)[1] == len(lib.encode(text, add_special_tokens=False).ids), (text, vocab[257:])


def test_one_pass_over_matches_equals_trying_all_pieces():
    """Ties, characters that are no piece and pieces of several marks: against every piece tried at every place. A word is
    worked out once, and its two counts are kept as one number."""
    import random

    from riskgraph.llm.tokens import MARK, SHIFT, UNKNOWN_PENALTY, Counter

    def plain(word, voc, unknown):
        best = [(0.0, 0, 0)]
        for end in range(1, len(word) + 1):
            top = None
            for start in range(end):
                if (score := voc.get(word[start:end])) is not None:
                    s, n, f = best[start]
                    if top is None or s + score > top[0]:
                        top = (s + score, n + 1, f)
            if word[end - 1] not in voc:
                s, n, f = best[end - 1]
                if top is None or s + unknown > top[0]:
                    top = (s + unknown, n + len(word[end - 1].encode()), f + 1)
            best.append(top)
        return best[-1][1:]

    rnd = random.Random(5)
    for _ in range(300):
        voc = {"".join(rnd.choice("ab" + MARK + "é") for _ in range(rnd.randint(1, 4))): -float(rnd.randint(0, 4)) for _ in range(rnd.randint(1, 10))}
        counter, unknown = Counter(list(voc.items())), min(voc.values()) - UNKNOWN_PENALTY
        words = [MARK + "".join(rnd.choice("abéc") for _ in range(rnd.randint(1, 9))) for _ in range(8)]
        want = [plain(w, voc, unknown) for w in words]
        assert [counter.word(w) for w in words] == want
        text = " ".join(w[1:] for w in words + words)
        assert counter.text(text)[1:] == tuple(2 * sum(x) for x in zip(*want, strict=True))
        assert dict(counter.words) == {w[1:]: n + (f << SHIFT) for w, (n, f) in zip(words, want, strict=True)}
