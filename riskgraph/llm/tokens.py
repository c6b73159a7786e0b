"""Operator 9: count-only Viterbi over a unigram vocabulary.

The number of tokens of a text under a unigram tokenizer, without making the tokens. An Aho-Corasick automaton over
the vocabulary gives every piece that ends at a position; the best way to reach that position carries its score and
its number of tokens only. Text is cut where a space follows another character, since no piece crosses that place: a
run of spaces, whose marks are pieces of several marks, stays with the word that follows, and such a unit costs one
pass the first time a task meets it. With a vocabulary that has a piece across such a place, a text is not cut.

Rules of the tokenizer that decide counts, and that ties depend on:
- a path replaces another only if its score is higher. Paths to a position are tried by where their last piece
  starts, from the left, so at equal scores the longest last piece stays;
- a character that is no piece by itself can be taken alone, at the lowest score of the vocabulary less 10;
- such a character then counts as one token for each byte of its UTF-8 form.
Scores are whole numbers here, or in any case double precision, added from the left.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import chain

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .base import record_batch, slices, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
UNKNOWN_PENALTY = 10.0
#: Words that a task remembers; beyond that it starts over, which costs time only.
CACHE_WORDS = 1 << 20

SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_tokens", pa.int64()), ("n_fallback", pa.int64())])
DDL = "doc_id long, n_words long, n_tokens long, n_fallback long"


def load_vocabulary(path: str = VOCABULARY) -> list[tuple[str, float]]:
    """(piece, score) of a SentencePiece model file, taken as a unigram vocabulary."""
    from sentencepiece import sentencepiece_model_pb2

    model = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        model.ParseFromString(f.read())
    return [(p.piece, float(p.score)) for p in model.pieces]


#: Two counts in one number: tokens, and from this bit on the characters that are no piece.
SHIFT = 40


class Known(dict):
    """What is known of each word; a word that is not there is worked out."""

    def __init__(self, work: Callable[[str], int]) -> None:
        super().__init__()
        self.work = work

    def __missing__(self, word: str) -> int:
        if len(self) >= CACHE_WORDS:
            self.clear()
        got = self[word] = self.work(word)
        return got


class Counter:
    """Counts the tokens of texts; keeps what it found for each word. With ``split``, text is split before each space,
    so that no piece has a mark but at its start."""

    def __init__(self, vocabulary: list[tuple[str, float]], split: bool = True) -> None:
        self.split = split
        self.crossed = any(re.search(f"[^{MARK}]{MARK}", piece) for piece, _ in vocabulary)
        self.automaton = ahocorasick.Automaton()
        for piece, score in vocabulary:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in vocabulary) - UNKNOWN_PENALTY
        self.words = Known(lambda w: self.packed(MARK + w.replace(" ", MARK)))

    def packed(self, word: str) -> int:
        """Tokens and characters that are no piece, in one number, of one word with its mark."""
        unknown, last = self.unknown, len(word)
        best, count = [0.0], [0]
        at, top, size, found, alone = 0, 0.0, 0, 0, False  # of the pieces that end at ``at``: the best so far; is one a character
        for end, (n, score) in chain(self.automaton.iter(word), [(last, (0, 0.0))]):
            while at < end:
                if not alone:
                    score_unknown = best[at] + unknown
                    if not size or score_unknown > top:
                        top, found = score_unknown, count[at] + len(word[at].encode("utf-8")) + (1 << SHIFT)
                best.append(top)
                count.append(found)
                at, size, alone = at + 1, 0, False
            if n:
                score += best[end + 1 - n]
                if not size or score > top or (score == top and n > size):  # of equal scores the leftmost start
                    top, size, found = score, n, count[end + 1 - n] + 1
                if n == 1:
                    alone = True
        return count[-1]

    def word(self, word: str) -> tuple[int, int]:
        """(tokens, characters that are no piece) of one word with its mark."""
        fallback, tokens = divmod(self.packed(word), 1 << SHIFT)
        return tokens, fallback

    def text(self, text: str) -> tuple[int, int, int]:
        """(words, tokens, characters that are no piece)."""
        if not text:
            return 0, 0, 0
        spaced = text.replace(MARK, " ")
        if spaced[0] != " ":  # a mark at the start is the first word's own
            spaced = " " + spaced
        n_words = spaced.count(" ")
        if not self.split and self.crossed:
            return n_words, *self.word(spaced.replace(" ", MARK))
        words = spaced[1:].split(" ") if self.split or "  " not in spaced else re.findall(" ( *[^ ]*)", spaced)
        fallback, tokens = divmod(sum(map(self.words.__getitem__, words)), 1 << SHIFT)
        return n_words, tokens, fallback


def count_tokens(docs: DataFrame, vocabulary: list[tuple[str, float]], text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_tokens, n_fallback.

    Null or empty text: zeros. Each text is counted alone and whole, runs of spaces as the pieces that they are; repeated rows and ties give equal rows, other
    columns are not read. The vocabulary, whose size does not depend on the corpus, is broadcast."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value, split=False)
        for batch, texts in slices(batches, "text"):
            rows = [counter.text(t.decode("utf-8", "replace")) for t in texts]
            words, tokens, fallback = zip(*rows, strict=True)
            yield record_batch(SCHEMA, {"doc_id": batch.column(0), "n_words": words, "n_tokens": tokens, "n_fallback": fallback})

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")).mapInArrow(run, DDL)


def op9_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), load_vocabulary())
