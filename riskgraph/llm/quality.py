"""Operator 5: quality rules by compression bands.

zstandard shrinks ordinary prose by a factor that depends little on its content but much on its length. Text that
repeats itself shrinks far more, text without structure (encoded bytes, random characters) hardly at all. The whole
document and each of its fixed chunks are compressed on their own; each ratio must lie in the band of its length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .base import record_batch, slices

LEVEL = 3
CHUNK_BYTES = 2048
#: (bytes from, lowest ratio, highest ratio). A frame costs about 13 bytes, so the shortest texts have no lower limit.
#: Base64 of random bytes has 1.3; prose starts at 1.35 in 250 bytes, 1.5 in 500, 1.7 in 1000.
DOCUMENT_BANDS = ((0, 0.0, 2.5), (250, 1.05, 2.5), (500, 1.2, 2.75), (1000, 1.4, 3.0), (4000, 1.45, 3.5), (32_000, 1.45, 4.0))
#: For chunks; a last chunk of under half the size is left out unless it is the only one.
CHUNK_BANDS = ((0, 0.0, 2.5), (250, 1.05, 2.5), (500, 1.2, 2.75), (1000, 1.4, 3.0))
#: A document goes when more than this share of its chunks is outside the band.
BAD_CHUNK_SHARE = 0.25
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 20, 30, 8
SYMBOLS = b"#*$%&|<>"

SCHEMA = pa.schema([
    ("doc_id", pa.int64()), ("n_words", pa.int64()), ("word_chars", pa.int64()), ("n_symbols", pa.int64()),
    ("n_dup_lines", pa.int64()), ("n_repeat_words", pa.int64()), ("base_failed", pa.bool_()), ("kept", pa.bool_()),
    ("ratio", pa.float64()), ("n_chunks", pa.int64()), ("n_bad_chunks", pa.int64())])
DDL = ("doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
       "base_failed boolean, kept boolean, ratio double, n_chunks long, n_bad_chunks long")


def in_band(n_bytes: int, ratio: float, bands) -> bool:
    low, high = next((lo, hi) for at, lo, hi in reversed(bands) if n_bytes >= at)
    return low <= ratio <= high


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Number of words in windows of ``window`` words that occur at least twice, the first occurrence included."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]).tolist()
    starts = [0, *ends[:-1]]
    pieces = [joined[s:e - 1] for s, e in zip(starts[:n], ends[window - 1:], strict=True)]
    if len(set(pieces)) == n:
        return 0
    counts = Counter(pieces)
    at = np.fromiter((i for i, p in enumerate(pieces) if counts[p] > 1), dtype=np.int64)
    edges = np.zeros(len(words) + 1, dtype=np.int64)
    np.add.at(edges, at, 1)
    np.add.at(edges, at + window, -1)
    return int((np.cumsum(edges[:-1]) > 0).sum())


def duplicate_lines(text: bytes) -> int:
    lines = [x for x in text.split(b"\n") if x.split(None, 1)]
    return len(lines) - len(set(lines))


def compression(text: bytes, z: zstandard.ZstdCompressor) -> tuple[float, int, int, bool]:
    """Ratio of the whole, number of chunks, of those outside their band, and the verdict. Empty text: kept is false."""
    if not text:
        return 0.0, 0, 0, False
    ratio = len(text) / len(z.compress(text))
    chunks = [text[i:i + CHUNK_BYTES] for i in range(0, len(text), CHUNK_BYTES)]
    if len(chunks) > 1 and 2 * len(chunks[-1]) < CHUNK_BYTES:
        chunks.pop()
    bad = (sum(not in_band(len(c), len(c) / len(z.compress(c)), CHUNK_BANDS) for c in chunks)
           if len(chunks) > 1 else int(not in_band(len(text), ratio, CHUNK_BANDS)))
    ok = in_band(len(text), ratio, DOCUMENT_BANDS) and bad <= BAD_CHUNK_SHARE * len(chunks)
    return ratio, len(chunks), bad, ok


def judge(text: bytes, z: zstandard.ZstdCompressor) -> tuple:
    words = text.split()
    n_chars = len(b"".join(words).decode("utf-8", "replace"))
    repeat = repeated_words(words)
    failed = len(words) < MIN_WORDS or 100 * repeat > MAX_REPEAT_PERCENT * len(words)
    ratio, n, bad, ok = compression(text, z)
    symbols = sum(text.count(s) for s in SYMBOLS)
    return len(words), n_chars, symbols, duplicate_lines(text), repeat, failed, ok and not failed, ratio, n, bad


def quality_rules(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs`` with its counts and verdict (columns of ``DDL``).

    Each document is judged alone, so ties, repeated rows and other columns change nothing. Null or empty text: all
    counts 0, base_failed true, kept false. A null id stays null. Long texts are judged whole, chunk by chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        for batch, texts in slices(batches, "text"):
            rows = [judge(t, z) for t in texts]
            cols = dict(zip(SCHEMA.names[1:], map(list, zip(*rows)), strict=True))
            yield record_batch(SCHEMA, {"doc_id": batch.column(0), **cols})

    narrow = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    return narrow.mapInArrow(run, DDL)


def quality_filter(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, with the columns of ``docs``: the same judgement in one pass over
    the rows, without a join back."""
    schema = docs.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=LEVEL, write_checksum=False)
        for batch, texts in slices(batches, "text"):
            keep = [judge(t, z)[6] for t in texts]
            yield batch.filter(pa.array(keep, type=pa.bool_()))

    return docs.mapInArrow(run, schema)


def op5_quality(spark, sf_dir: str) -> DataFrame:
    return quality_rules(spark.read.parquet(f"{sf_dir}/documents.parquet"))
