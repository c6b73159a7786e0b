"""Operator 11: removal of every copy of repeated passages, found by fixed blocks.

A word goes when some window of 35 words that covers it also starts anywhere else, in this or another document.

1. *Index.* The words of each document are cut into blocks of 18 that do not overlap. Each window of 35 words has one
   such block wholly inside, wherever it starts.
2. *Probe.* Every run of 18 words of every document, at every start, probes the index by its hash. A block that
   another run of the corpus equals is an *anchor*. A document needs only its own anchors: each occurrence of a
   repeated window holds a block of its own document, which the other occurrence's runs meet. So a probe is no more
   than a hash, and a task sends its distinct ones in order, as differences: about 3 bytes a word.
3. *Extend.* An anchor grows by 17 words, to the left and right in each of the 18 ways, and grown windows that are
   equal (96 bits of hash over their words) are exact repeats. Repeats that follow each other merge to maximal ones:
   both occurrences of a passage are anchored block by block, so nothing between is missed.
4. Repeats are joined back to the documents, which lose the words that they cover.

Hot passages: a task sends equal probes or windows once for all of its documents, and blocks or windows that it holds
twice itself are settled before the shuffle. A passage in a third of the corpus is then one row per task in one
bucket, and buckets are of even size.

Documents are numbered and written once, bucketed by that number; lists are joined to them in place.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from ..sources.io import cut, cut_bucketed
from .base import slices, table, total
from .suffix import _POWERS, _mixed, _prefix_hash

#: Words of a window, words of a block: a window holds a whole block if it has at least 2 * 18 - 1 words.
WINDOW, BLOCK = 35, 18
#: Bytes of text hashed at once; bytes of text, or windows, that a task gathers before it sends.
PIECE, BATCH, WINDOWS = 1 << 20, 8 << 20, 1 << 20
#: Average bytes of text behind a bucket of probes, windows in a bucket, bytes of text in a bucket of documents.
PROBE_BUCKET, WINDOW_BUCKET, DOC_BUCKET = 16 << 20, 1 << 20, 64 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_OTHER = np.uint64(0x5851F42D4C957F2D)
_MSG = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
_MSG_DDL = "bucket int, data binary"
_RUNS = pa.schema([("row", pa.int64()), ("start", pa.int64()), ("n", pa.int64())])
_RUNS_DDL = "row long, start long, n long"


# ---- words and hashes -------------------------------------------------------------------------------------------

def parts(text: bytes, overlap: int) -> Iterator[tuple[bytes, int]]:
    """``text`` in pieces of whole words with the number of each piece's first word; a piece starts with the last
    ``overlap`` words of the one before."""
    at = first = 0
    size = PIECE
    while len(text) - at > size:
        space = _SPACE[np.frombuffer(text, np.uint8, size, at)]
        stops = np.flatnonzero(space)
        end = int(stops[-1]) if len(stops) else 0
        inside = ~space[:end]
        starts = np.flatnonzero(inside & np.concatenate([[True], space[:end]])[:end])
        if len(starts) <= overlap:  # words as long as a piece
            size *= 2
            continue
        yield text[at:at + end], first
        first += len(starts) - overlap
        at += int(starts[-overlap]) if overlap else end
        size = PIECE
    yield text[at:], first


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all ``texts`` in order, and the number of words of each."""
    buf = np.frombuffer(b"\n".join([*texts, b""]), dtype=np.uint8)
    space = _SPACE[buf]
    turn = np.flatnonzero(np.diff(space, prepend=True))
    starts, ends = turn[::2], turn[1::2]  # the last byte is a space
    s = _prefix_hash(buf)
    _, down = _POWERS.to(len(buf) + 1)
    words = _mixed((s[ends] - s[starts]) * down[starts] + (ends - starts).astype(np.uint64))
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return words, np.diff(np.searchsorted(starts, bounds), prepend=0)


def run_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of the ``k`` words from each position on."""
    if len(words) < k:
        return np.empty(0, dtype=np.uint64)
    up, down = _POWERS.to(len(words) + 1)
    s = np.zeros(len(words) + 1, dtype=np.uint64)
    np.cumsum(words * up[:-1], out=s[1:])
    return _mixed((s[k:] - s[:-k]) * down[:len(words) - k + 1])


# ---- messages ---------------------------------------------------------------------------------------------------

def _planes(x: np.ndarray) -> bytes:
    """Whole numbers as byte planes, as many as the largest needs."""
    x = np.ascontiguousarray(x, dtype="<u8")
    width = (int(x.max()).bit_length() + 7) // 8 if len(x) else 0
    return len(x).to_bytes(4, "little") + bytes([width]) + x.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes()


def pack(*arrays: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(map(_planes, arrays)))


def unpack(data: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.ZstdDecompressor().decompress(data), 0, []
    while at < len(data):
        n, width = int.from_bytes(data[at:at + 4], "little"), data[at + 4]
        x = np.zeros((n, 8), dtype=np.uint8)
        x[:, :width] = np.frombuffer(data, np.uint8, n * width, at + 5).reshape(width, n).T
        out.append(x.view("<u8").reshape(n))
        at += 5 + n * width
    return out


def _steps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers."""
    return np.diff(x.astype(np.uint64), prepend=np.uint64(0))


def _sums(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.uint64)


def _messages(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], schema=_MSG)


def _runs(row: np.ndarray, start: np.ndarray) -> pa.Table:
    """(row, start, n): neighbouring starts of a row as one."""
    order = np.lexsort((start, row))
    row, start = row[order].astype(np.int64), start[order].astype(np.int64)
    new = np.ones(len(row), dtype=bool)
    new[1:] = (row[1:] != row[:-1]) | (start[1:] != start[:-1] + 1)
    at = np.flatnonzero(new)
    return pa.table([pa.array(row[at]), pa.array(start[at]), pa.array(np.diff(np.append(at, len(row))))], schema=_RUNS)


# ---- index and probes -------------------------------------------------------------------------------------------

def _probes(pieces: list[tuple[bytes, int, int, bool]], bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of pieces (text, row, first word, of a longer text): hashes of all runs; hashes, rows and positions of the
    blocks. Texts with fewer words than a window have neither."""
    words, counts = word_hashes([p[0] for p in pieces])
    h = run_hashes(words, BLOCK) >> np.uint64(64 - bits)
    offsets = np.cumsum(counts) - counts
    wide = (counts >= WINDOW) | np.array([p[3] for p in pieces])
    piece = np.repeat(np.arange(len(pieces)), counts)[:len(h)]
    local = np.arange(len(h)) - offsets[piece]
    inside = wide[piece] & (local + BLOCK <= counts[piece])
    pos = local + np.array([p[2] for p in pieces], dtype=np.int64)[piece]
    block = inside & (pos % BLOCK == 0)
    return h[inside], h[block], np.array([p[1] for p in pieces], dtype=np.int64)[piece[block]], pos[block]


def _send_probes(found: list[tuple], bits: int, buckets: int) -> pa.RecordBatch:
    h, bh, row, pos = (np.concatenate(x) for x in zip(*found, strict=True))
    probes, times = np.unique(h, return_counts=True)
    at = np.searchsorted(probes, bh)
    known = times[at] > 1  # met by another run of this task
    order = np.flatnonzero(~known)
    order = order[np.lexsort((pos[order], row[order], at[order]))]
    at, b_row, b_pos = at[order], row[order], pos[order]
    edges = [((b << bits) + buckets - 1) // buckets for b in range(1, buckets)]  # first hash of each bucket but 0
    cuts = [0, *np.searchsorted(probes, np.array(edges, dtype=np.uint64)).tolist(), len(probes)]
    inner = np.searchsorted(at, cuts).tolist()
    # the settled ones ride along with any one message
    rider = int(_mixed(np.array([len(probes) + int(row[0] if len(row) else 0)], dtype=np.uint64))[0] % np.uint64(buckets))
    rows, none = [], np.empty(0, np.int64)
    for b in range(buckets):
        lo, hi, p, q = cuts[b], cuts[b + 1], inner[b], inner[b + 1]
        settled = (row[known], pos[known] // BLOCK) if b == rider else (none, none)
        if lo < hi or len(settled[0]):
            rows.append((b, pack(_steps(probes[lo:hi]), _steps(at[p:q] - lo), b_row[p:q], b_pos[p:q] // BLOCK, *settled)))
    return _messages(rows)


def _anchors(group: pa.Table) -> pa.Table:
    """Blocks of one bucket whose hash comes from two tasks' messages or more, and those settled before."""
    probes, blocks, rows, poss, done = [], [], [], [], [(np.empty(0, np.uint64),) * 2]
    for data in group["data"].to_pylist():
        steps, at, row, pos, known_row, known_pos = unpack(data)
        p = _sums(steps)
        probes.append(p)
        blocks.append(p[_sums(at).astype(np.int64)])
        rows.append(row)
        poss.append(pos)
        done.append((known_row, known_pos))
    values, times = np.unique(np.concatenate(probes), return_counts=True)
    twice = values[times > 1]
    bh, at = np.concatenate(blocks), np.empty(0, np.int64)
    if len(twice):
        at = np.flatnonzero(twice[np.minimum(np.searchsorted(twice, bh), len(twice) - 1)] == bh)
    row = np.concatenate([np.concatenate(rows)[at], *(r for r, _ in done)])
    pos = np.concatenate([np.concatenate(poss)[at], *(p for _, p in done)])
    return _runs(row, pos)


def anchors(numbered: DataFrame, size: int) -> DataFrame:
    """(row, start, n): runs of block numbers of each document whose words another run of the corpus equals."""
    buckets = max(1, math.ceil(size / PROBE_BUCKET))
    bits = min(64, max(40, size.bit_length() + 10))  # a chance meeting, one block in some hundred, only costs time

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, pieces, n = [], 0, [], 0
        for batch, texts in slices(batches, "text", PIECE):
            for row, text in zip(batch.column(0).to_pylist(), texts, strict=True):
                long = len(text) > PIECE
                for body, first in parts(text, BLOCK - 1):
                    pieces.append((body, row, first, long))
                    n += len(body)
                    if n >= PIECE:
                        found.append(_probes(pieces, bits))
                        held, pieces, n = held + n, [], 0
                    if held >= BATCH:
                        yield _send_probes(found, bits, buckets)
                        found, held = [], 0
        if pieces:
            found.append(_probes(pieces, bits))
        if found:
            yield _send_probes(found, bits, buckets)

    return numbered.select("row", "text").mapInArrow(send, _MSG_DDL).groupBy("bucket").applyInArrow(_anchors, _RUNS_DDL)


# ---- extension --------------------------------------------------------------------------------------------------

def _grown(blocks: list[tuple[int, int]]) -> np.ndarray:
    """Starts of the windows that hold one of the blocks, given as runs of block numbers."""
    out = [np.arange(max(0, a * BLOCK - (WINDOW - BLOCK)), (a + n - 1) * BLOCK + 1) for a, n in blocks]
    return np.unique(np.concatenate(out))


def _least(h: np.ndarray, n: int) -> np.ndarray:
    """Least of the ``n`` hashes from each position on."""
    step = 1
    while 2 * step <= n:
        h, step = np.minimum(h[:-step], h[step:]), 2 * step
    return np.minimum(h[:len(h) - (n - step)], h[n - step:]) if step < n else h


def _windows(pieces: list[tuple[bytes, int, int, np.ndarray]]) -> tuple[np.ndarray, ...]:
    """Of pieces (text, row, first word, wanted starts): key of the bucket, both hashes, row and start of each window.
    Equal windows have equal keys, and neighbours mostly share one, so that they come out of a bucket as one run."""
    words, counts = word_hashes([p[0] for p in pieces])
    key = _mixed(_least(run_hashes(words, BLOCK), WINDOW - BLOCK + 1)) if len(words) >= WINDOW else np.empty(0, np.uint64)
    h, other = run_hashes(words, WINDOW), run_hashes(_mixed(words ^ _OTHER), WINDOW) >> np.uint64(32)
    places, rows, starts = [], [], []
    for offset, n, (_, row, first, want) in zip(np.cumsum(counts) - counts, counts, pieces, strict=True):
        want = want[np.searchsorted(want, first):np.searchsorted(want, first + n - WINDOW, side="right")]
        places.append(offset + want - first)
        rows.append(np.full(len(want), row, dtype=np.int64))
        starts.append(want)
    at = np.concatenate(places).astype(np.int64)
    return key[at], h[at], other[at], np.concatenate(rows), np.concatenate(starts)


def _send_windows(found: list[tuple], buckets: int) -> pa.RecordBatch | None:
    key, h, other, row, start = (np.concatenate(x) for x in zip(*found, strict=True))
    if not len(h):
        return None
    order = np.lexsort((start, row, other, h))
    key, h, other, row, start = (x[order] for x in (key, h, other, row, start))
    new = np.ones(len(h), dtype=bool)
    new[1:] = (h[1:] != h[:-1]) | (other[1:] != other[:-1])
    first = np.flatnonzero(new)
    several = np.diff(np.append(first, len(h))) > 1
    known = np.repeat(several, np.diff(np.append(first, len(h))))
    settled = _runs(row[known], start[known])
    bucket = ((key[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((start[first], row[first], bucket))
    rider, rows, none = int(bucket[0]), [], np.empty(0, np.int64)
    for at in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1):
        b, w = int(bucket[at[0]]), first[at]
        done = [np.asarray(settled[c]) for c in ("row", "start", "n")] if b == rider else [none] * 3
        rows.append((b, pack(h[w], other[w], _steps(row[w]), start[w], several[at], *done)))
    return _messages(rows)


def _repeats(group: pa.Table) -> pa.Table:
    """Windows of one bucket that come from two tasks' messages or more, and those settled before."""
    met, done = [], []
    for data in group["data"].to_pylist():
        h, other, row, start, several, *settled = unpack(data)
        met.append((h, other, _sums(row), start, several))
        done.append(pa.table([pa.array(x.astype(np.int64)) for x in settled], schema=_RUNS))
    h, other, row, start, several = (np.concatenate(x) for x in zip(*met, strict=True))
    order = np.lexsort((other, h))
    same = (h[order][1:] == h[order][:-1]) & (other[order][1:] == other[order][:-1])
    twice = np.zeros(len(h), dtype=bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice & (several == 0))
    return pa.concat_tables([_runs(row[at], start[at]), *done])


def _listed(runs: DataFrame) -> DataFrame:
    return runs.groupBy(F.col("row").alias("__row")).agg(F.collect_list(F.struct("start", "n")).alias("runs"))


def repeats(numbered: DataFrame, anchored: DataFrame) -> DataFrame:
    """(row, start, n): runs of window starts whose words are found elsewhere too."""
    buckets = max(1, math.ceil(total(anchored, F.col("n")) * BLOCK / WINDOW_BUCKET))
    lists = _listed(anchored).hint("shuffle_hash")
    rows = numbered.join(lists, F.col("row") == F.col("__row")).select("row", "text", "runs")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, held, pieces, n = [], 0, [], 0
        for batch, texts in slices(batches, "text", PIECE):
            for row, text, runs in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                want = _grown([(r["start"], r["n"]) for r in runs])
                for body, first in parts(text, WINDOW - 1):
                    pieces.append((body, row, first, want))
                    n += len(body)
                    if n >= PIECE:
                        found.append(_windows(pieces))
                        held, pieces, n = held + len(found[-1][0]), [], 0
                    if held >= WINDOWS:
                        if (out := _send_windows(found, buckets)) is not None:
                            yield out
                        found, held = [], 0
        if pieces:
            found.append(_windows(pieces))
        if found and (out := _send_windows(found, buckets)) is not None:
            yield out

    return rows.mapInArrow(send, _MSG_DDL).groupBy("bucket").applyInArrow(_repeats, _RUNS_DDL)


# ---- result -----------------------------------------------------------------------------------------------------

_SPAN = pa.struct([("start", pa.int64()), ("end", pa.int64())])
_RESULT = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()),
                     ("spans", pa.list_(_SPAN)), ("kept", pa.binary())])
_RESULT_DDL = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start:long,end:long>>, kept binary"


def spans(runs: list[dict] | None) -> list[tuple[int, int]]:
    """Maximal runs of words (end exclusive) that the windows cover."""
    out: list[list[int]] = []
    for a, b in sorted((r["start"], r["start"] + r["n"] - 1 + WINDOW) for r in runs or ()):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _kept(text: bytes, gone: list[tuple[int, int]]) -> Iterator[tuple[int, bytes]]:
    """Number of words and the words that stay, joined by spaces, of each piece of a text."""
    for body, first in parts(text, 0):
        words = body.split()
        if gone:
            edges = [0, *(min(max(x - first, 0), len(words)) for s in gone for x in s), len(words)]
            yield len(words), b" ".join([w for a, b in zip(edges[::2], edges[1::2], strict=True) for w in words[a:b]])
        else:
            yield len(words), b" ".join(words)


def remove_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space),
    spans of removed words (end exclusive) and kept (the kept words; null without ``keep_text``).

    Null text has no words; a text of fewer than 35 words stays whole. Each row is a document: rows that repeat an id
    or a whole row, and rows without an id, are copies of each other like any other. All copies go, the first too.
    Long texts are handled whole, in pieces that overlap. Other columns are not read, whatever their names. An empty
    table gives an empty result."""
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary").alias("text"))
    size = total(rows, F.octet_length("text"))
    # with fewer buckets than shuffle partitions Spark would shuffle the texts again for each join
    buckets = max(shuffle_partitions(docs.sparkSession), math.ceil(size / DOC_BUCKET))
    numbered = cut_bucketed(rows.withColumn("row", F.monotonically_increasing_id()), "anchors-documents", "row", buckets)
    anchored = cut(anchors(numbered, size), "anchors-blocks")
    repeated = cut(repeats(numbered, anchored), "anchors-repeats")

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            out = []
            for i, body, runs in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                gone = spans(runs)
                digest, n, kept = hashlib.sha256(), 0, []
                for k, some in _kept(body, gone):
                    n += k
                    if some:
                        digest.update(b" " + some if kept else some)
                        kept.append(some if keep_text else b"")
                out.append((i, n, sum(b - a for a, b in gone), digest.hexdigest(), [{"start": a, "end": b} for a, b in gone],
                            b" ".join(kept) if keep_text else None))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), _RESULT, strict=True)], schema=_RESULT)

    joined = numbered.join(_listed(repeated).hint("shuffle_hash"), F.col("row") == F.col("__row"), "left")
    return joined.select("doc_id", "text", "runs").mapInArrow(finish, _RESULT_DDL)


def op11_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_copies(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_words", "n_removed", "kept_sha256")
