"""Operator 1: removal of repeated byte strings by suffix order and longest previous factors.

A byte of a document goes when some 100-byte string that covers it also starts earlier: in a document with a smaller
id, or earlier in the same one. The first occurrence stays. That is a question about the longest previous factor of
each position: is it 100 or more? The factor follows from the suffix order, where the nearest smaller positions
before and after a suffix are the earlier texts that agree with it longest.

One suffix array of all text would not fit anywhere, so equal strings are first brought together:

1. A 100-byte window is named by the least hash of the 32-byte strings in it (its minimizer). Equal windows have
   equal minimizers. Neighbouring windows mostly share one; such a *run* of up to 69 windows is one row: minimizer,
   hash of the run's bytes, document, position. Text of average kind has one run per 35 bytes.
2. Runs meet by minimizer. Of runs with equal bytes all but the first are removed whole. Where a minimizer has a
   single text, nothing else can match it.
3. The first runs of minimizers with several texts are fetched as bytes. They get a suffix array up to depth 100 (ranks
   by doubling, ties by position); the previous and next smaller positions in suffix order and the common lengths with
   them make the array of longest previous factors, and windows whose factor reaches 100 go.
4. Removed windows are joined back to their documents and merged into spans.

A minimizer with more than ``HOT`` texts, say in a line that a third of the corpus holds, would put too many bytes
into one task; its windows are scattered by the hash of the whole window instead and meet by that, as runs of one.
A task keeps one row per text of a run, so copies cost little before the shuffle.
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

from ..sources.io import cut
from .base import ranked, slices, table, total

LENGTH, K = 100, 32
W = LENGTH - K + 1
#: Bytes hashed at once, bytes whose runs are sorted at once, average bytes of text behind a bucket of runs.
PIECE, BATCH, BUCKET = 1 << 20, 8 << 20, 8 << 20
#: Texts of one minimizer above which its windows are scattered.
HOT = 20_000
#: Bytes of run text in a task of step 3, on average.
FETCH = 1 << 20
_rng = np.random.Generator(np.random.PCG64(20240229))
_BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
#: A run: bucket key (minimizer, or hash of a window), hash of its text, document, tie, position, number of windows.
RUN = np.dtype([("key", "<u8"), ("text", "<u8"), ("doc", "<i8"), ("tie", "<u8"), ("pos", "<u4"), ("n", "u1")])
_MSG = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
_MSG_DDL = "bucket int, data binary"
_OUT = pa.schema([("kind", pa.int32()), ("doc", pa.int64()), ("tie", pa.int64()), ("pos", pa.int64()), ("n", pa.int64()), ("key", pa.int64())])
_OUT_DDL = "kind int, doc long, tie long, pos long, n long, key long"
REMOVED, FETCHED, SCATTERED = 0, 1, 2


class Powers:
    """Powers of the hash base and of its inverse modulo 2**64."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            for name, b in (("up", _BASE), ("down", pow(_BASE, -1, 1 << 64))):
                x = np.full(n, b, dtype=np.uint64)
                x[0] = 1
                setattr(self, name, np.multiply.accumulate(x))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _prefix_hash(buf: np.ndarray) -> np.ndarray:
    up, _ = _POWERS.to(len(buf) + 1)
    s = np.zeros(len(buf) + 1, dtype=np.uint64)
    np.cumsum(_BYTE[buf] * up[:-1], out=s[1:])
    return s


def runs(texts: list[bytes], docs: np.ndarray, ties: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Runs of the windows of ``texts``; text i is the part of document docs[i] from offsets[i] on."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    buf = np.frombuffer(b"".join(texts), dtype=np.uint8)
    if len(buf) < LENGTH:
        return np.empty(0, dtype=RUN)
    s = _prefix_hash(buf)
    _, down = _POWERS.to(len(buf) + 1)
    h = _mixed((s[K:] - s[:-K]) * down[:len(buf) - K + 1])
    # 40 bits of hash over 24 bits of position: the least is the leftmost of the least
    x = (h & np.uint64(0xFFFFFFFFFF000000)) | np.arange(len(h), dtype=np.uint64)
    step = 1
    while 2 * step <= W:
        x = np.minimum(x[:-step], x[step:])
        step *= 2
    if step < W:
        x = np.minimum(x[:len(x) - (W - step)], x[W - step:])
    starts = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(texts)), sizes)[:len(x)]
    inside = np.arange(len(x)) + LENGTH <= (starts + sizes)[of]  # windows that do not cross into the next text
    change = np.ones(len(x), dtype=bool)
    change[1:] = (x[1:] != x[:-1]) | (of[1:] != of[:-1])
    first = np.flatnonzero(change & inside)
    # a text's windows are its first positions, so a run ends at the next change or at the last window of its text
    edges = np.append(np.flatnonzero(change), len(x))
    end = np.minimum(edges[np.searchsorted(edges, first, side="right")], (starts + sizes)[of[first]] - LENGTH + 1)
    out = np.empty(len(first), dtype=RUN)
    # least hashes are small numbers: mixed once more, they spread evenly over the buckets
    out["key"] = _mixed(h[(x[first] & np.uint64(0xFFFFFF)).astype(np.int64)])
    out["n"] = end - first
    out["text"] = _mixed((s[end - 1 + LENGTH] - s[first]) * down[first] + (end - first).astype(np.uint64))
    out["doc"], out["tie"] = docs[of[first]], ties[of[first]]
    out["pos"] = first - starts[of[first]] + offsets[of[first]]
    return out


def _sorted(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct runs by key, text and place, and which of them have an earlier equal text."""
    r = r[np.lexsort((r["pos"], r["tie"], r["doc"], r["n"], r["text"], r["key"]))]
    if len(r) < 2:
        return r, np.zeros(len(r), dtype=bool)
    same = (r["key"][1:] == r["key"][:-1]) & (r["text"][1:] == r["text"][:-1]) & (r["n"][1:] == r["n"][:-1])
    place = (r["pos"][1:] == r["pos"][:-1]) & (r["tie"][1:] == r["tie"][:-1]) & (r["doc"][1:] == r["doc"][:-1])
    keep = np.concatenate([[True], ~(same & place)])
    return r[keep], np.concatenate([[False], same])[keep]


def pack(r: np.ndarray) -> bytes:
    r = r[np.lexsort((r["pos"], r["doc"]))]
    cols = [np.diff(r["doc"], prepend=0).astype("<i8"), *(r[c] for c in ("tie", "pos", "n", "key", "text"))]
    return zstandard.ZstdCompressor(level=1).compress(len(r).to_bytes(4, "little") + b"".join(np.ascontiguousarray(c).tobytes() for c in cols))


def unpack(data: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    n, at = int.from_bytes(data[:4], "little"), 4
    out = np.empty(n, dtype=RUN)
    for c, t in (("doc", "<i8"), ("tie", "<u8"), ("pos", "<u4"), ("n", "u1"), ("key", "<u8"), ("text", "<u8")):
        x = np.frombuffer(data, t, n, at)
        out[c] = np.cumsum(x) if c == "doc" else x
        at += n * np.dtype(t).itemsize
    return out


def _messages(kept: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    where = ((kept["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    order = np.argsort(where, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        if len(part):
            yield int(where[part[0]]), kept[part]


def _batch(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], schema=_MSG)


def _out(kind: int, r: np.ndarray) -> pa.Table:
    return pa.table([pa.array(np.full(len(r), kind, np.int32)), *(pa.array(r[c].astype(np.int64)) for c in ("doc", "tie", "pos", "n")),
                     pa.array(r["key"].view(np.int64) if len(r) else np.empty(0, np.int64))], schema=_OUT)


def _send(kept: list[np.ndarray], buckets: int, passed: int) -> pa.RecordBatch:
    """Messages of a batch of runs: the first of each text to the bucket of its minimizer, later ones (removed for
    sure) past the buckets, spread by document."""
    r, later = _sorted(np.concatenate(kept))
    rows = [(b, pack(part)) for b, part in _messages(r[~later], buckets)]
    gone = r[later]
    owner = (_mixed(gone["doc"].view(np.uint64) + gone["tie"] * np.uint64(_BASE)) % np.uint64(passed)).astype(np.int64)
    rows += [(-1 - int(o), pack(gone[owner == o])) for o in np.unique(owner)]
    return _batch(rows)


# ---- steps 1 and 2 ----------------------------------------------------------------------------------------------

def _met(docs: DataFrame, buckets: int) -> DataFrame:
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch, texts in slices(batches, "text", PIECE):
            ids, ties = (np.asarray(batch.column(i)) for i in (0, 1))
            parts = [(t[o:o + PIECE + LENGTH - 1], i, o) for i, t in enumerate(texts)
                     for o in (range(0, max(1, len(t) - LENGTH + 1), PIECE) if len(t) >= LENGTH else ())]
            while parts:  # one long text makes several pieces
                some, n = [], 0
                while parts and (not some or n + len(parts[0][0]) <= PIECE + LENGTH):
                    n += len(parts[0][0])
                    some.append(parts.pop(0))
                at = np.array([i for _, i, _ in some])
                kept.append(runs([t for t, _, _ in some], ids[at], ties[at], np.array([o for _, _, o in some], dtype=np.int64)))
                size += n
                if size >= BATCH:
                    yield _send(kept, buckets, buckets)
                    kept, size = [], 0
        if kept:
            yield _send(kept, buckets, buckets)

    return docs.mapInArrow(send, _MSG_DDL).groupBy("bucket").applyInArrow(_meet, _OUT_DDL)


def _meet(group: pa.Table) -> pa.Table:
    parts = [unpack(d) for d in group["data"].to_pylist()]
    if group["bucket"][0].as_py() < 0:
        return _out(REMOVED, np.concatenate(parts))
    r, later = _sorted(np.concatenate(parts))
    one, key = r[~later], r["key"][~later]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(one) else np.empty(0, np.int64)
    texts = np.repeat(np.diff(np.append(starts, len(one))), np.diff(np.append(starts, len(one))))
    return pa.concat_tables([_out(REMOVED, r[later]), _out(FETCHED, one[(texts > 1) & (texts <= HOT)]), _out(SCATTERED, one[texts > HOT])])


# ---- step 3 -----------------------------------------------------------------------------------------------------

def ranks_by_depth(buf: np.ndarray, ends: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks of all suffixes by their first 8, 16, 32, 64 and LENGTH bytes (equal: equal rank), by doubling. ``ends``
    has the end of the text that each byte of ``buf`` lies in; a rank means something where the text has so many bytes
    left."""
    n = len(buf)
    word = np.zeros(n + 8, dtype=np.uint64)
    padded = np.concatenate([buf, np.zeros(16, np.uint8)])
    for i in range(8):
        word[:n] = (word[:n] << np.uint64(8)) | padded[i:n + i]
    rank, depth = np.unique(word[:n], return_inverse=True)[1].astype(np.int64), 8
    out = {depth: rank}
    while depth < LENGTH:
        step = min(depth, LENGTH - depth)
        ok = np.flatnonzero(np.arange(n) + depth + step <= ends)
        pair = rank[ok] * np.int64(rank.max() + 1) + rank[ok + step]
        new = np.zeros(n, dtype=np.int64)
        new[ok] = np.unique(pair, return_inverse=True)[1]
        rank, depth = new, depth + step
        out[depth] = rank
    return out


def suffix_ranks(buf: np.ndarray, ends: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Ranks of the suffixes at ``at`` by their first LENGTH bytes; each has LENGTH bytes before its text's end."""
    return ranks_by_depth(buf, ends)[LENGTH][at]


def nearest_smaller(x: np.ndarray) -> np.ndarray:
    """For each of the distinct numbers, where the nearest smaller one before it is, -1 if nowhere. All pointers jump
    at once: what a pointer leaps over is larger than the number that it belongs to, and so larger than any smaller
    number that follows the pointer."""
    p = np.arange(len(x)) - 1
    todo = np.flatnonzero(p >= 0)
    while len(todo := todo[(p[todo] >= 0) & (x[p[todo]] > x[todo])]):
        p[todo] = p[p[todo]]
    return p


def common_length(ranks: dict[int, np.ndarray], buf: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Length of the common beginning of the suffixes at ``i`` and ``j``, LENGTH at most."""
    n = np.zeros(len(i), dtype=np.int64)
    for depth in (d for d in sorted(ranks, reverse=True) if d < LENGTH):
        ok = np.flatnonzero(n + depth <= LENGTH)
        n[ok[ranks[depth][i[ok] + n[ok]] == ranks[depth][j[ok] + n[ok]]]] += depth
    on = np.arange(len(i))
    while len(on := on[n[on] < LENGTH]):  # fewer than eight bytes are left that agree
        on = on[buf[i[on] + n[on]] == buf[j[on] + n[on]]]
        n[on] += 1
    return np.where(ranks[LENGTH][i] == ranks[LENGTH][j], LENGTH, n)


def previous_factors(ranks: dict[int, np.ndarray], buf: np.ndarray, at: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Longest previous factor of each suffix at ``at``, LENGTH at most: in suffix order, the nearest suffixes before
    and after it that start at a smaller place are the earlier texts that agree with it longest. ``places``: distinct
    numbers by place."""
    order = np.lexsort((places, ranks[LENGTH][at]))
    at, place = at[order], places[order]
    before = nearest_smaller(place)
    after = len(place) - 1 - nearest_smaller(place[::-1])[::-1]
    factor = np.zeros(len(at), dtype=np.int64)
    for other, some in ((before, before >= 0), (after, after < len(at))):
        some = np.flatnonzero(some)
        factor[some] = np.maximum(factor[some], common_length(ranks, buf, at[some], at[other[some]]))
    out = np.empty_like(factor)
    out[order] = factor
    return out


def later_copies(ranks: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Whether the longest previous factor of each suffix reaches LENGTH.

    In suffix order with ties by place, the nearest smaller place before a suffix of equal rank is its neighbour, and
    the nearest smaller place after it, if any, has a higher rank: it agrees with it in fewer than LENGTH bytes. So
    the factor is long enough where the neighbour before has the same rank. ``places``: distinct numbers by place."""
    order = np.lexsort((places, ranks))
    out = np.zeros(len(ranks), dtype=bool)
    if len(order):
        out[order[1:]] = ranks[order[1:]] == ranks[order[:-1]]
    return out


def _merge(doc, tie, pos) -> np.ndarray:
    """Removed windows as runs of neighbours, of up to 200 each."""
    order = np.lexsort((pos, tie, doc))
    doc, tie, pos = doc[order], tie[order], pos[order]
    if not len(doc):
        return np.empty(0, dtype=RUN)
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tie[1:] != tie[:-1]) | (pos[1:] != pos[:-1] + 1)])
    start = np.flatnonzero(new)
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(doc))))
    new |= (np.arange(len(doc)) - start[run]) % 200 == 0
    start = np.flatnonzero(new)
    out = np.zeros(len(start), dtype=RUN)
    out["doc"], out["tie"], out["pos"], out["n"] = doc[start], tie[start], pos[start], np.diff(np.append(start, len(doc)))
    return out


def _compared(r: np.ndarray, texts: bytes) -> pa.Table:
    """Removed windows among the runs ``r``, whose texts follow each other in ``texts``."""
    buf = np.frombuffer(texts, np.uint8)
    sizes = r["n"].astype(np.int64) + LENGTH - 1
    stop = np.cumsum(sizes)
    run = np.repeat(np.arange(len(r)), r["n"])
    within = np.arange(len(run)) - np.repeat(np.cumsum(r["n"].astype(np.int64)) - r["n"], r["n"])
    ranks = ranks_by_depth(buf, np.repeat(stop, sizes))
    pos = r["pos"][run].astype(np.int64) + within
    places = np.empty(len(run), dtype=np.int64)
    places[np.lexsort((pos, r["tie"][run], r["doc"][run]))] = np.arange(len(run))
    gone = previous_factors(ranks, buf, (stop - sizes)[run] + within, places) >= LENGTH
    return _out(REMOVED, _merge(r["doc"][run][gone], r["tie"][run][gone], pos[gone]))


def _compare(docs: DataFrame, met: DataFrame) -> DataFrame:
    """Removed windows of the runs that have to be compared by their bytes, and of the scattered ones."""
    asked = met.where(F.col("kind") != REMOVED)
    n = asked.agg(F.sum(F.col("n") + LENGTH)).first()[0] or 0
    buckets = max(1, math.ceil(n / FETCH), docs.sparkSession.sparkContext.defaultParallelism if n else 1)
    lists = asked.groupBy("doc", "tie").agg(F.collect_list(F.struct("kind", "pos", "n", "key")).alias("runs"))
    rows = docs.join(lists.withColumnsRenamed({"doc": "__doc", "tie": "__tie"}), (F.col("doc") == F.col("__doc")) & (F.col("tie") == F.col("__tie"))) \
        .dropDuplicates(["doc", "tie"]).select("doc", "tie", "text", "runs")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            r, bodies, one = [], [], []
            for doc, tie, asked_, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3).to_pylist(), texts, strict=True):
                whole = None
                for x in asked_:
                    p, k, key = x["pos"], x["n"], x["key"] & 0xFFFFFFFFFFFFFFFF
                    if x["kind"] == FETCHED:
                        r.append((key, 0, doc, tie, p, k))
                        bodies.append(t[p:p + k + LENGTH - 1])
                    else:
                        if whole is None:
                            whole = _prefix_hash(np.frombuffer(t, np.uint8))
                            _, down = _POWERS.to(len(t) + 1)
                        at = np.arange(p, p + k)
                        w = np.zeros(k, dtype=RUN)
                        w["key"] = w["text"] = _mixed((whole[at + LENGTH] - whole[at]) * down[at])
                        w["doc"], w["tie"], w["pos"], w["n"] = doc, tie, at, 1
                        one.append(w)
            rows = []
            if r:
                r = np.array(r, dtype=RUN)
                where = ((r["key"] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
                for b in np.unique(where):
                    at = np.flatnonzero(where == b)
                    rows.append((int(b), b"B" + len(at).to_bytes(4, "little") + r[at].tobytes() + b"".join(bodies[i] for i in at)))
            if one:
                w, later = _sorted(np.concatenate(one))
                rows += [(b, b"W" + pack(part)) for b, part in _messages(w[~later], buckets)]
                if later.any():  # removed already, wherever the first one is
                    rows.append((int(w["key"][later][0] % np.uint64(buckets)), b"R" + pack(w[later])))
            if rows:
                yield _batch(rows)

    def meet(group: pa.Table) -> pa.Table:
        out, r, bodies, one = [], [], [], []
        for data in group["data"].to_pylist():
            if data[:1] == b"B":
                k = int.from_bytes(data[1:5], "little")
                r.append(np.frombuffer(data, RUN, k, 5))
                bodies.append(data[5 + k * RUN.itemsize:])
            elif data[:1] == b"W":
                one.append(unpack(data[1:]))
            else:
                x = unpack(data[1:])
                out.append(_out(REMOVED, _merge(x["doc"], x["tie"], x["pos"].astype(np.int64))))
        if r:
            out.append(_compared(np.concatenate(r), b"".join(bodies)))
        if one:
            w, later = _sorted(np.concatenate(one))
            out.append(_out(REMOVED, _merge(w["doc"][later], w["tie"][later], w["pos"][later].astype(np.int64))))
        return pa.concat_tables(out) if out else _out(REMOVED, np.empty(0, RUN))

    return rows.mapInArrow(fetch, _MSG_DDL).groupBy("bucket").applyInArrow(meet, _OUT_DDL)


# ---- step 4 -----------------------------------------------------------------------------------------------------

_RESULT = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()),
                     ("kept_sha256", pa.string()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), ("kept", pa.binary())])
_RESULT_DDL = ("doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, "
               "spans array<struct<start:long,end:long>>, kept binary")


def removed_spans(windows: list[dict] | None) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for x in sorted((w["pos"], w["pos"] + w["n"] - 1 + LENGTH) for w in windows or ()):
        if out and x[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], x[1])
        else:
            out.append(list(x))
    return [(a, b) for a, b in out]


def _with_ties(rows: DataFrame) -> DataFrame:
    """``rows`` (doc, text, doc_id) with ``tie``: 0, or, where several rows have one id, the place of the row's text
    among the different texts of that id. Places come from 160 bits of the texts and are whole numbers, so that two
    texts are never taken for one. Only rows of repeated ids are hashed and joined, by hash, so that an id (null, say)
    which very many rows have is spread."""
    several = cut(rows.groupBy("doc").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("doc"), "suffix-several")
    if several.limit(1).count() == 0:
        return rows.withColumn("tie", F.lit(0).cast("long"))
    marked = cut(rows.join(several.withColumn("__several", F.lit(True)), "doc", "left")
                 .withColumn("__crc", F.when(F.col("__several"), F.crc32("text"))).withColumn("__md5", F.when(F.col("__several"), F.md5("text"))), "suffix-marked")
    texts = marked.where("__several").select("doc", "__crc", "__md5").distinct()
    places = ranked(texts, ["doc"], ["__crc", "__md5"], "__place").select(
        F.col("doc").alias("__doc"), F.col("__md5").alias("__same"), "__place")
    return cut(marked.join(places, (F.col("doc") == F.col("__doc")) & (F.col("__md5") == F.col("__same")), "left")
               .select("doc", "text", "doc_id", F.coalesce("__place", F.lit(0)).cast("long").alias("tie")), "suffix-rows")


def remove_repeats(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", keep_text: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans (start, end in bytes, end
    exclusive) and kept (the remaining bytes; null without ``keep_text``).

    Null text is empty and keeps nothing: n_bytes 0, the hash of no bytes. Texts under 100 bytes stay whole. A null
    id is smaller than all others. Rows that repeat an id are ordered by the CRC-32 of their texts, then by their
    MD5, and identical rows are one document: each gets the same result and neither removes the other. Long texts are handled whole, in
    pieces that overlap by 99 bytes. Other columns are not read. An empty table gives an empty result."""
    body = F.coalesce(docs[text].cast("string"), F.lit("")).cast("binary")
    rows = _with_ties(docs.select(F.coalesce(docs[doc_id].cast("long"), F.lit(-1 << 63)).alias("doc"), body.alias("text"),
                                  docs[doc_id].cast("long").alias("doc_id")))
    size = total(rows, F.octet_length("text"))
    buckets = max(1, math.ceil(size / BUCKET))
    met = cut(_met(rows.select("doc", "tie", "text"), buckets), "suffix-runs")
    compared = cut(_compare(rows.select("doc", "tie", "text"), met), "suffix-compared")
    gone = met.where(F.col("kind") == REMOVED).select("doc", "tie", "pos", "n").union(compared.select("doc", "tie", "pos", "n"))
    lists = gone.groupBy("doc", "tie").agg(F.collect_list(F.struct("pos", "n")).alias("windows")) \
        .withColumnsRenamed({"doc": "__doc", "tie": "__tie"})

    def finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            out = []
            for i, t, windows in zip(batch.column(0).to_pylist(), texts, batch.column(2).to_pylist(), strict=True):
                spans = removed_spans(windows)
                edges = [0, *(x for s in spans for x in s), len(t)]
                kept = b"".join(t[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((i, len(t), len(t) - len(kept), len(spans), hashlib.sha256(kept).hexdigest(),
                            [{"start": a, "end": b} for a, b in spans], kept if keep_text else None))
            cols = list(zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, _RESULT, strict=True)], schema=_RESULT)

    joined = rows.join(lists, (F.col("doc") == F.col("__doc")) & (F.col("tie") == F.col("__tie")), "left")
    return joined.select("doc_id", "text", "windows").mapInArrow(finish, _RESULT_DDL)


def op1_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), keep_text=False).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
