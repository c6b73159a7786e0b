"""Operator 8: benchmark decontamination by latent semantic retrieval.

Finds the documents that hold a benchmark item, word for word or paraphrased with most of its words in order.

1. Every text becomes the hashes of its lower-case words. Candidates are found by 16 bits of them, written once (two
   bytes a word); document frequencies come from all documents, and a word weighs log(N / df), ``FLOOR`` at least: no
   word is cut off, so that an item that a third of the documents hold is found as well.
2. A randomised singular value decomposition of TF-IDF passages: the pieces of the items, which count as much as all
   other passages together, and the passages of all documents. Each round multiplies by A'A in the tasks that hold the passages, and the
   driver orthonormalises a matrix of ``VOCABULARY`` x ``RANK`` numbers; where the items of a block have more words
   than that, it has a row for each of them, at most one per hash (``IDS``).
3. All passages of all documents (two blocks of ``BLOCK`` words, each block in two passages) are projected and meet
   the items' pieces: a candidate's passage has at least ``THRESHOLD`` of the piece's own length in the direction of the
   piece, whatever else stands in the passage. A text that holds the first piece of an item word for word is a candidate
   without the space, found by hashes of word runs, so that items of few or frequent words are not lost in it.
4. A candidate is checked against the words around it, by 64 bits of their hashes, so that words that share 16 bits
   count as different: the longest common subsequence with the whole item has at least ``LCS`` of its words, and at least ``ANSWER`` of its ``ANSWER_WORDS`` rarest words, which carry what it asks or
   answers, are there.

Items are taken in blocks of ``ITEMS``; each block is one pass over the texts.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import cut
from .anchors import word_hashes
from .base import lower_ascii, slices, table

IDS = 1 << 16
FLOOR = 0.01
BLOCK, RANK, ROUNDS = 24, 256, 2
VOCABULARY, ITEMS = 16_384, 2048
#: Documents whose passages a task multiplies at a time when the space is made, from all documents.
SAMPLE = 3000
#: Passages that are multiplied at once, and how many of their most frequent words go through matrix products.
PASSAGES, DENSE = 512, 1024
#: Share of a piece's length in the space that a passage has in the piece's direction.
THRESHOLD = 0.35
LCS, ANSWER, ANSWER_WORDS = 0.7, 0.6, 5

_IDS = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])
_PART = pa.schema([("part", pa.int32()), ("data", pa.binary())])
_LEAK = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("cosine", pa.float64()), ("lcs", pa.int32()),
                   ("item_words", pa.int32()), ("answer_share", pa.float64()), ("word", pa.int64())])
_LEAK_DDL = "doc_id long, item_id long, cosine double, lcs int, item_words int, answer_share double, word long"


def hashed(texts: list[bytes]) -> list[np.ndarray]:
    """64-bit hashes of the lower-case words of each text; a text of several MB is one array."""
    out: list[np.ndarray] = []
    for lo, hi in _runs([len(t) for t in texts], 1 << 20):
        words, counts = word_hashes([lower_ascii(t) for t in texts[lo:hi]])
        out += np.split(words, np.cumsum(counts)[:-1])
    return out


def short(words: np.ndarray) -> np.ndarray:
    """The 16 bits by which candidates are found."""
    return (words & np.uint64(IDS - 1)).astype(np.uint16)


# ---- 1: word hashes and weights ---------------------------------------------------------------------------------

def word_ids(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids): the word hashes of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([short(h).tobytes() for h in hashed(texts)], pa.binary())], schema=_IDS)

    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text")) \
        .mapInArrow(run, "doc_id long, ids binary")


def _summed(parts: DataFrame, dtype) -> np.ndarray:
    """Sum of arrays that tasks sent in parts: (part, data). A group adds up its messages one by one."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        acc: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, data in zip(batch["part"].to_pylist(), batch["data"].to_pylist(), strict=True):
                x = np.frombuffer(data, dtype)
                if part in acc:
                    acc[part] += x
                else:
                    acc[part] = x.copy()
        if acc:
            yield pa.RecordBatch.from_arrays([pa.array(list(acc), pa.int32()), pa.array([x.tobytes() for x in acc.values()], pa.binary())], schema=_PART)

    rows = parts.repartition(8, "part").mapInArrow(add, "part int, data binary").toArrow()
    got = dict(zip(rows["part"].to_pylist(), rows["data"].to_pylist(), strict=True))
    return np.concatenate([np.frombuffer(got[p], dtype) for p in sorted(got)]) if got else np.empty(0, dtype)


def _in_parts(x: np.ndarray, parts: int = 16) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(range(parts), pa.int32()), pa.array([p.tobytes() for p in np.split(x.reshape(-1), parts)], pa.binary())], schema=_PART)


def document_frequencies(ids: DataFrame) -> tuple[int, np.ndarray]:
    """Number of documents and, per word hash, of documents with it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros(IDS + 16, dtype=np.int64)  # 16 more, the first of which counts documents
        for batch in batches:
            for data in batch.column(0).to_pylist():
                df[np.unique(np.frombuffer(data, np.uint16))] += 1
                df[IDS] += 1
        yield _in_parts(df)

    df = _summed(ids.select("ids").coalesce(ids.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "part int, data binary"), np.int64)
    return (int(df[IDS]), df[:IDS]) if len(df) else (0, np.zeros(IDS, dtype=np.int64))


def weights(n: int, df: np.ndarray) -> np.ndarray:
    """log(N / df) per word hash, FLOOR at least."""
    return np.maximum(np.log((n + 1) / (df + 1)), FLOOR).astype(np.float32)


# ---- 2: the space -----------------------------------------------------------------------------------------------

def pieces(ids: np.ndarray) -> list[np.ndarray]:
    """Parts of an item of at most BLOCK words that cover it, the last one whole."""
    if len(ids) <= BLOCK:
        return [ids]
    starts = [*range(0, len(ids) - BLOCK, BLOCK), len(ids) - BLOCK]
    return [ids[a:a + BLOCK] for a in starts]


def _unit_rows(passages: list[np.ndarray], weight: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words of passages as (vocabulary place, passage, weight), each passage with length 1, known words only."""
    of = np.repeat(np.arange(len(passages)), [len(p) for p in passages])
    flat = np.concatenate(passages) if passages else np.empty(0, np.uint16)
    w = weight[flat]
    keep = (w > 0) & (at[flat] >= 0)
    flat, of, w = flat[keep], of[keep], w[keep]
    norm = np.sqrt(np.bincount(of, w * w, len(passages)))
    return at[flat], of, (w / np.maximum(norm[of], 1e-9)).astype(np.float32)


def _add_rows(out: np.ndarray, to: np.ndarray, rows: np.ndarray, at: np.ndarray, w: np.ndarray) -> None:
    """out[to] += w * rows[at], also where ``to`` repeats: all first ones at once, then all second ones, and so on."""
    order = np.argsort(to, kind="stable")
    to = to[order]
    first = np.flatnonzero(np.concatenate([[True], to[1:] != to[:-1]])) if len(to) else np.empty(0, np.int64)
    sizes = np.diff(np.append(first, len(to)))
    nth = np.arange(len(to)) - np.repeat(first, sizes)
    again = np.argsort(nth, kind="stable")
    lo = 0
    for n in np.bincount(nth):
        some = again[lo:lo + n]
        x = rows.take(at[order[some]], axis=0)
        x *= w[order[some], None]
        out[to[some]] += x
        lo += n


def _frequent_apart(word: np.ndarray, of: np.ndarray, w: np.ndarray, n: int, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The DENSE most frequent words of ``n`` passages, a matrix of their weights, and where the other words stand."""
    count = np.bincount(word, minlength=words)
    top = np.argpartition(-count, DENSE)[:DENSE] if words > DENSE else np.arange(words)
    top = top[count[top] > 0]
    place = np.full(words, -1, dtype=np.int64)
    place[top] = np.arange(len(top))
    column = place[word]
    dense = column >= 0
    matrix = np.bincount(of[dense] * len(top) + column[dense], w[dense], n * len(top)).astype(np.float32).reshape(n, len(top))
    return top, matrix, np.flatnonzero(~dense)


def _times(word: np.ndarray, of: np.ndarray, w: np.ndarray, n: int, q: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """A q for ``n`` sparse rows; with ``back``, A'A q is added to it. Few words are most of a text: they go through
    matrix products, the others row by row."""
    top, matrix, rest = _frequent_apart(word, of, w, n, len(q))
    word, of, w = word[rest], of[rest], w[rest]
    p = matrix @ q[top]
    _add_rows(p, of, q, word, w)
    if back is not None:
        back[top] += matrix.T @ p
        _add_rows(back, word, p, of, w)
    return p


def _gram_times(word: np.ndarray, of: np.ndarray, w: np.ndarray, q: np.ndarray) -> np.ndarray:
    """A'A q for sparse rows, some passages at a time."""
    out = np.zeros_like(q)
    starts = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]])) if len(of) else np.empty(0, np.int64)
    for lo in range(0, len(starts), PASSAGES):
        a, some = starts[lo], starts[lo:lo + PASSAGES]
        b = starts[lo + PASSAGES] if lo + PASSAGES < len(starts) else len(of)
        local = np.repeat(np.arange(len(some)), np.diff(np.append(some, b)))
        _times(word[a:b], local, w[a:b], len(some), q, out)
    return out


_RUN = np.random.Generator(np.random.PCG64(9)).integers(1, 1 << 63, IDS, dtype=np.uint64)
_FACTOR = np.uint64(0x9E3779B97F4A7C15)


def _run_hashes(flat: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(n, hashes of the n words from each place on) for n = 1, 2, 4, ... up to BLOCK."""
    x, n = _RUN[flat], 1
    while n <= BLOCK and len(x):
        yield n, x
        y = (x[:-n] ^ (x[:-n] >> np.uint64(29))) * _FACTOR + x[n:] if len(x) > n else x[:0]
        x, n = y, 2 * n


class Runs:
    """The first pieces of items, word for word: a piece of n words is the run of the largest power of two from its
    first word on and the one that ends with its last word."""

    def __init__(self, firsts: list[np.ndarray]) -> None:
        by: dict[int, list[tuple[int, int, int, int]]] = {}
        for k, p in enumerate(firsts):
            n, x = list(_run_hashes(p))[-1]
            by.setdefault(n, []).append((int(x[0]), int(x[-1]), len(p), k))
        self.by = {}
        for n, rows in by.items():
            head, tail, size, item = zip(*sorted(rows), strict=True)
            head = np.array(head, dtype=np.uint64)
            seen = np.zeros(1 << 16, dtype=bool)
            seen[head & np.uint64(0xFFFF)] = True
            self.by[n] = seen, head, np.array(tail, dtype=np.uint64), np.array(size), np.array(item)

    def find(self, flat: np.ndarray, ends: np.ndarray) -> Iterator[tuple[int, int]]:
        """(place, item) of each first piece in texts laid end to end, which end at ``ends``."""
        for n, x in _run_hashes(flat):
            if n not in self.by:
                continue
            seen, head, tail, size, item = self.by[n]
            at = np.flatnonzero(seen[x & np.uint64(0xFFFF)])
            lo, hi = (np.searchsorted(head, x[at], side) for side in ("left", "right"))
            at, lo, count = at[hi > lo], lo[hi > lo], (hi - lo)[hi > lo]
            j = np.repeat(lo - np.cumsum(count) + count, count) + np.arange(count.sum())
            at = np.repeat(at, count)
            inside = at + size[j] <= ends[np.searchsorted(ends, at, "right")]
            at, j = at[inside], j[inside]
            same = x[at + size[j] - n] == tail[j]
            yield from zip(at[same].tolist(), item[j[same]].tolist(), strict=True)


class Space:
    """The projection and the items' pieces in it. Items: (item id, 16 bits per word, 64 bits per word)."""

    def __init__(self, weight, at, rows, items: list[tuple[int, np.ndarray, np.ndarray]]) -> None:
        self.weight, self.at, self.rows = weight, at, rows
        self.items = items
        self.runs = Runs([pieces(ids)[0] for _, ids, _ in items])
        self.of, units, lengths, self.first = [], [], [], {}
        for k, (_, ids, _) in enumerate(items):
            for i, p in enumerate(pieces(ids)):
                v = self.project(p)
                length = float(np.linalg.norm(v))
                if length > 0:
                    if not i:
                        self.first[k] = len(units)
                    self.of.append(k), units.append(v / length), lengths.append(length)
        self.units = np.array(units, dtype=np.float32).reshape(len(units), rows.shape[1])
        self.limits = THRESHOLD * np.array(lengths, dtype=np.float32)
        # the most that one occurrence of a word adds to the product with a piece, as a share of the piece's limit
        self.most = np.zeros(IDS, dtype=np.float32)
        known = np.flatnonzero(at >= 0)
        if len(self.units):
            for some in np.array_split(known, max(1, len(known) // 2048)):
                share = rows[at[some]] @ (self.units / self.limits[:, None]).T
                self.most[some] = weight[some] * np.maximum(share.max(axis=1), 0) if len(some) else 0
        # bits of the places of each word in an item, and its answer words: by 16 bits, and by 64
        self.masks, self.answers = ([], []), ([], [])
        for _, ids, words in items:
            weigh = dict(zip(words.tolist(), weight[ids].tolist(), strict=True))
            for exact, x in enumerate((ids.tolist(), words.tolist())):
                masks: dict[int, int] = {}
                for i, w in enumerate(x):
                    masks[w] = masks.get(w, 0) | 1 << i
                self.masks[exact].append(masks)
                rare = sorted(set(x), key=lambda w: (-(weigh[w] if exact else weight[w]), w))
                self.answers[exact].append([w for w in rare if (weigh[w] if exact else weight[w]) > 0][:ANSWER_WORDS])

    def project(self, ids: np.ndarray) -> np.ndarray:
        ids = ids[self.at[ids] >= 0]
        return (self.rows[self.at[ids]] * self.weight[ids][:, None]).sum(axis=0)

    def project_all(self, flat: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """:meth:`project` of the words from each start to before its end, some at a time."""
        out = np.empty((len(starts), self.rows.shape[1]), dtype=np.float32)
        for lo in range(0, len(starts), PASSAGES):
            a, sizes = starts[lo:lo + PASSAGES], (ends - starts)[lo:lo + PASSAGES]
            of = np.repeat(np.arange(len(a)), sizes)
            ids = flat[np.arange(len(of)) + (a - (np.cumsum(sizes) - sizes))[of]]
            known = self.at[ids] >= 0
            out[lo:lo + PASSAGES] = _times(self.at[ids[known]], of[known], self.weight[ids[known]], len(a), self.rows)
        return out

    def check(self, k: int, words: list[int], exact: bool = False) -> tuple[int, float] | None:
        """(common subsequence, share of answer words) of item k and ``words`` if both suffice; ``exact``: words are 64
        bits each, not 16."""
        size = len(self.items[k][1])
        masks, have = self.masks[exact][k], set(words)
        if sum(m.bit_count() for x, m in masks.items() if x in have) < LCS * size:
            return None
        answer = self.answers[exact][k]
        share = sum(x in have for x in answer) / len(answer) if answer else 1.0
        if share < ANSWER:
            return None
        full = (1 << size) - 1
        v = full
        for x in words:
            m = masks.get(x)
            if m:
                u = v & m
                v = ((v + u) | (v - u)) & full
        n = size - v.bit_count()
        return (n, share) if n >= LCS * size else None

    def search(self, texts: list[np.ndarray], words: list[np.ndarray] | None = None) -> Iterator[tuple[int, int, float, int, int, float, int]]:
        """(text, item id, cosine, common subsequence, item words, answer share, first word of the passage), one per
        text and item that it holds: the passage with the best cosine of those that pass. ``words``: 64 bits of each
        word, on which the check is done then."""
        exact = words is not None
        words = words if exact else texts
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        if not len(self.items) or not sizes.sum():
            return
        flat = np.concatenate(texts)
        blocks = -(-sizes // BLOCK)
        of = np.repeat(np.arange(len(texts)), blocks)
        start = np.cumsum(sizes) - sizes
        first = start[of] + (np.arange(len(of)) - (np.cumsum(blocks) - blocks)[of]) * BLOCK
        w = self.weight[flat]
        norm2, reach = np.add.reduceat(w * w, first), np.add.reduceat(self.most[flat], first)
        # a passage is a block and the next one of the same text; a text of one block is one passage
        pair = np.zeros(len(first), dtype=bool)
        pair[:-1] = of[1:] == of[:-1]
        passage = np.flatnonzero(pair | (blocks[of] == 1))
        joined = pair[passage]
        nxt = np.minimum(passage + 1, len(first) - 1)
        length = np.sqrt(np.maximum(norm2[passage] + np.where(joined, norm2[nxt], 0), 1e-9))
        # no piece can reach its limit where the most that each word can add does not
        strong = np.flatnonzero((reach[passage] + np.where(joined, reach[nxt], 0)) * 1.0001 >= 1)
        ends = np.append(first[1:], len(flat))
        used = np.unique(np.concatenate([passage[strong], nxt[strong][joined[strong]]]))
        latent = self.project_all(flat, first[used], ends[used])
        place = np.searchsorted(used, passage[strong])
        x = latent[place]
        x[joined[strong]] += latent[np.searchsorted(used, nxt[strong][joined[strong]])]
        best: dict[tuple[int, int], tuple] = {}
        for lo in range(0, len(strong), 4096):
            some = strong[lo:lo + 4096]
            score = x[lo:lo + 4096] @ self.units.T
            for i, j in zip(*np.nonzero(score >= self.limits), strict=True):
                p, k, c = int(passage[some[i]]), self.of[j], min(1.0, float(score[i, j] / length[some[i]]))
                t = int(of[p])
                if best.get((t, k), (0.0,))[0] >= c:
                    continue
                at, size = int(first[p] - start[t]), len(self.items[k][1])
                got = self.check(k, words[t][max(0, at - size):at + 2 * BLOCK + size].tolist(), exact)
                if got:
                    best[t, k] = (c, got, at)
        text_ends = np.cumsum(sizes)
        for i, k in self.runs.find(flat, text_ends):
            t = int(np.searchsorted(text_ends, i, "right"))
            if (t, k) in best:
                continue
            at, size = i - int(start[t]), len(self.items[k][1])
            at = min(at // BLOCK, max(0, int(blocks[t]) - 2)) * BLOCK
            got = self.check(k, words[t][max(0, at - size):at + 2 * BLOCK + size].tolist(), exact)
            if got:
                p = texts[t][at:at + 2 * BLOCK]
                v = float(self.project(p) @ self.units[self.first[k]] / np.linalg.norm(self.weight[p])) if k in self.first else 0.0
                best[t, k] = (min(1.0, max(0.0, v)), got, at)
        for (t, k), (c, (n, share), at) in sorted(best.items()):
            yield t, self.items[k][0], c, n, len(self.items[k][1]), share, at


def fit(ids: DataFrame, n: int, df: np.ndarray, items: list[tuple[int, np.ndarray, np.ndarray]]) -> Space:
    """The space for a block of items over ``ids`` with ``n`` documents and document frequencies ``df``."""
    weight = weights(n, df)
    parts = [p for _, x, _ in items for p in pieces(x)]
    own = np.unique(np.concatenate(parts)) if parts else np.empty(0, np.uint16)
    own = own[df[own] > 0]  # all of them; a word that no document holds would only make its piece longer
    order = np.argsort(-df, kind="stable")
    most = order[(df[order] > 0) & ~np.isin(order, own)][:max(0, VOCABULARY - len(own))]
    at = np.full(IDS, -1, dtype=np.int32)
    chosen = np.sort(np.concatenate([own.astype(np.int64), most]))
    at[chosen] = np.arange(len(chosen))
    pad = -len(chosen) % 16 + (16 if not len(chosen) else 0)
    spark = ids.sparkSession
    words = ids.agg(F.sum(F.octet_length("ids"))).first()[0] or 0
    boost = max(1.0, words / 2 / (2 * BLOCK) / max(1, len(parts)))
    q = np.random.Generator(np.random.PCG64(8)).standard_normal((len(chosen) + pad, RANK)).astype(np.float32)
    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((weight, at, q))

        def run(batches: Iterator[pa.RecordBatch], shared=shared, size=SAMPLE) -> Iterator[pa.RecordBatch]:
            weight, at, q = shared.value
            g = np.zeros_like(q)
            for batch in (b.slice(lo, size) for b in batches for lo in range(0, b.num_rows, size)):
                flat = [np.frombuffer(d, np.uint16) for d in batch.column(0).to_pylist()]
                g += _gram_times(*_unit_rows([x[a:a + 2 * BLOCK] for x in flat for a in range(0, len(x), 2 * BLOCK)], weight, at), q)
            yield _in_parts(g)

        # a task sends a whole matrix, whatever it read: one task per core, not one per file
        g = _summed(ids.select("ids").coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "part int, data binary"), np.float32)
        g = g.reshape(q.shape).copy() if len(g) else np.zeros_like(q)
        g += np.float32(boost) * _gram_times(*_unit_rows(parts, weight, at), q)
        q = np.linalg.qr(g)[0].astype(np.float32)
    return Space(weight, at, np.ascontiguousarray(q), items)


# ---- 3 and 4: the search ----------------------------------------------------------------------------------------

def item_blocks(benchmark: DataFrame, text: str = "text", item_id: str = "item_id", block: int = ITEMS) -> Iterator[list[tuple[int, np.ndarray, np.ndarray]]]:
    """Blocks of (item id, 16 bits per word, 64 bits per word) of the items with words, read in parts; null ids are left
    out."""
    rows = benchmark.select(benchmark[item_id].cast("long"), benchmark[text].cast("string")).dropDuplicates().toLocalIterator(prefetchPartitions=True)
    items = ((r[0], hashed([r[1].encode()])[0]) for r in rows if r[0] is not None and r[1])
    items = ((i, short(h), h) for i, h in items if len(h))
    while some := list(itertools.islice(items, block)):
        yield sorted(some, key=lambda x: (x[0], x[2].tobytes()))


def leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """One row per document and item that it holds: doc_id, item_id, cosine, lcs, item_words, answer_share, word (where
    the passage begins). Documents without an item have no row.

    Null and empty texts hold nothing, empty items are held by nothing, items with a null id are left out. Repeated documents each get their rows; an
    item id with several texts is found by any of them, once a block. Texts are searched whole. Other columns are not
    read. An empty table on either side gives an empty result."""
    spark = docs.sparkSession
    ids = cut(word_ids(docs), "leak-ids")
    n, df = document_frequencies(ids)
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    out = spark.createDataFrame([], _LEAK_DDL)
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(fit(ids, n, df, items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space = shared.value
            for batch, texts in slices(batches, "text", 1 << 20):
                names, words = batch.column(0).to_pylist(), hashed(texts)
                rows = [(names[t], *rest) for t, *rest in space.search([short(h) for h in words], words)]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _LEAK, strict=True)], schema=_LEAK)

        out = out.union(rows.mapInArrow(run, _LEAK_DDL))
    return out


def _runs(sizes: list[int], limit: int = 1 << 19) -> Iterator[tuple[int, int]]:
    lo = size = 0
    for i, s in enumerate(sizes):
        size += s
        if size >= limit or i + 1 == len(sizes):
            yield lo, i + 1
            lo, size = i + 1, 0


def decontaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``docs`` that hold no item, with the columns of ``docs``; the same search, row by row, without a
    join back. ``docs`` has a text column."""
    spark = docs.sparkSession
    ids = cut(word_ids(docs), "leak-ids")
    n, df = document_frequencies(ids)
    for items in item_blocks(benchmark):
        shared = spark.sparkContext.broadcast(fit(ids, n, df, items))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            space = shared.value
            for batch, texts in slices(batches, "text", 1 << 20):
                words = hashed(texts)
                held = {t for t, *_ in space.search([short(h) for h in words], words)}
                yield batch.filter(pa.array([i not in held for i in range(len(texts))], pa.bool_()))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
