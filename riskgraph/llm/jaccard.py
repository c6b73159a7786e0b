"""Operator 6: n-gram Jaccard join by signature trees.

Two documents link when their sets of 5-word shingles overlap by at least 75 % of the union. All such links count;
none is lost to a cap, a sample or a sketch. The result needs no list of links: per document, the size of its set
and the smallest document it can reach.

1. Each text becomes the set of the hashes of its shingles. Documents with equal word sequences are one *entity*.
2. Shingles meet in buckets by hash, packed as arrays, and learn in how many entities they occur. Those that occur
   once cannot be in any intersection; an entity with more than a quarter of such shingles links with nothing.
3. Prefix filter: in a fixed order of all shingles, rarest first, entities that link share one of the first
   n - ceil(0.75 n) + 1 shingles of each. Entities joined by such shingles form *families*; links stay in a family.
4. A family's sets lie in one task. A signature tree over them has, in each node, the OR of its sets' token bitmaps
   and the range of their sizes. Two trees (or one and itself) are traversed together: a pair of nodes is dropped
   when the sizes exclude a link, when the common bits bound the overlap below what a link needs, or when all below
   both is connected already. What is left is compared exactly. A family above ``FAMILY_TOKENS`` is split by set
   size and hash into several trees, and pairs of trees of like sizes go to tasks of their own.
5. The links found connect each component; alternating stars give its smallest document.

Hashes have 64 bits; a bucket keeps 48 of them and, for the other 16, its own number.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..operators.components import components
from ..sources.io import cut
from .base import fresh, lower_ascii, slices, table

WORDS = 5
#: A link: NEED[0] * union <= NEED[1] * intersection.
NEED = (75, 100)
#: Shingles in a bucket, on average.
BUCKET_TOKENS = 1 << 21
#: A family with more shingles than this is split into several trees.
FAMILY_TOKENS = 1 << 21
#: A shingle in this many entities of one slice is kept out of the buckets: it comes last in the order, with the
#: others of its kind. At most MOST_FREQUENT, those seen most often; the list does not grow beyond that.
FREQUENT, MOST_FREQUENT = 256, 1 << 19
BITS, LEAF, FAN = 1024, 8, 8


# ---- sets -------------------------------------------------------------------------------------------------------

def shingles(text: bytes) -> tuple[int, np.ndarray]:
    """Key of the word sequence and the sorted, distinct hashes of its shingles."""
    words = lower_ascii(text).split()
    joined = b" ".join(words)
    h = xxhash.xxh3_64_intdigest
    if len(words) <= WORDS:
        return h(joined), np.array([h(joined)] if words else [], dtype=np.uint64)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1).tolist()
    starts = [0, *ends]
    return h(joined), np.unique(np.array([h(joined[s:e - 1]) for s, e in zip(starts, ends[WORDS - 1:])], dtype=np.uint64))


def _signed(x: np.ndarray) -> np.ndarray:
    return np.asarray(x, dtype=np.uint64).view(np.int64)


def overlap_needed(n: int) -> int:
    """Least overlap of a set of ``n`` with anything it links with: intersection >= 0.75 union >= 0.75 n."""
    return -(-NEED[0] * n // NEED[1])


def linked(n: int, m: int, common: int) -> bool:
    return NEED[1] * common >= NEED[0] * (n + m - common) and common > 0


# ---- packed columns ---------------------------------------------------------------------------------------------

def _pack(ents: np.ndarray, toks: np.ndarray, dfs: np.ndarray | None = None) -> bytes:
    """Entities and tokens, sorted by entity, with each entity once and 48 bits of a token (and 16 of its count)."""
    keys, counts = np.unique(ents, return_counts=True)
    low = np.ascontiguousarray(toks.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :6]
    parts = [np.uint32([len(keys), len(toks)]), keys.astype("<u8"), counts.astype("<u4"), low]
    if dfs is not None:
        parts.append(dfs.astype("<u2"))
    return b"".join(np.ascontiguousarray(p).tobytes() for p in parts)


def _unpack(data: bytes, with_dfs: bool = False) -> tuple[np.ndarray, ...]:
    k, n = np.frombuffer(data, "<u4", 2).tolist()
    keys = np.frombuffer(data, "<u8", k, 8)
    counts = np.frombuffer(data, "<u4", k, 8 + 8 * k)
    wide = np.zeros((n, 8), dtype=np.uint8)
    wide[:, :6] = np.frombuffer(data, np.uint8, 6 * n, 8 + 12 * k).reshape(n, 6)
    out = (np.repeat(keys, counts), wide.view("<u8").reshape(-1))
    return (*out, np.frombuffer(data, "<u2", n, 8 + 12 * k + 6 * n)) if with_dfs else out


# ---- 1: entities ------------------------------------------------------------------------------------------------

_FIRST = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int64()), ("frequent", pa.binary())])


def _entities(docs: DataFrame) -> DataFrame:
    """(doc_id, key, n) of each document, and rows with the shingles that are frequent in a slice and their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            sets = [shingles(t) for t in texts]
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array(_signed([k for k, _ in sets])), pa.array([len(s) for _, s in sets], pa.int64()),
                pa.nulls(len(sets), pa.binary())], schema=_FIRST)
            if len(sets) >= FREQUENT:
                toks, counts = np.unique(np.concatenate([s for _, s in dict(sets).items()]), return_counts=True)
                often = counts >= FREQUENT
                if often.any():
                    data = toks[often].tobytes() + counts[often].astype(np.uint64).tobytes()
                    yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()),
                                                      pa.array([data], pa.binary())], schema=_FIRST)

    return docs.mapInArrow(run, "doc_id long, key long, n long, frequent binary")


def _frequent(first: DataFrame) -> np.ndarray:
    """Shingles that come last in the order, sorted; at most MOST_FREQUENT."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0).to_pylist():
                x = np.frombuffer(data, np.uint64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(_signed(x[0])), pa.array(x[1].astype(np.int64))], names=["token", "n"])

    rows = first.where("frequent is not null").select("frequent").mapInArrow(run, "token long, n long")
    top = rows.groupBy("token").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "token").limit(MOST_FREQUENT)
    return np.sort(np.asarray(top.toArrow()["token"], dtype=np.int64).view(np.uint64))


# ---- 2: shingles meet -------------------------------------------------------------------------------------------

_MEET = pa.schema([("bucket", pa.int32()), ("data", pa.binary())])
_SET = pa.schema([("ent", pa.int64()), ("n", pa.int64()), ("tokens", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _bucket_of(toks: np.ndarray, buckets: int) -> np.ndarray:
    """By the low 16 bits, then the next 16: any number of buckets below 2**32."""
    low = (toks & np.uint64(0xFFFF)) << np.uint64(16) | toks >> np.uint64(16) & np.uint64(0xFFFF)
    return (low * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _token(kept: np.ndarray, bucket: int, buckets: int) -> np.ndarray:
    """Tokens of a bucket from their upper 48 bits. The other 16 follow from the bucket where there are at least as
    many buckets as values; else its number stands for them, which is one for all tokens of equal bits."""
    if buckets < 1 << 16:
        return kept << np.uint64(16) | np.uint64(bucket)
    least = -(-(bucket << 32) // buckets)  # the first number of 32 bits that falls into the bucket
    middle = (kept & np.uint64(0xFFFF)).astype(np.int64)
    return kept << np.uint64(16) | (-((middle - least) // (1 << 16))).astype(np.uint64)


def _shared_sets(docs: DataFrame, frequent: np.ndarray, buckets: int) -> DataFrame:
    """(ent, n, tokens, prefix) of the entities that may link: their shingles that occur elsewhere too, sorted, and
    of those the ones in the prefix. Shingle buckets are numbered from 0; the messages that go to an entity's own
    bucket without a stop, from -1 down."""
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def owner(ents: np.ndarray) -> np.ndarray:
        return (ents >> np.uint64(20)).astype(np.int64) % buckets

    def split(where: np.ndarray, *cols: np.ndarray) -> Iterator[tuple]:
        order = np.argsort(where, kind="stable")
        edges = np.flatnonzero(np.diff(where[order])) + 1
        for part in np.split(order, edges):
            if len(part):
                yield (int(where[part[0]]), *(c[part] for c in cols))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often = shared.value
        for _, texts in slices(batches, "text", 16 << 20):
            sets = dict(shingles(t) for t in texts)
            ents = np.array([k for k, s in sets.items() if len(s)], dtype=np.uint64)
            sizes = np.array([len(s) for s in sets.values() if len(s)], dtype=np.uint64)
            if not len(ents):
                continue
            toks = np.concatenate([s for s in sets.values() if len(s)])
            of = np.repeat(ents, sizes.astype(np.int64))
            hot = np.zeros(len(toks), dtype=bool)
            if len(often):
                hot = often[np.minimum(np.searchsorted(often, toks), len(often) - 1)] == toks
            rows = []
            for b, e, t in split(_bucket_of(toks[~hot], buckets), of[~hot], toks[~hot] >> np.uint64(16)):
                order = np.argsort(e, kind="stable")
                rows.append((b, _pack(e[order], t[order])))
            for b, e, n in split(owner(ents), ents, sizes):
                rows.append((-1 - b, b"N" + np.stack([e, n]).astype("<u8").tobytes()))
            for b, e, t in split(owner(of[hot]), of[hot], toks[hot]):
                rows.append((-1 - b, b"F" + np.stack([e, t]).astype("<u8").tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([b for b, _ in rows], pa.int32()), pa.array([d for _, d in rows], pa.binary())], schema=_MEET)

    def meet(group: pa.Table) -> pa.Table:
        b = group["bucket"][0].as_py()
        if b < 0:
            return pa.table([pa.array([-1 - b] * len(group), pa.int32()), group["data"].combine_chunks()], schema=_MEET)
        parts = [_unpack(d) for d in group["data"].to_pylist()]
        ents, toks = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((ents, toks))
        ents, toks = ents[order], toks[order]
        same = np.zeros(len(toks), dtype=bool)  # an entity that several tasks saw
        same[1:] = (toks[1:] == toks[:-1]) & (ents[1:] == ents[:-1])
        ents, toks = ents[~same], toks[~same]
        first = np.flatnonzero(np.concatenate([[True], toks[1:] != toks[:-1]]))
        counts = np.diff(np.append(first, len(toks)))
        dfs = np.repeat(np.minimum(counts, 0xFFFE), counts)
        keep = dfs > 1
        rows = []
        for o, e, t, d in split(owner(ents[keep]), ents[keep], toks[keep], dfs[keep]):
            order = np.argsort(e, kind="stable")
            rows.append((o, b"T" + np.uint32([b]).tobytes() + _pack(e[order], t[order], d[order])))
        return pa.table([pa.array([o for o, _ in rows], pa.int32()), pa.array([x for _, x in rows], pa.binary())], schema=_MEET)

    def gather(group: pa.Table) -> pa.Table:
        ents, toks, dfs, size = [], [], [], {}
        for data in group["data"].to_pylist():
            if data[:1] == b"N":
                size.update(np.frombuffer(data, "<u8", offset=1).reshape(2, -1).T.tolist())
            elif data[:1] == b"F":
                e, t = np.frombuffer(data, "<u8", offset=1).reshape(2, -1)
                ents.append(e), toks.append(t), dfs.append(np.full(len(e), 0xFFFF, np.uint16))
            else:
                b = np.frombuffer(data, "<u4", 1, 1)[0]
                e, t, d = _unpack(data[5:], True)
                ents.append(e), toks.append(_token(t, int(b), buckets)), dfs.append(d)
        out = []
        if ents:
            ents, toks, dfs = np.concatenate(ents), np.concatenate(toks), np.concatenate(dfs)
            order = np.lexsort((toks, dfs, ents))
            ents, toks, dfs = ents[order], toks[order], dfs[order]
            # a frequent shingle of an entity that several tasks saw comes more than once
            same = np.zeros(len(toks), dtype=bool)
            same[1:] = (toks[1:] == toks[:-1]) & (ents[1:] == ents[:-1])
            ents, toks = ents[~same], toks[~same]
            first = np.flatnonzero(np.concatenate([[True], ents[1:] != ents[:-1]]))
            for lo, hi in zip(first, np.append(first[1:], len(ents))):
                n = size[int(ents[lo])]
                alone = n - (hi - lo)  # shingles that no one else has: the first of the order
                length = n - overlap_needed(n) + 1 - alone
                if length > 0:
                    out.append((ents[lo], n, np.sort(toks[lo:hi]).tobytes(), _signed(toks[lo:lo + length])))
        return pa.table([pa.array(_signed([x[0] for x in out])), pa.array([x[1] for x in out], pa.int64()),
                         pa.array([x[2] for x in out], pa.binary()), pa.array([x[3] for x in out], pa.list_(pa.int64()))], schema=_SET)

    sent = docs.select("text").mapInArrow(send, "bucket int, data binary")
    met = sent.groupBy("bucket").applyInArrow(meet, "bucket int, data binary")
    return met.groupBy("bucket").applyInArrow(gather, "ent long, n long, tokens binary, prefix array<long>")


# ---- 4: signature trees -----------------------------------------------------------------------------------------

class Node:
    """Sets ``lo`` to ``hi`` of a tree: OR of their bitmaps, range of their sizes, most tokens that share a bit with
    another token of their set, and the nodes below (none: a leaf)."""

    __slots__ = ("lo", "hi", "bits", "least", "most", "slack", "below", "whole")

    def __init__(self, lo, hi, bits, least, most, slack, below):
        self.lo, self.hi, self.bits, self.least, self.most, self.slack, self.below = lo, hi, bits, least, most, slack, below
        self.whole = False


class Sets:
    """Sets with a signature tree over them, like ones side by side: sorted by their smallest mixed hashes."""

    def __init__(self, ents: list[int], sizes: list[int], tokens: list[np.ndarray]) -> None:
        mixed = [np.sort(t * np.uint64(0x9E3779B97F4A7C15))[:2].tolist() for t in tokens]
        order = sorted(range(len(ents)), key=lambda i: (mixed[i], ents[i]))
        self.ents, self.sizes, self.tokens = ([x[i] for i in order] for x in (ents, sizes, tokens))
        self.bits, self.slack = np.zeros((len(order), BITS // 64), dtype=np.uint64), []
        for i, t in enumerate(self.tokens):
            at = np.unique((t >> np.uint64(20)) % np.uint64(BITS))
            np.bitwise_or.at(self.bits[i], (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
            self.slack.append(len(t) - len(at))
        level = []
        for lo in range(0, len(order), LEAF):
            hi = min(lo + LEAF, len(order))
            level.append(Node(lo, hi, np.bitwise_or.reduce(self.bits[lo:hi]), min(self.sizes[lo:hi]),
                              max(self.sizes[lo:hi]), max(self.slack[lo:hi]), ()))
        while len(level) > 1:
            level = [Node(p[0].lo, p[-1].hi, np.bitwise_or.reduce([x.bits for x in p]), min(x.least for x in p),
                          max(x.most for x in p), max(x.slack for x in p), tuple(p))
                     for p in (level[i:i + FAN] for i in range(0, len(level), FAN))]
        self.root = level[0]


def _ones(x: np.ndarray) -> int:
    return int(np.bitwise_count(x).sum())


def tree_links(a: Sets, b: Sets) -> list[tuple[int, int]]:
    """Links between the sets of ``a`` and of ``b`` (which may be ``a``) that connect whatever links connect."""
    base = 0 if a is b else len(a.ents)
    up = list(range(len(a.ents) + (0 if a is b else len(b.ents))))
    out = []

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    def whole(node, off):
        """All sets of the node are connected."""
        if not node.whole:
            r = find(node.lo + off)
            node.whole = all(find(i + off) == r for i in range(node.lo + 1, node.hi))
        return node.whole

    for side, off in ((a, 0), (b, base)):
        stack = [side.root]
        while stack:
            x = stack.pop()
            x.whole = False
            stack.extend(x.below)
    stack = [(a.root, b.root)]
    while stack:
        x, y = stack.pop()
        if 100 * min(x.most, y.most) < 75 * max(x.least, y.least):
            continue  # of two linked sets the smaller has 75 % of the larger at least
        need = overlap_needed(max(x.least, y.least))
        if _ones(x.bits & y.bits) + min(x.slack, y.slack) < need:
            continue
        if whole(x, 0) and whole(y, base) and find(x.lo) == find(y.lo + base):
            continue
        if x.below and (not y.below or x.hi - x.lo >= y.hi - y.lo) and x is not y:
            stack.extend((c, y) for c in x.below)
        elif x is y and x.below:
            stack.extend((x.below[i], x.below[j]) for i in range(len(x.below)) for j in range(i, len(x.below)))
        elif y.below:
            stack.extend((x, c) for c in y.below)
        else:
            for i in range(x.lo, x.hi):
                for j in range(i + 1 if x is y else y.lo, y.hi):
                    n, m = a.sizes[i], b.sizes[j]
                    if 100 * min(n, m) < 75 * max(n, m) or find(i) == find(j + base):
                        continue
                    if _ones(a.bits[i] & b.bits[j]) + min(a.slack[i], b.slack[j]) < overlap_needed(max(n, m)):
                        continue
                    if linked(n, m, len(np.intersect1d(a.tokens[i], b.tokens[j], assume_unique=True))):
                        up[find(i)] = find(j + base)
                        out.append((a.ents[i], b.ents[j]))
    return out


def _family_links(sets: DataFrame) -> DataFrame:
    """(u, v): links that connect the entities of each family."""
    rows = sets.select("ent", F.explode("prefix").alias("token"))
    rows = cut(rows, "jaccard-prefix")
    low = cut(rows.groupBy("token").agg(F.min("ent").alias("v"), F.count(F.lit(1)).alias("k")).where("k > 1").drop("k"), "jaccard-low")
    family = cut(components(rows.join(low, "token").select(F.col("ent").alias("u"), "v").distinct()), "jaccard-family")
    members = cut(sets.join(family, F.col("ent") == F.col("node")).select(
        F.col("component").alias("family"), "ent", "n", "tokens", (F.octet_length("tokens") / 8).cast("long").alias("k")), "jaccard-members")
    # sizes of linked sets differ by a factor of 4/3 at most: they fall into one band or into neighbours
    band = F.floor(F.log("n") / math.log(4 / 3)).cast("int")
    sums = members.groupBy("family", band.alias("band")).agg(F.sum("k").alias("k"))
    whole = Window.partitionBy("family")
    plan = cut(sums.withColumn("all", F.sum("k").over(whole)).select(
        "family", "band", F.when(F.col("all") <= FAMILY_TOKENS, 1).otherwise(F.ceil(F.col("k") * 2 / FAMILY_TOKENS)).cast("int").alias("parts"),
        (F.col("all") > FAMILY_TOKENS).alias("large")), "jaccard-plan")
    chunk = F.when(F.col("large"), F.struct("band", F.pmod(F.xxhash64("ent"), F.col("parts").cast("long")).cast("int").alias("part"))) \
        .otherwise(F.struct(F.lit(0).alias("band"), F.lit(0).alias("part")))
    placed = members.withColumn("band", band).join(plan, ["family", "band"]).select("family", "ent", "n", "tokens", "k", "large", chunk.alias("chunk"))
    # pairs of chunks of a family in one band or in neighbours; a small family has one chunk, paired with itself
    chunks = plan.where("large").select("family", F.explode(F.transform(F.sequence(F.lit(0), F.col("parts") - 1), lambda p: F.struct("band", p.alias("part")))).alias("chunk")) \
        .union(plan.where("not large").select("family", F.struct(F.lit(0).alias("band"), F.lit(0).alias("part")).alias("chunk")).distinct())
    near = chunks.select("family", F.col("chunk").alias("a"), F.explode(F.array(F.col("chunk.band"), F.col("chunk.band") + 1)).alias("to"))
    pairs = (near.join(chunks.select("family", F.col("chunk").alias("b"), F.col("chunk.band").alias("to")), ["family", "to"])
             .where("a <= b").select("family", "a", "b"))
    sides = pairs.select("family", "a", "b", F.explode(F.array_distinct(F.array("a", "b"))).alias("chunk"))
    total = int(members.agg(F.sum("k")).first()[0] or 0)
    slots = max(1, math.ceil(total / FAMILY_TOKENS), members.sparkSession.sparkContext.defaultParallelism * 2)
    tasks = placed.join(sides, ["family", "chunk"]).select(
        F.pmod(F.xxhash64("family", "a", "b"), F.lit(slots)).cast("int").alias("slot"),
        F.concat_ws(":", "family", "a.band", "a.part", "b.band", "b.part").alias("pair"), (F.col("chunk") == F.col("a")).alias("left"),
        (F.col("a") == F.col("b")).alias("self"), "ent", "n", "tokens")

    def match(group: pa.Table) -> pa.Table:
        at: dict[str, tuple[bool, list, list]] = {}
        for pair, left, self_, ent, n, tokens in zip(*(group[c].to_pylist() for c in ("pair", "left", "self", "ent", "n", "tokens")), strict=True):
            at.setdefault(pair, (self_, [], []))[1 if left else 2].append((ent, n, np.frombuffer(tokens, np.uint64)))
        out = []
        for self_, left, right in at.values():
            a = Sets(*map(list, zip(*left, strict=True))) if left else None
            b = a if self_ else Sets(*map(list, zip(*right, strict=True))) if right else None
            if a and b:
                out += tree_links(a, b)
        return pa.table({"u": pa.array([u for u, _ in out], pa.int64()), "v": pa.array([v for _, v in out], pa.int64())})

    return tasks.groupBy("slot").applyInArrow(match, "u long, v long")


# ---- the join ---------------------------------------------------------------------------------------------------

def _labelled(docs: DataFrame) -> DataFrame:
    """(doc_id, n, key, component) of each row of ``docs`` (doc_id, text): size of its set, key of its word sequence,
    least key of its component."""
    first = cut(_entities(docs), "jaccard-first")
    rows = first.where("frequent is null").select("doc_id", "key", "n")
    buckets = max(1, math.ceil((rows.agg(F.sum("n")).first()[0] or 0) / BUCKET_TOKENS))
    sets = cut(_shared_sets(docs, _frequent(first), buckets), "jaccard-sets")
    links = cut(_family_links(sets), "jaccard-links")
    comp = cut(components(links), "jaccard-components")
    # rows of one component may be a third of the table: every join is of written tables, whose keys Spark can split
    return cut(rows.join(comp, F.col("key") == F.col("node"), "left").select(
        "doc_id", "n", "key", F.coalesce("component", "key").alias("component")), "jaccard-rows")


def _narrow(docs: DataFrame, text: str, doc_id: str) -> DataFrame:
    return docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))


def jaccard_join(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id.

    Null or empty text, or one of white space: n_shingles 0, component_id the row's own id. Under five words the
    whole sequence is the one shingle. Repeated rows link with each other; a null id is no one's smallest id and its
    component has null only if it has no other id. Ties cannot arise. Other columns are not read. An empty table
    gives an empty result."""
    rows = _labelled(_narrow(docs, text, doc_id))
    least = cut(rows.groupBy("component").agg(F.min("doc_id").alias("least")), "jaccard-least")
    return rows.join(least, "component").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("least")).alias("component_id"))


def one_per_group(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (with doc_id and text) without near duplicates: of each component the row with the
    smallest id (not null if there is another) stays, with the columns of ``docs``. Texts without words are linked
    with nothing and stay. Rows that agree in id and words are one document, of which one row stays."""
    rows = _labelled(_narrow(docs, "text", "doc_id"))
    first = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "key")
    own, kept_id, kept_key, nth = (fresh(docs, c) for c in ("__key", "__kept_id", "__kept_key", "__nth"))
    kept = cut(rows.where("n > 0").groupBy("component").agg(F.min(first).alias("s")).select("s.doc_id", "s.key")
               .union(rows.where("n = 0").select("doc_id", "key").distinct())
               .select(F.col("doc_id").alias(kept_id), F.col("key").alias(kept_key)), "jaccard-kept")
    keyed = StructType([*docs.schema.fields, StructField(own, LongType())])

    def with_key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in slices(batches, "text"):
            keys = pa.array(_signed([xxhash.xxh3_64_intdigest(b" ".join(lower_ascii(t).split())) for t in texts]))
            yield pa.RecordBatch.from_arrays([*batch.columns, keys], names=[*batch.schema.names, own])

    joined = docs.mapInArrow(with_key, keyed).join(
        kept, F.col("doc_id").cast("long").eqNullSafe(F.col(kept_id)) & (F.col(own) == F.col(kept_key)))
    one = Window.partitionBy(kept_id, kept_key).orderBy("text")
    return joined.withColumn(nth, F.row_number().over(one)).where(F.col(nth) == 1).select(*[F.col(c) for c in docs.columns])


def op6_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
