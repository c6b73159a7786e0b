"""Operator 13: how far the sources of a language are from each other and from the language, term by term.

A term of a group (a source within a language) has the price p = 1 + floor(10^9 (count + 2) / (N + 2V)) with N counts
over the V kept terms, and two prices differ by floor((p - q)^2 / (p + q)). All of it is whole numbers.

1. Tasks count the terms of a slice of text, with the documents that hold them, per group, and send what belongs to a
   bucket of (language, term) hashes as one packed message. A bucket adds them up, keeps the terms in enough documents
   of their language, and gives each with its counts per source. Kept terms get dense ids in the order of their bytes.
2. A group's counts become packed arrays of (term id, count) in id order, cut at every ``BLOCK`` ids, so that no array
   grows with the vocabulary.
3. One task per unordered pair of groups and block co-groups the two arrays. A galloping intersection finds the shared
   terms; these, and the terms of one side only, are priced both ways at once, since the difference is symmetric.
   Terms that neither side has all cost the same and are multiplied at the end.
4. Against the language, the terms of a group are priced by expressions on the rows.

The pairs of a language's sources are the result asked for; nothing else is paired.
"""

from __future__ import annotations

import json
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.io import cut
from .anchors import _MSG_DDL, _messages, _steps, _sums, pack, unpack
from .base import ranked, slices, table, total

#: Documents of its language that hold a kept term; terms reported per group.
MIN_DOCS, TOP_TERMS = 10, 10
UNIT = 1_000_000_000
#: Term ids per array.
BLOCK = 1 << 16
#: Bytes of text counted at once (a longer text alone), average bytes of text behind a bucket of terms.
SLICE, BUCKET = 8 << 20, 32 << 20

#: A-Z in lower case, other ASCII but a-z as a space; bytes of other characters stay.
_FOLD = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_KEPT = pa.schema([("lang", pa.string()), ("term", pa.string()), ("lang_n", pa.int64()), ("sources", pa.list_(pa.string())), ("ns", pa.list_(pa.int64()))])
_KEPT_DDL = "lang string, term string, lang_n long, sources array<string>, ns array<long>"
_ARRAYS_DDL = "lang string, i long, block long, data binary"
_PRICED_DDL = "lang string, i long, j long, cost long, met long"


def count_slice(texts: list[bytes], group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct terms of some texts, and rows of (term, group, occurrences, documents); ``group``: of each text."""
    folded = pa.array([t.translate(_FOLD) for t in texts], pa.large_binary()).cast(pa.large_string())
    lists = pc.ascii_split_whitespace(folded)
    words, doc = lists.flatten(), np.asarray(pc.list_parent_indices(lists)).astype(np.int64)
    coded = words.dictionary_encode()
    terms, code = coded.dictionary, np.asarray(coded.indices).astype(np.int64)
    some = np.asarray(pc.binary_length(terms))[code] > 0 if len(code) else np.empty(0, bool)  # a text's ends may be spaces
    n = max(1, len(terms))
    held, times = np.unique(doc[some] * n + code[some], return_counts=True)
    key = held % n * (int(group.max(initial=0)) + 1) + group[held // n]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    occurrences = np.add.reduceat(times[order], first) if len(first) else np.empty(0, np.int64)
    return terms, key[first] // (int(group.max(initial=0)) + 1), key[first] % (int(group.max(initial=0)) + 1), occurrences, np.diff(np.append(first, len(key)))


def _bucketed(langs: list[str], sources: list[str], texts: list[bytes], buckets: int) -> pa.RecordBatch:
    """Messages of one slice: the terms of a bucket, its groups, and its rows."""
    names = list(dict.fromkeys(zip(langs, sources, strict=True)))
    place = {g: k for k, g in enumerate(names)}
    terms, code, group, n, docs = count_slice(texts, np.array([place[g] for g in zip(langs, sources, strict=True)], dtype=np.int64))
    salt = np.array([zlib.crc32(g[0].encode()) for g in names], dtype=np.int64)
    bodies = terms.cast(pa.large_binary()).to_pylist()
    where = (np.array([zlib.crc32(t) for t in bodies], dtype=np.int64)[code] ^ salt[group]) * 2654435761 % (1 << 32) * buckets >> 32
    order = np.lexsort((group, code, where))
    rows = []
    for at in np.split(order, np.flatnonzero(np.diff(where[order])) + 1):
        if len(at):
            used, local = np.unique(code[at], return_inverse=True)
            said, of = np.unique(group[at], return_inverse=True)
            mine = [bodies[c] for c in used.tolist()]
            head = json.dumps([names[k] for k in said.tolist()]).encode() + b"\0" + b" ".join(mine)
            rows.append((int(where[at[0]]), zlib.compress(head, 1) + pack(_steps(local), of, n[at], docs[at])))
    return _messages(rows)


def _added(group: pa.Table, min_docs: int) -> pa.Table:
    """Kept terms of one bucket with their counts per source."""
    place: dict[tuple[str, str], int] = {}
    terms, parts, seen = [], [], 0
    for data in group["data"].to_pylist():
        inflate = zlib.decompressobj()
        said, mine = inflate.decompress(data).split(b"\0", 1)
        local, of, n, docs = (x.astype(np.int64) for x in unpack(inflate.unused_data))
        groups = np.array([place.setdefault(tuple(g), len(place)) for g in json.loads(said)], dtype=np.int64)
        mine = mine.split(b" ")
        terms.append(pa.array(mine, pa.binary()))
        parts.append((np.cumsum(local) + seen, groups[of], n, docs))
        seen += len(mine)
    coded = pa.chunked_array(terms).combine_chunks().dictionary_encode()
    code, of, n, docs = (np.concatenate(x) for x in zip(*parts, strict=True))
    code = np.asarray(coded.indices).astype(np.int64)[code]
    names = list(place)
    langs = list(dict.fromkeys(g[0] for g in names))
    lang = np.array([langs.index(g[0]) for g in names], dtype=np.int64)
    # one number per (language, term), then per source
    term = lang[of] * len(coded.dictionary) + code
    used, term = np.unique(term, return_inverse=True)
    kept = np.bincount(term, weights=docs, minlength=len(used)) >= min_docs  # exact below 2^53
    at = np.flatnonzero(kept[term])
    key, inverse = np.unique(term[at] * len(names) + of[at], return_inverse=True)
    sums = np.zeros(len(key), dtype=np.int64)
    np.add.at(sums, inverse, n[at])
    owner = key // len(names)
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    used = used[owner[first]]
    offsets = pa.array(np.append(first, len(key)), pa.int32())
    text = coded.dictionary.take(pa.array(used % len(coded.dictionary))).cast(pa.string())
    return pa.Table.from_arrays([
        pa.array([langs[k] for k in (used // len(coded.dictionary)).tolist()], pa.string()), text,
        pa.array(np.add.reduceat(sums, first) if len(first) else np.empty(0, np.int64), pa.int64()),
        pa.ListArray.from_arrays(offsets, pa.array([names[k][1] for k in (key % len(names)).tolist()], pa.string())),
        pa.ListArray.from_arrays(offsets, pa.array(sums))], schema=_KEPT)


def price(count: np.ndarray, n: int, v: int) -> np.ndarray:
    """1 + floor(10^9 (count + 2) / (n + 2v)), exact by long division in thousands: n + 2v may be near 2^53."""
    d = n + 2 * v
    rest = np.asarray(count, dtype=np.int64) + 2
    out = rest // d
    rest = rest % d
    for _ in range(3):
        rest = rest * 1000
        out = out * 1000 + rest // d
        rest = rest % d
    return out + 1


def price_column(count: Column, n: Column, v: Column) -> Column:
    """:func:`price` on columns."""
    d = F.greatest(n + 2 * v, F.lit(1).cast("long"))  # 0 only where a language has no kept term
    rest, digits = count + 2, []
    for _ in range(4):
        digits.append(_div(rest, d))
        rest = rest % d * 1000
    return digits[0] * UNIT + digits[1] * 1_000_000 + digits[2] * 1000 + digits[3] + 1


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of two longs."""
    return F.call_function("div", a, b)


def cost(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def gallop(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Where each of the ascending ``small`` would go in the ascending ``large`` (its lower bound).

    Every 32nd probe is searched first. From its place the probes behind it double their stride until they pass their
    key, then halve the last stride: the steps grow with the logarithm of the gap, not of the array."""
    n = len(large)
    if not len(small) or not n:
        return np.zeros(len(small), dtype=np.int64)
    low = np.repeat(np.searchsorted(large, small[::32]), 32)[:len(small)].astype(np.int64)
    high, stride, on = low.copy(), 1, np.arange(len(small))
    while len(on):  # large[low - 1] < key; stop where large[high] >= key or high = n
        on = on[(high[on] < n) & (large[np.minimum(high[on], n - 1)] < small[on])]
        low[on] = high[on] + 1
        high[on] = np.minimum(high[on] + stride, n)
        stride *= 2
    while len(on := np.flatnonzero(low < high)):
        mid = (low[on] + high[on]) // 2
        less = large[mid] < small[on]
        low[on] = np.where(less, mid + 1, low[on])
        high[on] = np.where(less, high[on], mid)
    return low


def merge_cost(ids_a: np.ndarray, n_a: np.ndarray, ids_b: np.ndarray, n_b: np.ndarray, total_a: int, total_b: int, v: int) -> tuple[int, int]:
    """Summed difference over the terms that either array has, and how many these are."""
    if len(ids_a) > len(ids_b):
        ids_a, n_a, total_a, ids_b, n_b, total_b = ids_b, n_b, total_b, ids_a, n_a, total_a
    at = gallop(ids_a, ids_b)
    both = at < len(ids_b)
    both[both] = ids_b[at[both]] == ids_a[both]
    alone = np.ones(len(ids_b), dtype=bool)
    alone[at[both]] = False
    p, q = price(n_a, total_a, v), price(n_b, total_b, v)
    p0, q0 = price(np.zeros(1, np.int64), total_a, v), price(np.zeros(1, np.int64), total_b, v)
    out = cost(p[both], q[at[both]]).sum() + cost(p[~both], q0).sum() + cost(p0, q[alone]).sum()
    return int(out), len(ids_a) + len(ids_b) - int(both.sum())


def _packed(group: pa.Table) -> pa.Table:
    """The array of one group and block."""
    order = np.argsort(np.asarray(group["id"]))
    ids, ns = np.asarray(group["id"])[order], np.asarray(group["n"])[order]
    return group.select(["lang", "i", "block"]).slice(0, 1).append_column("data", pa.array([pack(_steps(ids), ns)], pa.binary()))


def _arrays(side: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(ids, counts); a block without terms of the group has no array."""
    if not side.num_rows:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    ids, ns = unpack(side["data"][0].as_py())
    return _sums(ids).astype(np.int64), ns.astype(np.int64)


def _priced(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
    lang, i, j, n_i, n_j, v, _ = (k.as_py() for k in key)
    value, met = merge_cost(*_arrays(left), *_arrays(right), n_i, n_j, v)
    return pa.table({"lang": pa.array([lang], pa.string()), "i": pa.array([i], pa.int64()), "j": pa.array([j], pa.int64()),
                     "cost": pa.array([value], pa.int64()), "met": pa.array([met], pa.int64())})


def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows with about ``SLICE`` bytes of text together, over the bounds of batches."""
    held, texts, size = [], [], 0
    for batch, some in slices(batches, "text", SLICE):
        n = sum(map(len, some))
        if held and size + n > SLICE:
            yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts
            held, texts, size = [], [], 0
        held.append(batch.select(["lang", "source"]))
        texts, size = texts + some, size + n
    if held:
        yield pa.Table.from_batches(held).combine_chunks().to_batches()[0], texts


def _texts(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    return docs.select(*[F.coalesce(docs[c].cast("string"), F.lit("")).alias(n) for c, n in ((lang, "lang"), (source, "source"), (text, "text"))])


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(counts, groups). Counts: lang, source, term, id and n of the kept terms that a group has, with lang_n (the
    term in its language). Groups: every group, terms or not, with its number ``i`` within its language, n_group and
    n_lang (summed counts) and v (kept terms)."""
    rows = _texts(docs, text, lang, source)
    buckets = max(1, math.ceil(total(rows, F.octet_length("text")) / BUCKET))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in gathered(batches):
            yield _bucketed(*(batch.column(c).to_pylist() for c in (0, 1)), texts, buckets)

    # written before it is ranked, which reads it twice
    kept = cut(rows.mapInArrow(send, _MSG_DDL).groupBy("bucket").applyInArrow(lambda g: _added(g, min_docs), _KEPT_DDL), "divergence-kept")
    kept = cut(ranked(kept, ["lang"], ["term"], "id"), "divergence-terms")
    langs = kept.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("lang_n").alias("n_lang"))
    counts = kept.select("lang", "term", "id", "lang_n", F.explode(F.arrays_zip("sources", "ns")).alias("x")) \
        .select("lang", F.col("x.sources").alias("source"), "term", "id", "lang_n", F.col("x.ns").alias("n"))
    sums = counts.groupBy("lang", "source").agg(F.sum("n").alias("n_group"))
    groups = rows.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(langs, "lang", "left")
    groups = groups.select("lang", "source", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_group", "v", "n_lang")])
    return counts, cut(ranked(groups, ["lang"], ["source"], "i"), "divergence-groups")


def pair_costs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): the difference of every two sources of a language, both ways."""
    later = groups.where("i > 0").select("lang", "i", "v", F.col("n_group").alias("n_i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("i") - 1)).alias("j"))
    pairs = cut(later.join(groups.select("lang", F.col("i").alias("j"), F.col("n_group").alias("n_j")), ["lang", "j"])
                .select("lang", "i", "j", "n_i", "n_j", "v"), "divergence-pairs")
    arrays = (counts.join(groups.select("lang", "source", "i"), ["lang", "source"])
              .select("lang", "i", _div(F.col("id"), F.lit(BLOCK).cast("long")).alias("block"), "id", "n")
              .groupBy("lang", "i", "block").applyInArrow(_packed, _ARRAYS_DDL))
    arrays = cut(arrays, "divergence-arrays")
    key = ["lang", "i", "j", "n_i", "n_j", "v", "block"]
    left = pairs.join(arrays, ["lang", "i"]).select(*key, "data")
    right = pairs.join(arrays.withColumnRenamed("i", "j"), ["lang", "j"]).select(*[F.col(c).alias(c) for c in (*key, "data")])
    priced = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_priced, _PRICED_DDL)
    sums = priced.groupBy("lang", "i", "j").agg(F.sum("cost").alias("cost"), F.sum("met").alias("met"))
    zero = F.lit(0).cast("long")
    p, q = (price_column(zero, F.col(n), F.col("v")) for n in ("n_i", "n_j"))
    absent = F.when(F.col("v") > 0, (F.col("v") - F.coalesce("met", zero)) * _div((p - q) * (p - q), p + q)).otherwise(zero)
    done = pairs.join(sums, ["lang", "i", "j"], "left").select("lang", "i", "j", (F.coalesce("cost", zero) + absent).alias("value"))
    names = groups.select("lang", "i", "source")
    done = done.join(names, ["lang", "i"]).join(names.select("lang", F.col("i").alias("j"), F.col("source").alias("other")), ["lang", "j"])
    ways = F.explode(F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item"))))
    return done.select("lang", ways.alias("w"), "value").select("lang", "w.source", "w.item", "value")


def term_costs(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, source, item, value): terms that a group has at a higher price than its language."""
    rows = counts.join(groups.select("lang", "source", "n_group", "n_lang", "v"), ["lang", "source"])
    p, q = price_column(F.col("n"), F.col("n_group"), F.col("v")), price_column(F.col("lang_n"), F.col("n_lang"), F.col("v"))
    return (rows.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
            .select("lang", "source", "item", _div((F.col("p") - F.col("q")) * (F.col("p") - F.col("q")), F.col("p") + F.col("q")).alias("value")))


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", min_docs: int = MIN_DOCS, top: int = TOP_TERMS) -> DataFrame:
    """lang, source, part, item, value, rank. Part ``pair`` has every other source of the language, part ``term`` the
    ``top`` terms that the group has above its language; ranks start at 1 per group and part, by value descending
    and item ascending in UTF-8.

    A null text, lang or source reads as empty, and '' is a group like any other. Each row is a document, repeated
    rows too. A group without terms has pairs; a language without kept terms has pairs of value 0 and no terms; a
    language of one source has no pairs. Long texts are counted whole. Other columns are not read, whatever their
    names. An empty table gives an empty result."""
    counts, groups = term_counts(docs, text, lang, source, min_docs)
    order = [F.desc("value"), F.asc("item")]
    per_group = Window.partitionBy("lang", "source").orderBy(*order)
    pairs = pair_costs(counts, groups).withColumn("rank", F.row_number().over(per_group))
    # the limit on the rank is applied before the rows of a group meet
    terms = term_costs(counts, groups).withColumn("rank", F.row_number().over(per_group)).where(F.col("rank") <= top)
    columns = ("item", F.col("value").cast("long").alias("value"), F.col("rank").cast("int").alias("rank"))
    return pairs.select("lang", "source", F.lit("pair").alias("part"), *columns) \
        .unionByName(terms.select("lang", "source", F.lit("term").alias("part"), *columns))


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"))


ORACLE_DIVERGENCE = r"""
with d as (select row_number() over () as r, coalesce(lang, '') as lang, coalesce(source, '') as source, coalesce(text, '') as text from documents),
t as (select r, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from d),
kept as (select lang, term, count(*)::hugeint as lang_n from t group by lang, term having count(distinct r) >= 10),
langs as (select lang, count(*)::hugeint as v, sum(lang_n)::hugeint as n from kept group by lang),
c as (select t.lang, t.source, t.term, count(*)::hugeint as n from t join kept using (lang, term) group by all),
g as (select d.lang, d.source, coalesce(max(s.n), 0)::hugeint as n from (select distinct lang, source from d) d
      left join (select lang, source, sum(n) as n from c group by all) s using (lang, source) group by all),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) as n, 1 + (1000000000 * (coalesce(c.n, 0) + 2)) // (g.n + 2 * l.v) as p,
             1 + (1000000000 * (k.lang_n + 2)) // (l.n + 2 * l.v) as q
      from g join langs l using (lang) join kept k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
pv as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) as value
       from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(pv.value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
          left join pv on pv.lang = a.lang and pv.source = a.source and pv.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from p where n > 0 and p > q),
u as (select lang, source, 'pair' as part, item, value from pairs union all select lang, source, 'term', item, value from terms),
k as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from u)
select lang, source, part, item, value, rank from k where part = 'pair' or rank <= 10
"""
