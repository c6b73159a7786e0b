"""Operator 12: alignment of the tokens of two tokenizers, and the corpus counts of the id pairs that it links.

Tokenizer A is byte-level BPE, B a SentencePiece model that puts a space before the text. Both cover the same bytes,
a space and the text. Byte offsets where tokens of both end cut them into groups; tokens whose bytes overlap are
linked.

1. A text is tokenised whole by both. The bytes of its tokens are compared with the text; one that a tokenizer does
   not give back has no tokens here.
2. An anchor is an end that both share before a token that starts with a space on both sides. Anchors split a
   document into windows of token ids, mostly a word. The alignment of a window depends on its two tuples of ids
   alone, so a task works it out once and looks it up after that; new windows are worked out many at once.
3. A slice of documents (``SLICE_BYTES`` of text) is one written row: its windows, its distinct id pairs, and how many
   of its documents hold each pair. Spark adds the counts up over slices.
4. The counts are joined back to the slices' pairs, which are few beside the links, and summed over the windows.

Both tokenizers are asked for text in units, cut at single spaces between visible characters, and remember these.
That is exact where the tokenizer's own rules cut there too: A's pattern takes a space with what follows it, and no
piece of B goes on after a mark that follows another character. A vocabulary of B with such a piece is given whole
texts instead. Where A's merges are in the order of its ids, as here, a faster library takes its units of Latin
letters, digits and signs: it merges by ids, which is then the same.
"""

from __future__ import annotations

import functools
import hashlib
import io
import itertools
import json
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import cut
from .base import record_batch, slices, table

MODEL_A, MODEL_B = "/opt/tokenizers/byte_bpe_50k.json", "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
#: Bytes of text in a slice; units and windows that a task remembers when it starts a slice; longest window remembered.
SLICE_BYTES, REMEMBERED, LONGEST = 4 << 20, 300_000, 64
#: Units given to a tokenizer at once, windows looked up at once.
ASKED, LOOKED_UP = 4096, 1 << 16
#: Units from this length on go to A's own library, whose time does not grow with the square of a unit.
LATIN_MOST = 512
#: Characters that no tokenizer takes for white space: a space between two of them is a cut.
VISIBLE = "!-~¡-ᙿ‰-⁞、-퟿"
#: A space that is no cut: without a visible character before or after it.
_ODD = re.compile(f" (?![{VISIBLE}])|(?<![{VISIBLE}]) ")
_SEEN = re.compile(f"[{VISIBLE}]")

#: Text on which pre-tokenizers of all Unicode versions agree, and the pattern of byte-level BPE.
_LATIN = re.compile("[ -~\u00a1-\u00ac\u00ae-\u017f]+")
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Between the ids of A and of B in the key of a window.
_BETWEEN = b"\xff\xff\xff\xff"

_SLICES = pa.schema([("payload", pa.binary()), ("pairs", pa.list_(pa.int64())), ("docs", pa.list_(pa.int64()))])
_SLICES_DDL = "payload binary, pairs array<long>, docs array<long>"
_RESULT = pa.schema([("doc_id", pa.int64()), *((c, pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")),
                     ("groups_sha256", pa.string()), ("groups", pa.string())])
_RESULT_DDL = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string, groups string"


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself where it is visible, else the next
    character from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = sorted(set(range(256)) - set(own))
    return {chr(c): b for b, c in [*((b, b) for b in own), *((b, 256 + i) for i, b in enumerate(rest))]}


class ByteLevel:
    """Tokenizer A from the text of its file."""

    def __init__(self, model: bytes) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_str(model.decode("utf-8"))
        self.own.encode_special_tokens = True
        byte_of = byte_characters()
        vocabulary = self.own.get_vocab(with_added_tokens=True)
        self.bytes = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes[i] = bytes(byte_of[c] for c in token)
        self.units = True
        self.ranks = self._by_rank(json.loads(model), byte_of)

    @staticmethod
    def _by_rank(file: dict, byte_of: dict[str, int]):
        """The same BPE by ranks, if the k-th merge makes the token of the k-th id after the bytes'; else None."""
        model, pre = file["model"], file.get("pre_tokenizer") or {}
        plain = (file.get("normalizer") is None and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
                 and model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges")))
        merges = [m.split(" ") if isinstance(m, str) else m for m in model.get("merges", ())]
        if not plain or any(model["vocab"].get(a + b) != 256 + k for k, (a, b) in enumerate(merges)):
            return None
        import tiktoken

        ranks = {bytes(byte_of[c] for c in t): i for t, i in model["vocab"].items() if i < 256 + len(merges)}
        return tiktoken.Encoding("units", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(self, units: list[str]) -> list[list[int]]:
        if self.ranks is None:
            return [e.ids for e in self.own.encode_batch_fast(units, add_special_tokens=False)]
        fast = [len(u) < LATIN_MOST and bool(_LATIN.fullmatch(u)) for u in units]
        others = iter(self.own.encode_batch_fast([u for u, f in zip(units, fast, strict=True) if not f], add_special_tokens=False))
        encode = self.ranks.encode_ordinary
        return [encode(u) if f else next(others).ids for u, f in zip(units, fast, strict=True)]


class Pieces:
    """Tokenizer B from its model file. Units start with the space that it adds itself."""

    def __init__(self, model: bytes) -> None:
        import sentencepiece

        self.own = sentencepiece.SentencePieceProcessor(model_proto=model)
        pieces = [self.own.id_to_piece(i) for i in range(self.own.get_piece_size())]
        self.bytes = [bytes([int(p[3:5], 16)]) if self.own.is_byte(i) else p.replace(MARK, " ").encode("utf-8") for i, p in enumerate(pieces)]
        self.units = not any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces)

    def encode(self, units: list[str]) -> list[list[int]]:
        return self.own.encode([u[1:] for u in units], num_threads=1)


def units(text: str) -> list[str]:
    """``text`` (not empty) cut at each single space between visible characters, which is left out: each unit has one
    space before it, the first too."""
    if _ODD.search(text) is None:
        return text.split(" ")
    words = text.split(" ")
    out, open_ = [], [words[0]]
    for before, w in zip(words, words[1:]):
        if _SEEN.match(before[-1:]) and _SEEN.match(w):
            out.append(" ".join(open_))
            open_ = [w]
        else:
            open_.append(w)
    return [*out, " ".join(open_)]


class Aligner:
    """Both tokenizers with what has been worked out for units and windows so far."""

    def __init__(self, a: ByteLevel, b: Pieces) -> None:
        self.a, self.b = a, b
        self.split = a.units and b.units
        self.len_a, self.len_b = [len(x) for x in a.bytes], [len(x) for x in b.bytes]
        self.size_a, self.size_b = (np.array(x, dtype=np.int64) for x in (self.len_a, self.len_b))
        self.space_a, self.space_b = (np.array([x[:1] == b" " for x in t.bytes]) for t in (a, b))
        # an id with what may follow it: "," or "|" for A, then "," or ";" or the end of a window for B
        self.words = [f"{i}{c}" for n, signs in ((len(a.bytes), ",|"), (len(b.bytes), ",;\n")) for c in signs for i in range(n)]
        self.forget()

    def forget(self) -> None:
        self.known: dict[str, int] = {}  # unit without its first space: its place in the lists below
        self.ids_a: list[bytes] = []
        self.ids_b: list[bytes] = []
        self.whole: list[bool] = []  # both tokenizers give the unit's bytes back
        self.windows: dict[bytes, int] = {}
        self.text: list[str] = []
        self.n_groups: list[int] = []
        self.links: list[bytes] = []  # pairs a << 32 | b

    def learn(self, new: Iterable[str]) -> None:
        new = list(new)
        for at in range(0, len(new), ASKED):
            some = [" " + u for u in new[at:at + ASKED]]
            bodies = [u.encode("utf-8") for u in some]
            sizes = np.array(list(map(len, bodies)), dtype=np.int64)
            good = np.ones(len(some), dtype=bool)
            for tokenizer, size, kept in ((self.a, self.size_a, self.ids_a), (self.b, self.size_b, self.ids_b)):
                ids = tokenizer.encode(some)
                counts = np.array(list(map(len, ids)), dtype=np.int64)
                flat = np.array(list(itertools.chain.from_iterable(ids)), dtype="<i4")
                edges = np.concatenate([[0], np.cumsum(counts)])
                ends = np.concatenate([[0], np.cumsum(size[flat])])[edges]
                back = b"".join(map(tokenizer.bytes.__getitem__, flat.tolist()))
                if (np.diff(ends) != sizes).any() or back != b"".join(bodies):
                    ends = ends.tolist()
                    good &= [back[lo:hi] == body for lo, hi, body in zip(ends, ends[1:], bodies, strict=False)]
                raw, edges = flat.tobytes(), (4 * edges).tolist()
                kept += [raw[lo:hi] for lo, hi in zip(edges, edges[1:])]
            self.known.update(zip(new[at:at + ASKED], range(len(self.whole), len(self.whole) + len(some)), strict=True))
            self.whole += good.tolist()

    def tokens(self, texts: list[str]) -> list[list[int]]:
        """Units of each text that both tokenizers give back; none for the others."""
        cuts = [(units(t) if self.split else [t]) if t else [] for t in texts]
        self.learn(dict.fromkeys(u for c in cuts for u in c if u not in self.known))
        out = [list(map(self.known.__getitem__, c)) for c in cuts]
        return [u if all(map(self.whole.__getitem__, u)) else [] for u in out]

    def work_out(self, keys: list[bytes]) -> None:
        """Alignments of new windows, all at once: they are laid end to end, which both sides' bytes allow."""
        cut_at = [k.index(_BETWEEN) if len(k) < 64 else _between(k) for k in keys]
        a = np.frombuffer(b"".join([k[:c] for k, c in zip(keys, cut_at, strict=True)]), "<i4").astype(np.int64)
        b = np.frombuffer(b"".join([k[c + 4:] for k, c in zip(keys, cut_at, strict=True)]), "<i4").astype(np.int64)
        n_a = np.array(cut_at, dtype=np.int64) >> 2
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        side = np.zeros(int(end_a[-1]) + 1, dtype=np.int8)  # which side's tokens end at a byte
        side[end_a] = 1
        side[end_b] += 2
        shared_a, shared_b = side[end_a] == 3, side[end_b] == 3
        ends = np.flatnonzero(side)
        links = a[np.searchsorted(end_a, ends)] << 32 | b[np.searchsorted(end_b, ends)]
        stop = end_a[np.cumsum(n_a) - 1]
        n_links = np.searchsorted(ends, stop, side="right")
        n_groups = np.searchsorted(end_a[shared_a], stop, side="right")
        last = np.zeros(len(b), dtype=bool)
        last[np.searchsorted(end_b, stop)] = True
        first_b = 2 * len(self.len_a)
        said = np.concatenate([a + shared_a * len(self.len_a), first_b + b + (shared_b.astype(np.int64) + last) * len(self.len_b)])
        group = np.concatenate([2 * (np.cumsum(shared_a) - shared_a), 2 * (np.cumsum(shared_b) - shared_b) + 1])
        text = "".join(map(self.words.__getitem__, said[np.argsort(group, kind="stable")].tolist())).split("\n")
        raw, edges = links.astype("<i8").tobytes(), [0, *(8 * n_links).tolist()]
        place = len(self.text)
        self.text += text[:-1]
        self.n_groups += np.diff(n_groups, prepend=0).tolist()
        self.links += [raw[lo:hi] for lo, hi in zip(edges, edges[1:])]
        for k, key in enumerate(keys):
            self.windows[key] = place + k

    def looked_up(self, keys: list[bytes]) -> list[int]:
        """Places of the alignments of some windows."""
        get = self.windows.get
        if new := [k for k in dict.fromkeys(keys) if k not in self.windows]:
            self.work_out(new)
            places = list(map(get, keys))
            for k in new:
                if len(k) > 4 * LONGEST:
                    del self.windows[k]  # too long to come again
            return places
        return list(map(get, keys))

    def slice(self, texts: list[str]) -> dict[str, np.ndarray]:
        """Windows and counts of some documents; ``places`` has those of all their windows in order."""
        if len(self.known) > REMEMBERED or len(self.text) > REMEMBERED:
            self.forget()
        found = self.tokens(texts)
        every = [u for f in found for u in f]
        raw_a, raw_b = (b"".join(map(x.__getitem__, every)) for x in (self.ids_a, self.ids_b))
        a, b = np.frombuffer(raw_a, "<i4"), np.frombuffer(raw_b, "<i4")
        end_a, end_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # documents follow each other in both, as both give back the same bytes
        stops = np.cumsum([sum([len(self.ids_a[u]) for u in f]) >> 2 for f in found]) if found else np.empty(0, np.int64)
        n = int(end_a[-1]) if len(a) else 0
        at = np.zeros(n + 1, dtype=np.int64)  # 1 + place of B's token that ends there
        at[end_b] = np.arange(1, len(b) + 1)
        i = np.flatnonzero(at[end_a]) if len(a) else np.empty(0, np.int64)
        j = at[end_a[i]] - 1 if len(a) else i
        last = np.zeros(len(a) + 1, dtype=bool)
        last[stops[stops > 0] - 1] = True
        marked = last[i]
        inner = ~marked
        marked[inner] = self.space_a[a[i[inner] + 1]] & self.space_b[b[j[inner] + 1]]
        i, j = i[marked] + 1, j[marked] + 1
        places = np.empty(len(i), dtype=np.int64)
        for lo in range(0, len(i), LOOKED_UP):
            hi = min(len(i), lo + LOOKED_UP)
            p, q = ([int(x[lo - 1]) * 4 if lo else 0, *(x[lo:hi] * 4).tolist()] for x in (i, j))
            places[lo:hi] = self.looked_up([raw_a[x:y] + _BETWEEN + raw_b[z:w] for x, y, z, w in zip(p, p[1:], q, q[1:])])
        bounds = np.searchsorted(i, stops, side="right")  # windows up to the end of each document
        return {"places": places, "bounds": bounds, "n_a": np.diff(stops, prepend=0),
                "n_b": np.diff(np.concatenate([[0], j])[bounds], prepend=0)}


def _between(key: bytes) -> int:
    """Where the sides of a long key meet, at a whole number of ids."""
    return int(np.flatnonzero(np.frombuffer(key, "<i4") == -1)[0]) * 4


@functools.lru_cache(maxsize=2)
def aligner(a: bytes, b: bytes) -> Aligner:
    """One per Python process; what it remembers is bounded."""
    return Aligner(ByteLevel(a), Pieces(b))


def _pack(arrays: dict) -> bytes:
    out = io.BytesIO()
    np.savez(out, **arrays)
    return zstandard.ZstdCompressor(level=1).compress(out.getvalue())


def _unpack(data: bytes) -> dict:
    with np.load(io.BytesIO(zstandard.ZstdDecompressor().decompress(data)), allow_pickle=False) as f:
        return dict(f)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of each range one after the other."""
    return np.repeat(start - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum()) if len(count) else np.empty(0, np.int64)


def _slice_row(own: Aligner, doc_ids: pa.Array, texts: list[bytes], keep: bool) -> pa.RecordBatch:
    got = own.slice([t.decode("utf-8", "replace") for t in texts])
    places, bounds = got["places"], got["bounds"]
    used, window = np.unique(places, return_inverse=True)
    held_links = list(map(own.links.__getitem__, used.tolist()))
    per_window = np.array(list(map(len, held_links)), dtype=np.int64) >> 3
    codes = np.frombuffer(b"".join(held_links), "<i8")
    pairs, link = np.unique(codes, return_inverse=True)
    starts = np.cumsum(per_window) - per_window
    # documents that hold each pair: distinct windows of a document first, then distinct pairs
    doc = np.repeat(np.arange(len(texts)), np.diff(bounds, prepend=0))
    held = np.unique(doc * max(1, len(used)) + window)
    d, w = np.divmod(held, max(1, len(used)))
    held = np.unique(np.repeat(d, per_window[w]) * max(1, len(pairs)) + link[_ranges(starts[w], per_window[w])])
    docs = np.bincount(held % max(1, len(pairs)), minlength=len(pairs))
    groups = np.array(list(map(own.n_groups.__getitem__, used.tolist())), dtype=np.int64)
    sums = np.concatenate([[0], np.cumsum(groups[window])])
    digests, whole = [], []
    for lo, hi in zip([0, *bounds[:-1].tolist()], bounds.tolist(), strict=True) if len(bounds) else ():
        line = ";".join(map(own.text.__getitem__, places[lo:hi].tolist()))
        digests.append(hashlib.sha256(line.encode()).hexdigest() if line else "")
        whole.append(line)
    ids = doc_ids.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    payload = {"doc_id": ids, "no_id": np.asarray(doc_ids.is_null()), "n_a": got["n_a"], "n_b": got["n_b"],
               "n_groups": np.diff(sums[bounds], prepend=0), "sha": np.array(digests, dtype="S64"), "bounds": bounds,
               "window": window.astype(np.int32), "per_window": per_window.astype(np.int32), "link": link.astype(np.int32)}
    if keep:
        payload["groups"] = np.frombuffer("\n".join(whole).encode(), np.uint8)
    return pa.RecordBatch.from_arrays([pa.array([_pack(payload)], pa.binary()), pa.array([pairs.tolist()], pa.list_(pa.int64())),
                                       pa.array([docs.tolist()], pa.list_(pa.int64()))], schema=_SLICES)


def _finish(left: pa.Table, right: pa.Table) -> pa.Table:
    """Rows of one slice from its payload and the counts of its pairs."""
    x = _unpack(left["payload"][0].as_py())
    at = np.asarray(right["at"]).astype(np.int64)
    n, best = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
    n[at], best[at] = np.asarray(right["n"]), np.asarray(right["best"]).astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(x["per_window"].astype(np.int64))])
    bounds, out = np.concatenate([[0], x["bounds"]]).astype(np.int64), {}
    for name, values in (("n_best", best), ("count_sum", n)):
        per_window = np.diff(np.concatenate([[0], np.cumsum(values[x["link"]])])[ends])
        out[name] = np.diff(np.concatenate([[0], np.cumsum(per_window[x["window"]])])[bounds])
    links = np.diff(np.concatenate([[0], np.cumsum(x["per_window"].astype(np.int64)[x["window"]])])[bounds])
    groups = x["groups"].tobytes().decode().split("\n") if "groups" in x else [None] * len(links)
    return pa.Table.from_batches([record_batch(_RESULT, {
        "doc_id": pa.array(x["doc_id"], pa.int64(), mask=x["no_id"]), "n_a": x["n_a"], "n_b": x["n_b"], "n_groups": x["n_groups"],
        "n_links": links, **out, "groups_sha256": [s.decode() for s in x["sha"].tolist()], "groups": groups})])


def aligned(docs: DataFrame, model_a: str = MODEL_A, model_b: str = MODEL_B, text: str = "text", doc_id: str = "doc_id",
            keep_groups: bool = False) -> tuple[DataFrame, DataFrame]:
    """(documents, links). Documents: one row per row of ``docs`` with doc_id, n_a, n_b, n_groups, n_links, n_best,
    count_sum, groups_sha256 and groups (``a1,a2|b1;a3|b2``; null without ``keep_groups``). Links: a, b, n (documents
    that hold the pair linked) and best (n is the highest of a).

    A text that is null or empty, or that a tokenizer does not give back byte for byte (one that holds the mark
    itself, say), has no tokens: zeros and ''. Each row is a document, repeated rows and null ids too. Long texts are
    tokenised whole; a text without anchors is one window. Other columns are not read, whatever their names. An empty
    table gives empty results. The two model files are read where the query is planned and sent to the tasks; their
    size does not depend on the corpus."""
    models = []
    for path in (model_a, model_b):
        with open(path, "rb") as f:
            models.append(f.read())
    shared = docs.sparkSession.sparkContext.broadcast(tuple(models))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = aligner(*shared.value)
        for batch, texts in slices(batches, "text", SLICE_BYTES):
            yield _slice_row(own, batch.column(0), texts, keep_groups)

    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[text].cast("string").alias("text"))
    parts = cut(rows.mapInArrow(run, _SLICES_DDL).withColumn("slice", F.monotonically_increasing_id()), "alignment-slices")
    counts = cut(parts.select(F.explode(F.arrays_zip("pairs", "docs")).alias("x")).groupBy(F.col("x.pairs").alias("pair"))
                 .agg(F.sum("x.docs").alias("n")), "alignment-counts")
    a = F.shiftright("pair", 32)
    top = counts.groupBy(a.alias("a")).agg(F.max("n").alias("top"))
    links = cut(counts.withColumn("a", a).join(top, "a").select("pair", "a", "n", (F.col("n") == F.col("top")).alias("best")), "alignment-links")
    asked = parts.select("slice", F.posexplode("pairs").alias("at", "pair")).join(links, "pair").select(F.col("slice").alias("slice"), "at", "n", "best")
    out = parts.select("slice", "payload").groupBy("slice").cogroup(asked.groupBy("slice")).applyInArrow(_finish, _RESULT_DDL)
    return out, links.select("a", F.col("pair").bitwiseAND(F.lit((1 << 32) - 1)).alias("b"), "n", "best")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))[0].drop("groups")
