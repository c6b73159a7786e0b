"""Operator 10: WARC archives as seekable Zstandard bundles.

Each bundle is a file of independent Zstandard frames, each of which holds a group of WARC records, and a skippable
frame at the end with the seek table of the public seekable format (compressed and decompressed size per frame). Any
zstd tool unpacks a bundle as one stream. An index maps record identifiers to (file, frame, offset within the frame,
length), so one record costs one small read and one frame.

A page whose payload has at least ``MIN_REVISIT`` bytes and equals that of a page with a larger id is written as a
`revisit` record, which names that page's record and the digest and length of the payload, without the payload.
"""

from __future__ import annotations

import hashlib
import struct
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path
from ..sources.io import cut
from .base import record_batch, slices, table

MIN_REVISIT = 1000
FRAME_BYTES = 1 << 18
#: A bundle is closed at this many compressed bytes; a task writes as many as its rows fill.
BUNDLE_BYTES = 8 << 20
LEVEL = 3
SKIPPABLE, SEEKABLE = 0x184D2A5E, 0x8F92EAB1
DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

INDEX_DDL = "page_id long, record_id string, file string, frame int, frame_start long, frame_bytes int, offset int, length int"
INDEX = pa.schema([("page_id", pa.int64()), ("record_id", pa.string()), ("file", pa.string()), ("frame", pa.int32()),
                   ("frame_start", pa.int64()), ("frame_bytes", pa.int32()), ("offset", pa.int32()), ("length", pa.int32())])
RECORD_DDL = ("page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, "
              "record_id string, url string, payload binary")
RECORD = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()),
                    ("record_type", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()),
                    ("url", pa.string()), ("payload", pa.binary())])


def record_id(page_id: int | None, digest: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}')}>"


def write_record(page_id, url, payload: bytes, refers_to) -> tuple[str, bytes]:
    """One WARC/1.1 record; a revisit where ``refers_to`` is an id. X- fields carry what WARC has no field for."""
    digest = hashlib.sha1(payload, usedforsecurity=False).hexdigest()
    rid = record_id(page_id, digest)
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {rid}",
            f"WARC-Date: {DATE}", "Content-Type: text/html", f"WARC-Payload-Digest: sha1:{digest}",
            f"X-Payload-Length: {len(payload)}"]
    if url is not None:
        head.append("WARC-Target-URI: " + url.replace("%", "%25").replace("\r", "%0D").replace("\n", "%0A"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"X-Refers-To-Page: {refers_to}"]
        payload = b""
    head.append(f"Content-Length: {len(payload)}")
    return rid, "\r\n".join(head).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n"


def read_record(data: bytes, at: int) -> tuple[dict[str, str], bytes, int]:
    """Header fields and block of the record at ``at``, and where the next one starts."""
    end = data.index(b"\r\n\r\n", at)
    lines = data[at:end].decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError(f"no WARC record at {at}")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    n = int(fields["Content-Length"])
    body = data[end + 4:end + 4 + n]
    if len(body) != n or data[end + 4 + n:end + 8 + n] != b"\r\n\r\n":
        raise ValueError("record cut short")
    return fields, body, end + 8 + n


def seek_table(frames: list[tuple[int, int]]) -> bytes:
    body = b"".join(struct.pack("<II", c, d) for c, d in frames) + struct.pack("<IBI", len(frames), 0, SEEKABLE)
    return struct.pack("<II", SKIPPABLE, len(body)) + body


def read_seek_table(data: bytes) -> list[tuple[int, int, int]]:
    """(start, compressed bytes, bytes) of each frame, from the footer."""
    n, _, magic = struct.unpack("<IBI", data[-9:])
    if magic != SEEKABLE:
        raise ValueError("no seek table")
    out, at = [], 0
    for i in range(n):
        c, d = struct.unpack_from("<II", data, len(data) - 9 - 8 * (n - i))
        out.append((at, c, d))
        at += c
    return out


class Bundle:
    """Collects records into frames; ``close`` returns the bytes of the file and its index rows."""

    def __init__(self) -> None:
        self.z = zstandard.ZstdCompressor(level=LEVEL, write_content_size=True)
        self.frames, self.out, self.size, self.index = [], [], 0, []
        self.open, self.filled, self.rows = [], 0, []

    def add(self, page_id, rid: str, record: bytes) -> None:
        self.rows.append((page_id, rid, self.filled, len(record)))
        self.open.append(record)
        self.filled += len(record)
        if self.filled >= FRAME_BYTES:
            self.end_frame()

    def end_frame(self) -> None:
        if self.open:
            packed = self.z.compress(b"".join(self.open))
            self.index += [(p, r, len(self.frames), self.size, len(packed), o, n) for p, r, o, n in self.rows]
            self.frames.append((len(packed), self.filled))
            self.out.append(packed)
            self.size += len(packed)
            self.open, self.filled, self.rows = [], 0, []

    def close(self) -> tuple[bytes, list[tuple]]:
        self.end_frame()
        return b"".join([*self.out, seek_table(self.frames)]), self.index


def _store(folder: str, name: str, data: bytes) -> str:
    """Put a file into ``folder``, which all executors share, by the store its URI names. It appears whole under its
    last name or not at all, and a second attempt of the same task writes the same bytes under the same name."""
    fs, path = pa.fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder}")
    fs.create_dir(path, recursive=True)
    part = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(part) as f:
        f.write(data)
    fs.move(part, f"{path}/{name}")
    return f"{folder if '://' in folder else f'file://{folder}'}/{name}"


def revisits(pages: DataFrame) -> DataFrame:
    """(page_id, digest, refers_to) of the pages that are revisits. Only ids and digests are shuffled; the largest id
    of each payload comes from partial maxima, and both sides of the join are written tables, so that Spark can
    split a payload that a third of the pages share."""
    body = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    keys = cut(pages.where(F.octet_length("html") >= MIN_REVISIT)
               .select("page_id", F.sha1(body).alias("digest"), F.xxhash64(body).alias("check")), "warc-keys")
    last = cut(keys.groupBy("digest", "check").agg(F.max("page_id").alias("refers_to"), F.count(F.lit(1)).alias("n"))
               .where("n > 1 and refers_to is not null").drop("n"), "warc-last")
    return (keys.join(last, ["digest", "check"]).where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
            .select("page_id", "digest", "refers_to"))


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Write the pages as bundles into ``folder``; returns the index, one row per record, read from where it was
    written. Null html: empty payload. A null id makes a response without X-Page-ID. Rows that repeat a page id are
    records of their own; those with the largest id of a payload are all responses. Other columns are ignored."""
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                          F.col("html").cast("string").alias("html"))
    rev = cut(revisits(narrow), "warc-revisits")
    rev = rev.dropDuplicates(["page_id", "digest"]).select(F.col("page_id").alias("__p"), F.col("digest").alias("__d"), "refers_to")
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    rows = narrow.withColumn("digest", digest).join(rev, (F.col("page_id") == F.col("__p")) & (F.col("digest") == F.col("__d")), "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = Bundle()

        def done() -> pa.RecordBatch:
            data, index = bundle.close()
            name = f"{hashlib.sha1(data, usedforsecurity=False).hexdigest()}.warc.zst"
            path = _store(folder, name, data)
            cols = list(zip(*index, strict=True))
            return record_batch(INDEX, dict(zip(INDEX.names, [cols[0], cols[1], [path] * len(index), *cols[2:]], strict=True)))

        for batch, texts in slices(batches, "html"):
            for page_id, url, to, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(),
                                                 batch.column(3).to_pylist(), texts, strict=True):
                bundle.add(page_id, *write_record(page_id, url, payload, to))
                if bundle.size >= BUNDLE_BYTES:
                    yield done()
                    bundle = Bundle()
        bundle.end_frame()
        if bundle.index:
            yield done()

    return cut(rows.select("page_id", "url", "html", "refers_to").mapInArrow(run, INDEX_DDL), "warc-index")


def _rows(records: list[tuple[dict[str, str], bytes]]) -> pa.RecordBatch:
    def url(f):
        u = f.get("WARC-Target-URI")
        return None if u is None else u.replace("%0A", "\n").replace("%0D", "\r").replace("%25", "%")

    number = lambda f, k: int(f[k]) if k in f else None
    return record_batch(RECORD, {
        "page_id": [number(f, "X-Page-ID") for f, _ in records],
        "payload_bytes": [int(f["X-Payload-Length"]) for f, _ in records],
        "payload_digest": [hashlib.sha1(b, usedforsecurity=False).hexdigest() if f["WARC-Type"] == "response"
                           else f["WARC-Payload-Digest"].removeprefix("sha1:") for f, b in records],
        "record_type": [f["WARC-Type"] for f, _ in records],
        "refers_to": [number(f, "X-Refers-To-Page") for f, _ in records],
        "record_id": [f["WARC-Record-ID"] for f, _ in records], "url": [url(f) for f, _ in records],
        "payload": [b for _, b in records]})


def read_archives(spark: SparkSession, index: DataFrame) -> DataFrame:
    """All records of the bundles that ``index`` names, a frame at a time: each frame is found by the index, checked
    against the seek table, unpacked on its own and walked record by record."""
    frames = index.groupBy("file", "frame", "frame_start", "frame_bytes").agg(
        F.collect_list(F.struct("offset", "length")).alias("at"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z, last, fs, f, seeks = zstandard.ZstdDecompressor(), None, None, None, []
        for batch in batches:
            for r in batch.to_pylist():
                if r["file"] != last:
                    if f is not None:
                        f.close()
                    fs, path = pa.fs.FileSystem.from_uri(r["file"])
                    f, last = fs.open_input_file(path), r["file"]
                    f.seek(f.size() - 9)
                    n = struct.unpack("<IBI", f.read(9))[0]
                    f.seek(f.size() - 9 - 8 * n)
                    seeks = read_seek_table(f.read(8 * n + 9))
                start, packed, size = seeks[r["frame"]]
                if (start, packed) != (r["frame_start"], r["frame_bytes"]):
                    raise ValueError(f"index and seek table disagree on frame {r['frame']} of {last}")
                f.seek(start)
                data = z.decompress(f.read(packed))
                if len(data) != size:
                    raise ValueError("frame cut short")
                out = []
                for x in sorted(r["at"], key=lambda x: x["offset"]):
                    fields, body, end = read_record(data, x["offset"])
                    if end - x["offset"] != x["length"]:
                        raise ValueError("index and record disagree")
                    out.append((fields, body))
                yield _rows(out)
        if f is not None:
            f.close()

    # as many tasks as bundles: left to itself, Spark would merge them by the size of the index
    bundles = max(1, index.select("file").distinct().count())
    return frames.repartition(bundles, "file").sortWithinPartitions("file", "frame").mapInArrow(run, RECORD_DDL)


def lookup(index: DataFrame, record_ids: list[str]) -> DataFrame:
    """Only the named records: reads the frames that hold them."""
    return read_archives(index.sparkSession, index.where(F.col("record_id").isin(record_ids)))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = write_archives(table(spark, sf_dir, "pages"), scratch_path(spark, "warc"))
    return read_archives(spark, index).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE_WARC = """
select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest,
  case when strlen(html) >= 1000 and page_id < max(page_id) over (partition by html) then 'revisit' else 'response' end as record_type,
  case when strlen(html) >= 1000 and page_id < max(page_id) over (partition by html)
       then max(page_id) over (partition by html) end as refers_to
from pages
"""
