import hashlib
import io
import os

import pyarrow.parquet as pq
import zstandard

from riskgraph.llm import warc
from riskgraph.session import scratch_path

SF = "/root/testdata/sf0.01"


def brute(rows):
    last = {}
    for i, _, h in rows:
        if i is not None and len((h or "").encode()) >= 1000:
            last[h] = max(i, last.get(h, i))
    out = []
    for i, _, h in rows:
        b = (h or "").encode()
        to = last.get(h) if len(b) >= 1000 and i is not None and i != last[h] else None
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "response" if to is None else "revisit", to))
    return sorted(out, key=str)


def rows_of(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def made():
    long = "<p>é</p>" * 200
    rows = [(i, f"http://h/{i}%20\n", long if i % 3 == 0 else f"<a>{i % 20}</a>" * (i % 150)) for i in range(200)]
    return rows + [(300, None, None), (301, "", ""), (None, "u", long), (500, "u", long), (500, "u", long), (502, "x\r\n\r\ny", "WARC/1.1\r\n\r\n" * 300)]


def test_round_trip(spark, monkeypatch):
    monkeypatch.setattr(warc, "FRAME_BYTES", 3000)
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 2000)
    rows = made()
    folder = scratch_path(spark, "warc-test")
    index = warc.write_archives(spark.createDataFrame(rows, "page_id long, url string, html string"), folder)
    got = warc.read_archives(spark, index)
    assert rows_of(got) == brute(rows)
    payloads = {r.page_id: bytes(r.payload) for r in got.collect() if r.record_type == "response"}
    texts = {i: (h or "").encode() for i, _, h in rows}
    assert all(b == texts[i] for i, b in payloads.items())
    assert {r.page_id: r.url for r in got.collect()} == {i: u for i, u, _ in rows}


def test_bundles_are_plain_zstd_with_a_seek_table(spark):
    folder = scratch_path(spark, "warc-test")
    index = warc.write_archives(spark.read.parquet(f"{SF}/pages.parquet"), folder)
    rows = index.collect()
    for name in {r.file for r in rows}:
        data = open(name.removeprefix("file://"), "rb").read()
        stream = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
        frames = warc.read_seek_table(data)
        assert len(stream) == sum(n for _, _, n in frames)
        at, seen = 0, 0
        while at < len(stream):
            _, _, at = warc.read_record(stream, at)
            seen += 1
        assert seen == sum(r.file == name for r in rows)
    assert not [f for f in os.listdir(folder.removeprefix("file://")) if not f.endswith(".warc.zst") and not f.endswith(".crc")]
    some = rows[len(rows) // 2]
    one = warc.lookup(index, [some.record_id]).collect()
    assert [r.page_id for r in one] == [some.page_id]


def test_table(spark):
    t = pq.read_table(f"{SF}/pages.parquet")
    rows = list(zip(t["page_id"].to_pylist(), t["url"].to_pylist(), t["html"].to_pylist()))
    assert rows_of(warc.op10_warc(spark, SF)) == brute(rows)


def test_empty_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "u", "h", "x", 2)], "page_id long, url string, html string, digest string, refers_to long")
    read = lambda d: warc.read_archives(spark, warc.write_archives(d, scratch_path(spark, "warc-test"))).collect()
    assert read(df.limit(0)) == []
    assert [(r.page_id, r.record_type) for r in read(df)] == [(1, "response")]


def test_bundles_are_read_by_as_many_tasks(spark, monkeypatch, tmp_path):
    from riskgraph.llm import warc
    monkeypatch.setattr(warc, "BUNDLE_BYTES", 20)
    long = "0123456789" * (warc.FRAME_BYTES // 10)  # a frame and a bundle of its own for each page
    pages = spark.createDataFrame([(i, f"u{i}", long + str(i)) for i in range(24)], "page_id long, url string, html string").repartition(2)
    index = warc.write_archives(pages, str(tmp_path / "w"))
    n = index.select("file").distinct().count()
    back = warc.read_archives(spark, index)
    assert n > 8 and back.rdd.getNumPartitions() == n and back.count() == 24
