import pyarrow as pa

from riskgraph.llm import base


def test_slices_give_memory_back_after_the_last_one(monkeypatch):
    done = []
    monkeypatch.setattr(base, "give_back", lambda: done.append(True))
    batches = [pa.record_batch({"text": pa.array(["one", None, "three"])}), pa.record_batch({"text": pa.array([], pa.string())})]
    got = []
    for batch, texts in base.slices(iter(batches), "text", 4):
        assert not done
        got.append((batch.num_rows, texts))
    assert got == [(2, [b"one", b""]), (1, [b"three"])] and done == [True]


def test_memory_freed_by_arrow_is_given_back():
    kept = [pa.array(range(10_000)) for _ in range(200)]
    del kept
    base.give_back()
    assert pa.default_memory_pool().bytes_allocated() < 1 << 24
