import heapq
import random
import zlib
from collections import Counter, defaultdict

import pyarrow.parquet as pq

from riskgraph.llm import sharding
from riskgraph.llm.base import ranked

SF = "/root/testdata/sf0.01"


def by_heap(sizes, shards):
    """Loads after one heap step per group."""
    heap = [(0, s) for s in range(shards)]
    for size in sorted(sizes, reverse=True):
        load, s = heap[0]
        heapq.heapreplace(heap, (load + size, s))
    return sorted(load for load, _ in heap)


def test_schedule_equals_one_step_per_group():
    rng = random.Random(1)
    for _ in range(200):
        sizes = [rng.choice([1, 2, 3, 50, rng.randint(1, 400)]) for _ in range(rng.randint(0, 400))]
        sizes += [rng.randint(1, 30)] * rng.choice([0, 0, 500])
        plan = sharding.schedule(list(Counter(sizes).items()), 8)
        loads = [0] * 8
        for size, took in plan:
            assert sum(took) == sizes.count(size)
            loads = [x + size * t for x, t in zip(loads, took)]
        assert sorted(loads) == by_heap(sizes, 8)


def check(rows, texts):
    """The contract on result rows; texts: (doc_id, text) with repeats."""
    size = lambda t: len((t or "").encode()) + 1
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in rows) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in texts)
    assert {r.law for r in rows} <= {"bytes"} and all(r.grown_shard is None and 0 <= r.shard < 8 for r in rows)
    slots = defaultdict(list)
    for r in rows:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    where = defaultdict(set)
    for r in rows:
        where[r.size, r.text_crc32].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
    groups = Counter()
    for _, t in texts:
        groups[t or ""] += size(t)
    loads = Counter()
    for r in rows:
        loads[r.shard] += r.size
    assert sorted(loads[s] for s in range(8)) == by_heap(groups.values(), 8)


def test_table(spark):
    t = pq.read_table(f"{SF}/documents.parquet")
    check(sharding.op2_sharding(spark, SF).collect(), list(zip(t["doc_id"].to_pylist(), t["text"].to_pylist())))


def test_a_hot_group_and_odd_rows(spark):
    rows = [(i, "the same text" if i % 3 == 0 else f"text {i % 40}" * (i % 7), i) for i in range(300)]
    rows += [(None, None, 1), (5, None, 1), (5, "", 1), (5, "", 1), (None, "é", 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size long")
    check(sharding.shard_rows(df).collect(), [r[:2] for r in rows])
    assert sharding.shard_rows(df.limit(0)).collect() == []


def test_ranks(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot", "hot", "a", None]), rng.random()) for _ in range(2000)]
    got = ranked(spark.createDataFrame(rows, "k string, v double"), ["k"], ["v"], "n").collect()
    by = defaultdict(list)
    for r in got:
        by[r.k].append((r.v, r.n))
    assert len(got) == 2000 and all([n for _, n in sorted(x)] == list(range(len(x))) for x in by.values())
