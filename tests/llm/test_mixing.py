import hashlib
import math
import re
from collections import Counter

import duckdb
import pytest

from riskgraph.llm import mixing

SF = "/root/testdata/sf0.01"


def targets(sizes):
    """Targets by the rule as written: {source: target}."""
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    capped = set()
    while True:
        rest = sum(sizes.values()) - sum(3 * sizes[s] for s in capped)
        share = sum(weight[s] for s in order if s not in capped) or 1
        over = {s for s in order if s not in capped and weight[s] * rest / share > 3 * sizes[s]}
        if not over:
            return {s: 3.0 * sizes[s] if s in capped else weight[s] * rest / share for s in order}
        capped |= over


def brute(rows):
    count = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += count(t)
    goal = targets(sizes)
    out = Counter()
    for i, t, s in rows:
        rate = goal[s] / sizes[s] if sizes[s] else 0.0
        u = int(hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest()[:13], 16) / 16 ** 13
        copies = math.floor(rate) + (u < rate - math.floor(rate))
        out[i, count(t), sizes[s], round(goal[s], 6), copies * count(t)] += 1
    return out


def test_rule_and_rows(spark):
    rows = [(i, "w " * (i % 9), "big" if i % 3 else f"s{i % 7}") for i in range(400)]
    rows += [(900, "a b c", None), (901, None, None), (902, "", ""), (903, "x", ""), (903, "x", ""), (None, "y z", "é"), (904, None, "none"), (905, "a\x1cb  ", "Z")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((r.doc_id, r.size, r.source_size, round(r.target, 6), r.taken) for r in mixing.mix(df).collect())
    assert got == brute(rows)
    mixed = Counter(map(tuple, mixing.mix_rows(df).collect()))
    copies = Counter()
    for (i, t, s), n in Counter(rows).items():
        copies[i, t, s] = mixed[i, t, s] / n
    for r in mixing.mix(df).collect():
        match = [c for (i, t, s), c in copies.items() if i == r.doc_id and (len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) == r.size)]
        assert r.copies in match
    assert mixing.mix_rows(df).columns == df.columns


def test_targets_on_the_table(spark):
    rows = mixing.op4_mixing(spark, SF).collect()
    source = dict(duckdb.sql(f"select doc_id, source from '{SF}/documents.parquet'").fetchall())
    taken, goal = Counter(), {}
    for r in rows:
        taken[source[r.doc_id]] += r.taken
        goal[source[r.doc_id]] = r.target
        assert r.taken <= 3 * r.size
    assert sum(goal.values()) == pytest.approx(sum(r.size for r in rows))
    assert sum(taken.values()) == pytest.approx(sum(goal.values()), rel=0.1)


def test_cap_is_met(spark):
    df = spark.createDataFrame([(1, "a", "a"), (2, "b " * 1000, "b"), (3, "c", "c")], "doc_id long, text string, source string")
    got = {r.doc_id: (r.target, r.taken) for r in mixing.mix(df).collect()}
    assert got[1] == (3.0, 3) and got[3] == (3.0, 3) and got[2][0] == 996.0


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id long, text string, source string, size long, target long")
    assert mixing.mix(df).collect() == [] == mixing.mix_rows(df).collect()


def test_clashing_column_names(spark):
    df = spark.createDataFrame([(i, "a b c", "s", 1, 2, 3, 4) for i in range(5)], "doc_id long, text string, source string, __mix_source int, __mix_size int, __mix_target int, __mix_copy int")
    got = mixing.mix_rows(df)
    assert got.columns == df.columns and got.count() == 5
