"""Operator 2: sharding by longest-processing-time scheduling.

Documents with equal text stay together. The groups, largest first, each go to the shard with the least bytes so
far, taken from a heap. The law that holds is ``bytes``: shards differ by no more than one of the last groups.

The heap needs only how many groups there are of each size: groups of one size follow each other and are
interchangeable. The histogram of sizes has at most sqrt(2 * bytes of all text) entries, since that many different
sizes already add up to the bytes; with K shards its schedule is K counts for each size. Neither groups nor
documents reach the driver. A run of groups of one size fills the shards level, so only its ends take heap steps.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import cut
from .base import ranked, table

SHARDS = 8


def schedule(sizes: list[tuple[int, int]], shards: int = SHARDS) -> list[tuple[int, list[int]]]:
    """Longest-processing-time schedule of ``sizes`` = (size, number of groups of it): for each size the number of
    its groups that each shard takes. The shard with the least load comes next, the lowest number at a tie.

    Of many groups of one size, most are dealt without the heap: as long as every shard stays at or under the
    highest load, the heap only fills the valley below it; from then on it goes round the shards."""
    heap = [(0, s) for s in range(shards)]
    out = []
    for size, n in sorted(sizes, reverse=True):
        took = [0] * shards
        if n > 4 * shards:
            top = max(load for load, _ in heap)
            fill = [((top - load) // size, s) for load, s in heap]
            if sum(f for f, _ in fill) <= n:
                loads = {s: load for load, s in heap}
                for f, s in fill:
                    took[s] += f
                    loads[s] += f * size
                n -= sum(f for f, _ in fill)
                # all loads are now within one size below the top: each round gives every shard one group
                rounds, n = divmod(n, shards)
                for s in range(shards):
                    took[s] += rounds
                    loads[s] += rounds * size
                heap = [(load, s) for s, load in loads.items()]
                heapq.heapify(heap)
        for _ in range(n):
            load, s = heap[0]
            took[s] += 1
            heapq.heapreplace(heap, (load + size, s))
        out.append((size, took))
    return out


def _plan_frame(spark: SparkSession, plan: list[tuple[int, list[int]]], shards: int) -> DataFrame:
    """(gsize, first, shard): the groups of a size with ranks from ``first`` on belong to ``shard``."""
    counts = np.array([t for _, t in plan], dtype=np.int64).reshape(-1, shards)
    ends = np.cumsum(counts, axis=1)
    keep = counts > 0
    at, shard = np.nonzero(keep)
    sizes = np.array([s for s, _ in plan], dtype=np.int64)
    t = pa.table({"gsize": sizes[at], "first": (ends - counts)[keep], "last": ends[keep] - 1,
                  "shard": shard.astype(np.int32)})
    return spark.createDataFrame(t)


def shard_rows(docs: DataFrame, shards: int = SHARDS, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Every row of ``docs`` with its shard: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    Size: UTF-8 bytes of the text plus 1; a null text counts as empty and joins the group of empty texts. Repeated
    rows are rows of their own in one group. Slots count the rows of a shard from 0, by doc_id (null first); rows
    that agree in everything may swap slots. An empty table gives an empty result. Text never leaves its scan: only
    ids, sizes and hashes are shuffled."""
    spark = docs.sparkSession
    body = F.coalesce(docs[text].cast("string"), F.lit(""))
    rows = cut(docs.select(
        docs[doc_id].cast("long").alias("doc_id"), (F.octet_length(body).cast("long") + 1).alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"), F.sha2(body, 256).alias("key")), "shard-rows")
    groups = cut(rows.groupBy("key").agg(F.sum("size").alias("gsize")), "shard-groups")
    histogram = groups.groupBy("gsize").agg(F.count(F.lit(1)).alias("n"))
    counts = histogram.toArrow()
    plan = _plan_frame(spark, schedule(list(zip(*(counts[c].to_pylist() for c in ("gsize", "n")), strict=True)), shards), shards)
    order = ranked(groups, ["gsize"], ["key"], "rank")
    # the ranges of a size are at most `shards` rows, so this join makes no pairs to speak of
    placed = cut(order.join(plan, "gsize").where("rank between first and last").select("key", "shard"), "shard-placed")
    out = rows.join(placed, "key").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("key").alias("__key"))
    return (ranked(out, ["shard"], ["doc_id", "__key"], "slot")
            .select("doc_id", "size", "text_crc32", "law", "shard", "slot", F.lit(None).cast("int").alias("grown_shard")))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_rows(table(spark, sf_dir, "documents"))
