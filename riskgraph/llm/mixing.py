"""Operator 4: mixing sources to target weights.

Words are summed per source; a target per source follows from its weight; target / size is the rate at which the
source repeats. A document comes out floor(rate) times and once more when a hash of its id falls under the rate's
fraction, so reruns, retries and lost executors give the same copies.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.io import cut
from .base import WORD, fresh, ranked, table

MAX_RATE = 3
SEED = "mix"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def draw(doc_id: Column, seed: str = SEED) -> Column:
    """Uniform in [0, 1), the same for an id in every run: 52 bits of an MD5. Null ids share one draw."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(16 ** 13))


def source_targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) from (source, source_size). Sources by code point, null last, weigh 1, 2, 3 and
    so on again; together they take all words, but none more than ``MAX_RATE`` times its own, and what is over is
    shared among the rest by weight until none is above.

    Each round is one aggregate over the small table of sources, which gives two whole numbers."""
    placed = ranked(sizes.withColumn("__last", F.col("source").isNull()), [], ["__last", "source"], "__place")
    ws = cut(placed.select("source", "source_size", (F.col("__place") % 3 + 1).cast("long").alias("weight")), "mix-sources")
    total, weights = ws.agg(F.sum("source_size"), F.sum("weight")).first()
    rest, share = total or 0, weights or 1
    while True:
        above = F.col("weight") * F.lit(rest) > F.lit(MAX_RATE * share) * F.col("source_size")
        capped, free = ws.agg(F.sum(F.when(above, MAX_RATE * F.col("source_size"))),
                              F.sum(F.when(~above, F.col("weight")))).first()
        new = ((total or 0) - (capped or 0), free or 1)
        if new == (rest, share):
            break
        rest, share = new
    target = F.when(above, (MAX_RATE * F.col("source_size")).cast("double")).otherwise(
        (F.col("weight") * F.lit(rest)).cast("double") / F.lit(float(share)))
    return ws.select("source", "source_size", target.alias("target"))


def rates(docs: DataFrame, text: str = "text", source: str = "source") -> DataFrame:
    """(source, source_size, target) of every source of ``docs``, written once. The partial sums before the shuffle
    leave one row per source and task, so a hot source costs no more than another."""
    sizes = docs.groupBy(docs[source].cast("string").alias("source")).agg(F.sum(word_count(docs[text])).alias("source_size"))
    return cut(source_targets(sizes), "mix-targets")


def _copies(doc_id: Column, size: Column, source_size: Column, target: Column) -> Column:
    rate = F.when(source_size > 0, target / source_size).otherwise(F.lit(0.0))
    return (F.floor(rate) + F.when(draw(doc_id) < rate - F.floor(rate), 1).otherwise(0)).cast("long")


def mix(docs: DataFrame, text: str = "text", source: str = "source", doc_id: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, size, source_size, target, copies, taken.

    Null text has size 0; a source without words has rate 0. Null is a source of its own. Repeated rows are drawn
    alike. An empty table gives an empty result. Only ids, sizes and sources meet the table of targets; Spark
    broadcasts it when its file is under the broadcast limit, else joins by shuffle and splits a hot source."""
    targets = rates(docs, text, source)
    rows = docs.select(docs[doc_id].cast("long").alias("doc_id"), docs[source].cast("string").alias("__source"),
                       word_count(docs[text]).alias("size"))
    return (rows.join(targets, F.col("__source").eqNullSafe(F.col("source")))
            .withColumn("copies", _copies(F.col("doc_id"), F.col("size"), F.col("source_size"), F.col("target")))
            .select("doc_id", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken")))


def mix_rows(docs: DataFrame) -> DataFrame:
    """The mixture itself: each row of ``docs`` as often as :func:`mix` takes it, with the columns of ``docs``."""
    source, size, target, copy = (fresh(docs, c) for c in ("__mix_source", "__mix_size", "__mix_target", "__mix_copy"))
    t = rates(docs).select(F.col("source").alias(source), F.col("source_size").alias(size), F.col("target").alias(target))
    n = _copies(docs["doc_id"], F.lit(0), F.col(size), F.col(target))
    return (docs.join(t, docs["source"].cast("string").eqNullSafe(F.col(source)))
            .withColumn(copy, F.explode(F.array_repeat(F.lit(1), n.cast("int"))))
            .select(*[docs[c] for c in docs.columns]))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE_MIX = r"""
with d as (
  select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size
  from {documents}),
s as (
  select source, sum(size)::bigint as source_size from d group by source),
w as (
  select *, (row_number() over (order by source nulls last) - 1) % 3 + 1 as weight from s),
-- sources that reach the cap are those with the least size for their weight: try each length of that list
o as (
  select *, row_number() over (order by source_size::double / weight, source nulls last) as nth from w),
c as (
  select *,
    sum(source_size) over () - 3 * coalesce(sum(source_size) over (order by nth rows between unbounded preceding and 1 preceding), 0) as rest,
    sum(weight) over (order by nth rows between current row and unbounded following) as share
  from o),
k as (
  select rest, share from c where weight * rest <= 3 * share * source_size order by nth limit 1),
t as (
  select source, source_size,
    case when weight * k.rest > 3 * k.share * source_size then (3 * source_size)::double
         else (weight * k.rest)::double / k.share::double end as target
  from o, k),
r as (
  select d.doc_id, d.size, t.source_size, t.target,
    case when t.source_size > 0 then t.target / t.source_size else 0.0 end as rate,
    ('0x' || substr(md5('mix:' || coalesce(d.doc_id::varchar, '')), 1, 13))::bigint / 4503599627370496.0 as u
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size::bigint as source_size, target,
  ((floor(rate) + case when u < rate - floor(rate) then 1 else 0 end) * size)::bigint as taken
from r
"""
