"""Column expressions and small planning helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.io import cut


def col_(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_yyyymmdd(c: Column | str) -> Column:
    """int/str yyyyMMdd → timestamp (C5); malformed text gives null."""
    return F.try_to_timestamp(col_(c).cast("string"), F.lit("yyyyMMdd"))


def parse_period(c: Column | str) -> Column:
    """int yyyyMM tax period → timestamp of its first day."""
    return F.try_to_timestamp(F.concat(col_(c).cast("string"), F.lit("01")), F.lit("yyyyMMdd"))


def product_skipping_unit_weights(fi: Column | str) -> Column:
    """Aggregate ∏ |1 − Fi| where factors equal to 0 (Fi = 1) are skipped,
    null when every factor is skipped (D1). Written as exp Σ ln so that it
    stays a partial (map-side combinable) sum."""
    return F.exp(F.sum(F.ln(F.nullif(F.abs(F.lit(1.0) - col_(fi)), F.lit(0.0)))))


def bounded_broadcast(df: DataFrame, max_rows: int) -> DataFrame:
    """Broadcast hint only behind a size check: a cheap bounded count
    (``limit(max_rows+1)``) proves the side small; otherwise the DataFrame is
    returned as is and the planner picks a shuffle join."""
    n = df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df


# Results are reported rounded to 6 decimals. Inputs here are short decimals,
# so exact ties at the 7th digit are common (e.g. 0.25 · 0.25375 = 0.0634375)
# and last-bit noise from summation order would round them either way. A
# nudge far above that noise (~1e-16) and far below the unit (1e-6) makes the
# reported value stable; the oracle applies the same rule.
ROUND_NUDGE = 1e-10


def r6(c: Column | str, digits: int = 6) -> Column:
    return F.round(col_(c) + F.lit(ROUND_NUDGE), digits)


def _placed(df: DataFrame, order: Sequence, num_partitions: int | None = None) -> DataFrame:
    """``df`` range-partitioned on ``order`` and written once, with the number
    of each row's partition as ``__pid``. Counts and ranks must both come from
    this table: a second range exchange would sample other bounds."""
    n = [num_partitions] if num_partitions else []
    return cut(df.repartitionByRange(*n, *order).withColumn("__pid", F.spark_partition_id()), "placed")


def exact_quantiles(df: DataFrame, value: str, probs: Sequence[float], by: Sequence[str] = (),
                    tiebreak: Sequence[str] = (), num_partitions: int | None = None) -> DataFrame:
    """Exact linearly interpolated quantiles (pandas ``describe``, DuckDB
    ``quantile_cont``), computed without gathering a group in one task.

    Rows are range-partitioned on (group, value, row hash), so equal values –
    even a group holding a third of all rows – spread over many tasks, and
    written once with their partition's number. Each task ranks the rows of
    one partition; per-(partition, group) counts from the same written table
    give the offsets that turn local ranks into group ranks; only the rows
    sitting on the wanted ranks are kept. A null group is a group of its own.
    Output: ``by`` columns, ``p`` and ``q``."""
    by = list(by)
    hash_cols = list(tiebreak) or [c for c in df.columns]
    keyed = (df.where(F.col(value).isNotNull())
             .select(*by, F.col(value).cast("double").alias("__v"),
                     F.xxhash64(*[F.col(c) for c in hash_cols]).alias("__t")))
    rp = _placed(keyed, [*by, "__v", "__t"], num_partitions)

    cnt = rp.groupBy("__pid", *by).agg(F.count(F.lit(1)).alias("__c"))
    wgrp = Window.partitionBy(*by) if by else Window.partitionBy()
    off = (cnt.withColumn("__off", F.coalesce(
                F.sum("__c").over(wgrp.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)),
                F.lit(0)))
              .withColumn("__n", F.sum("__c").over(wgrp)))
    p_arr = F.array(*[F.lit(float(p)) for p in probs])
    tg = (off.select("__pid", *by, "__off", "__c", "__n", F.explode(p_arr).alias("p"))
          .withColumn("__pos", F.col("p") * (F.col("__n") - 1))
          .withColumn("__lo", F.floor("__pos"))
          .withColumn("__hi", F.ceil("__pos")))
    # one row per (partition, group, p, which-end) whose wanted rank lies in this partition
    ends = tg.select("__pid", *by, "p", "__pos", "__lo", "__off", "__c",
                     F.explode(F.array(
                         F.struct(F.lit(0).alias("e"), F.col("__lo").alias("rk")),
                         F.struct(F.lit(1).alias("e"), F.col("__hi").alias("rk")))).alias("__x"))
    ends = (ends.select("__pid", *by, "p", "__pos", "__lo", F.col("__x.e").alias("__e"),
                        (F.col("__x.rk") - F.col("__off")).alias("__r"), "__c")
            .where((F.col("__r") >= 0) & (F.col("__r") < F.col("__c")))
            .drop("__c"))
    ranked = rp.withColumn("__r", F.row_number().over(
        Window.partitionBy("__pid", *by).orderBy("__v", "__t")) - 1)
    # a null group is a group
    ends = ends.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], "p", "__pos", "__lo", "__e",
                       F.col("__pid").alias("__ep"), F.col("__r").alias("__er"))
    hits = (ranked.join(ends, [F.col("__pid") == F.col("__ep"), F.col("__r") == F.col("__er"),
                               *[F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)]])
            .select(*by, "p", "__pos", "__lo", "__e", "__v"))
    agg = hits.groupBy(*by, "p").agg(
        F.first("__pos").alias("__pos"), F.first("__lo").alias("__lo"),
        F.max(F.when(F.col("__e") == 0, F.col("__v"))).alias("__vlo"),
        F.max(F.when(F.col("__e") == 1, F.col("__v"))).alias("__vhi"))
    frac = F.col("__pos") - F.col("__lo")
    return agg.select(*by, "p", (F.col("__vlo") + (F.col("__vhi") - F.col("__vlo")) * frac).alias("q"))


def describe(df: DataFrame, value: str, by: Sequence[str] = (), tiebreak: Sequence[str] = ()) -> DataFrame:
    """pandas-style ``describe`` of one numeric column, optionally per group:
    count, mean, std (sample), min, 25%, 50%, 75%, max. Moments are partial
    aggregates; quartiles come from :func:`exact_quantiles`."""
    by = list(by)
    v = F.col(value).cast("double")
    moments = df.groupBy(*by).agg(
        F.count(v).alias("count"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("std"),
        F.min(v).alias("min"), F.max(v).alias("max"))
    q = exact_quantiles(df, value, [0.25, 0.5, 0.75], by=by, tiebreak=tiebreak)
    qw = q.groupBy(*by).agg(
        F.max(F.when(F.col("p") == 0.25, F.col("q"))).alias("q25"),
        F.max(F.when(F.col("p") == 0.5, F.col("q"))).alias("q50"),
        F.max(F.when(F.col("p") == 0.75, F.col("q"))).alias("q75"))
    if by:
        qw = qw.select(*[F.col(c).alias(f"__g{i}") for i, c in enumerate(by)], "q25", "q50", "q75")
        out = moments.join(qw, [F.col(c).eqNullSafe(F.col(f"__g{i}")) for i, c in enumerate(by)], "left")
    else:
        out = moments.select("*", *[qw.select(c).scalar().alias(c) for c in ("q25", "q50", "q75")])
    return out.select(*by, F.col("count").cast("bigint").alias("count"), "mean", "std", "min",
                      "q25", "q50", "q75", "max")


def distributed_rank(df: DataFrame, order: Sequence[Column], name: str = "rank",
                     num_partitions: int | None = None) -> DataFrame:
    """Exact 1-based ``row_number`` over a global order without a global
    window: rows are range-partitioned on ``order``, written once with their
    partition's number, numbered inside their partition, and shifted by the
    row counts of the partitions before them (a table of one row per
    partition, from the same written rows). ``order`` must be a total order."""
    rp = _placed(df, order, num_partitions)
    cnt = rp.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    off = cnt.select("__pid", F.coalesce(F.sum("__c").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__off"))
    local = rp.withColumn("__r", F.row_number().over(Window.partitionBy("__pid").orderBy(*order)))
    return (local.join(F.broadcast(off), "__pid")
            .withColumn(name, F.col("__off") + F.col("__r"))
            .drop("__pid", "__off", "__r"))
