"""Distributions (H1-H5): histograms, density, Gaussian KDE, describe."""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import describe


def histogram(df: DataFrame, col: str, bins: int, by: Sequence[str] = (), stat: str = "count") -> DataFrame:
    """H1/H2: ``bins`` equal-width bins between the (group's) min and max,
    last bin closed, empty bins included (numpy semantics). Output: by…,
    bin (0-based), bin_lo, bin_hi, count (and density for stat='density').

    The per-group min/max/n table is joined back (one row per group; for no
    group it is one row and broadcast). Bins are enumerated from that table
    with a fixed-size sequence, so empty bins need no cross join."""
    by = list(by)
    x = F.col(col).cast("double")
    base = df.where(x.isNotNull()).select(*by, x.alias("__x"))
    stats = base.groupBy(*by).agg(F.min("__x").alias("__mn"), F.max("__x").alias("__mx"),
                                  F.count(F.lit(1)).alias("__n"))
    width = (F.col("__mx") - F.col("__mn")) / bins
    if by:
        j = base.join(stats, by)
    else:
        # one global row: attach it as scalar subqueries (evaluated once)
        j = base.select("__x", stats.select("__mn").scalar().alias("__mn"),
                        stats.select("__mx").scalar().alias("__mx"), stats.select("__n").scalar().alias("__n"))
    b = F.when(F.col("__mx") == F.col("__mn"), F.lit(0)).otherwise(
        F.least(F.floor((F.col("__x") - F.col("__mn")) * bins / (F.col("__mx") - F.col("__mn"))), F.lit(bins - 1)))
    counts = j.groupBy(*by, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    grid = stats.select(*by, "__mn", "__mx", "__n", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin"))
    out = (grid.join(counts, [*by, "bin"], "left")
           .select(*by, "bin",
                   (F.col("__mn") + F.col("bin") * width).alias("bin_lo"),
                   F.when(F.col("bin") == bins - 1, F.col("__mx"))
                    .otherwise(F.col("__mn") + (F.col("bin") + 1) * width).alias("bin_hi"),
                   F.coalesce(F.col("count"), F.lit(0)).cast("bigint").alias("count"),
                   "__n", "__mx", "__mn"))
    if stat == "density":
        w = F.when(F.col("__mx") == F.col("__mn"), F.lit(1.0)).otherwise(width)
        out = out.withColumn("density", F.col("count") / (F.col("__n") * w))
    return out.drop("__n", "__mx", "__mn")


def kde(df: DataFrame, col: str, grid: int = 200, cut: float = 3.0) -> DataFrame:
    """H3: Gaussian KDE on ``grid`` points from min − cut·h to max + cut·h,
    Scott bandwidth h = std·n^(-1/5) (sample std). A task adds its values up
    in one array of ``grid`` numbers, which it hands on at its end; the arrays
    are then summed point by point. What is shuffled grows with the number of
    tasks, not with the values."""
    x = F.col(col).cast("double")
    base = df.where(x.isNotNull()).select(x.alias("x"))
    n, sd, lo, hi = base.agg(F.count("x"), F.stddev_samp("x"), F.min("x"), F.max("x")).first()  # four numbers
    if not n or not sd:  # no spread, no bandwidth
        none = F.lit(None).cast("double")
        return df.sparkSession.range(grid if n else 0).select(F.col("id").cast("int").alias("i"), none.alias("x"), none.alias("density"))
    h = sd * float(n) ** -0.2
    lo, hi = lo - cut * h, hi + cut * h
    points = lo + np.arange(grid) * ((hi - lo) / (grid - 1))

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = np.zeros(grid)
        for batch in batches:
            values, times = np.unique(np.asarray(batch.column(0)), return_counts=True)
            for at in range(0, len(values), 4096):
                z = (values[at:at + 4096, None] - points) / h
                state += times[at:at + 4096] @ np.exp(-0.5 * z * z)
        if state.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(grid), pa.int32()), pa.array(state)], names=["i", "s"])

    sums = base.mapInArrow(add, "i int, s double").groupBy("i").agg(F.sum("s").alias("s"))
    place = F.lit(lo) + F.col("i") * ((F.lit(hi) - F.lit(lo)) / (grid - 1))
    return sums.select("i", place.alias("x"), (F.col("s") / (n * h * math.sqrt(2 * math.pi))).alias("density"))


def describe_scores(df: DataFrame, col: str = "score", where=None) -> DataFrame:
    """Describe of a (filtered) score column."""
    d = df.where(where) if where is not None else df
    return describe(d, col)


def compare_scenarios(new_by_scenario: dict[str, DataFrame], threshold: float = 0.5) -> DataFrame:
    """H5: per scenario, new entities with score ≥ threshold and > 0."""
    out = None
    for name, df in new_by_scenario.items():
        s = F.col("score")
        row = df.agg(F.lit(name).alias("scenario"), F.count_if(s >= threshold).alias("n_high"),
                     F.count_if(s > 0).alias("n_positive"), F.count(F.lit(1)).alias("n_new"))
        out = row if out is None else out.unionByName(row)
    return out
