"""Joins of many rows with one row per key, where some keys hold very many of the rows.

``heavy_keys`` lists the keys with more than 1/(``SHARE`` · partitions) of all rows. The counts of all keys add up to
the number of rows, so the list has fewer than ``SHARE`` · partitions rows whatever the data: it may be broadcast. The
rows of such a key are dealt over as many salts as it holds such shares, and its one row on the other side is repeated
for each salt. Every other key has the one salt 0, so nothing but the heavy keys' single rows is repeated."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import shuffle_partitions
from ..sources.io import cut

#: Shares of a shuffle partition that make a key heavy: fewer than SHARE * partitions keys can hold one.
SHARE = 16


def heavy_keys(counts: DataFrame, key: str, rows: str, share: int = SHARE) -> DataFrame | None:
    """(key, __salts) of the heavy keys, or None. ``counts``: one row per key, read more than once (written)."""
    parts = share * shuffle_partitions(counts.sparkSession)
    n = counts.agg(F.sum(rows)).first()[0] or 0
    least = max(1.0, n / parts)
    heavy = counts.where((F.col(rows) > least) & F.col(key).isNotNull())
    if n < parts or heavy.limit(1).count() == 0:
        return None
    return heavy.select(key, F.ceil(F.col(rows) / least).cast("int").alias("__salts"))


def salted_join(df: DataFrame, one: DataFrame, key: str, heavy: DataFrame | None, how: str = "inner") -> DataFrame:
    """``df`` joined with ``one`` (one row per key) on ``key``; ``how``: inner, left, left_semi or left_anti. Rows of
    a heavy key are spread by a hash of the whole row, the same when a lost task runs again."""
    if heavy is None:
        return df.join(one, key, how)
    salts = F.broadcast(heavy)
    spread = F.pmod(F.xxhash64(*df.columns), F.coalesce("__salts", F.lit(1)))
    many = df.join(salts, key, "left").withColumn("__salt", spread.cast("int")).drop("__salts")
    few = one.join(salts, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), F.coalesce("__salts", F.lit(1)) - 1))).drop("__salts")
    return many.join(few, [key, "__salt"], how).drop("__salt")


def with_totals(df: DataFrame, key: str, totals: Sequence[Column]) -> DataFrame:
    """``df`` with aggregates of its key, as a window over ``key`` would give, but no key meets in one task: totals
    are partial aggregates, written once with the rows per key, and joined back with heavy keys salted. Rows with a
    null key are left out. ``df`` is read twice: write it first if it is dear."""
    sums = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(*totals, F.count(F.lit(1)).alias("__rows")), "totals")
    return salted_join(df, sums.drop("__rows"), key, heavy_keys(sums, key, "__rows"))


def semi_join(df: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    """Rows of ``df`` whose ``key`` is among the values of the one column of ``ids``; heavy keys of ``df`` salted."""
    counts = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows")), "key-counts")
    return salted_join(df, ids.toDF(key).distinct(), key, heavy_keys(counts, key, "__rows"), "left_semi")
