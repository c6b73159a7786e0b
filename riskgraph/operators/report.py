"""Community report (G1-G7): size filter, ranking, profile, describe,
stacked histogram. Group statistics are partial aggregates; a community
holding a third of all nodes is never gathered in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import describe
from ..functions.skew import heavy_keys, salted_join
from ..sources.io import cut

NUMERIC_LABELS = ("score", "total_pago_f29", "IVA_neto", "n_documentos", "lifetime", "alerta_inicial",
                  "modularidad")


def min_size(df: DataFrame, n: int = 15, key: str = "comunidad") -> DataFrame:
    """G1: rows of communities with at least ``n`` members (null dropped)."""
    sizes = cut(df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("__rows")), "community-sizes")
    large = sizes.where(F.col("__rows") >= n).select(key)
    return salted_join(df, large, key, heavy_keys(sizes, key, "__rows"), "left_semi")


def rank_communities(df: DataFrame, key: str = "comunidad", score: str = "score") -> DataFrame:
    """Mean score per community (display order: score desc, key)."""
    return df.groupBy(key).agg(F.avg(score).alias("score"))


def top_communities(df: DataFrame, k: int = 5, key: str = "comunidad") -> DataFrame:
    """The k communities with the highest mean score."""
    return rank_communities(df, key).orderBy(F.desc("score"), F.asc(key)).limit(k)


def community_profile(df: DataFrame, key: str = "comunidad", region: str = "unidad_regional") -> DataFrame:
    """Size, mean score, Σ seed flags and their %, most frequent region
    (count desc, name asc; nulls ignored) and its count."""
    base = df.groupBy(key).agg(
        F.count(F.lit(1)).alias("group_size"), F.avg("score").alias("score_mean"),
        F.sum("alerta_inicial").cast("bigint").alias("alertas_iniciales"))
    base = base.withColumn("perc_alertas", 100.0 * F.col("alertas_iniciales") / F.col("group_size"))
    per_region = (df.where(F.col(region).isNotNull()).groupBy(key, region)
                  .agg(F.count(F.lit(1)).alias("__c")))
    mode = per_region.groupBy(key).agg(F.min(F.struct((-F.col("__c")).alias("nc"), F.col(region).alias("r"))).alias("__m"))
    mode = mode.select(key, F.col("__m.r").alias("most_common_region"),
                       (-F.col("__m.nc")).alias("most_common_count"))
    return base.join(mode, key, "left")


def community_describe(df: DataFrame, key: str = "comunidad", columns: Sequence[str] = NUMERIC_LABELS,
                       id_col: str = "cont_rut") -> DataFrame:
    """Describe of every numeric label per community: the columns are
    unpivoted into (community, column, value) and described per group."""
    cols = [c for c in columns if c in df.columns]
    long = df.select(key, id_col, F.explode(F.array(*[
        F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in cols])).alias("x"))
    long = long.select(key, id_col, "x.column", "x.value")
    return describe(long, "value", by=[key, "column"], tiebreak=[key, "column", id_col])


def community_hist(df: DataFrame, bins: int = 10, key: str = "comunidad", hue: str = "alerta_inicial") -> DataFrame:
    """Per community, ``bins`` score bins over the community's range,
    counts split by the seed flag (stacked histogram data)."""
    x = F.col("score").cast("double")
    # range and rows of each community: written once, for the bins, their edges and the heavy communities alike
    rng = cut(df.where(x.isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(
        F.min(x).alias("__mn"), F.max(x).alias("__mx"), F.count(F.lit(1)).alias("__rows")), "community-ranges")
    j = salted_join(df.where(x.isNotNull()), rng, key, heavy_keys(rng, key, "__rows"))
    width = (F.col("__mx") - F.col("__mn")) / bins
    edges = rng.select(key, "__mn", "__mx", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))).alias("bin")).select(
        key, "bin", (F.col("__mn") + F.col("bin") * width).alias("bin_lo"),
        F.when(F.col("bin") == bins - 1, F.col("__mx")).otherwise(F.col("__mn") + (F.col("bin") + 1) * width).alias("bin_hi"))
    b = F.when(F.col("__mx") == F.col("__mn"), F.lit(0)).otherwise(
        F.least(F.floor((x - F.col("__mn")) * bins / (F.col("__mx") - F.col("__mn"))), F.lit(bins - 1))).cast("int")
    counts = j.groupBy(key, b.alias("bin"), hue).agg(F.count(F.lit(1)).alias("count"))
    return counts.join(edges, [key, "bin"])
