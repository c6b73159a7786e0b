"""Seeds: alerted entities that start the propagation with score 1."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Alert codes that make an entity a seed; 4113 counts only
# while the alert is still open (no deactivation date).
SEED_CODES = ("4110", "4111", "4112")
OPEN_ONLY_CODES = ("4113",)
ACTIVE_CODES = ("4110", "4111", "4112", "4113")


def seed_predicate(code: str = "ALER_COD_TIPO_ALERTA_VO", closed: str = "aler_fecha_desactiv_vo",
                   codes: Iterable[str] = SEED_CODES, open_only_codes: Iterable[str] = OPEN_ONLY_CODES):
    """code ∈ codes OR (code ∈ open_only_codes AND not deactivated): the
    open-alert test binds to the open-only codes alone."""
    return (F.col(code).isin(*codes)
            | (F.col(code).isin(*open_only_codes) & F.col(closed).isNull()))


def alerts_for_seeds(alerts: DataFrame, codes: Iterable[str] = SEED_CODES,
                     open_only_codes: Iterable[str] = OPEN_ONLY_CODES) -> DataFrame:
    return alerts.where(seed_predicate(codes=codes, open_only_codes=open_only_codes))


def seeds_from_alerts(alerts: DataFrame, codes: Iterable[str] = SEED_CODES,
                      open_only_codes: Iterable[str] = OPEN_ONLY_CODES) -> DataFrame:
    """B1: one row per alerted entity, score 1."""
    return (alerts_for_seeds(alerts, codes, open_only_codes)
            .select("cont_rut").distinct()
            .select("cont_rut", F.lit(1).alias("score")))


def alert_counts(alerts: DataFrame, codes: Iterable[str] = SEED_CODES,
                 open_only_codes: Iterable[str] = OPEN_ONLY_CODES) -> DataFrame:
    """Seed-making alerts per entity (sort with ``c`` desc when shown)."""
    return (alerts_for_seeds(alerts, codes, open_only_codes)
            .groupBy("cont_rut").agg(F.count(F.lit(1)).alias("c")))


def alert_types(alerts: DataFrame, codes: Iterable[str] = SEED_CODES,
                open_only_codes: Iterable[str] = OPEN_ONLY_CODES) -> DataFrame:
    """Distinct descriptions of the seed-making alerts."""
    return alerts_for_seeds(alerts, codes, open_only_codes).select("aler_desc_tipo_alerta_vo").distinct()


def seeds_from_active(extract: DataFrame, codes: Iterable[str] = ACTIVE_CODES, dedup: bool = True,
                      code: str = "ALER_COD_TIPO_ALERTA", entity: str = "CONT_RUT_E",
                      id_type: str = "bigint") -> DataFrame:
    """Seeds from an already-active, all-string extract. Codes are
    compared as text (no implicit cast); the id is cast once, explicitly.
    ``dedup=False`` keeps the raw form, where a repeated entity would fan out
    every later join."""
    out = (extract.where(F.col(code).isin(*[str(c) for c in codes]))
           .select(F.col(entity).cast(id_type).alias("cont_rut"), F.lit(1).alias("score")))
    return out.dropDuplicates(["cont_rut"]) if dedup else out
