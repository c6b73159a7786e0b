"""Entity labels.

Every label is one row per entity and is left-joined onto the scored nodes.
All labels are keyed by the entity id, so after the first exchange the
chain of joins reuses the nodes' hash partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bounded_broadcast, parse_period
from .forces import invoices

DEFAULT_SINCE = "2020-01-01 00:00:00"
# An operating-unit dimension is a short list; broadcast it only below this.
MAX_UNITS_BROADCAST = 100_000


def _ts(v: str):
    return F.lit(v).cast("timestamp")


def label_paid(forms: DataFrame, since: str = DEFAULT_SINCE) -> DataFrame:
    """Σ F29_C_89 of valid forms whose period starts on or after ``since``.
    The month of ``since`` is also compared as the stored number, which the
    scan can use; the parsed period decides."""
    f = forms.where((F.col("TIVA_COD_VALIDEZ") == 1) & (F.col("F29_AGNO_MES_TRIBUTARIO_VO") >= int(since[:7].replace("-", ""))))
    f = f.where(parse_period("F29_AGNO_MES_TRIBUTARIO_VO") >= _ts(since))
    return f.groupBy(F.col("CONT_RUT").alias("cont_rut")).agg(
        F.sum("F29_C_89").alias("total_pago_f29"))


def label_net_vat(documents: DataFrame, since: str = DEFAULT_SINCE) -> DataFrame:
    """VAT received − VAT issued on invoices from ``since`` on. One pass:
    each invoice contributes (issuer, −iva) and (receiver, +iva)."""
    inv = invoices(documents, since=since)
    both = inv.select(F.explode(F.array(
        F.struct(F.col("dhdr_rut_emisor").alias("cont_rut"), (-F.col("dhdr_iva")).alias("v")),
        F.struct(F.col("dhdr_rut_recep").alias("cont_rut"), F.col("dhdr_iva").alias("v")))).alias("x"))
    return both.groupBy(F.col("x.cont_rut").alias("cont_rut")).agg(F.sum("x.v").alias("IVA_neto"))


def label_region(businesses: DataFrame, units: DataFrame) -> DataFrame:
    """Region of the latest business row per entity (date desc, nulls
    last; ties → smallest region name). A min over a struct is a partial
    aggregate, so an entity with very many rows is not sorted in one task."""
    u = bounded_broadcast(units.select("UNOP_UNIDAD", "UNOP_DES_REGIONAL"), MAX_UNITS_BROADCAST)
    b = businesses.select("CONT_RUT", "UNOP_UNIDAD", "NEGO_FECHA_VIGENCIA").join(u, "UNOP_UNIDAD", "left")
    date_key = F.coalesce(-F.unix_micros(F.col("NEGO_FECHA_VIGENCIA").cast("timestamp")),
                          F.lit(2 ** 63 - 1).cast("bigint"))
    key = F.struct(date_key.alias("d"), F.col("UNOP_DES_REGIONAL").isNull().alias("n"),
                   F.col("UNOP_DES_REGIONAL").alias("r"))
    return (b.groupBy(F.col("CONT_RUT").alias("cont_rut")).agg(F.min(key).alias("k"))
            .select("cont_rut", F.col("k.r").alias("unidad_regional")))


def label_doc_count(documents: DataFrame) -> DataFrame:
    """Number of invoices issued (no date cutoff)."""
    return (invoices(documents).groupBy(F.col("dhdr_rut_emisor").alias("cont_rut"))
            .agg(F.count(F.lit(1)).alias("n_documentos")))


def label_invoices(documents: DataFrame, since: str = DEFAULT_SINCE) -> DataFrame:
    """E2 and E4 in one scan of the invoices: net VAT from ``since`` on (null
    without such an invoice) and the number of invoices issued (null without)."""
    inv = invoices(documents)
    late = F.col("dhdr_fch_emis_int") >= _ts(since)
    both = inv.select(F.explode(F.array(
        F.struct(F.col("dhdr_rut_emisor").alias("cont_rut"), F.when(late, -F.col("dhdr_iva")).alias("v"), F.lit(1).alias("n")),
        F.struct(F.col("dhdr_rut_recep").alias("cont_rut"), F.when(late, F.col("dhdr_iva")).alias("v"), F.lit(0).alias("n")))).alias("x"))
    sums = both.groupBy(F.col("x.cont_rut").alias("cont_rut")).agg(F.sum("x.v").alias("IVA_neto"), F.sum("x.n").cast("long").alias("n"))
    return sums.select("cont_rut", "IVA_neto", F.when(F.col("n") > 0, F.col("n")).alias("n_documentos"))


def label_lifetime(taxpayers: DataFrame, as_of: str) -> DataFrame:
    """E5: age in days at ``as_of``; null when unknown or in the future.
    Unique per entity (max)."""
    d = F.col("cont_fecha_constitucion_vo").cast("timestamp")
    now = _ts(as_of)
    life = F.when(d.isNull() | (d > now), F.lit(None)).otherwise(F.datediff(now, d))
    return taxpayers.groupBy("cont_rut").agg(F.max(life).alias("lifetime"))


def label_seed(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """alerta_inicial = 1 for seeds, else 0."""
    s = seeds.select(F.col("cont_rut").alias("__s")).distinct()
    return (nodes.join(s, nodes.cont_rut == s.__s, "left")
            .withColumn("alerta_inicial", F.when(F.col("__s").isNotNull(), 1).otherwise(0))
            .drop("__s"))


LABEL_COLUMNS = ["cont_rut", "score", "total_pago_f29", "IVA_neto", "unidad_regional",
                 "n_documentos", "lifetime", "alerta_inicial"]


def enrich(state: DataFrame, forms: DataFrame, documents: DataFrame, businesses: DataFrame,
           units: DataFrame, taxpayers: DataFrame, seeds: DataFrame,
           since: str = DEFAULT_SINCE, as_of: str | None = None) -> DataFrame:
    """All labels on the scored nodes, in the reference's column order.
    The invoices are scanned once for both of their labels."""
    if as_of is None:
        as_of = str(state.sparkSession.sql("select cast(current_timestamp() as string) as t").first()["t"])
    out = state.select("cont_rut", "score")
    for lbl in (label_paid(forms, since), label_invoices(documents, since),
                label_region(businesses, units), label_lifetime(taxpayers, as_of)):
        out = out.join(lbl, "cont_rut", "left")
    out = label_seed(out, seeds)
    return out.select(*LABEL_COLUMNS)


def label_coverage(labelled: DataFrame) -> DataFrame:
    """Number of entities that have each label (labels are unique per
    entity, so a non-null count is a distinct count; no Expand needed)."""
    cols = [c for c in LABEL_COLUMNS if c not in ("cont_rut", "score", "alerta_inicial")]
    return labelled.agg(
        F.count_distinct("cont_rut").alias("n_entities"),
        *[F.count(F.col(c)).alias(f"n_{c}") for c in cols],
        F.sum("alerta_inicial").cast("bigint").alias("n_seeds"))
