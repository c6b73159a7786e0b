"""Forces: weighted issuer → receiver edges.

Every force is one row per (emisor, receptor) with ``Fi`` in [0, 1].
Per-receiver totals are partial aggregates joined back with heavy receivers
salted (functions/skew.py), not a window: a receiver holding a third of all
arcs is dealt over many tasks."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import bounded_broadcast, parse_yyyymmdd
from ..functions.skew import with_totals
from ..sources.io import cut

# Invoice document types (33 = invoice, 34 = exempt invoice).
INVOICE_TYPES = ("33", "34")


# -- VAT force ---------------------------------------------------------------

def vat_profile(arcs: DataFrame, amount: str = "Monto_IVA") -> DataFrame:
    """Count and sum of non-positive and positive VAT arcs, one pass."""
    a = F.col(amount)
    return arcs.agg(
        F.count_if(a <= 0).alias("n_nonpos"), F.count_if(a > 0).alias("n_pos"),
        F.sum(F.when(a <= 0, a)).alias("sum_nonpos"), F.sum(F.when(a > 0, a)).alias("sum_pos"))


def positive_arcs(arcs: DataFrame, amount: str = "Monto_IVA") -> DataFrame:
    """Keep arcs with positive VAT."""
    return arcs.where(F.col(amount) > 0)


def receiver_totals(arcs: DataFrame, receiver: str = "PARU_RUT_E2", amount: str = "Monto_IVA") -> DataFrame:
    """Σ positive VAT per receiver (the denominator of C3)."""
    return (positive_arcs(arcs, amount).groupBy(receiver)
            .agg(F.sum(amount).alias("Total_IVA")))


def force_vat(arcs: DataFrame, issuer: str = "PARU_RUT_E0", receiver: str = "PARU_RUT_E2",
              amount: str = "Monto_IVA", digits: int = 4) -> DataFrame:
    """Fi = round(VAT / Σ_receiver VAT, 4) over positive arcs. Rows that
    round to 0 are kept (only displays filter Fi > 0)."""
    pos = positive_arcs(arcs, amount).select(issuer, receiver, amount)
    return (with_totals(pos, receiver, [F.sum(amount).alias("Total_IVA")])
            .select(F.col(issuer).alias("emisor"), F.col(receiver).alias("receptor"),
                    F.round(F.col(amount) / F.col("Total_IVA"), digits).alias("Fi")))


# -- representative force ------------------------------------------------------

def invoices(documents: DataFrame, types: Iterable[str] = INVOICE_TYPES,
             date_col: str = "dhdr_fch_emis_int", since: str | None = None) -> DataFrame:
    """Invoice-type documents, int yyyyMMdd issue date → timestamp;
    with ``since``, only those issued from then on. The day of ``since`` is
    also compared as the whole number that is stored, which the scan can use;
    the parsed date decides."""
    rows = documents.where(F.col("dtdc_codigo").isin(*types))
    if since is not None:
        rows = rows.where((F.col(date_col) >= int(since[:10].replace("-", ""))) & (parse_yyyymmdd(date_col) >= F.lit(since).cast("timestamp")))
    return (rows
            .select("dhdr_rut_emisor", "dhdr_rut_recep", "dhdr_iva", "dhdr_mnt_total",
                    parse_yyyymmdd(date_col).alias(date_col)))


def docs_representatives(documents: DataFrame, reps: DataFrame) -> DataFrame:
    """Invoices joined to every representative of their receiver (inner:
    receivers without a representative drop out)."""
    inv = invoices(documents)
    return inv.join(reps, inv.dhdr_rut_recep == reps.CONT_RUT)


#: Receivers of many terms that are broadcast at most; more are joined by shuffle.
MAX_CUT_BROADCAST = 100_000
#: Terms of office of one receiver from which its terms are cut at the edges of months.
MANY_TERMS = 64


def _month(c) -> Column:
    return F.year(c) * 12 + F.month(c)


def term_index(reps: DataFrame, invoices: DataFrame, many_terms: int = MANY_TERMS) -> tuple[DataFrame, DataFrame]:
    """(terms, receivers): terms of office with ``__period``, and the receivers whose terms are cut (``__cut``).

    A receiver with very many terms would meet each of its invoices with each of its terms. Its terms are cut at the
    edges of the months that have invoices at all, and an invoice meets those of its month. Other receivers have the
    one period 0: a term of theirs stays one row. At most 1/``many_terms`` of the terms' number are such receivers."""
    r = reps.select("CONT_RUT", "CONT_RUT_REPRESENTANTE", "REPR_FECHA_INICIO_VO", "REPR_FECHA_TERMINO_VO")
    many = r.groupBy("CONT_RUT").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > many_terms).select("CONT_RUT", F.lit(True).alias("__cut"))
    many = cut(many, "receivers-of-many-terms")
    if many.limit(1).count() == 0:
        return r.withColumn("__period", F.lit(0)), many
    d = F.col("dhdr_fch_emis_int")
    first, last = invoices.agg(F.min(_month(d)), F.max(_month(d))).first()  # two numbers
    lo = F.greatest(_month(F.col("REPR_FECHA_INICIO_VO")), F.lit(first or 0))
    hi = F.least(F.coalesce(_month(F.col("REPR_FECHA_TERMINO_VO")), F.lit(last or 0)), F.lit(last or 0))
    periods = F.when(F.col("__cut"), F.when(lo <= hi, F.sequence(lo, hi))).otherwise(F.array(F.lit(0)))
    return r.join(many, "CONT_RUT", "left").withColumn("__period", F.explode(periods)).drop("__cut"), many


def docs_with_active_rep(documents: DataFrame, reps: DataFrame, seeds: DataFrame, many_terms: int = MANY_TERMS) -> DataFrame:
    """Invoice × representative rows where the representative was in
    office on the issue date (open end = still in office) and VAT > 0, with
    ``alerted`` = the representative is a seed. A document with k active
    representatives counts k times.

    An equi-join on (receiver, period) with the interval as the rest of the
    condition; see :func:`term_index` for receivers with many terms."""
    inv = invoices(documents).where(F.col("dhdr_iva") > 0)
    terms, many = term_index(reps, inv, many_terms)
    r = terms.withColumnRenamed("__period", "__term_period")
    s = seeds.select(F.col("cont_rut").alias("__seed"), F.lit(True).alias("alerted")).dropDuplicates(["__seed"])
    d = F.col("dhdr_fch_emis_int")
    inv = inv.join(bounded_broadcast(many.select(F.col("CONT_RUT").alias("dhdr_rut_recep"), "__cut"), MAX_CUT_BROADCAST), "dhdr_rut_recep", "left") \
        .withColumn("__period", F.when(F.col("__cut"), _month(d)).otherwise(F.lit(0))).drop("__cut")
    joined = inv.join(
        r, (inv.dhdr_rut_recep == r.CONT_RUT) & (F.col("__period") == F.col("__term_period")) & (d >= r.REPR_FECHA_INICIO_VO)
        & ((d <= r.REPR_FECHA_TERMINO_VO) | r.REPR_FECHA_TERMINO_VO.isNull()))
    return (joined.join(s, joined.CONT_RUT_REPRESENTANTE == s.__seed, "left")
            .select("dhdr_rut_emisor", "dhdr_rut_recep", "dhdr_iva", "dhdr_fch_emis_int",
                    "CONT_RUT_REPRESENTANTE", "REPR_FECHA_INICIO_VO", "REPR_FECHA_TERMINO_VO",
                    F.coalesce(F.col("alerted"), F.lit(False)).alias("alerted")))


def rep_pair_aggs(detail: DataFrame) -> DataFrame:
    """Per (issuer, receiver): all rows and rows with an alerted
    representative, counted and summed in one conditional aggregate."""
    a = F.col("alerted")
    return detail.groupBy("dhdr_rut_emisor", "dhdr_rut_recep").agg(
        F.count_if(a).alias("count1"),
        F.coalesce(F.sum(F.when(a, F.col("dhdr_iva"))), F.lit(0)).cast("bigint").alias("sum1"),
        F.count(F.lit(1)).alias("count2"),
        F.sum("dhdr_iva").cast("bigint").alias("sum2"))


def force_representative(documents: DataFrame, reps: DataFrame, seeds: DataFrame,
                         digits: int = 5) -> DataFrame:
    """Fi = round(Fa/2 + Fb/2, 5) with Fa = alerted share of documents
    and Fb = alerted share of VAT; edges with Fi = 0 are dropped."""
    agg = rep_pair_aggs(docs_with_active_rep(documents, reps, seeds))
    fa = F.col("count1") / F.col("count2")
    fb = F.col("sum1") / F.col("sum2")
    return (agg.select(F.col("dhdr_rut_emisor").alias("emisor"), F.col("dhdr_rut_recep").alias("receptor"),
                       F.round(fa / 2 + fb / 2, digits).alias("Fi"))
            .where(F.col("Fi") > 0))


# -- combination -------------------------------------------------------------

def combine_forces(f1: DataFrame, f2: DataFrame, drop_zero: bool = True) -> DataFrame:
    """Full outer join on the pair; a side missing a pair takes the
    other side's value (not 0); Fi = FiA/2 + FiB/2."""
    a = f1.select("emisor", "receptor", F.col("Fi").alias("Fi1"))
    b = f2.select("emisor", "receptor", F.col("Fi").alias("Fi2"))
    j = a.join(b, ["emisor", "receptor"], "full")
    fia = F.coalesce(F.col("Fi1"), F.col("Fi2"))
    fib = F.coalesce(F.col("Fi2"), F.col("Fi1"))
    out = j.select("emisor", "receptor", (fia / 2 + fib / 2).alias("Fi"))
    return out.where(F.col("Fi") > 0) if drop_zero else out


def normalise_edges(df: DataFrame, mapping: dict[str, str] | None = None,
                    fi_type: str = "double") -> DataFrame:
    """Rename a raw force extract to emisor/receptor/Fi, cast Fi."""
    mapping = mapping or {"PARU_RUT_E0": "emisor", "PARU_RUT_E2": "receptor"}
    cols = [F.col(c).alias(mapping.get(c, c)) for c in df.columns]
    out = df.select(*cols)
    return out.withColumn("Fi", F.col("Fi").cast(fi_type)) if "Fi" in out.columns else out
