"""Canonical input tables derived from the driver's test tables.

The risk pipeline expects invoices, commercial arcs, alerts, legal
representatives, monthly tax forms, businesses, operating units and
taxpayers. The test data holds TPC-H-like tables instead; the mapping below
turns them into the canonical shape (see FIXTURES.md §2). Each function is a
plain DataFrame job over the whole tables; ``FIXTURE_SQL`` holds the same
mapping as DuckDB SQL for the oracle.

Suppliers and customers share the integer id space, so supplier k is
customer k: the graph has self-loops and reciprocal pairs on purpose.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the mapping (FIXTURES.md §2).
SINCE = "1998-01-01 00:00:00"          # cutoff for E1/E2
AS_OF = "2002-01-01 00:00:00"          # "now" for E5
FIXED_COMMUNITIES = 25                 # fixed partition: comunidad = node % 25 + 1


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _ymd_int(c):
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoice headers: issuer = supplier, receiver = customer of the order."""
    li = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_extendedprice", "l_tax", "l_returnflag")
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    sign = F.when(F.col("l_returnflag") == "R", F.lit(-1)).otherwise(F.lit(1))
    return (li.join(o, li.l_orderkey == o.o_orderkey)
            .select(F.col("l_suppkey").alias("dhdr_rut_emisor"),
                    F.col("o_custkey").alias("dhdr_rut_recep"),
                    (sign * F.floor(F.col("l_extendedprice") * F.col("l_tax"))).cast("bigint").alias("dhdr_iva"),
                    F.col("l_extendedprice").alias("dhdr_mnt_total"),
                    _ymd_int(F.col("o_orderdate")).alias("dhdr_fch_emis_int"),
                    F.when(F.col("l_returnflag") == "N", "33")
                     .when(F.col("l_returnflag") == "A", "34")
                     .otherwise("61").alias("dtdc_codigo")))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-aggregated commercial arcs: signed VAT per (issuer, receiver)."""
    return arcs_of(documents(spark, sf_dir))


def arcs_of(d: DataFrame) -> DataFrame:
    """Arcs of the invoices ``d``."""
    return (d.groupBy("dhdr_rut_emisor", "dhdr_rut_recep")
            .agg(F.sum("dhdr_iva").cast("bigint").alias("Monto_IVA"))
            .select(F.col("dhdr_rut_emisor").alias("PARU_RUT_E0"),
                    F.col("dhdr_rut_recep").alias("PARU_RUT_E2"), "Monto_IVA"))


def alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    code = (F.when(F.col("value").isNull() | (F.col("value") < 250), "9999")
            .when(F.col("event_type") == "error", "4110")
            .when(F.col("event_type") == "purchase", "4111")
            .when(F.col("event_type") == "signup", "4112")
            .when(F.col("event_type") == "click", "4113")
            .otherwise("9999"))
    return e.select(F.col("user_id").alias("cont_rut"),
                    code.alias("ALER_COD_TIPO_ALERTA_VO"),
                    F.col("event_type").alias("aler_desc_tipo_alerta_vo"),
                    F.when(F.col("event_id") % 2 == 0, F.col("ts")).alias("aler_fecha_desactiv_vo"))


def active_alerts_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An 'already active' extract in the raw all-string form: open alerts
    only, entity id and code as text (B5's input)."""
    a = alerts(spark, sf_dir).where(F.col("aler_fecha_desactiv_vo").isNull())
    return a.select(F.col("ALER_COD_TIPO_ALERTA_VO").alias("ALER_COD_TIPO_ALERTA"),
                    F.col("cont_rut").cast("string").alias("CONT_RUT_E"))


def representatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    n_sup = table(spark, sf_dir, "supplier").select(F.count(F.lit(1))).scalar()
    k = F.col("c_custkey")
    start = (F.when(k % 4 == 0, F.lit("1995-01-01 00:00:00"))
             .when(k % 4 == 1, F.lit("1996-01-01 00:00:00"))
             .when(k % 4 == 2, F.lit("1997-01-01 00:00:00"))
             .otherwise(F.lit("1998-01-01 00:00:00"))).cast("timestamp")
    end = F.when(k % 3 == 0, F.lit(None).cast("timestamp")).otherwise(
        F.lit("1999-12-31 00:00:00").cast("timestamp"))
    first = c.select(k.alias("CONT_RUT"), ((k * 7 + 3) % n_sup).alias("CONT_RUT_REPRESENTANTE"),
                     start.alias("REPR_FECHA_INICIO_VO"), end.alias("REPR_FECHA_TERMINO_VO"))
    second = c.where(k % 2 == 0).select(
        k.alias("CONT_RUT"), ((k * 11 + 5) % n_sup).alias("CONT_RUT_REPRESENTANTE"),
        F.lit("1997-01-01 00:00:00").cast("timestamp").alias("REPR_FECHA_INICIO_VO"),
        F.lit(None).cast("timestamp").alias("REPR_FECHA_TERMINO_VO"))
    return first.unionByName(second)


def tax_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("CONT_RUT"),
                    F.floor("o_totalprice").cast("bigint").alias("F29_C_89"),
                    (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("int")
                    .alias("F29_AGNO_MES_TRIBUTARIO_VO"),
                    F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("TIVA_COD_VALIDEZ"))


def businesses(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("CONT_RUT"),
                    (F.col("o_orderkey") % 26).cast("int").alias("UNOP_UNIDAD"),
                    F.col("o_orderdate").alias("NEGO_FECHA_VIGENCIA"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    return (n.join(r, n.n_regionkey == r.r_regionkey)
            .select(F.col("n_nationkey").alias("UNOP_UNIDAD"), F.col("r_name").alias("UNOP_DES_REGIONAL")))


def taxpayers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").select("c_custkey")
    first = (table(spark, sf_dir, "orders").groupBy("o_custkey")
             .agg(F.min("o_orderdate").alias("d")))
    k = F.col("c_custkey")
    d = (F.when(k % 10 == 0, F.lit(None).cast("timestamp"))
         .when(k % 10 == 1, F.lit("2030-01-01 00:00:00").cast("timestamp"))
         .otherwise(F.col("d").cast("timestamp")))
    return (c.join(first, c.c_custkey == first.o_custkey, "left")
            .select(k.alias("cont_rut"), d.alias("cont_fecha_constitucion_vo")))


# ---------------------------------------------------------------------------
# The same mapping as DuckDB SQL (CTE bodies). Names avoid the driver's own
# views (its ``documents`` table is unrelated prose).
FIXTURE_SQL: dict[str, str] = {
    "dte": """select l_suppkey as dhdr_rut_emisor, o_custkey as dhdr_rut_recep,
 cast(case when l_returnflag='R' then -1 else 1 end * floor(l_extendedprice*l_tax) as bigint) as dhdr_iva,
 l_extendedprice as dhdr_mnt_total,
 cast(year(o_orderdate)*10000+month(o_orderdate)*100+day(o_orderdate) as int) as dhdr_fch_emis_int,
 case l_returnflag when 'N' then '33' when 'A' then '34' else '61' end as dtdc_codigo
 from lineitem join orders on l_orderkey=o_orderkey""",
    "arcs": """select dhdr_rut_emisor as PARU_RUT_E0, dhdr_rut_recep as PARU_RUT_E2,
 cast(sum(dhdr_iva) as bigint) as Monto_IVA from dte group by dhdr_rut_emisor, dhdr_rut_recep""",
    "alerts": """select user_id as cont_rut, case when value is null or value < 250 then '9999' when event_type = 'error' then '4110'
 when event_type = 'purchase' then '4111' when event_type = 'signup' then '4112' when event_type = 'click' then '4113' else '9999' end as ALER_COD_TIPO_ALERTA_VO,
 event_type as aler_desc_tipo_alerta_vo, case when event_id % 2 = 0 then ts end as aler_fecha_desactiv_vo
 from events""",
    "active_alerts": """select ALER_COD_TIPO_ALERTA_VO as ALER_COD_TIPO_ALERTA, cast(cont_rut as varchar) as CONT_RUT_E
 from alerts where aler_fecha_desactiv_vo is null""",
    "reps": """select c_custkey as CONT_RUT, (c_custkey*7+3) % (select count(*) from supplier) as CONT_RUT_REPRESENTANTE,
 case c_custkey % 4 when 0 then timestamp '1995-01-01 00:00:00' when 1 then timestamp '1996-01-01 00:00:00'
 when 2 then timestamp '1997-01-01 00:00:00' else timestamp '1998-01-01 00:00:00' end as REPR_FECHA_INICIO_VO,
 case when c_custkey % 3 = 0 then null else timestamp '1999-12-31 00:00:00' end as REPR_FECHA_TERMINO_VO from customer
 union all select c_custkey, (c_custkey*11+5) % (select count(*) from supplier), timestamp '1997-01-01 00:00:00',
 cast(null as timestamp) from customer where c_custkey % 2 = 0""",
    "tax_forms": """select o_custkey as CONT_RUT, cast(floor(o_totalprice) as bigint) as F29_C_89,
 cast(year(o_orderdate)*100+month(o_orderdate) as int) as F29_AGNO_MES_TRIBUTARIO_VO,
 case when o_orderstatus='F' then 1 else 0 end as TIVA_COD_VALIDEZ from orders""",
    "businesses": """select o_custkey as CONT_RUT, cast(o_orderkey % 26 as int) as UNOP_UNIDAD,
 o_orderdate as NEGO_FECHA_VIGENCIA from orders""",
    "units": """select n_nationkey as UNOP_UNIDAD, r_name as UNOP_DES_REGIONAL from nation
 join region on n_regionkey=r_regionkey""",
    "taxpayers": """select c_custkey as cont_rut, case when c_custkey % 10 = 0 then null
 when c_custkey % 10 = 1 then timestamp '2030-01-01 00:00:00' else d end as cont_fecha_constitucion_vo
 from customer left join (select o_custkey, min(o_orderdate) as d from orders group by o_custkey) x
 on c_custkey=o_custkey""",
}

FIXTURE_DEPS: dict[str, tuple[str, ...]] = {
    "dte": (), "arcs": ("dte",), "alerts": (), "active_alerts": ("alerts",), "reps": (),
    "tax_forms": (), "businesses": (), "units": (), "taxpayers": (),
}
