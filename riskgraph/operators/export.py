"""Graph export (A8-A10): node and edge tables as a property-graph loader
expects them. Written by the executors as CSV (io.write_csv)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, FloatType

from ..functions.skew import semi_join
from ..sources.io import cut

NODE_PROPERTIES = ("cont_rut", "score", "total_pago_f29", "IVA_neto", "unidad_regional", "n_documentos",
                   "lifetime", "alerta_inicial", "comunidad")


def _as_text(df: DataFrame, c: str):
    t = df.schema[c].dataType
    col = F.col(c)
    if isinstance(t, (DoubleType, FloatType)):
        # fixed 6-decimal text: engine-independent, no exponent notation
        col = F.round(col + F.lit(1e-10), 6).cast("decimal(38,6)")
    return F.coalesce(col.cast("string"), F.lit("")).alias(c)


def export_nodes(labelled: DataFrame, limit: int | None = None) -> DataFrame:
    """The nine node properties as text, nulls → '' (``modularidad`` is
    not exported). ``limit`` keeps the first rows by id (a preview load)."""
    df = labelled.select(*NODE_PROPERTIES)
    if limit is not None:
        df = df.orderBy("cont_rut").limit(limit)
    return df.select(F.col("cont_rut").cast("string").alias("cont_rut"),
                     *[_as_text(df, c) for c in NODE_PROPERTIES[1:]])


def export_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """An edge is loaded only if both end nodes exist; duplicate pairs
    merge into one relation whose ``Fuerza`` is the largest weight (a
    deterministic stand-in for the loader's last write)."""
    ids = cut(nodes.select("cont_rut").distinct(), "export-ids")
    e = semi_join(semi_join(edges, ids, "emisor"), ids, "receptor")
    return (e.groupBy("emisor", "receptor").agg(F.max(F.col("Fi").cast("double")).alias("Fuerza"))
            .withColumn("relation", F.lit("emite_a")))


def node_key_violations(nodes: DataFrame, key: str = "cont_rut") -> DataFrame:
    """A10: keys that occur more than once (a unique-id rule check)."""
    return nodes.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)
