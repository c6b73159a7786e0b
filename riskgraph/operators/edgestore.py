"""Edges stored by the communities of both ends.

An edge lies in the cell (cell of its source's community, cell of its target's community) of a grid of ``cells`` by
``cells`` partitions. The relations of one community are a row and a column of the grid, the edges inside some
communities the cells where their rows and columns meet: Spark prunes the rest by the partition values, before any file
is opened. In a cell, rows are sorted by community, so that row groups are skipped as well."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .graphops import RELATION

CELLS = 16
#: Rows of a file: a hot cell becomes several files, written by several tasks.
ROWS_PER_FILE = 5_000_000


def _cell(community: Column, cells: int) -> Column:
    return F.pmod(F.xxhash64(community.cast("string")), F.lit(cells)).cast("int")


def cells_of(spark: SparkSession, communities: Iterable, cells: int = CELLS) -> list[int]:
    """Cells of the given communities (a list that a caller names)."""
    names = [(str(c),) for c in communities]
    return sorted({r[0] for r in spark.createDataFrame(names, "c string").select(_cell(F.col("c"), cells)).collect()})


def write_edge_store(edges: DataFrame, nodes: DataFrame, path: str, cells: int = CELLS, key: str = "comunidad") -> None:
    """``edges`` (emisor, receptor, weight columns) with the community, seed flag and net VAT that I6 reports. Edges
    with an end outside ``nodes`` are left out, as the loader does (A9). Communities are kept as text, as loaded."""
    n = nodes.select("cont_rut", F.col(key).cast("string").alias("c"), "alerta_inicial", "IVA_neto")
    s = n.select(F.col("cont_rut").alias("emisor"), F.col("c").alias("cs"), "alerta_inicial", "IVA_neto")
    t = n.select(F.col("cont_rut").alias("receptor"), F.col("c").alias("ct"))
    rows = edges.join(s, "emisor").join(t, "receptor").withColumn("bs", _cell(F.col("cs"), cells)).withColumn("bt", _cell(F.col("ct"), cells))
    spread = F.pmod(F.xxhash64("emisor", "receptor"), F.lit(4))  # a hot cell goes through several tasks
    (rows.repartition("bs", "bt", spread).sortWithinPartitions("bs", "bt", "cs", "ct").write.mode("overwrite")
        .option("maxRecordsPerFile", ROWS_PER_FILE).partitionBy("bs", "bt").parquet(path))


def induced_edges(spark: SparkSession, path: str, communities: Iterable, cells: int = CELLS) -> DataFrame:
    """I1 + I2: edges with both ends in the given communities."""
    ids = [str(c) for c in communities]
    at = cells_of(spark, ids, cells)
    rows = spark.read.parquet(path)
    return rows.where(F.col("bs").isin(at) & F.col("bt").isin(at) & F.col("cs").isin(ids) & F.col("ct").isin(ids)).drop("bs", "bt")


def community_edges(spark: SparkSession, path: str, community, cells: int = CELLS) -> DataFrame:
    """Relations with the source or the target in ``community``, with the source's seed flag and net VAT."""
    want = str(community)
    at = cells_of(spark, [want], cells)
    rows = spark.read.parquet(path)
    rows = rows.where((F.col("bs").isin(at) | F.col("bt").isin(at)) & ((F.col("cs") == want) | (F.col("ct") == want)))
    return rows.select(F.col("emisor").alias("source"), "alerta_inicial", "IVA_neto", F.lit(RELATION).alias("relation"),
                       F.col("receptor").alias("target"))


def relations_with_communities(spark: SparkSession, path: str) -> DataFrame:
    """I4: relations with both ends' communities (text), read as stored: no join."""
    return spark.read.parquet(path).select(F.col("emisor").alias("source"), F.lit(RELATION).alias("relation"),
                                           F.col("receptor").alias("target"), F.col("cs").alias("comunidad_source"), F.col("ct").alias("comunidad_target"))
