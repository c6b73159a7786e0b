"""Sampling and graph queries (I1-I7) on the node and edge tables."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import distributed_rank
from ..functions.skew import semi_join
from ..sources.io import cut

RELATION = "emite_a"


def select_communities(labelled: DataFrame, ids: Iterable[int], key: str = "comunidad") -> DataFrame:
    """Nodes of the given communities."""
    return labelled.where(F.col(key).isin(*list(ids)))


def induced_edges(edges: DataFrame, nodes: DataFrame, node: str = "cont_rut") -> DataFrame:
    """Edges whose two ends are both in ``nodes`` (two semi joins; an end
    that very many edges share is dealt over many tasks)."""
    ids = cut(nodes.select(node).distinct(), "induced-ids")
    order = edges.columns
    return semi_join(semi_join(edges, ids, "emisor"), ids, "receptor").select(*order)


def relations(edges: DataFrame) -> DataFrame:
    """Source, relation, target."""
    return edges.select(F.col("emisor").alias("source"), F.lit(RELATION).alias("relation"),
                        F.col("receptor").alias("target"))


def relations_with_communities(edges: DataFrame, nodes: DataFrame, key: str = "comunidad") -> DataFrame:
    """I4: relations with both ends' communities."""
    n = nodes.select("cont_rut", key)
    s = n.select(F.col("cont_rut").alias("source"), F.col(key).alias("comunidad_source"))
    t = n.select(F.col("cont_rut").alias("target"), F.col(key).alias("comunidad_target"))
    return relations(edges).join(s, "source").join(t, "target").select(
        "source", "relation", "target", "comunidad_source", "comunidad_target")


def distinct_communities(nodes: DataFrame, key: str = "comunidad") -> DataFrame:
    """Distinct community values."""
    return nodes.select(key).distinct()


def community_index(nodes: DataFrame, key: str = "comunidad") -> DataFrame:
    """Distinct community values with their place (``indice``, from 0, null
    last), as a list shows them; places by distributed rank, no global window."""
    distinct = distinct_communities(nodes, key)
    order = [F.col(key).isNull().asc(), F.col(key).asc()]
    return distributed_rank(distinct, order, name="place").select((F.col("place") - 1).cast("long").alias("indice"), key)


def community_edges(edges: DataFrame, nodes: DataFrame, community, key: str = "comunidad") -> DataFrame:
    """Relations with the source or the target in ``community``; the id
    is compared as text, as stored by the graph loader; the source's seed
    flag and net VAT are returned."""
    n = nodes.select("cont_rut", F.col(key).cast("string").alias("__c"), "alerta_inicial", "IVA_neto")
    s = n.select(F.col("cont_rut").alias("source"), F.col("__c").alias("cs"), "alerta_inicial", "IVA_neto")
    t = n.select(F.col("cont_rut").alias("target"), F.col("__c").alias("ct"))
    want = str(community)
    r = relations(edges).join(s, "source").join(t, "target")
    return (r.where((F.col("cs") == want) | (F.col("ct") == want))
            .select("source", "alerta_inicial", "IVA_neto", "relation", "target"))
