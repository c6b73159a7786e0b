"""Communities on the force graph (F1-F6): undirected weights, modularity,
a distributed Louvain, membership attachment and the resolution study.

Conventions (SURVEY §2.12.6-7): the undirected weight of a pair is
w_uv + w_vu; a self-loop counts once in m and in L_c and twice in degrees;
Q_γ = Σ_c [L_c/m − γ·(d_c/2m)²]."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.io import cut, kept, release
from . import packed
from .components import components
from .ids import dictionary, encoded
from .louvain import connected_parts, modularities, partitions


def to_undirected(edges: DataFrame, weight: str = "Fi") -> DataFrame:
    """(u ≤ v, w) with w = Σ of both directions; self-loops kept."""
    u = F.least("emisor", "receptor")
    v = F.greatest("emisor", "receptor")
    return edges.groupBy(u.alias("u"), v.alias("v")).agg(F.sum(weight).alias("w"))


def degrees(und: DataFrame) -> DataFrame:
    """k_u = Σ incident weights, a self-loop counted twice."""
    ends = und.select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.col("w").alias("w")),
        F.struct(F.col("v").alias("node"), F.col("w").alias("w")))).alias("x"))
    return ends.groupBy(F.col("x.node").alias("node")).agg(F.sum("x.w").alias("k"))


def modularity(und: DataFrame, membership: DataFrame, resolution: float = 1.0,
               node: str = "node", community: str = "comunidad", m: float | None = None) -> DataFrame:
    """one row, ``modularidad`` = Q_γ of the partition. Two partial
    aggregates (intra weight per community, degree sum per community) and
    one tiny final sum. The graph, which three branches read, is written once."""
    und = cut(und.select("u", "v", "w"), "modularity-graph")
    mb = membership.select(F.col(node).alias("__n"), F.col(community).alias("__c"))
    m = F.lit(float(m)) if m is not None else und.select(F.sum("w")).scalar()
    cu = und.join(mb.withColumnRenamed("__c", "cu"), und.u == mb.__n).drop("__n")
    cuv = cu.join(mb.withColumnRenamed("__c", "cv"), cu.v == mb.__n).drop("__n")
    lc = cuv.where(F.col("cu") == F.col("cv")).groupBy(F.col("cu").alias("c")).agg(F.sum("w").alias("L"))
    dc = (degrees(und).join(mb, F.col("node") == mb.__n)
          .groupBy(F.col("__c").alias("c")).agg(F.sum("k").alias("d")))
    per_c = dc.join(lc, "c", "left").select(
        (F.coalesce(F.col("L"), F.lit(0.0)) / m
         - F.lit(float(resolution)) * F.pow(F.col("d") / (2 * m), 2)).alias("q"))
    return per_c.agg(F.sum("q").alias("modularidad"))


def attach_communities(labelled: DataFrame, membership: DataFrame,
                       node: str = "nodo", extra: Sequence[str] = ("comunidad", "modularidad")) -> DataFrame:
    """left join on cont_rut = nodo, ``nodo`` dropped."""
    mb = membership.select(F.col(node).alias("__nodo"), *extra)
    return labelled.join(mb, labelled.cont_rut == mb.__nodo, "left").drop("__nodo")


def node_gains(und: DataFrame, membership: DataFrame, m: float) -> DataFrame:
    """(gamma, node, gain): what Q_γ gains at most if this one node moves to the community of a neighbour; null where
    all neighbours are in its own. Straight from the definition:
    ΔQ = (w(u, d) − w(u, c∖u))/m − γ·k_u·(D_d − (D_c − k_u))/(2m²).  ``membership``: gamma, node, c."""
    deg = cut(degrees(und), "certificate-degrees")
    memb = membership.join(deg, "node")
    total = memb.groupBy("gamma", "c").agg(F.sum("k").alias("D"))
    near = und.where("u <> v").select(F.explode(F.array(
        F.struct(F.col("u").alias("node"), F.col("v").alias("other")),
        F.struct(F.col("v").alias("node"), F.col("u").alias("other")))).alias("x"), "w").select("x.node", "x.other", "w")
    to = (near.join(membership.select("gamma", F.col("node").alias("other"), F.col("c").alias("d")), "other")
          .groupBy("gamma", "node", "d").agg(F.sum("w").alias("to")))
    rows = (to.join(memb, ["gamma", "node"])
            .join(total.select("gamma", F.col("c").alias("d"), F.col("D").alias("D_d")), ["gamma", "d"]))
    own = rows.groupBy("gamma", "node").agg(
        F.max(F.when(F.col("c") == F.col("d"), F.col("to"))).alias("kin"),
        F.max(F.when(F.col("c") != F.col("d"), F.col("to") / m - F.col("gamma") * F.col("k") * F.col("D_d") / (2 * m * m))).alias("best"))
    return (memb.join(total, ["gamma", "c"]).join(own, ["gamma", "node"], "left")
            .select("gamma", "node", (F.col("best") - F.coalesce("kin", F.lit(0.0)) / m
                                      + F.col("gamma") * F.col("k") * (F.col("D") - F.col("k")) / (2 * m * m)).alias("gain")))


def _largest_gains(block: packed.Block, shared: dict) -> Iterator[tuple]:
    """:func:`node_gains` of the nodes of a block: the largest of each γ."""
    src = block.src()
    for gamma, (c, total, m) in shared.items():
        own, k = c[block.nodes], block.k
        there = (own[src] >= 0) & (c[block.dst] >= 0)
        at, d, w = src[there], c[block.dst[there]], block.w[there]
        order = np.lexsort((d, at))
        at, d, w = at[order], d[order], w[order]
        first = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (d[1:] != d[:-1])])) if len(at) else np.zeros(0, np.int64)
        if not len(first):
            continue
        at, d, to = at[first], d[first], np.add.reduceat(w, first)
        inside = d == own[at]
        kin, best = np.zeros(len(own)), np.full(len(own), -np.inf)
        kin[at[inside]] = to[inside]
        at, d, to = at[~inside], d[~inside], to[~inside]
        np.maximum.at(best, at, to / m - gamma * k[at] * total[d] / (2 * m * m))
        out = np.flatnonzero(best > -np.inf)
        if len(out):
            yield gamma, float((best[out] - kin[out] / m + gamma * k[out] * (total[own[out]] - k[out]) / (2 * m * m)).max())


def _measured(und: DataFrame, ids: DataFrame, n: int, memb: DataFrame) -> DataFrame:
    """(gamma, pieces, best_gain, q) of ``memb`` (gamma, node, c), by passes over the graph in blocks."""
    graph = packed.Graph(und, n, ids)
    gammas = sorted(r["gamma"] for r in memb.select("gamma").distinct().collect())  # a dozen at most
    rows = []
    for gs in graph.groups(gammas):
        cs = {}
        for g in gs:
            got = memb.where((F.col("gamma") == g) & F.col("c").isNotNull()).select(F.col("node").cast("int"), "c").toArrow()
            cs[g] = np.full(n + 1, -1, dtype=np.int32)
            cs[g][got.column(0).to_numpy()] = np.unique(got.column(1).to_numpy(), return_inverse=True)[1]
        pieces, inner = graph.pieces(cs), graph.inner(cs)
        gains = graph.over(_largest_gains, "gamma double, gain double", {g: (c, graph.totals(c), graph.m) for g, c in cs.items()}).toArrow().to_pylist()
        for g, c in cs.items():
            rows.append((g, len(np.unique(pieces[g][c >= 0])), max((r["gain"] for r in gains if r["gamma"] == g), default=None),
                         graph.quality(inner[g], c, g)))
    graph.drop()
    return und.sparkSession.createDataFrame(rows, "gamma double, pieces long, best_gain double, q double")


def certificate(und: DataFrame, study: DataFrame, tol: float = 1e-7) -> DataFrame:
    """What must hold of a partition, per γ of ``study`` (gamma, nodo, comunidad, q_gamma), recomputed on the whole
    graph and by other code than Louvain's moves: n_nodes, n_communities; once (each node of the graph has one community),
    gapless (labels 1..k, by size), connected (as many communities as connected pieces), best_gain (the largest gain of
    a single move, null if there is none) and stable (it is at most ``tol``), q (Q_γ by its definition) and q_stated (it
    is the q_gamma of every row). One row per γ; every γ goes through the same jobs."""
    und = kept(und.select("u", "v", "w"), "certificate-graph")
    ids = dictionary(und.select("u").union(und.select("v")))
    memb = cut(encoded(study.select("gamma", F.col("nodo").alias("node"), F.col("comunidad").alias("c"), "q_gamma"), ids, ["node"]), "certificate-memb")
    n = ids.count()
    release(und.sparkSession)
    per_node = memb.groupBy("gamma", "node").agg(F.count(F.lit(1)).alias("rows"))
    nodes = per_node.groupBy("gamma").agg(F.count(F.lit(1)).alias("n_nodes"), F.max("rows").alias("most"))
    sizes = memb.groupBy("gamma", "c").agg(F.count(F.lit(1)).alias("size"))
    later = sizes.select("gamma", (F.col("c") - 1).alias("c"), F.col("size").alias("next"))
    labels = sizes.join(later, ["gamma", "c"], "left").groupBy("gamma").agg(
        F.count(F.lit(1)).alias("k"), F.min("c").alias("lo"), F.max("c").alias("hi"),
        F.coalesce(F.bool_and(F.col("size") >= F.col("next")), F.lit(True)).alias("by_size"))
    flat = memb.select("gamma", "node", "c")
    if n <= packed.NODES:
        found = [_measured(und, ids, n, flat)]
    else:
        und = cut(encoded(und, ids, ["u", "v"]), "certificate-und")
        m = und.agg(F.sum("w")).first()[0]
        found = [connected_parts(und, flat, n).groupBy("gamma").agg(F.count_distinct("c").alias("pieces")),
                 node_gains(und, flat, m).groupBy("gamma").agg(F.max("gain").alias("best_gain")),
                 modularities(und, flat, m).select("gamma", F.col("q_gamma").alias("q"))]
    stated = memb.groupBy("gamma").agg(F.min("q_gamma").alias("q_lo"), F.max("q_gamma").alias("q_hi"))
    out = nodes
    for part in (labels, *found, stated):
        out = out.join(part, "gamma")
    near = F.greatest(F.abs(F.col("q_hi") - F.col("q")), F.abs(F.col("q_lo") - F.col("q"))) < 1e-9
    return out.select("gamma", "n_nodes", F.col("k").alias("n_communities"), ((F.col("n_nodes") == n) & (F.col("most") == 1)).alias("once"),
                      ((F.col("lo") == 1) & (F.col("hi") == F.col("k")) & F.col("by_size")).alias("gapless"),
                      (F.col("pieces") == F.col("k")).alias("connected"), "best_gain",
                      (F.coalesce("best_gain", F.lit(0.0)) <= tol + 1e-9).alias("stable"), "q", near.alias("q_stated"))


def louvain(und: DataFrame, resolution: float = 1.0, seed: int = 0, tol: float = 1e-7) -> DataFrame:
    """weighted Louvain as DataFrame jobs → (nodo, comunidad, q_gamma),
    labels 1..k by size descending, then smallest member. It ends when no
    node of any level can raise Q_γ by more than ``tol`` (see louvain.py)."""
    return partitions(und, [resolution], seed, tol).select("nodo", "comunidad", "q_gamma")


def connected_components(und: DataFrame) -> DataFrame:
    """γ = 0 limit of Louvain: every component is one community, named by its
    smallest node → (node, c). Runs until nothing changes, in rounds that grow
    with the logarithm of the longest path (see operators/components.py)."""
    return components(und).select("node", F.col("component").alias("c"))


def resolution_study(und: DataFrame, gammas: Sequence[float] = tuple(i / 10 for i in range(11)),
                     seed: int = 0, tol: float = 1e-7) -> DataFrame:
    """Louvain at each γ and Q at γ = 1 of its partition → long table
    (nodo, gamma, comunidad, modularidad). All resolutions advance in the same
    jobs."""
    return partitions(und, gammas, seed, tol).select("nodo", "gamma", "comunidad", F.col("q_1").alias("modularidad"))


def study_table(labelled: DataFrame, long: DataFrame, gammas: Sequence[float]) -> DataFrame:
    """one community and one modularity column per γ, left-joined onto
    the labelled nodes, exact duplicate rows removed."""
    gl = [float(g) for g in gammas]
    wide = long.groupBy("nodo").pivot("gamma", gl).agg(F.first("comunidad").alias("comunidad"),
                                                       F.first("modularidad").alias("modularidad"))
    ren = []
    for c in wide.columns:
        if c == "nodo":
            ren.append(F.col(c))
        else:
            g, what = c.split("_", 1)
            ren.append(F.col(f"`{c}`").alias(f"{what}_{g}"))
    wide = wide.select(*ren)
    return labelled.join(wide, labelled.cont_rut == wide.nodo, "left").drop("nodo").dropDuplicates()
