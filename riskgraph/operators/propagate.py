"""Synchronous score propagation along force edges.

One round, for every receiver r with in-edges:

    s'(r) = Σ_e f(e)·score(emisor(e)) + f0(r)·score(r)
    score(r) ← s'(r) if s'(r) > score(r) else score(r)

Nodes without in-edges keep their score, so scores never decrease.

Execution plan per round (after a one-off preparation):

* The prepared edges are written once as a table bucketed by issuer, and the
  state of every round as a table bucketed by node with the same bucket
  count, so the edge ⋈ state join reads both sides in place. Every
  node also carries one *self row* (node → node, weight f0), so the receiver
  term f0·score(r) and the previous score come out of the same join: a round
  is one join of edges with the state plus one partially aggregated shuffle
  by receiver – no second join of the state.
* Issuers whose out-degree is above a threshold ("hot" issuers, e.g. one
  holding a third of all edges) are taken out of the hash partitioning: their
  edges are spread evenly and joined with a broadcast of the hot issuers'
  scores. The threshold is max(min_hot_degree, |E| / max_hot_keys), so at
  most ``max_hot_keys`` rows are ever broadcast.
* Laid out by issuer, a receiver has a partial sum in nearly every bucket that
  one of its edges lies in, until each edge is sent by itself. So where
  receivers have ``MIN_IN_DEGREE`` edges or more on average and at most
  ``MAX_ISSUERS`` nodes issue any, the edges are laid out by receiver and meet
  a broadcast of the issuers' scores: a receiver is then a row or two of the
  shuffle, however many buckets there are. The edges of a heavy receiver are
  dealt over many files.
* Those tables live in the shared checkpoint folder: each round ends the
  lineage, and the loss of an executor costs at most the current round. With a
  journal (journal.py) the loss of the driver costs no more: the next run reads
  the layout and the last committed round.
* ``frontier`` rounds sum only receivers of which an issuer, or the receiver
  itself, changed in the round before. The edges are also kept bucketed by
  receiver, and each such receiver is summed again in full, so that scores are
  those of a full round.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.expr import describe, product_skipping_unit_weights
from ..functions.skew import with_totals
from ..session import bucket_count
from ..sources.io import cut, drop_folder, write_bucketed
from .journal import Journal, described, opened

DEFAULT_ROUNDS = 15

#: Edges per receiver from which they are laid out by receiver, and issuers whose scores are broadcast at most for it.
MIN_IN_DEGREE, MAX_ISSUERS = 4, 1 << 19
#: Files that the edges of a receiver above the hot threshold are dealt over.
HEAVY_FILES = 64


# -- preparation (D1-D4) --------------------------------------------------------

def _influence() -> list[Column]:
    return [F.coalesce(product_skipping_unit_weights("Fi"), F.lit(0.0)).alias("f0"), F.sum("Fi").alias("sFi")]


def receiver_influence(edges: DataFrame) -> DataFrame:
    """Per receiver, f0 = ∏|1 − Fi| skipping factors equal to 0 (null →
    0) and sFi = Σ Fi."""
    return edges.groupBy("receptor").agg(*_influence())


def prepare_edges(edges: DataFrame) -> DataFrame:
    """t = round((1 − f0)·Fi, 4); f = t if t = 0 else t / sFi. ``edges``
    is read twice (the totals, then the rows); a heavy receiver is dealt over
    many tasks (functions/skew.py)."""
    t = F.round((F.lit(1.0) - F.col("f0")) * F.col("Fi"), 4)
    return (with_totals(edges.select("emisor", "receptor", "Fi"), "receptor", _influence())
            .select("emisor", "receptor", "Fi", "f0",
                    F.when(t == 0, t).otherwise(t / F.col("sFi")).alias("f")))


def node_universe(edges: DataFrame) -> DataFrame:
    """D3: every issuer and receiver once. Seeds without edges are not nodes."""
    return (edges.select(F.col("emisor").alias("cont_rut"))
            .union(edges.select(F.col("receptor").alias("cont_rut")))
            .distinct())


def initial_state(nodes: DataFrame, seeds: DataFrame) -> DataFrame:
    """score = seed score if positive, else 0."""
    s = (seeds.groupBy("cont_rut").agg(F.max("score").alias("__s")))
    return (nodes.join(s, "cont_rut", "left")
            .select("cont_rut", F.when(F.col("__s") > 0, F.col("__s")).otherwise(F.lit(0))
                    .cast("double").alias("score")))


# -- the round ------------------------------------------------------------------

@dataclass
class StepGraph:
    """Edges laid out for repeated rounds (see module doc)."""
    cold: DataFrame                 # emisor, receptor, w, is_self – partitioned by emisor; self rows only if ``incoming``
    hot: DataFrame | None           # emisor, receptor, w – edges of hot issuers
    hot_ids: DataFrame | None       # emisor – at most max_hot_keys rows
    nodes: DataFrame                # cont_rut
    n_edges: int = 0
    hot_threshold: int = 0
    buckets: int = 0
    reverse: DataFrame | None = None  # emisor, receptor, w, is_self – all rows, bucketed by receptor
    incoming: DataFrame | None = None  # emisor, receptor, w, is_self – edges of issuers that are not hot, by receiver
    issuers: DataFrame | None = None   # emisor – at most MAX_ISSUERS rows, bucketed like the state

    def unpersist(self) -> None:
        """Nothing is held in executor memory: all pieces are written tables."""


def _by_receiver(edges: DataFrame, threshold: int, n_parts: int) -> DataFrame:
    """``edges`` with the rows of a receiver side by side; those of a receiver of more than ``threshold`` edges in up to
    HEAVY_FILES places."""
    heavy = (edges.groupBy("receptor").agg(F.count(F.lit(1)).alias("deg")).where(F.col("deg") > threshold)
             .select(F.col("receptor").alias("__r")))
    heavy = cut(heavy, "heavy-receivers")  # Σ in-degree = |E|: at most max_hot_keys rows
    place = F.lit(0)
    if heavy.limit(1).count() > 0:
        edges = edges.join(F.broadcast(heavy), edges.receptor == heavy["__r"], "left")
        place = F.when(F.col("__r").isNotNull(), F.pmod(F.xxhash64("emisor"), F.lit(HEAVY_FILES))).otherwise(F.lit(0))
    return edges.withColumn("__place", place).repartition(n_parts, "receptor", "__place").select("emisor", "receptor", "w", "is_self")


def build_step_graph(prepared: DataFrame, min_hot_degree: int = 100_000, max_hot_keys: int = 10_000,
                     num_partitions: int | None = None, reverse: bool = False,
                     journal: Journal | None = None) -> StepGraph:
    """Layout of the prepared edges; ``reverse`` adds the one by receiver, which frontier rounds need."""
    spark = prepared.sparkSession
    # written once: the counts, the degree check and the layout below all
    # read this table instead of recomputing the forces
    prepared = cut(prepared.select("emisor", "receptor", "f0", "f"), "prepared-edges")
    real = prepared.select("emisor", "receptor", F.col("f").alias("w"))
    n_edges = real.count()
    n_parts = num_partitions or bucket_count(spark, n_edges)
    threshold = max(int(min_hot_degree), math.ceil(n_edges / max(1, max_hot_keys)))
    # Σ out-degree = |E|, so fewer than max_hot_keys issuers can pass it.
    hot_ids = (real.groupBy("emisor").agg(F.count(F.lit(1)).alias("deg"))
               .where(F.col("deg") > threshold).select("emisor"))
    has_hot = hot_ids.limit(1).count() > 0
    n_issuers, n_receivers = (real.select(c).distinct().count() for c in ("emisor", "receptor"))
    by_receiver = not reverse and n_issuers <= MAX_ISSUERS and n_edges >= MIN_IN_DEGREE * n_receivers

    nodes = node_universe(prepared)
    f0 = prepared.select("receptor", "f0").dropDuplicates(["receptor"])
    selfrows = (nodes.join(f0, nodes.cont_rut == f0.receptor, "left")
                .select(F.col("cont_rut").alias("emisor"), F.col("cont_rut").alias("receptor"),
                        F.coalesce(F.col("f0"), F.lit(0.0)).alias("w"), F.lit(True).alias("is_self")))
    if has_hot:
        hot_ids = cut(hot_ids, "hot-issuers")
        hb = F.broadcast(hot_ids)
        cold_real = real.join(hb, "emisor", "left_anti")
        hot = real.join(hb, "emisor", "left_semi")
        hot = cut(_by_receiver(hot.withColumn("is_self", F.lit(False)), threshold, n_parts).drop("is_self") if by_receiver
                  else hot.repartition(n_parts), "hot-edges")
    else:
        cold_real, hot = real, None
    rows = ["emisor", "receptor", "w", "is_self"]
    real_rows = real.withColumn("is_self", F.lit(False)).select(*rows)
    selfrows = cut(selfrows, "self-rows")
    cold_rows = cold_real.withColumn("is_self", F.lit(False)).select(*rows)
    incoming, issuers, issuers_path = None, None, ""
    if by_receiver:
        incoming = cut(_by_receiver(cold_rows, threshold, n_parts), "edges-in")
        issuers, issuers_path = write_bucketed(incoming.select("emisor").distinct(), "issuers", "emisor", n_parts)
    cold, cold_path = write_bucketed(selfrows if by_receiver else cold_rows.unionByName(selfrows), "edges", "emisor", n_parts)
    back, back_path = write_bucketed(real_rows.unionByName(selfrows), "edges-back", "receptor", n_parts) if reverse else (None, "")
    graph = StepGraph(cold=cold, hot=hot, hot_ids=hot_ids if has_hot else None, nodes=cut(nodes, "nodes") if journal else nodes,
                      n_edges=n_edges, hot_threshold=threshold, buckets=n_parts, reverse=back,
                      incoming=incoming, issuers=issuers)
    if journal:
        journal.commit("layout", cold=described(cold, cold_path, "emisor", n_parts), n_edges=n_edges, hot_threshold=threshold,
                       reverse=described(back, back_path, "receptor", n_parts) if reverse else None,
                       issuers=described(issuers, issuers_path, "emisor", n_parts) if by_receiver else None,
                       **{k: df.inputFiles()[0].rsplit("/", 1)[0] if df is not None and df.inputFiles() else None
                          for k, df in (("nodes", graph.nodes), ("hot", hot), ("hot_ids", graph.hot_ids), ("incoming", incoming))})
    return graph


def _read_layout(spark: SparkSession, fields: dict) -> StepGraph:
    def folder(name):
        return spark.read.parquet(fields[name]) if fields[name] else None

    return StepGraph(cold=opened(spark, fields["cold"]), hot=folder("hot"), hot_ids=folder("hot_ids"), nodes=folder("nodes"),
                     n_edges=fields["n_edges"], hot_threshold=fields["hot_threshold"], buckets=fields["cold"]["buckets"],
                     reverse=opened(spark, fields["reverse"]) if fields["reverse"] else None, incoming=folder("incoming"),
                     issuers=opened(spark, fields["issuers"]) if fields["issuers"] else None)


def _weighted(graph: StepGraph, rows: DataFrame, st: DataFrame, cold_only: bool) -> DataFrame:
    """receptor, is_self, x = w · score(emisor) and the score itself, for ``rows`` of edges. Edges of hot issuers meet
    a broadcast of the hot scores (at most ``max_hot_keys`` rows)."""
    def scored(part, scores):
        return (part.join(scores, part.emisor == scores.cont_rut)
                .select("receptor", "is_self", (F.col("w") * F.col("score")).alias("x"), "score"))

    if cold_only and graph.incoming is not None:  # the rows are self rows, the edges lie by receiver
        scores = st.join(graph.issuers, st.cont_rut == graph.issuers.emisor).select("cont_rut", "score")
        own = scored(rows, st).unionByName(scored(graph.incoming, F.broadcast(scores)))
    else:
        own = scored(rows, st) if cold_only or graph.hot is None else None
    if graph.hot is None:
        return own
    hot_scores = F.broadcast(st.join(F.broadcast(graph.hot_ids), st.cont_rut == graph.hot_ids.emisor, "left_semi"))
    if cold_only:  # the hot edges lie apart
        return own.unionByName(scored(graph.hot.withColumn("is_self", F.lit(False)), hot_scores))
    ids = F.broadcast(graph.hot_ids)
    return scored(rows.join(ids, "emisor", "left_anti"), st).unionByName(scored(rows.join(ids, "emisor", "left_semi"), hot_scores))


def _raised(weighted: DataFrame) -> DataFrame:
    """cont_rut, score: each receiver's sum where it is higher than its score."""
    not_self = ~F.col("is_self")
    agg = weighted.groupBy("receptor").agg(
        F.sum(F.when(not_self, F.col("x"))).alias("s_in"),
        F.count_if(not_self).alias("n_in"),
        F.max(F.when(F.col("is_self"), F.col("x"))).alias("self_term"),
        F.max(F.when(F.col("is_self"), F.col("score"))).alias("old"))
    s1 = F.col("s_in") + F.col("self_term")
    return agg.select(F.col("receptor").alias("cont_rut"),
                      F.when((F.col("n_in") > 0) & (s1 > F.col("old")), s1).otherwise(F.col("old")).alias("score"))


def propagate_step(graph: StepGraph, state: DataFrame) -> DataFrame:
    """One synchronous round (lazy). ``state``: cont_rut, score."""
    return _raised(_weighted(graph, graph.cold, state.select("cont_rut", "score"), cold_only=True))


def frontier_step(graph: StepGraph, state: DataFrame, before: DataFrame | None) -> tuple[DataFrame, int]:
    """D5 for the receivers whose sum can have changed since ``before`` (the state one round earlier; None: all that a
    score above 0 reaches): the next state (lazy) and how many edge rows are read for it.

    A round reads the rows of a changed node by the layout by issuer (its own self row leads to itself) and the rows of
    the receivers found by the layout by receiver, both in place."""
    st = state.select("cont_rut", "score")
    if before is None:
        changed = st.where("score > 0").select("cont_rut")
    else:
        old = before.select("cont_rut", F.col("score").alias("old"))
        changed = st.join(old, "cont_rut").where("score <> old").select("cont_rut")
    reached = graph.cold.join(changed, graph.cold.emisor == changed.cont_rut, "left_semi").select("receptor")
    if graph.hot is not None:
        hot = F.broadcast(changed.join(F.broadcast(graph.hot_ids), changed.cont_rut == graph.hot_ids.emisor, "left_semi"))
        reached = reached.union(graph.hot.join(hot, graph.hot.emisor == hot.cont_rut, "left_semi").select("receptor"))
    rows = cut(graph.reverse.join(reached.distinct(), "receptor", "left_semi").select("emisor", "receptor", "w", "is_self"), "frontier")
    new = _raised(_weighted(graph, rows, st, cold_only=False)).withColumnRenamed("score", "new")
    nxt = st.join(new, "cont_rut", "left").select("cont_rut", F.coalesce("new", "score").alias("score"))
    return nxt, rows.count()


@dataclass
class Propagation:
    state: DataFrame                # final state: cont_rut, score
    states: list[DataFrame]         # state after round 0..rounds (each a written table); the last two without keep_states
    graph: StepGraph
    rounds_run: int = 0
    metrics: DataFrame | None = None  # D7's counters per round, taken in the loop
    edges_read: list[int] = field(default_factory=list)  # edge rows of each frontier round


def propagate(edges: DataFrame, seeds: DataFrame, rounds: int = DEFAULT_ROUNDS,
              clamp: bool = False, min_hot_degree: int = 100_000, max_hot_keys: int = 10_000,
              tol: float | None = None, frontier: bool = False, journal: Journal | None = None,
              keep_states: bool = True) -> Propagation:
    """``rounds`` synchronous rounds from the seed overlay. The driver
    only sequences the rounds; each round's state is written to the shared
    checkpoint folder. ``edges`` is read twice: write it first if it is dear.

    ``tol`` asks for fewer rounds: the run ends once no score moves by more
    than ``tol``, and ``rounds_run`` says how many it took. ``frontier`` sums
    only what can have changed (frontier_step). With ``journal``, a run that
    was stopped goes on after its last committed round, and one of more rounds
    after those of a shorter one. Without ``keep_states`` the counters of D7
    are taken as each round ends, and older states are removed: two are left."""
    spark = edges.sparkSession
    layout = journal.read("layout") if journal else None
    if layout:
        graph = _read_layout(spark, layout)
    else:
        graph = build_step_graph(prepare_edges(edges), min_hot_degree=min_hot_degree, max_hot_keys=max_hot_keys,
                                 reverse=frontier, journal=journal)
    kept: dict[int, tuple[DataFrame, str]] = {}
    counters: list[tuple] = []
    edges_read: list[int] = []
    found = journal.last("round-", rounds) if journal else None

    def ended(k: int, df: DataFrame, path: str) -> None:
        kept[k] = (df, path)
        if not keep_states and k:
            counters.append((k, *df.agg(*_counters()).first()))
        if journal:
            journal.commit(f"round-{k}", **described(df, path, "cont_rut", graph.buckets), counters=counters, edges_read=edges_read)
        if not keep_states and k - 2 in kept:
            drop_folder(spark, kept.pop(k - 2)[1])

    if found:
        first = 0 if keep_states else max(0, found[0] - 1)
        for k in range(first, found[0] + 1):
            fields = found[1] if k == found[0] else journal.read(f"round-{k}")
            kept[k] = (opened(spark, fields), fields["path"])
        counters += [tuple(c) for c in found[1]["counters"]]
        edges_read += found[1]["edges_read"]
    else:
        ended(0, *write_bucketed(initial_state(graph.nodes, seeds), "state-r0", "cont_rut", graph.buckets))
    for k in range(max(kept) + 1, rounds + 1):
        state = kept[k - 1][0]
        if frontier:
            nxt, n = frontier_step(graph, state, kept[k - 2][0] if k > 1 else None)
            edges_read.append(n)
        else:
            nxt = propagate_step(graph, state)
        if clamp:
            nxt = nxt.withColumn("score", F.least(F.col("score"), F.lit(1.0)))
        ended(k, *write_bucketed(nxt, f"state-r{k}", "cont_rut", graph.buckets, repartition=clamp or frontier))
        if tol is not None:
            moved = (kept[k][0].alias("n").join(state.alias("o"), "cont_rut")
                     .agg(F.max(F.col("n.score") - F.col("o.score")).alias("d")).first()["d"])
            if moved is None or moved <= tol:
                break
    done = max(kept)
    metrics = spark.createDataFrame(counters, "iterations int, " + ", ".join(f"{c} long" for c in COUNTERS)) if not keep_states else None
    return Propagation(state=kept[done][0], states=[kept[k][0] for k in sorted(kept)], graph=graph, rounds_run=done,
                       metrics=metrics, edges_read=edges_read)


# -- outputs and counters (D7-D12) -----------------------------------------------

COUNTERS = ("new_values", "over_05_not_1", "over_01_below_1", "over_01")


def _counters() -> list[Column]:
    s = F.col("score")
    return [c.alias(n) for n, c in zip(COUNTERS, (F.count_if((s > 0.5) & (s < 1)), F.count_if((s > 0.5) & (s != 1)),
                                                  F.count_if((s > 0.1) & (s < 1)), F.count_if(s > 0.1)), strict=True)]


def round_metrics(states: list[DataFrame]) -> DataFrame:
    """Per round, the counters printed by the reference runs:
    0.5 < s < 1 (``new_values``), s > 0.5 and s ≠ 1, 0.1 < s < 1, s > 0.1.
    One grouped aggregate over the union of the written round states."""
    tagged = None
    for k, st in enumerate(states):
        if k == 0:
            continue
        t = st.select(F.lit(k).alias("iterations"), "score")
        tagged = t if tagged is None else tagged.unionByName(t)
    return tagged.groupBy("iterations").agg(*_counters())


def describe_rounds(states: list[DataFrame]) -> DataFrame:
    """Pandas-style describe of the scores after every round, as the
    reference prints it inside its loop: (iterations, count, mean, std, min,
    q25, q50, q75, max). All rounds go through one grouped describe."""
    tagged = [st.select(F.lit(k).alias("iterations"), "cont_rut", "score") for k, st in enumerate(states) if k]
    return describe(reduce(lambda a, b: a.unionByName(b), tagged), "score", by=["iterations"], tiebreak=["iterations", "cont_rut"])


def total_scores(state: DataFrame) -> DataFrame:
    """All nodes including seeds, unrounded."""
    return state.select("cont_rut", "score")


def new_scores(state: DataFrame, seeds: DataFrame, digits: int = 3) -> DataFrame:
    """Nodes that were not seeds, score rounded to 3 decimals."""
    return (state.join(seeds.select("cont_rut"), "cont_rut", "left_anti")
            .select(F.col("cont_rut").alias("contaminados"), F.round("score", digits).alias("score")))
