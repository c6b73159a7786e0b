"""Registered queries: one Spark callable and (where SQL can state it) one
DuckDB oracle per operator of SURVEY §2.

Every query reads the whole test tables of ``sf_dir``. Doubles that are
results (not inputs of later steps) are rounded to 6 decimals on both sides
and every computed column is aliased identically."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.expr import r6
from ..operators import forces, propagate, seeds
from ..session import scratch_path
from ..sources import checked, fixtures, io, loader, publish
from ..sources.io import preview
from . import oracle as O
from .oracle import R6
from .scenarios import Inputs, run_scenario

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def q(name: str, sql: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


TS_FMT_SPARK = "yyyy-MM-dd HH:mm:ss"
TS_FMT_DUCK = "%Y-%m-%d %H:%M:%S"


def ts_str(c: str):
    return F.date_format(F.col(c), TS_FMT_SPARK).alias(c)


def sql_ts_str(c: str, src: str | None = None) -> str:
    return f"strftime({src or c}, '{TS_FMT_DUCK}') as {c}"


# ===================================================================== sources
@q("scan_arcs", O.build("select PARU_RUT_E0, PARU_RUT_E2, Monto_IVA from arcs", ["arcs"]))
def scan_arcs(spark, d):
    return Inputs(spark, d).arcs()


# ======================================================================= seeds
@q("seeds", O.build("select cont_rut, score from seeds", ["seeds"]))
def q_seeds(spark, d):
    return Inputs(spark, d).seeds()


@q("alert_counts", O.build("select cont_rut, count(*) as c from seed_alerts group by cont_rut", ["seed_alerts"]))
def q_alert_counts(spark, d):
    return seeds.alert_counts(Inputs(spark, d).alerts())


@q("alert_types", O.build("select distinct aler_desc_tipo_alerta_vo from seed_alerts", ["seed_alerts"]))
def q_alert_types(spark, d):
    return seeds.alert_types(Inputs(spark, d).alerts())


@q("seeds_active", O.build("""select distinct cast(CONT_RUT_E as bigint) as cont_rut, 1 as score
 from active_alerts where ALER_COD_TIPO_ALERTA in ('4110','4111','4112','4113')""", ["active_alerts"]))
def q_seeds_active(spark, d):
    return seeds.seeds_from_active(fixtures.active_alerts_extract(spark, d))


# ====================================================================== forces
@q("vat_profile", O.build("""select count_if(Monto_IVA <= 0) as n_nonpos, count_if(Monto_IVA > 0) as n_pos,
 cast(sum(case when Monto_IVA <= 0 then Monto_IVA end) as bigint) as sum_nonpos,
 cast(sum(case when Monto_IVA > 0 then Monto_IVA end) as bigint) as sum_pos from arcs""", ["arcs"]))
def q_vat_profile(spark, d):
    return forces.vat_profile(Inputs(spark, d).arcs())


@q("arcs_positive", O.build("select * from arcs_pos", ["arcs_pos"]))
def q_arcs_positive(spark, d):
    return forces.positive_arcs(Inputs(spark, d).arcs())


@q("receiver_totals", O.build("select PARU_RUT_E2, Total_IVA from recv_tot", ["recv_tot"]))
def q_receiver_totals(spark, d):
    return forces.receiver_totals(Inputs(spark, d).arcs())


@q("force_vat", O.build("select emisor, receptor, Fi from f_vat", ["f_vat"]))
def q_force_vat(spark, d):
    return Inputs(spark, d).force_vat()


@q("top_forces_desc", O.build(
    "select emisor, receptor, Fi from f_vat where Fi > 0 order by Fi desc, emisor, receptor limit 20", ["f_vat"]))
def q_top_forces_desc(spark, d):
    f = Inputs(spark, d).force_vat().where(F.col("Fi") > 0)
    return preview(f, [F.desc("Fi"), "emisor", "receptor"], 20)


@q("top_forces_asc", O.build(
    "select emisor, receptor, Fi from f_rep order by Fi asc, emisor, receptor limit 20", ["f_rep"]))
def q_top_forces_asc(spark, d):
    return preview(Inputs(spark, d).force_rep(), [F.asc("Fi"), "emisor", "receptor"], 20)


@q("invoices", O.build(f"""select dhdr_rut_emisor, dhdr_rut_recep, dhdr_iva, dhdr_mnt_total,
 {sql_ts_str('dhdr_fch_emis_int')} from inv""", ["inv"]))
def q_invoices(spark, d):
    inv = forces.invoices(Inputs(spark, d).documents())
    return inv.select("dhdr_rut_emisor", "dhdr_rut_recep", "dhdr_iva", "dhdr_mnt_total", ts_str("dhdr_fch_emis_int"))


@q("docs_representatives", O.build(f"""select i.dhdr_rut_emisor, i.dhdr_rut_recep, i.dhdr_iva,
 r.CONT_RUT_REPRESENTANTE, {sql_ts_str('REPR_FECHA_INICIO_VO', 'r.REPR_FECHA_INICIO_VO')},
 {sql_ts_str('REPR_FECHA_TERMINO_VO', 'r.REPR_FECHA_TERMINO_VO')}
 from inv i join reps r on i.dhdr_rut_recep = r.CONT_RUT""", ["inv", "reps"]))
def q_docs_representatives(spark, d):
    inp = Inputs(spark, d)
    j = forces.docs_representatives(inp.documents(), inp.reps())
    return j.select("dhdr_rut_emisor", "dhdr_rut_recep", "dhdr_iva", "CONT_RUT_REPRESENTANTE",
                    ts_str("REPR_FECHA_INICIO_VO"), ts_str("REPR_FECHA_TERMINO_VO"))


@q("force_rep_detail", O.build(f"""select dhdr_rut_emisor, dhdr_rut_recep, dhdr_iva,
 {sql_ts_str('dhdr_fch_emis_int')}, CONT_RUT_REPRESENTANTE, cast(alerted as int) as alerted from rep_detail""",
                               ["rep_detail"]))
def q_force_rep_detail(spark, d):
    inp = Inputs(spark, d)
    det = forces.docs_with_active_rep(inp.documents(), inp.reps(), inp.seeds())
    return det.select("dhdr_rut_emisor", "dhdr_rut_recep", "dhdr_iva", ts_str("dhdr_fch_emis_int"),
                      "CONT_RUT_REPRESENTANTE", F.col("alerted").cast("int").alias("alerted"))


@q("rep_pair_aggs", O.build("select * from rep_aggs", ["rep_aggs"]))
def q_rep_pair_aggs(spark, d):
    inp = Inputs(spark, d)
    agg = forces.rep_pair_aggs(forces.docs_with_active_rep(inp.documents(), inp.reps(), inp.seeds()))
    return agg.select("dhdr_rut_emisor", "dhdr_rut_recep", "count1", "sum1", "count2", "sum2")


@q("force_representative", O.build("select emisor, receptor, Fi from f_rep", ["f_rep"]))
def q_force_representative(spark, d):
    return Inputs(spark, d).force_rep()


@q("combine_forces", O.build(f"select emisor, receptor, {R6('Fi', 'Fi')} from f_comb", ["f_comb"]))
def q_combine_forces(spark, d):
    return Inputs(spark, d).force_combined().withColumn("Fi", r6("Fi"))


@q("combine_forces_all", O.build(f"select emisor, receptor, {R6('Fi', 'Fi')} from f_comb_all", ["f_comb_all"]))
def q_combine_forces_all(spark, d):
    return Inputs(spark, d).force_combined(drop_zero=False).withColumn("Fi", r6("Fi"))


# ================================================================= propagation
O.state_cte("combined", 15)
O.state_cte("vat", 15)
O.state_cte("rep", 15)


@q("receiver_f0", O.build(f"select receptor, {R6('f0', 'f0')}, {R6('sFi', 'sFi')} from combined_infl",
                          ["combined_infl"]))
def q_receiver_f0(spark, d):
    infl = propagate.receiver_influence(Inputs(spark, d).edges("combined"))
    return infl.select("receptor", r6("f0").alias("f0"), r6("sFi").alias("sFi"))


@q("edge_influence", O.build(f"""select emisor, receptor, {R6('Fi', 'Fi')}, {R6('f0', 'f0')}, {R6('f', 'f')}
 from combined_prep""", ["combined_prep"]))
def q_edge_influence(spark, d):
    p = propagate.prepare_edges(Inputs(spark, d).edges("combined"))
    return p.select("emisor", "receptor", r6("Fi").alias("Fi"), r6("f0").alias("f0"), r6("f").alias("f"))


@q("node_universe", O.build("select cont_rut from combined_nodes", ["combined_nodes"]))
def q_node_universe(spark, d):
    return propagate.node_universe(Inputs(spark, d).edges("combined"))


@q("initial_state", O.build("select cont_rut, score from combined_s0", ["combined_s0"]))
def q_initial_state(spark, d):
    inp = Inputs(spark, d)
    return propagate.initial_state(propagate.node_universe(inp.edges("combined")), inp.seeds())


def _state_query(scenario: str, rounds: int):
    def fn(spark, d):
        st = run_scenario(spark, d, scenario, rounds=rounds).state
        return st.select("cont_rut", r6("score").alias("score"))
    return fn


for _r in (1, 3, 5, 15):
    _name = f"combined_s{_r}"
    O.state_cte("combined", _r)
    q(f"propagate_{_r}", O.build(f"select cont_rut, {R6('score', 'score')} from {_name}", [_name]))(
        _state_query("combined", _r))


def _new_scores_query(scenario: str, rounds: int = 15):
    def fn(spark, d):
        res = run_scenario(spark, d, scenario, rounds=rounds)
        return propagate.new_scores(res.state, Inputs(spark, d).seeds())
    return fn


def _new_scores_sql(scenario: str, rounds: int = 15) -> str:
    st = f"{scenario}_s{rounds}"
    return O.build(f"""select s.cont_rut as contaminados, round(s.score, 3) as score from {st} s
 where s.cont_rut not in (select cont_rut from seeds)""", [st, "seeds"])


for _sc in ("vat", "rep", "combined"):
    q(f"scenario_{_sc}", _new_scores_sql(_sc))(_new_scores_query(_sc))

q("new_scores", _new_scores_sql("combined"))(_new_scores_query("combined"))


def _round_metrics_sql(scenario: str, rounds: int) -> str:
    parts = []
    for k in range(1, rounds + 1):
        st = f"{scenario}_s{k}"
        parts.append(f"""select {k} as iterations, count_if(score > 0.5 and score < 1) as new_values,
 count_if(score > 0.5 and score <> 1) as over_05_not_1, count_if(score > 0.1 and score < 1) as over_01_below_1,
 count_if(score > 0.1) as over_01 from {st}""")
    return O.build("\nunion all\n".join(parts), [f"{scenario}_s{rounds}"])


@q("round_metrics", _round_metrics_sql("combined", 15))
def q_round_metrics(spark, d):
    return propagate.round_metrics(run_scenario(spark, d, "combined", rounds=15).states)


def _round_describe_sql(rounds: int) -> str:
    names = [f"combined_s{k}" for k in range(1, rounds + 1)]
    rows = "\nunion all\n".join(f"select {k} as iterations, score from {n}" for k, n in enumerate(names, 1))
    return O.build(f"""select iterations, count(score) as count, {R6('avg(score)', 'mean')}, {R6('stddev_samp(score)', 'std')},
 {R6('min(score)', 'min')}, {R6('quantile_cont(score, 0.25)', 'q25')}, {R6('quantile_cont(score, 0.5)', 'q50')},
 {R6('quantile_cont(score, 0.75)', 'q75')}, {R6('max(score)', 'max')} from ({rows}) group by iterations""", names)


@q("describe_rounds", _round_describe_sql(15))
def q_describe_rounds(spark, d):
    """The describe of every round."""
    df = propagate.describe_rounds(run_scenario(spark, d, "combined", rounds=15).states)
    return df.select("iterations", "count", *[r6(c).alias(c) for c in ("mean", "std", "min", "q25", "q50", "q75", "max")])


@q("propagate_frontier", O.build(f"select cont_rut, {R6('score', 'score')} from combined_s15", ["combined_s15"]))
def q_propagate_frontier(spark, d):
    """D6 by frontier rounds: only receivers that a change can reach are summed."""
    st = run_scenario(spark, d, "combined", rounds=15, frontier=True).state
    return st.select("cont_rut", r6("score").alias("score"))


@q("round_metrics_in_loop", _round_metrics_sql("combined", 15))
def q_round_metrics_in_loop(spark, d):
    """D7 taken as each round ends, with no more than two states kept."""
    inp = Inputs(spark, d)
    return propagate.propagate(inp.edges("combined"), inp.seeds(), rounds=15, keep_states=False).metrics


@q("graph_counts", O.build("""select
 (select count(*) from combined_prep) as n_edges,
 (select count(*) from combined_nodes) as n_nodes,
 (select count(distinct emisor) from combined_prep) as n_issuers,
 (select count(distinct receptor) from combined_prep) as n_receivers,
 (select count(*) from combined_prep where emisor = receptor) as n_self_loops,
 (select count(*) from seeds) as n_seeds,
 (select count(*) from combined_s15 where cont_rut in (select cont_rut from seeds)) as n_seed_nodes,
 (select count(*) from combined_s15 where cont_rut not in (select cont_rut from seeds)) as n_new""",
                           ["combined_s15", "seeds"]))
def q_graph_counts(spark, d):
    inp = Inputs(spark, d)
    e = inp.edges("combined")
    sd = inp.seeds().select("cont_rut")
    st = run_scenario(spark, d, "combined", rounds=15).state

    def n(df):
        return df.select(F.count(F.lit(1))).scalar()

    # each distinct count is its own partial aggregate (no Expand of the edges)
    return (e.agg(F.count(F.lit(1)).alias("n_edges"),
                  F.count_if(F.col("emisor") == F.col("receptor")).alias("n_self_loops"))
            .select("n_edges", n(propagate.node_universe(e)).alias("n_nodes"),
                    n(e.select("emisor").distinct()).alias("n_issuers"),
                    n(e.select("receptor").distinct()).alias("n_receivers"),
                    "n_self_loops", n(sd).alias("n_seeds"),
                    n(st.join(sd, "cont_rut", "left_semi")).alias("n_seed_nodes"),
                    n(st.join(sd, "cont_rut", "left_anti")).alias("n_new")))


# ====================================================================== labels
from ..functions.expr import describe  # noqa: E402
from ..operators import community, edgestore, enrich, export, graphops, profile, report  # noqa: E402
from .scenarios import GAMMAS, fixed_membership, labelled_nodes, louvain_membership, resolution_study  # noqa: E402,E501

SINCE, AS_OF = fixtures.SINCE, fixtures.AS_OF
ENR = O.enrich_cte("combined", 15)


@q("label_paid", O.build("select cont_rut, total_pago_f29 from lbl_paid", ["lbl_paid"]))
def q_label_paid(spark, d):
    return enrich.label_paid(Inputs(spark, d).tax_forms(), SINCE)


@q("label_net_vat", O.build("select cont_rut, IVA_neto from lbl_netvat", ["lbl_netvat"]))
def q_label_net_vat(spark, d):
    return enrich.label_net_vat(Inputs(spark, d).documents(), SINCE)


@q("label_region", O.build("select cont_rut, unidad_regional from lbl_region", ["lbl_region"]))
def q_label_region(spark, d):
    inp = Inputs(spark, d)
    return enrich.label_region(inp.businesses(), inp.units())


@q("label_doc_count", O.build("select cont_rut, n_documentos from lbl_docs", ["lbl_docs"]))
def q_label_doc_count(spark, d):
    return enrich.label_doc_count(Inputs(spark, d).documents())


@q("label_lifetime", O.build("select cont_rut, cast(lifetime as double) as lifetime from lbl_life", ["lbl_life"]))
def q_label_lifetime(spark, d):
    return enrich.label_lifetime(Inputs(spark, d).taxpayers(), AS_OF).select(
        "cont_rut", F.col("lifetime").cast("double").alias("lifetime"))


@q("label_seed", O.build("""select n.cont_rut, case when s.cont_rut is null then 0 else 1 end as alerta_inicial
 from combined_nodes n left join seeds s on n.cont_rut = s.cont_rut""", ["combined_nodes", "seeds"]))
def q_label_seed(spark, d):
    inp = Inputs(spark, d)
    return enrich.label_seed(propagate.node_universe(inp.edges("combined")), inp.seeds())


# Nullable integer labels are reported as double, as in the reference's
# labelled table (a CSV read back by pandas): engine-independent nulls.
ENRICH_COLS_SQL = (f"cont_rut, {R6('score', 'score')}, cast(total_pago_f29 as double) as total_pago_f29, "
                   "cast(IVA_neto as double) as IVA_neto, unidad_regional, cast(n_documentos as double) as n_documentos, "
                   "cast(lifetime as double) as lifetime, alerta_inicial")


def _enrich_cols(df):
    return df.select("cont_rut", r6("score").alias("score"),
                     *[F.col(c).cast("double").alias(c) for c in ("total_pago_f29", "IVA_neto")],
                     "unidad_regional",
                     *[F.col(c).cast("double").alias(c) for c in ("n_documentos", "lifetime")],
                     "alerta_inicial")


@q("enrich", O.build(f"select {ENRICH_COLS_SQL} from {ENR}", [ENR]))
def q_enrich(spark, d):
    return _enrich_cols(labelled_nodes(spark, d))


@q("label_coverage", O.build(f"""select count(distinct cont_rut) as n_entities, count(total_pago_f29) as n_total_pago_f29,
 count(IVA_neto) as n_IVA_neto, count(unidad_regional) as n_unidad_regional, count(n_documentos) as n_n_documentos,
 count(lifetime) as n_lifetime, cast(sum(alerta_inicial) as bigint) as n_seeds from {ENR}""", [ENR]))
def q_label_coverage(spark, d):
    return enrich.label_coverage(labelled_nodes(spark, d))


# ================================================================= communities
O.cte("und", """select least(emisor, receptor) as u, greatest(emisor, receptor) as v, sum(Fi) as w
 from f_comb group by 1, 2""", ("f_comb",))
O.cte("und_deg", """select node, sum(w) as k from (select u as node, w from und union all select v, w from und)
 group by node""", ("und",))
O.cte("fixed_memb", f"select cont_rut as nodo, cont_rut % {fixtures.FIXED_COMMUNITIES} + 1 as comunidad "
                    "from combined_nodes", ("combined_nodes",))
O.cte("fixed_q", """select sum(coalesce(l.L, 0) / (select sum(w) from und)
   - power(dc.d / (2 * (select sum(w) from und)), 2)) as modularidad
 from (select m.comunidad as c, sum(k) as d from und_deg g join fixed_memb m on g.node = m.nodo group by 1) dc
 left join (select a.comunidad as c, sum(w) as L from und join fixed_memb a on und.u = a.nodo
            join fixed_memb b on und.v = b.nodo where a.comunidad = b.comunidad group by 1) l on dc.c = l.c""",
      ("und", "und_deg", "fixed_memb"))
O.cte("labelled", f"""select e.*, m.comunidad, (select modularidad from fixed_q) as modularidad
 from {ENR} e left join fixed_memb m on e.cont_rut = m.nodo""", (ENR, "fixed_memb", "fixed_q"), materialized=True)


@q("undirected", O.build(f"select u, v, {R6('w', 'w')} from und", ["und"]))
def q_undirected(spark, d):
    return Inputs(spark, d).undirected().select("u", "v", r6("w").alias("w"))


@q("modularity", O.build(f"select {R6('modularidad', 'modularidad')} from fixed_q", ["fixed_q"]))
def q_modularity(spark, d):
    inp = Inputs(spark, d)
    und = inp.undirected()
    mb = fixed_membership(propagate.node_universe(inp.edges("combined")))
    return community.modularity(und, mb, 1.0, node="nodo").select(r6("modularidad").alias("modularidad"))


LAB_COLS_SQL = ENRICH_COLS_SQL + f", comunidad, {R6('modularidad', 'modularidad')}"


def _lab_cols(df):
    return _enrich_cols(df).join(df.select("cont_rut", "comunidad", r6("modularidad").alias("modularidad")), "cont_rut")


@q("attach_communities", O.build(f"select {LAB_COLS_SQL} from labelled", ["labelled"]))
def q_attach_communities(spark, d):
    return _lab_cols(labelled_nodes(spark, d))


def _nodes_of(cte: str) -> str:
    return f"(select count(*) from (select u from {cte} union select v from {cte}))"


def _certificate_sql(gammas) -> str:
    values = ", ".join(f"({g}::double)" for g in gammas)
    return O.build(f"""select gamma, {_nodes_of('und')} as n_nodes, true as once, true as gapless, true as connected,
 true as stable, true as q_stated from (values {values}) g(gamma)""", ["und"])


def _certified(spark, d, study):
    c = community.certificate(Inputs(spark, d).undirected(), study)
    return c.select("gamma", "n_nodes", "once", "gapless", "connected", "stable", "q_stated")


@q("louvain", _certificate_sql([0.5]))
def q_louvain(spark, d):
    """F2 at resolution 0.5 (the main run) on the combined force graph, as its certificate: every node has one
    community, labels run 1..k by size, communities are connected, no single move gains, Q is as stated."""
    return _certified(spark, d, louvain_membership(spark, d, 0.5, 0).withColumn("gamma", F.lit(0.5)))


@q("louvain_labelled", O.build(f"select {ENRICH_COLS_SQL}, true as en_comunidad, true as modularidad_cierta from {ENR}", [ENR]))
def q_louvain_labelled(spark, d):
    """F2 + F3 + F4: labelled nodes with Louvain communities and Q at γ=1. Which community is Louvain's to choose; that
    each node has one, and the Q of the result by F3's other path, are checked."""
    mb = io.cut(louvain_membership(spark, d, 0.5, 0).select("nodo", "comunidad"), "louvain-members")
    lab = labelled_nodes(spark, d, membership=mb)
    memb = mb.select(F.lit(1.0).alias("gamma"), F.col("nodo").alias("node"), F.col("comunidad").alias("c"))
    und = Inputs(spark, d).undirected()
    # written: its one γ is a constant, and a join on it would be planned as a nested loop
    q1 = io.cut(community.modularities(und, memb, und.agg(F.sum("w")).first()[0]), "labelled-q").select("q_1").scalar()
    extra = lab.select("cont_rut", F.col("comunidad").isNotNull().alias("en_comunidad"),
                       (F.abs(F.col("modularidad") - q1) < 1e-9).alias("modularidad_cierta"))
    return _enrich_cols(lab).join(extra, "cont_rut")


@q("resolution_study", _certificate_sql(GAMMAS))
def q_resolution_study(spark, d):
    """Louvain at γ = 0.0, 0.1, …, 1.0, as the certificate of each partition (see q_louvain)."""
    return _certified(spark, d, resolution_study(spark, d))


@q("study_table", O.build(f"select {ENRICH_COLS_SQL}, 11 as comunidades, 11 as modularidades_ciertas from {ENR}", [ENR]))
def q_study_table(spark, d):
    """labelled nodes with one community and one modularity column per γ: how many of the first are there, and how
    many of the second are Q at γ = 1 of that partition, computed anew."""
    study = resolution_study(spark, d)
    wide = community.study_table(labelled_nodes(spark, d), study, GAMMAS)
    und = Inputs(spark, d).undirected()
    memb = study.select("gamma", F.col("nodo").alias("node"), F.col("comunidad").alias("c"))
    q1 = io.cut(community.modularities(und, memb, und.agg(F.sum("w")).first()[0]), "study-q")  # one row per γ
    there = sum((F.col(f"`comunidad_{g}`").isNotNull().cast("int") for g in GAMMAS), F.lit(0))
    right = sum((F.coalesce(F.abs(F.col(f"`modularidad_{g}`") - q1.where(F.col("gamma") == g).select("q_1").scalar()) < 1e-9, F.lit(False)).cast("int")
                 for g in GAMMAS), F.lit(0))
    return _enrich_cols(wide).join(wide.select("cont_rut", there.alias("comunidades"), right.alias("modularidades_ciertas")), "cont_rut")


#: Components from the nodes that no neighbour is smaller than: the smallest of a component is one of them.
_REACH = """with recursive ends as (select u as a, v as b from und union select v, u from und),
 low as (select a from ends group by a having min(b) >= a),
 reach(node, low) as (select a, a from low union select e.b, r.low from reach r join ends e on r.node = e.a)
 select node, min(low) as component from reach group by node"""


@q("components", O.build(f"select * from ({_REACH})", ["und"]))
def q_components(spark, d):
    """The γ = 0 limit of F2 by itself: connected components of the whole graph."""
    return community.connected_components(Inputs(spark, d).undirected()).select("node", F.col("c").alias("component"))


@q("louvain_zero", O.build(f"""select t.node as nodo, k.comunidad from ({_REACH}) t join
 (select component, row_number() over (order by count(*) desc, component) as comunidad from ({_REACH}) group by component) k
 on t.component = k.component""", ["und"]))
def q_louvain_zero(spark, d):
    """F2 at γ = 0: components, labelled by size, through the same code as every γ."""
    return community.louvain(Inputs(spark, d).undirected(), resolution=0.0).select("nodo", "comunidad")


def _hashed(c: str):
    """A text id in Base64, as the published extracts have: the order is not that of the numbers."""
    return F.base64(F.unhex(F.md5(F.col(c).cast("string"))))


@q("louvain_text_ids", _certificate_sql([0.0, 0.5, 1.0]))
def q_louvain_text_ids(spark, d):
    """F1-F3, F5 on Base64 ids: the same graph with every id hashed to text."""
    e = Inputs(spark, d).edges("combined").select(_hashed("emisor").alias("emisor"), _hashed("receptor").alias("receptor"), "Fi")
    und = io.cut(community.to_undirected(e), "text-ids")
    study = io.cut(community.partitions(und, [0.0, 0.5, 1.0]), "text-ids-study")
    c = community.certificate(und, study)
    return c.select("gamma", "n_nodes", "once", "gapless", "connected", "stable", "q_stated")


# ====================================================================== report
@q("communities_min_size", O.build(f"""select {LAB_COLS_SQL} from labelled where comunidad in
 (select comunidad from labelled where comunidad is not null group by comunidad having count(*) >= 15)""",
                                   ["labelled"]))
def q_communities_min_size(spark, d):
    return _lab_cols(report.min_size(labelled_nodes(spark, d), 15))


@q("rank_communities", O.build(f"""select comunidad, {R6('avg(score)', 'score')} from labelled where comunidad in
 (select comunidad from labelled where comunidad is not null group by comunidad having count(*) >= 15)
 group by comunidad""", ["labelled"]))
def q_rank_communities(spark, d):
    r = report.rank_communities(report.min_size(labelled_nodes(spark, d), 15))
    return r.select("comunidad", r6("score").alias("score"))


TOP5_SQL = """select comunidad from (select comunidad, avg(score) as s from labelled where comunidad in
 (select comunidad from labelled where comunidad is not null group by comunidad having count(*) >= 15)
 group by comunidad) order by s desc, comunidad limit 5"""
O.cte("top5", TOP5_SQL, ("labelled",))
O.cte("top5_rows", "select * from labelled where comunidad in (select comunidad from top5)", ("labelled", "top5"))


def _top5_rows(spark, d):
    lab = report.min_size(labelled_nodes(spark, d), 15)
    top = report.top_communities(lab, 5).select("comunidad")
    return lab.join(top, "comunidad", "left_semi")


@q("top_communities", O.build(f"""select comunidad, {R6('s', 'score')} from (select comunidad, avg(score) as s
 from labelled where comunidad in (select comunidad from top5) group by comunidad)""", ["labelled", "top5"]))
def q_top_communities(spark, d):
    t = report.top_communities(report.min_size(labelled_nodes(spark, d), 15), 5)
    return t.select("comunidad", r6("score").alias("score"))


@q("community_profile", O.build(f"""select p.comunidad, p.group_size, {R6('p.score_mean', 'score_mean')},
 p.alertas_iniciales, {R6('p.perc_alertas', 'perc_alertas')}, m.most_common_region, m.most_common_count
 from (select comunidad, count(*) as group_size, avg(score) as score_mean,
       cast(sum(alerta_inicial) as bigint) as alertas_iniciales,
       100.0 * sum(alerta_inicial) / count(*) as perc_alertas from top5_rows group by comunidad) p
 left join (select comunidad, unidad_regional as most_common_region, c as most_common_count from
   (select comunidad, unidad_regional, c, row_number() over (partition by comunidad order by c desc, unidad_regional) as rn
    from (select comunidad, unidad_regional, count(*) as c from top5_rows where unidad_regional is not null
          group by 1, 2)) where rn = 1) m on p.comunidad = m.comunidad""", ["top5_rows"]))
def q_community_profile(spark, d):
    p = report.community_profile(_top5_rows(spark, d))
    return p.select("comunidad", "group_size", r6("score_mean").alias("score_mean"), "alertas_iniciales",
                    r6("perc_alertas").alias("perc_alertas"), "most_common_region", "most_common_count")


def _describe_sql(src: str, value: str, by: list[str], where: str = "true") -> str:
    g = ", ".join(by)
    sel = (g + ", ") if by else ""
    grp = f" group by {g}" if by else ""
    return f"""select {sel}count({value}) as count, {R6(f'avg({value})', 'mean')}, {R6(f'stddev_samp({value})', 'std')},
 {R6(f'min({value})', 'min')}, {R6(f'quantile_cont({value}, 0.25)', 'q25')}, {R6(f'quantile_cont({value}, 0.5)', 'q50')},
 {R6(f'quantile_cont({value}, 0.75)', 'q75')}, {R6(f'max({value})', 'max')} from {src} where {where}{grp}"""


def _describe_cols(df, by=()):
    return df.select(*by, "count", r6("mean").alias("mean"), r6("std").alias("std"), r6("min").alias("min"),
                     r6("q25").alias("q25"), r6("q50").alias("q50"), r6("q75").alias("q75"), r6("max").alias("max"))


_G5_COLS = ["score", "total_pago_f29", "IVA_neto", "n_documentos", "lifetime", "alerta_inicial", "modularidad"]
O.cte("top5_long", " union all ".join(
    f"select comunidad, '{c}' as \"column\", cast({c} as double) as value from top5_rows" for c in _G5_COLS),
    ("top5_rows",))


@q("community_describe", O.build(
    _describe_sql("top5_long", "value", ["comunidad", '"column"'], "value is not null"), ["top5_long"]))
def q_community_describe(spark, d):
    return _describe_cols(report.community_describe(_top5_rows(spark, d)), ["comunidad", "column"])


def _hist_sql(src: str, col: str, bins: int, by: list[str], where: str = "true", density: bool = False) -> str:
    g = ", ".join(by)
    sel = (g + ", ") if by else ""
    join_on = " and ".join(f"x.{b} = s.{b}" for b in by) or "true"
    grid_by = ", ".join(f"s.{b}" for b in by)
    gsel = (grid_by + ", ") if by else ""
    cnt_by = ", ".join(f"c.{b}" for b in by)
    on_c = " and ".join([f"c.{b} = gr.{b}" for b in by] + ["c.bin = gr.bin"])
    dens = (f", {R6('coalesce(c.count, 0) / (gr.n * case when gr.mx = gr.mn then 1.0 else (gr.mx - gr.mn) / ' + str(bins) + ' end)', 'density')}"
            if density else "")
    bysel = ", ".join(f"gr.{b}" for b in by)
    bysel = (bysel + ", ") if by else ""
    return f"""with base as (select {sel}cast({col} as double) as x from {src} where {col} is not null and ({where})),
 st as (select {sel}min(x) as mn, max(x) as mx, count(*) as n from base{(' group by ' + g) if by else ''}),
 binned as (select {('x.' + ', x.'.join(by) + ', ') if by else ''}case when s.mx = s.mn then 0
   else least(floor((x.x - s.mn) * {bins} / (s.mx - s.mn)), {bins - 1}) end as bin
   from base x join st s on {join_on}),
 c as (select {sel}cast(bin as integer) as bin, count(*) as count from binned group by {sel}bin),
 gr as (select {gsel}s.mn, s.mx, s.n, cast(b.bin as integer) as bin from st s, range({bins}) b(bin))
 select {bysel}gr.bin, {R6(f'gr.mn + gr.bin * (gr.mx - gr.mn) / {bins}', 'bin_lo')},
  {R6(f'case when gr.bin = {bins - 1} then gr.mx else gr.mn + (gr.bin + 1) * (gr.mx - gr.mn) / {bins} end', 'bin_hi')},
  cast(coalesce(c.count, 0) as bigint) as count{dens}
 from gr left join c on {on_c}"""


def _hist_cols(df, by=(), density=False):
    cols = [*by, "bin", r6("bin_lo").alias("bin_lo"), r6("bin_hi").alias("bin_hi"), "count"]
    if density:
        cols.append(r6("density").alias("density"))
    return df.select(*cols)


def _nested(inner: str, needs) -> str:
    """Prefix the CTEs ``needs`` to a query that has its own WITH."""
    head = O.build("select 1", needs)
    return head[:-len("select 1")].rstrip() + ",\n" + inner[len("with "):]


@q("community_hist", _nested(_hist_sql("top5_rows", "score", 10, ["comunidad"]), ["top5_rows"]))
def q_community_hist_total(spark, d):
    h = profile.histogram(_top5_rows(spark, d), "score", 10, by=["comunidad"])
    return _hist_cols(h, ["comunidad"])


@q("community_hist_stacked", O.build(f"""select r.comunidad, cast(case when g.mx = g.mn then 0
   else least(floor((r.score - g.mn) * 10 / (g.mx - g.mn)), 9) end as integer) as bin, r.alerta_inicial,
   count(*) as count from top5_rows r join (select comunidad, min(score) as mn, max(score) as mx from top5_rows
   group by comunidad) g on r.comunidad = g.comunidad where r.score is not null group by 1, 2, 3""", ["top5_rows"]))
def q_community_hist_stacked(spark, d):
    h = report.community_hist(_top5_rows(spark, d), 10)
    return h.select("comunidad", "bin", "alerta_inicial", "count")


# ================================================================ distributions
@q("hist_vat", _nested(_hist_sql("arcs", "Monto_IVA", 30, [], "Monto_IVA > 0 and Monto_IVA < 1e6"), ["arcs"]))
def q_hist_vat(spark, d):
    a = Inputs(spark, d).arcs().where((F.col("Monto_IVA") > 0) & (F.col("Monto_IVA") < 1e6))
    return _hist_cols(profile.histogram(a, "Monto_IVA", 30))


@q("hist_score", _nested(_hist_sql("combined_s15", "score", 10, [], "score > 0.1"), ["combined_s15"]))
def q_hist_score(spark, d):
    st = run_scenario(spark, d, "combined", 15).state.where(F.col("score") > 0.1)
    return _hist_cols(profile.histogram(st, "score", 10))


O.cte("new_comb", "select s.cont_rut as contaminados, round(s.score, 3) as score from combined_s15 s "
                  "where s.cont_rut not in (select cont_rut from seeds)", ("combined_s15", "seeds"))


def _new_comb(spark, d):
    return propagate.new_scores(run_scenario(spark, d, "combined", 15).state, Inputs(spark, d).seeds())


@q("hist_density", _nested(_hist_sql("new_comb", "score", 100, [], "score > 0", density=True), ["new_comb"]))
def q_hist_density(spark, d):
    return _hist_cols(profile.histogram(_new_comb(spark, d).where(F.col("score") > 0), "score", 100,
                                        stat="density"), density=True)


@q("hist_density_high", _nested(_hist_sql("new_comb", "score", 100, [], "score >= 0.5", density=True),
                                ["new_comb"]))
def q_hist_density_high(spark, d):
    return _hist_cols(profile.histogram(_new_comb(spark, d).where(F.col("score") >= 0.5), "score", 100,
                                        stat="density"), density=True)


_KDE_SQL = f"""select cast(g.i as integer) as i, {R6('st.lo + g.i * (st.hi - st.lo) / 199', 'x')},
 {R6('sum(v.w * exp(-0.5 * power((v.x - (st.lo + g.i * (st.hi - st.lo) / 199)) / st.h, 2))) / (st.n * st.h * sqrt(2 * pi()))', 'density')}
 from (select score as x, count(*) as w from {{src}} where score >= 0.5 group by score) v,
  (select n, h, mn - 3 * h as lo, mx + 3 * h as hi from (select count(*) as n, stddev_samp(score) * power(count(*), -0.2) as h,
    min(score) as mn, max(score) as mx from {{src}} where score >= 0.5)) st,
  range(200) g(i)
 group by g.i, st.lo, st.hi, st.n, st.h"""


@q("kde_score", O.build(_KDE_SQL.format(src="new_comb"), ["new_comb"]))
def q_kde_score(spark, d):
    k = profile.kde(_new_comb(spark, d).where(F.col("score") >= 0.5), "score", 200)
    return k.select(F.col("i").cast("int").alias("i"), r6("x").alias("x"), r6("density").alias("density"))


@q("describe_scores", O.build(_describe_sql("combined_s15", "score", []), ["combined_s15"]))
def q_describe_scores(spark, d):
    return _describe_cols(describe(run_scenario(spark, d, "combined", 15).state, "score", tiebreak=["cont_rut"]))


@q("describe_positive", O.build(_describe_sql("new_comb", "score", [], "score > 0"), ["new_comb"]))
def q_describe_positive(spark, d):
    return _describe_cols(describe(_new_comb(spark, d).where(F.col("score") > 0), "score",
                                   tiebreak=["contaminados"]))


@q("describe_high", O.build(_describe_sql("new_comb", "score", [], "score >= 0.5"), ["new_comb"]))
def q_describe_high(spark, d):
    return _describe_cols(describe(_new_comb(spark, d).where(F.col("score") >= 0.5), "score",
                                   tiebreak=["contaminados"]))


def _cmp_sql() -> str:
    parts, needs = [], []
    for sc in ("vat", "rep", "combined"):
        st = f"{sc}_s15"
        needs.append(st)
        parts.append(f"""select '{sc}' as scenario, count_if(score >= 0.5) as n_high, count_if(score > 0) as n_positive,
 count(*) as n_new from (select round(s.score, 3) as score from {st} s where s.cont_rut not in (select cont_rut from seeds))""")
    return O.build("\nunion all\n".join(parts), needs + ["seeds"])


@q("compare_scenarios", _cmp_sql())
def q_compare_scenarios(spark, d):
    sd = Inputs(spark, d).seeds()
    return profile.compare_scenarios({sc: propagate.new_scores(run_scenario(spark, d, sc, 15).state, sd)
                                      for sc in ("vat", "rep", "combined")})


# KDE of every positive score too: the work of a task does not grow with distinct values
q("kde_positive", O.build(_KDE_SQL.format(src="new_comb").replace("score >= 0.5", "score > 0"), ["new_comb"]))(
    lambda spark, d: profile.kde(_new_comb(spark, d).where(F.col("score") > 0), "score", 200).select(
        F.col("i").cast("int").alias("i"), r6("x").alias("x"), r6("density").alias("density")))


# =================================================================== graph ops
SAMPLE_COMMUNITIES = (3, 7, 11)
_ids = ", ".join(str(i) for i in SAMPLE_COMMUNITIES)
O.cte("sample_nodes", f"select * from labelled where comunidad in ({_ids})", ("labelled",))


@q("select_communities", O.build(f"select {LAB_COLS_SQL} from sample_nodes", ["sample_nodes"]))
def q_select_communities(spark, d):
    return _lab_cols(graphops.select_communities(labelled_nodes(spark, d), SAMPLE_COMMUNITIES))


@q("induced_edges", O.build(f"""select emisor, receptor, {R6('Fi', 'Fi')} from f_comb
 where emisor in (select cont_rut from sample_nodes) and receptor in (select cont_rut from sample_nodes)""",
                            ["f_comb", "sample_nodes"]))
def q_induced_edges(spark, d):
    nodes = graphops.select_communities(labelled_nodes(spark, d), SAMPLE_COMMUNITIES)
    e = graphops.induced_edges(Inputs(spark, d).edges("combined"), nodes)
    return e.select("emisor", "receptor", r6("Fi").alias("Fi"))


O.cte("exp_edges", """select emisor, receptor, max(cast(Fi as double)) as Fuerza from f_comb
 where emisor in (select cont_rut from labelled) and receptor in (select cont_rut from labelled)
 group by emisor, receptor""", ("f_comb", "labelled"))


def _export_edges(spark, d):
    return export.export_edges(Inputs(spark, d).edges("combined"), labelled_nodes(spark, d))


@q("relations", O.build("select emisor as source, 'emite_a' as relation, receptor as target from exp_edges",
                        ["exp_edges"]))
def q_relations(spark, d):
    return graphops.relations(_export_edges(spark, d))


@q("relations_communities", O.build("""select e.emisor as source, 'emite_a' as relation, e.receptor as target,
 a.comunidad as comunidad_source, b.comunidad as comunidad_target from exp_edges e
 join labelled a on e.emisor = a.cont_rut join labelled b on e.receptor = b.cont_rut""", ["exp_edges", "labelled"]))
def q_relations_communities(spark, d):
    return graphops.relations_with_communities(_export_edges(spark, d), labelled_nodes(spark, d))


@q("community_index", O.build("""select row_number() over (order by comunidad nulls last) - 1 as indice, comunidad
 from (select distinct comunidad from labelled)""", ["labelled"]))
def q_community_index(spark, d):
    """Distinct communities with their place in the list."""
    return graphops.community_index(labelled_nodes(spark, d))


@q("distinct_communities", O.build("select distinct comunidad from labelled", ["labelled"]))
def q_distinct_communities(spark, d):
    return graphops.distinct_communities(labelled_nodes(spark, d))


EDGE_COMMUNITY = 7


@q("community_edges", O.build(f"""select e.emisor as source, a.alerta_inicial, a.IVA_neto, 'emite_a' as relation,
 e.receptor as target from exp_edges e join labelled a on e.emisor = a.cont_rut join labelled b on e.receptor = b.cont_rut
 where cast(a.comunidad as varchar) = '{EDGE_COMMUNITY}' or cast(b.comunidad as varchar) = '{EDGE_COMMUNITY}'""",
                              ["exp_edges", "labelled"]))
def q_community_edges(spark, d):
    return graphops.community_edges(_export_edges(spark, d), labelled_nodes(spark, d), EDGE_COMMUNITY)


# ====================================================================== export
def _txt(c: str, dbl: bool = False) -> str:
    if dbl:
        return f"coalesce(cast(cast(round({c} + 1e-10, 6) as decimal(38, 6)) as varchar), '') as {c}"
    return f"coalesce(cast({c} as varchar), '') as {c}"


@q("export_nodes", O.build(f"""select cast(cont_rut as varchar) as cont_rut, {_txt('score', True)},
 {_txt('total_pago_f29')}, {_txt('IVA_neto')}, {_txt('unidad_regional')}, {_txt('n_documentos')},
 {_txt('lifetime')}, {_txt('alerta_inicial')}, {_txt('comunidad')} from labelled""", ["labelled"]))
def q_export_nodes(spark, d):
    return export.export_nodes(labelled_nodes(spark, d))


@q("export_edges", O.build(f"select emisor, receptor, {R6('Fuerza', 'Fuerza')}, 'emite_a' as relation from exp_edges",
                           ["exp_edges"]))
def q_export_edges(spark, d):
    return _export_edges(spark, d).select("emisor", "receptor", r6("Fuerza").alias("Fuerza"), "relation")


@q("community_edges_stored", ORACLE["community_edges"])
def q_community_edges_stored(spark, d):
    """I6 from the store by communities: a row and a column of its grid are read."""
    return edgestore.community_edges(spark, _edge_store(spark, d), EDGE_COMMUNITY)


@q("induced_edges_stored", ORACLE["induced_edges"])
def q_induced_edges_stored(spark, d):
    """I1 + I2 from the store: only the cells of the chosen communities are read."""
    e = edgestore.induced_edges(spark, _edge_store(spark, d), SAMPLE_COMMUNITIES)
    return e.select("emisor", "receptor", r6("Fi").alias("Fi"))


def _edge_store(spark, d):
    path = scratch_path(spark, "edge-store")
    edgestore.write_edge_store(Inputs(spark, d).edges("combined"), labelled_nodes(spark, d), path)
    return path


@q("loaded_nodes", ORACLE["export_nodes"])
def q_loaded_nodes(spark, d):
    """A8 through the batch loader, written twice: as written once."""
    nodes, folder = export.export_nodes(labelled_nodes(spark, d)), scratch_path(spark, "loaded-nodes")
    for sequence in (1, 2):
        loader.load(nodes, folder, ["cont_rut"], sequence)
    return loader.read_loaded(spark, folder, nodes.schema)


@q("loaded_edges", O.build(f"""select emisor, receptor, {R6('case when emisor < receptor then Fuerza / 2 else Fuerza end', 'Fuerza')},
 'emite_a' as relation from exp_edges""", ["exp_edges"]))
def q_loaded_edges(spark, d):
    """A9 through the batch loader: a later load replaces the relations that it names and leaves the others."""
    edges, folder = io.cut(_export_edges(spark, d), "edges-to-load"), scratch_path(spark, "loaded-edges")
    later = edges.where("emisor < receptor").withColumn("Fuerza", F.col("Fuerza") / 2)
    loader.load(later, folder, ["emisor", "receptor"], 7)
    loader.load(edges, folder, ["emisor", "receptor"], 3)  # comes last, but is the earlier one
    return loader.read_loaded(spark, folder, edges.schema).select("emisor", "receptor", r6("Fuerza").alias("Fuerza"), "relation")


@q("export_edges_of_paying", O.build(f"""select emisor, receptor, {R6('max(cast(Fi as double))', 'Fuerza')}, 'emite_a' as relation from f_comb
 where emisor in (select cont_rut from labelled where total_pago_f29 is not null)
   and receptor in (select cont_rut from labelled where total_pago_f29 is not null) group by emisor, receptor""", ["f_comb", "labelled"]))
def q_export_edges_of_paying(spark, d):
    """A9 where ends are missing: only entities with a tax payment are loaded as nodes, and edges to others fall out."""
    nodes = labelled_nodes(spark, d).where("total_pago_f29 is not null")
    return export.export_edges(Inputs(spark, d).edges("combined"), nodes).select("emisor", "receptor", r6("Fuerza").alias("Fuerza"), "relation")


#: Nodes of two extracts that overlap: every entity, and once more those that are seeds.
O.cte("two_extracts", "select cont_rut, score, 'todos' as origen from labelled union all select cont_rut, score, 'semillas' from labelled where alerta_inicial = 1",
      ("labelled",))


@q("refused_nodes", O.build(f"""select cont_rut, {R6('score', 'score')}, origen, count(*) over (partition by cont_rut) as key_rows from two_extracts
 qualify key_rows > 1""", ["two_extracts"]))
def q_refused_nodes(spark, d):
    """A10: a node table with duplicate ids is refused; the rows at fault are kept."""
    lab = labelled_nodes(spark, d)
    both = lab.select("cont_rut", "score", F.lit("todos").alias("origen")).union(
        lab.where("alerta_inicial = 1").select("cont_rut", "score", F.lit("semillas").alias("origen")))
    got = publish.publish_unique(both, scratch_path(spark, "publish"), "cont_rut")
    if got.ok:
        raise ValueError("duplicate ids were published")
    return spark.read.parquet(got.rejects).select("cont_rut", r6("score").alias("score"), "origen", "key_rows")


@q("published_nodes", O.build(f"select {ENRICH_COLS_SQL} from {ENR}", [ENR]))
def q_published_nodes(spark, d):
    """A10: a table that keeps the rule is published whole."""
    folder = scratch_path(spark, "publish")
    lab = labelled_nodes(spark, d)
    got = publish.publish_unique(lab, folder, "cont_rut")
    if not got.ok:
        raise ValueError(f"{got.n_violations} ids are not unique: {got.rejects}")
    return _enrich_cols(publish.read_published(spark, folder))


@q("groups_min_size", O.build(f"""select {LAB_COLS_SQL} from labelled where n_documentos in (select n_documentos from labelled
 where n_documentos is not null group by n_documentos having count(*) >= 4)""", ["labelled"]))
def q_groups_min_size(spark, d):
    """G1 on groups of all sizes: entities by number of invoices, groups of at least four."""
    return _lab_cols(report.min_size(labelled_nodes(spark, d), 4, key="n_documentos"))


@q("node_key_violations", O.build("select cont_rut, count(*) as n from labelled group by cont_rut having count(*) > 1",
                                  ["labelled"]))
def q_node_key_violations(spark, d):
    return export.node_key_violations(labelled_nodes(spark, d))


# ================================================= round trips through formats

FORCE_SQL = O.build(f"select emisor, receptor, {R6('Fi', 'Fi')} from f_vat", ["f_vat"])


def _force_cols(df):
    return df.select("emisor", "receptor", r6("Fi").alias("Fi"))


@q("csv_typed", FORCE_SQL)
def q_csv_typed(spark, d):
    """The force table as CSV with a header, read back with its schema."""
    f = Inputs(spark, d).force_vat()
    path = scratch_path(spark, "force-csv")
    io.write_csv(f, path)
    return _force_cols(io.read_csv(spark, path, f.schema))


@q("csv_untyped", O.build(f"select PARU_RUT_E0 as emisor, PARU_RUT_E2 as receptor, {R6('Monto_IVA', 'Fi')} from arcs", ["arcs"]))
def q_csv_untyped(spark, d):
    """A raw extract with ';' and no types, cast and renamed."""
    path = scratch_path(spark, "arcs-csv")
    io.write_csv(Inputs(spark, d).arcs().withColumnRenamed("Monto_IVA", "Fi"), path, sep=";")
    raw = io.cast_columns(io.read_csv(spark, path, sep=";"), {"PARU_RUT_E0": "bigint", "PARU_RUT_E2": "bigint"})
    return _force_cols(forces.normalise_edges(raw))


#: A raw extract of the arcs with ';' and a decimal comma, in which some lines are broken: one field too few, a word for the
#: amount, no receiver. Which ones follows from the data.
O.cte("raw_arcs", """select case when Monto_IVA % 7 = 3 then concat(PARU_RUT_E0, ';', PARU_RUT_E2)
  else concat(PARU_RUT_E0, ';', case when Monto_IVA % 5 = 2 then '' else cast(PARU_RUT_E2 as varchar) end, ';',
              case when Monto_IVA % 11 = 4 then 'sin monto' else concat(Monto_IVA, ',25') end) end as line,
 PARU_RUT_E0, PARU_RUT_E2, Monto_IVA,
 case when Monto_IVA % 7 = 3 then 'columns' when Monto_IVA % 5 = 2 and Monto_IVA % 11 = 4 then 'receptor,Fi'
      when Monto_IVA % 5 = 2 then 'receptor' when Monto_IVA % 11 = 4 then 'Fi' end as reason from arcs""", ("arcs",))


def _raw_arcs(spark, d):
    m, e, r = F.col("Monto_IVA"), F.col("PARU_RUT_E0"), F.col("PARU_RUT_E2")
    receiver = F.when(m % 5 == 2, F.lit("")).otherwise(r.cast("string"))
    amount = F.when(m % 11 == 4, F.lit("sin monto")).otherwise(F.concat(m, F.lit(",25")))
    line = F.when(m % 7 == 3, F.concat(e, F.lit(";"), r)).otherwise(F.concat(e, F.lit(";"), receiver, F.lit(";"), amount))
    path = scratch_path(spark, "raw-arcs")
    Inputs(spark, d).arcs().select(line.alias("value")).write.text(path)
    schema = StructType([StructField("emisor", LongType()), StructField("receptor", LongType(), False), StructField("Fi", DoubleType())])
    return checked.read_csv_checked(spark, path, schema, sep=";", decimal=",", header=False)


@q("csv_checked_good", O.build(f"""select PARU_RUT_E0 as emisor, PARU_RUT_E2 as receptor,
 {R6("cast(concat(Monto_IVA, '.25') as double)", 'Fi')} from raw_arcs where reason is null""", ["raw_arcs"]))
def q_csv_checked_good(spark, d):
    """A1, A2: the rows of a broken extract that can be read, decimal comma parsed."""
    return _force_cols(_raw_arcs(spark, d)[0])


@q("csv_checked_rejects", O.build("select line, reason from raw_arcs where reason is not null", ["raw_arcs"]))
def q_csv_checked_rejects(spark, d):
    """A1, A2: the rows that cannot, as they stand in the file, with the reason."""
    return _raw_arcs(spark, d)[1].select("line", "reason")


@q("parquet_round_trip", FORCE_SQL)
def q_parquet_round_trip(spark, d):
    """A3 and A5."""
    path = scratch_path(spark, "force-parquet")
    io.write_parquet(Inputs(spark, d).force_vat(), path)
    return _force_cols(io.read_parquet(spark, path))


@q("table_round_trip", FORCE_SQL)
def q_table_round_trip(spark, d):
    """A4: an external catalog table."""
    path = scratch_path(spark, "force-table")
    name = path.rsplit("/", 1)[1].replace("-", "_")
    Inputs(spark, d).force_vat().write.option("path", path).saveAsTable(name)
    return _force_cols(io.read_table(spark, name))


@q("view_query", O.build("select receptor, count(*) as n from f_vat group by receptor", ["f_vat"]))
def q_view_query(spark, d):
    """A7."""
    io.register(Inputs(spark, d).force_vat(), "force_vat_view")
    return spark.sql("select receptor, count(*) as n from force_vat_view group by receptor")


@q("schema_of_outputs", O.build("""select tabla, cast(place as int) as place, name, type from (values
 ('arcs', 0, 'PARU_RUT_E0', 'bigint'), ('arcs', 1, 'PARU_RUT_E2', 'bigint'), ('arcs', 2, 'Monto_IVA', 'bigint'),
 ('forces', 0, 'emisor', 'bigint'), ('forces', 1, 'receptor', 'bigint'), ('forces', 2, 'Fi', 'double'),
 ('scores', 0, 'cont_rut', 'bigint'), ('scores', 1, 'score', 'double')) t(tabla, place, name, type)""", []))
def q_schema_of_outputs(spark, d):
    """Names and types of the arcs, the force graph and the scores, as read."""
    inp = Inputs(spark, d)
    tables = {"arcs": inp.arcs(), "forces": inp.edges("combined"), "scores": run_scenario(spark, d, "combined", rounds=1).state}
    return reduce(lambda a, b: a.unionByName(b), [io.schema_rows(df).select(F.lit(t).alias("tabla"), "place", "name", "type") for t, df in tables.items()])


@q("seeds_active_raw", O.build("""select cast(CONT_RUT_E as bigint) as cont_rut, 1 as score
 from active_alerts where ALER_COD_TIPO_ALERTA in ('4110','4111','4112','4113')""", ["active_alerts"]))
def q_seeds_active_raw(spark, d):
    return seeds.seeds_from_active(fixtures.active_alerts_extract(spark, d), dedup=False)


# ==================================== distributions of the two other scenarios
def _new_of(scenario: str):
    return lambda spark, d: propagate.new_scores(run_scenario(spark, d, scenario, 15).state, Inputs(spark, d).seeds())


def _register_scenario(sc: str) -> None:
    src, new = f"new_{sc}", _new_of(sc)
    O.cte(src, f"select s.cont_rut as contaminados, round(s.score, 3) as score from {sc}_s15 s "
               "where s.cont_rut not in (select cont_rut from seeds)", (f"{sc}_s15", "seeds"))
    q(f"round_metrics_{sc}", _round_metrics_sql(sc, 15))(
        lambda spark, d: propagate.round_metrics(run_scenario(spark, d, sc, rounds=15).states))
    q(f"hist_density_{sc}", _nested(_hist_sql(src, "score", 100, [], "score > 0", density=True), [src]))(
        lambda spark, d: _hist_cols(profile.histogram(new(spark, d).where(F.col("score") > 0), "score", 100, stat="density"), density=True))
    for name, keep in (("positive", "score > 0"), ("high", "score >= 0.5")):
        q(f"describe_{name}_{sc}", O.build(_describe_sql(src, "score", [], keep), [src]))(
            lambda spark, d, keep=keep: _describe_cols(describe(new(spark, d).where(keep), "score", tiebreak=["contaminados"])))
    q(f"kde_score_{sc}", O.build(_KDE_SQL.format(src=src), [src]))(
        lambda spark, d: profile.kde(new(spark, d).where(F.col("score") >= 0.5), "score", 200).select(
            F.col("i").cast("int").alias("i"), r6("x").alias("x"), r6("density").alias("density")))


for _sc in ("vat", "rep"):
    _register_scenario(_sc)
