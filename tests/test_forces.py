import datetime as dt

import pytest

from conftest import edges_df, seeds_df
from riskgraph.operators import forces, seeds


def test_combine_takes_other_side(spark):
    f1 = edges_df(spark, [(1, 2, 0.4)])
    f2 = edges_df(spark, [(1, 2, 0.2), (1, 3, 0.6), (4, 2, 0.0)])
    got = {(r.emisor, r.receptor): r.Fi for r in forces.combine_forces(f1, f2).collect()}
    assert got == pytest.approx({(1, 2): 0.3, (1, 3): 0.6})
    allr = {(r.emisor, r.receptor) for r in forces.combine_forces(f1, f2, drop_zero=False).collect()}
    assert (4, 2) in allr


def test_vat_force_keeps_rounded_zero(spark):
    arcs = spark.createDataFrame([(1, 9, 1), (2, 9, 99999), (3, 9, -5), (4, 8, 7)],
                                 "PARU_RUT_E0 long, PARU_RUT_E2 long, Monto_IVA long")
    got = {(r.emisor, r.receptor): r.Fi for r in forces.force_vat(arcs).collect()}
    assert got == {(1, 9): 0.0, (2, 9): 1.0, (4, 8): 1.0}
    prof = forces.vat_profile(arcs).first()
    assert (prof.n_nonpos, prof.n_pos, prof.sum_nonpos, prof.sum_pos) == (1, 3, -5, 100007)


def test_active_representatives(spark):
    docs = spark.createDataFrame([(5, 6, 10, 100.0, 20200115, "33"), (5, 6, 10, 100.0, 20200115, "61")],
                                 "dhdr_rut_emisor long, dhdr_rut_recep long, dhdr_iva long, dhdr_mnt_total double, "
                                 "dhdr_fch_emis_int int, dtdc_codigo string")
    t = dt.datetime
    reps = spark.createDataFrame([(6, 70, t(2019, 1, 1), None), (6, 71, t(2019, 1, 1), t(2020, 1, 15)),
                                  (6, 72, t(2021, 1, 1), None)],
                                 "CONT_RUT long, CONT_RUT_REPRESENTANTE long, REPR_FECHA_INICIO_VO timestamp, "
                                 "REPR_FECHA_TERMINO_VO timestamp")
    sd = seeds_df(spark, [70])
    agg = forces.rep_pair_aggs(forces.docs_with_active_rep(docs, reps, sd)).first()
    assert (agg.count1, agg.count2, agg.sum1, agg.sum2) == (1, 2, 10, 20)
    assert forces.force_representative(docs, reps, sd).first().Fi == 0.5


def test_alert_precedence(spark):
    t = dt.datetime(2020, 1, 1)
    alerts = spark.createDataFrame([(1, "4110", "a", t), (2, "4113", "b", t), (3, "4113", "b", None),
                                    (4, "9999", "c", None), (1, "4111", "d", None)],
                                   "cont_rut long, ALER_COD_TIPO_ALERTA_VO string, aler_desc_tipo_alerta_vo string, "
                                   "aler_fecha_desactiv_vo timestamp")
    assert sorted(r.cont_rut for r in seeds.seeds_from_alerts(alerts).collect()) == [1, 3]
    assert {r.cont_rut: r.c for r in seeds.alert_counts(alerts).collect()} == {1: 2, 3: 1}


def test_active_extract_dedup_and_raw(spark):
    ex = spark.createDataFrame([("4110", "7"), ("4110", "7"), ("4200", "8"), ("4113", "9")],
                               "ALER_COD_TIPO_ALERTA string, CONT_RUT_E string")
    assert sorted(r.cont_rut for r in seeds.seeds_from_active(ex).collect()) == [7, 9]
    assert seeds.seeds_from_active(ex, dedup=False).count() == 3


def test_normalise_raw_extract(spark):
    raw = spark.createDataFrame([("1", "2", "0,5")], "PARU_RUT_E0 string, PARU_RUT_E2 string, Fi string")
    from riskgraph.sources.io import cast_columns
    out = forces.normalise_edges(cast_columns(raw, {"Fi": "double"})).first()
    assert (out.emisor, out.receptor, out.Fi) == ("1", "2", 0.5)
