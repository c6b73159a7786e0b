import datetime as dt


from riskgraph.operators import enrich, export, graphops

T = dt.datetime


def test_cutoff_parity_switch(spark):
    forms = spark.createDataFrame([(1, 100, 202001, 1), (1, 5, 202002, 1), (1, 7, 201912, 1), (2, 9, 202003, 0)],
                                  "CONT_RUT long, F29_C_89 long, F29_AGNO_MES_TRIBUTARIO_VO int, TIVA_COD_VALIDEZ int")
    inclusive = {r.cont_rut: r.total_pago_f29 for r in enrich.label_paid(forms, "2020-01-01 00:00:00").collect()}
    assert inclusive == {1: 105}                       # January form counts; invalid form never
    legacy = {r.cont_rut: r.total_pago_f29 for r in enrich.label_paid(forms, "2020-01-01 00:01:00").collect()}
    assert legacy == {1: 5}                            # the reference's 'yyyy-mm-dd' cutoff drops January


def test_net_vat_received_minus_issued(spark):
    docs = spark.createDataFrame([(1, 2, 10, 0.0, 20200105, "33"), (2, 1, 3, 0.0, 20200105, "34"),
                                  (1, 1, 4, 0.0, 20200105, "33"), (1, 2, 50, 0.0, 20190105, "33"),
                                  (1, 2, 70, 0.0, 20200105, "61")],
                                 "dhdr_rut_emisor long, dhdr_rut_recep long, dhdr_iva long, dhdr_mnt_total double, "
                                 "dhdr_fch_emis_int int, dtdc_codigo string")
    got = {r.cont_rut: r.IVA_neto for r in enrich.label_net_vat(docs, "2020-01-01 00:00:00").collect()}
    assert got == {1: 3 - 10, 2: 10 - 3}
    assert {r.cont_rut: r.n_documentos for r in enrich.label_doc_count(docs).collect()} == {1: 3, 2: 1}


def test_region_latest_with_tie_break_and_lifetime(spark):
    b = spark.createDataFrame([(1, 1, T(2020, 1, 1)), (1, 2, T(2021, 1, 1)), (1, 3, T(2021, 1, 1)),
                               (2, 9, T(2019, 1, 1)), (2, 1, None)],
                              "CONT_RUT long, UNOP_UNIDAD int, NEGO_FECHA_VIGENCIA timestamp")
    u = spark.createDataFrame([(1, "NORTE"), (2, "SUR"), (3, "CENTRO")], "UNOP_UNIDAD int, UNOP_DES_REGIONAL string")
    got = {r.cont_rut: r.unidad_regional for r in enrich.label_region(b, u).collect()}
    assert got == {1: "CENTRO", 2: None}               # tie → smallest name; unit 9 missing from the dimension
    tp = spark.createDataFrame([(1, T(2000, 1, 1)), (2, None), (3, T(2030, 1, 1))],
                               "cont_rut long, cont_fecha_constitucion_vo timestamp")
    life = {r.cont_rut: r.lifetime for r in enrich.label_lifetime(tp, "2000-01-11 00:00:00").collect()}
    assert life == {1: 10, 2: None, 3: None}


def test_export_nodes_text_and_edges(spark):
    lab = spark.createDataFrame([(1, 0.5, None, -3, "SUR", None, 10, 1, 4), (2, 1e-5, 7, None, None, 2, None, 0, None)],
                                "cont_rut long, score double, total_pago_f29 long, IVA_neto long, "
                                "unidad_regional string, n_documentos long, lifetime int, alerta_inicial int, "
                                "comunidad long")
    rows = {r.cont_rut: r for r in export.export_nodes(lab).collect()}
    assert rows["1"].score == "0.500000" and rows["1"].total_pago_f29 == "" and rows["1"].IVA_neto == "-3"
    assert rows["2"].score == "0.000010" and rows["2"].comunidad == ""
    assert export.export_nodes(lab, limit=1).count() == 1
    e = spark.createDataFrame([(1, 2, 0.3), (1, 2, 0.4), (2, 3, 0.9)], "emisor long, receptor long, Fi double")
    ex = export.export_edges(e, lab).collect()
    assert [(r.emisor, r.receptor, r.Fuerza, r.relation) for r in ex] == [(1, 2, 0.4, "emite_a")]
    assert export.node_key_violations(lab.unionByName(lab.limit(1))).first().cont_rut == 1
    ce = graphops.community_edges(e, lab, 4).collect()
    assert {(r.source, r.target) for r in ce} == {(1, 2)}
