"""Batch loader, staged publish, extracts with broken rows, the edge store, the interval index."""
import datetime as dt
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, DoubleType, IntegerType, LongType, StringType, StructField, StructType

from riskgraph.operators import edgestore, enrich, forces, graphops, profile
from riskgraph.session import scratch_path
from riskgraph.sources import checked, io, loader, publish

NODES = "cont_rut long, score string, comunidad string"


def nodes(spark, rows):
    return spark.createDataFrame(rows, NODES)


def read(spark, folder, df):
    return sorted(tuple(r) for r in loader.read_loaded(spark, folder, df.schema).collect())


def test_written_twice_is_written_once(spark):
    folder = scratch_path(spark, "load-twice")
    df = nodes(spark, [(i, str(i / 10), None if i % 5 else "7") for i in range(25_000)]).repartition(3)
    loader.load(df, folder, ["cont_rut"], 1)
    once = read(spark, folder, df)
    loader.load(df, folder, ["cont_rut"], 1)
    assert read(spark, folder, df) == once == sorted(tuple(r) for r in df.collect())
    loads = loader.manifests(spark, folder).collect()
    assert len(loads) == 2 and all(r.rows == 25_000 for r in loads)
    parts = spark.read.parquet(folder + "/staging/*").groupBy(F.col("_metadata.file_path")).count().collect()
    assert max(r["count"] for r in parts) <= loader.BATCH and len(parts) == sum(len(r.files) for r in loads)


def test_the_sequence_decides(spark):
    folder = scratch_path(spark, "load-sequence")
    new, old = nodes(spark, [(1, "new", "a"), (2, "new", None)]), nodes(spark, [(1, "old", "z"), (3, "old", "z")])
    loader.load(new, folder, ["cont_rut"], 10)
    loader.load(old, folder, ["cont_rut"], 9)  # arrives last, but is the earlier one
    assert read(spark, folder, new) == [(1, "new", "a"), (2, "new", None), (3, "old", "z")]
    loader.load(nodes(spark, [(1, "b", None), (1, "a", None)]), folder, ["cont_rut"], 11)  # a tie within a load
    assert read(spark, folder, new)[0] == (1, "b", None)
    loader.load(old, folder, ["cont_rut"], 1, overwrite=True)
    assert read(spark, folder, new) == [(1, "old", "z"), (3, "old", "z")]


def test_a_failed_task_leaves_nothing(spark):
    folder = scratch_path(spark, "load-fails")
    good = nodes(spark, [(1, "x", None)])
    assert read(spark, folder, good) == []
    loader.load(good, folder, ["cont_rut"], 1)
    # one of four tasks fails after it has written some batches
    bad = spark.range(0, 4000, 1, 4).select(F.col("id").alias("cont_rut"), F.when(F.col("id") == 3999, F.raise_error(F.lit("lost"))).otherwise(F.lit("y")).alias("score"),
                                            F.lit(None).cast("string").alias("comunidad"))
    with pytest.raises(Exception, match="lost"):
        loader.load(bad, folder, ["cont_rut"], 2, batch=100)
    assert read(spark, folder, good) == [(1, "x", None)]
    assert len(loader.manifests(spark, folder).collect()) == 1
    assert len([d for d in os.listdir(f"{folder.removeprefix('file://')}/staging") if not d.endswith(".json")]) == 1  # the abort removed the rest


def test_publish_refuses_duplicates_and_keeps_the_old_table(spark):
    folder = scratch_path(spark, "publish")
    assert publish.read_published(spark, folder) is None
    first = nodes(spark, [(1, "a", None), (2, "b", None)])
    assert publish.publish_unique(first, folder, "cont_rut").ok
    got = publish.publish_unique(nodes(spark, [(1, "a", None), (1, "c", "x"), (None, "d", None), (4, "e", None)]), folder, "cont_rut")
    assert not got.ok and got.path is None and got.n_violations == 2
    rows = sorted(map(tuple, spark.read.parquet(got.rejects).collect()), key=str)
    assert rows == [(1, "a", None, 2), (1, "c", "x", 2), (None, "d", None, 1)]
    assert sorted(map(tuple, publish.read_published(spark, folder).collect())) == [(1, "a", None), (2, "b", None)]
    assert publish.publish_unique(nodes(spark, [(9, "z", None)]), folder, "cont_rut").ok
    assert [tuple(r) for r in publish.read_published(spark, folder).collect()] == [(9, "z", None)]


def test_broken_rows_are_kept(spark):
    path = scratch_path(spark, "broken")
    lines = ["1;2;0,5;3,25", "1;x;0,5;", "1;2", "1;2;3;4;5", ";2;1e2;", "5;6;zwei;x", "7;8;;0,1"]
    spark.createDataFrame([(x,) for x in lines], "value string").coalesce(1).write.text(path)
    schema = StructType([StructField("emisor", LongType(), False), StructField("receptor", IntegerType()),
                         StructField("Fi", DoubleType()), StructField("peso", DecimalType(6, 2))])
    good, rejects = checked.read_csv_checked(spark, path, schema, sep=";", decimal=",", header=False)
    assert good.schema.simpleString() == schema.simpleString()
    got = sorted((r.emisor, r.receptor, r.Fi, None if r.peso is None else float(r.peso)) for r in good.collect())
    assert got == [(1, 2, 0.5, 3.25), (7, 8, None, 0.1)]
    bad = {r.line: r.reason for r in rejects.collect()}
    assert bad == {"1;x;0,5;": "receptor", "1;2": "columns", "1;2;3;4;5": "columns", ";2;1e2;": "emisor", "5;6;zwei;x": "Fi,peso"}
    assert all(r.file.endswith(".txt") for r in rejects.collect())


def test_checked_csv_with_a_header(spark):
    path = scratch_path(spark, "broken-header")
    io.write_csv(spark.createDataFrame([("1", "a"), ("q", None)], "n string, t string"), path)
    good, rejects = checked.read_csv_checked(spark, path, StructType([StructField("n", LongType()), StructField("t", StringType())]))
    assert [tuple(r) for r in good.collect()] == [(1, "a")] and [r.reason for r in rejects.collect()] == ["n"]


def scanned_files(df) -> int:
    """Files that the scan of ``df`` read, by its own metric."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    todo, n = [plan], 0
    while todo:
        p = todo.pop()
        name = p.getClass().getSimpleName()
        if name == "AdaptiveSparkPlanExec":
            todo.append(p.executedPlan())
        elif name == "FileSourceScanExec":
            n += p.metrics().apply("numFiles").value()
        children = p.children()
        todo += [children.apply(i) for i in range(children.size())]
    return n


def test_edge_store_reads_few_files(spark):
    lab = spark.range(200).select(F.col("id").alias("cont_rut"), (F.col("id") % 40).alias("comunidad"), (F.col("id") % 2).cast("int").alias("alerta_inicial"),
                                  (F.col("id") * 3).alias("IVA_neto"))
    e = spark.range(3000).select((F.col("id") % 200).alias("emisor"), (F.col("id") * 7 % 205).alias("receptor"), (F.col("id") / 3000).alias("Fi")).dropDuplicates(["emisor", "receptor"])
    path = scratch_path(spark, "store")
    edgestore.write_edge_store(e, lab, path)
    every = scanned_files(spark.read.parquet(path).select("emisor"))
    one = edgestore.community_edges(spark, path, 11)
    inner = edgestore.induced_edges(spark, path, (3, 11))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, graphops.community_edges(e, lab, 11).collect()))
    want = graphops.induced_edges(e, graphops.select_communities(lab, (3, 11)))
    assert sorted(map(tuple, inner.select("emisor", "receptor", "Fi").collect())) == sorted(map(tuple, want.collect()))
    assert scanned_files(one) <= every * 0.3 and scanned_files(inner) <= every * 0.1
    pairs = edgestore.relations_with_communities(spark, path)
    want = graphops.relations_with_communities(e, lab.withColumn("comunidad", F.col("comunidad").cast("string")))
    assert pairs.exceptAll(want).count() == 0 == want.exceptAll(pairs).count()


def test_many_terms_of_office_are_not_squared(spark):
    """10^4 terms of a day each and 10^4 invoices of one receiver: compared are those of a month."""
    day = F.expr("timestamp '1990-01-01 00:00:00' + make_interval(0, 0, 0, cast(id as int), 0, 0, 0)")
    reps = spark.range(10_000).select(F.lit(6).cast("long").alias("CONT_RUT"), F.col("id").alias("CONT_RUT_REPRESENTANTE"),
                                      day.alias("REPR_FECHA_INICIO_VO"), day.alias("REPR_FECHA_TERMINO_VO"))
    reps = reps.union(spark.createDataFrame([(8, 3, dt.datetime(1990, 1, 1), None)], "a long, b long, c timestamp, d timestamp"))
    docs = spark.range(10_000).select(F.lit(5).cast("long").alias("dhdr_rut_emisor"), F.when(F.col("id") % 100 == 7, 8).otherwise(6).cast("long").alias("dhdr_rut_recep"),
                                      F.lit(10).cast("long").alias("dhdr_iva"), F.lit(1.0).alias("dhdr_mnt_total"),
                                      F.date_format(day, "yyyyMMdd").cast("int").alias("dhdr_fch_emis_int"), F.lit("33").alias("dtdc_codigo"))
    seeds = spark.createDataFrame([(4,)], "cont_rut long")
    got = forces.docs_with_active_rep(docs, reps, seeds)
    rows = got.groupBy("dhdr_rut_recep").agg(F.count(F.lit(1)).alias("n"), F.count_if("alerted").alias("a")).collect()
    assert {r.dhdr_rut_recep: (r.n, r.a) for r in rows} == {6: (9900, 1), 8: (100, 0)}
    terms, many = forces.term_index(reps, forces.invoices(docs))
    assert [r.CONT_RUT for r in many.collect()] == [6]
    per_month = terms.where("CONT_RUT = 6").groupBy("__period").count().agg(F.max("count")).first()[0]
    assert per_month <= 31 and terms.where("CONT_RUT = 8").count() == 1


def test_cut_terms_give_the_same_rows(spark):
    from riskgraph.plans.scenarios import Inputs
    inp = Inputs(spark, "/root/testdata/sf0.001")
    a, b = (forces.docs_with_active_rep(inp.documents(), inp.reps(), inp.seeds(), many_terms=n) for n in (64, 0))
    assert a.count() == b.count() > 0 and a.exceptAll(b).count() == 0


def test_dates_reach_the_scan(spark):
    path = scratch_path(spark, "dated")
    spark.createDataFrame([(5, 6, 10, 100.0, 20200115, "33"), (5, 6, 30, 100.0, 20191231, "33")],
                          "dhdr_rut_emisor long, dhdr_rut_recep long, dhdr_iva long, dhdr_mnt_total double, dhdr_fch_emis_int int, dtdc_codigo string").write.parquet(path)
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    df = enrich.label_net_vat(spark.read.parquet(path), "2020-01-01 00:00:00")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(dhdr_fch_emis_int,20200101)" in plan
    assert sorted(map(tuple, df.collect())) == [(5, -10), (6, 10)]
    forms = scratch_path(spark, "forms")
    spark.createDataFrame([(1, 7, 202001, 1), (1, 9, 201912, 1)], "CONT_RUT long, F29_C_89 long, F29_AGNO_MES_TRIBUTARIO_VO int, TIVA_COD_VALIDEZ int").write.parquet(forms)
    paid = enrich.label_paid(spark.read.parquet(forms), "2020-01-01 00:00:00")
    assert "GreaterThanOrEqual(F29_AGNO_MES_TRIBUTARIO_VO,202001)" in paid._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in paid.collect()] == [(1, 7)]
    spark.conf.unset("spark.sql.maxMetadataStringLength")
    docs = spark.read.parquet(path)
    both = {r.cont_rut: (r.IVA_neto, r.n_documentos) for r in enrich.label_invoices(docs, "2020-01-01 00:00:00").collect()}
    assert both == {5: (-10, 2), 6: (10, None)}


def test_kde_shuffles_one_array_per_task(spark):
    import numpy as np
    values = np.random.default_rng(1).gamma(2.0, 0.2, 20_000)
    df = spark.createDataFrame([(float(v),) for v in values], "score double").repartition(4)
    got = profile.kde(df, "score")
    rows = sorted(got.collect(), key=lambda r: r.i)
    h = values.std(ddof=1) * len(values) ** -0.2
    x = np.linspace(values.min() - 3 * h, values.max() + 3 * h, 200)
    want = np.exp(-0.5 * ((values[:, None] - x) / h) ** 2).sum(axis=0) / (len(values) * h * np.sqrt(2 * np.pi))
    assert [r.x for r in rows] == pytest.approx(x) and [r.density for r in rows] == pytest.approx(want)
    plan = got._jdf.queryExecution().executedPlan()
    while plan.getClass().getSimpleName() == "AdaptiveSparkPlanExec":
        plan = plan.executedPlan()
    assert profile.kde(df.limit(0), "score").count() == 0
    same = spark.createDataFrame([(1.0,)] * 3, "score double")
    assert all(r.density is None for r in profile.kde(same, "score").collect())


def test_session_keeps_what_is_set(spark):
    from riskgraph.session import get_spark
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Santiago")
        assert get_spark("local[3]").sparkContext is spark.sparkContext
        assert spark.conf.get("spark.sql.session.timeZone") == "America/Santiago" and spark.sparkContext.master == "local[*]"
        assert spark.conf.get("spark.sql.shuffle.partitions") == "8"
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)


def test_signature_follows_the_files(spark):
    path = scratch_path(spark, "signed")
    spark.range(5).write.parquet(path)
    a = io.input_signature(spark, [path])
    assert a == io.input_signature(spark, [path])
    spark.range(6).write.mode("overwrite").parquet(path)
    assert a != io.input_signature(spark, [path])
    with pytest.raises(ValueError):
        io.drop_folder(spark, "/data/elsewhere")
