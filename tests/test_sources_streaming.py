from riskgraph.session import scratch_path
from riskgraph.sources import io


def test_csv_typed_and_untyped_roundtrip(spark):
    df = spark.createDataFrame([(1, 2, 0.25), (3, 4, 0.5)], "emisor long, receptor long, Fi double")
    path = scratch_path(spark, "csv")
    io.write_csv(df, path)
    typed = io.read_csv(spark, path, schema=df.schema)
    assert sorted(map(tuple, typed.collect())) == [(1, 2, 0.25), (3, 4, 0.5)]
    raw = io.read_csv(spark, path)                       # all strings
    assert dict(raw.dtypes)["Fi"] == "string"
    semi = scratch_path(spark, "csv-semi")
    io.write_csv(df, semi, sep=";")
    back = io.cast_columns(io.read_csv(spark, semi, sep=";"), {"emisor": "bigint", "Fi": "double"})
    assert sorted(r.Fi for r in back.collect()) == [0.25, 0.5]


def test_parquet_table_view_preview_schema(spark):
    df = spark.createDataFrame([(i, float(i) / 10) for i in range(30)], "emisor long, Fi double")
    path = scratch_path(spark, "pq")
    io.write_parquet(df, path)
    back = io.read_parquet(spark, path)
    assert back.count() == 30
    io.register(back, "rg_test_view")
    assert io.read_table(spark, "rg_test_view").count() == 30
    assert spark.sql("select max(Fi) as m from rg_test_view").first().m == 2.9
    top = io.preview(back, ["Fi"], n=20)
    assert top.count() == 20 and top.first().Fi == 0.0
    assert "emisor" in io.describe_schema(back)
    assert io.cut(back, "cut-test").count() == 30


def test_write_outputs_end_to_end(spark):
    from riskgraph.plans.scenarios import write_outputs
    out = scratch_path(spark, "outputs")
    paths = write_outputs(spark, "/root/testdata/sf0.001", out, rounds=3, communities="fixed")
    nodes = io.read_csv(spark, paths["nodes"])
    lab = spark.read.parquet(paths["labelled"])
    assert nodes.count() == lab.count() > 0
    assert set(nodes.columns) == {"cont_rut", "score", "total_pago_f29", "IVA_neto", "unidad_regional",
                                  "n_documentos", "lifetime", "alerta_inicial", "comunidad"}
    assert io.read_csv(spark, paths["new"]).count() + spark.read.parquet(paths["labelled"]).where(
        "alerta_inicial = 1").count() == io.read_csv(spark, paths["total"]).count()
