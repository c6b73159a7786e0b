"""A third of 1.2 million rows on one key: no task of the join holds more than twice the median."""
from statistics import median

import pytest
from pyspark.sql import functions as F

from riskgraph.functions import skew
from riskgraph.operators import export, forces, graphops, propagate, report

N = 1_200_000


@pytest.fixture(scope="module")
def plain(spark):
    """Shuffle joins only, partitions as planned."""
    conf = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.enabled": "false"}
    old = {k: spark.conf.get(k) for k in conf}
    for k, v in conf.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def hot(spark, key):
    """(id, key, value): every third row has key 7."""
    i = F.col("id")
    return spark.range(N).select(i, F.when(i % 3 == 0, F.lit(7)).otherwise(100 + i % 4001).cast("long").alias(key),
                                 (i % 1000 + 1).alias("value"))


def sizes(df):
    return [r.n for r in df.groupBy(F.spark_partition_id()).agg(F.count(F.lit(1)).alias("n")).collect()]


def even(df):
    n = sizes(df)
    assert sum(n) and max(n) <= 2 * median(n), n


def test_totals(plain):
    df = hot(plain, "k")
    got = skew.with_totals(df, "k", [F.sum("value").alias("total")])
    even(got)
    want = df.join(df.groupBy("k").agg(F.sum("value").alias("total")), "k")
    assert max(sizes(want)) > 2 * median(sizes(want))  # without salts it is not even
    assert got.select("id", "k", "value", "total").exceptAll(want.select("id", "k", "value", "total")).count() == 0
    assert got.count() == N


def test_vat_force_and_influence(plain):
    arcs = hot(plain, "PARU_RUT_E2").select(F.col("id").alias("PARU_RUT_E0"), "PARU_RUT_E2", F.col("value").alias("Monto_IVA"))
    even(forces.force_vat(arcs))
    even(propagate.prepare_edges(hot(plain, "receptor").select(F.col("id").alias("emisor"), "receptor", (F.col("value") / 1e5).alias("Fi"))))


def test_report(plain):
    df = hot(plain, "comunidad").select(F.col("id").alias("cont_rut"), "comunidad", (F.col("value") / 1000).alias("score"), (F.col("id") % 2).alias("alerta_inicial"))
    large = report.min_size(df, 150)
    even(large)
    assert large.count() == N
    assert report.min_size(df, 1000).select("comunidad").distinct().collect() == [(7,)]
    assert report.community_hist(df).agg(F.sum("count")).first()[0] == N


def test_edges_of_a_hot_node(plain):
    e = hot(plain, "receptor").select(F.col("id").alias("emisor"), "receptor", (F.col("value") / 1000).alias("Fi"))
    nodes = e.select(F.col("emisor").alias("cont_rut")).union(e.select("receptor")).distinct().where("cont_rut <> 9")
    got = graphops.induced_edges(e, nodes)
    even(got)
    assert got.count() == e.where("emisor <> 9 and receptor <> 9").count()
    assert export.export_edges(e, nodes).count() == got.count()


def test_heavy_list_is_bounded(plain):
    counts = plain.range(100_000).select(F.col("id").alias("k"), F.lit(1).alias("rows"))
    assert skew.heavy_keys(counts, "k", "rows") is None
    some = plain.range(3).select(F.col("id").alias("k"), F.lit(1000).alias("rows"))
    heavy = skew.heavy_keys(some, "k", "rows")
    assert heavy.count() == 3 < skew.SHARE * 8 and heavy.agg(F.max("__salts")).first()[0] <= skew.SHARE * 8


def test_null_keys_and_empty_tables(spark):
    df = spark.createDataFrame([(1, None), (2, 5), (3, 5)], "id long, k long")
    assert sorted(skew.with_totals(df, "k", [F.count(F.lit(1)).alias("n")]).select("id", "n").collect()) == [(2, 2), (3, 2)]
    assert skew.with_totals(df.limit(0), "k", [F.count(F.lit(1)).alias("n")]).collect() == []
    assert skew.semi_join(df, df.select("k").limit(0), "k").collect() == []
