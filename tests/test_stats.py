import numpy as np
import pytest

from riskgraph.functions.expr import describe, distributed_rank, exact_quantiles
from riskgraph.operators import profile, report
from pyspark.sql import functions as F


def test_exact_quantiles_match_numpy_with_a_hot_value(spark):
    rng = np.random.default_rng(7)
    vals = np.concatenate([rng.normal(size=300), np.full(200, 0.25)])        # a value holding 40 % of rows
    grp = np.where(np.arange(len(vals)) % 3 == 0, 1, 2)
    df = spark.createDataFrame([(int(i), int(g), float(v)) for i, (g, v) in enumerate(zip(grp, vals))],
                               "id long, g int, v double")
    got = {(r.g, r.p): r.q for r in exact_quantiles(df, "v", [0.0, 0.25, 0.5, 0.9, 1.0], by=["g"],
                                                     tiebreak=["id"], num_partitions=7).collect()}
    for g in (1, 2):
        for p in (0.0, 0.25, 0.5, 0.9, 1.0):
            assert got[(g, p)] == pytest.approx(np.quantile(vals[grp == g], p), abs=1e-12)
    d = describe(df, "v").first()
    assert d["count"] == 500 and d["q50"] == pytest.approx(np.median(vals))
    assert d["std"] == pytest.approx(np.std(vals, ddof=1))


def test_distributed_rank(spark):
    df = spark.range(0, 1000).select((F.col("id") * 7919 % 1000).alias("k"))
    got = {r.k: r.rank for r in distributed_rank(df, [F.desc("k")], num_partitions=5).collect()}
    assert got == {k: 1000 - k for k in range(1000)}


def test_ranks_and_quartiles_with_payload_and_without_exchange_reuse(spark):
    spark.conf.set("spark.sql.exchange.reuse", "false")
    try:
        n = 400_000
        df = spark.range(0, n).select((F.col("id") * 7919 % n).alias("k"), F.concat(F.lit("payload "), F.col("id")).alias("x"),
                                      F.when(F.col("id") % 3 > 0, F.col("id") % 2).alias("g"))
        ranked = distributed_rank(df, [F.desc("k")])
        assert ranked.where(F.col("rank") != n - F.col("k")).count() == 0
        assert ranked.agg(F.countDistinct("rank")).first()[0] == n
        got = {r.g: (r.q25, r.q50, r.q75) for r in describe(df, "k", by=["g"]).collect()}
        want = {r.g: tuple(r.q) for r in df.groupBy("g").agg(F.expr("percentile(k, array(0.25, 0.5, 0.75))").alias("q")).collect()}
        assert set(got) == {None, 0, 1}
        for g in want:
            assert got[g] == pytest.approx(want[g])
    finally:
        spark.conf.unset("spark.sql.exchange.reuse")


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(3)
    vals = rng.uniform(0, 10, size=400)
    df = spark.createDataFrame([(float(v),) for v in vals], "x double")
    h = {r.bin: r["count"] for r in profile.histogram(df, "x", 10).collect()}
    exp, _ = np.histogram(vals, bins=10)
    assert [h[i] for i in range(10)] == list(exp)


def test_kde_matches_direct_formula(spark):
    vals = [0.5, 0.6, 0.6, 0.9, 1.0]
    df = spark.createDataFrame([(v,) for v in vals], "s double")
    got = {r.i: r.density for r in profile.kde(df, "s", grid=5).collect()}
    a = np.array(vals)
    h = a.std(ddof=1) * len(a) ** -0.2
    grid = np.linspace(a.min() - 3 * h, a.max() + 3 * h, 5)
    exp = [np.exp(-0.5 * ((a - g) / h) ** 2).sum() / (len(a) * h * np.sqrt(2 * np.pi)) for g in grid]
    assert [got[i] for i in range(5)] == pytest.approx(exp)


def test_mode_tie_and_profile(spark):
    rows = [(1, 7, 0.5, 1, "X"), (2, 7, 0.7, 0, "Y"), (3, 7, 0.9, 0, None), (4, 7, 0.1, 1, None)]
    df = spark.createDataFrame(rows, "cont_rut long, comunidad long, score double, alerta_inicial int, "
                                     "unidad_regional string")
    p = report.community_profile(df).first()
    assert (p.most_common_region, p.most_common_count, p.group_size, p.alertas_iniciales) == ("X", 1, 4, 2)
    assert p.perc_alertas == pytest.approx(50.0)
    assert report.min_size(df, 5).count() == 0 and report.min_size(df, 4).count() == 4


def test_bounded_broadcast_falls_back_above_limit(spark):
    from riskgraph.functions.expr import bounded_broadcast
    small = spark.range(0, 10).withColumnRenamed("id", "k")
    big = spark.range(0, 1000).withColumnRenamed("id", "k")
    fact = spark.range(0, 5000).select((F.col("id") % 1000).alias("k"))
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        with_hint = fact.join(bounded_broadcast(small, 100), "k")._jdf.queryExecution().executedPlan().toString()
        without = fact.join(bounded_broadcast(big, 100), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert "BroadcastHashJoin" in with_hint
    assert "BroadcastHashJoin" not in without and "SortMergeJoin" in without
