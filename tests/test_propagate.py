import pytest

from conftest import edges_df, seeds_df
from riskgraph.operators import propagate as P

A, B, C, D, R, Z = 1, 2, 3, 4, 10, 99


def scores(res, k):
    return {r.cont_rut: r.score for r in res.states[k].collect()}


def test_unit_force(spark):
    e = edges_df(spark, [(A, R, 1.0), (B, R, 0.5)])
    infl = {r.receptor: r for r in P.receiver_influence(e).collect()}
    assert infl[R].f0 == pytest.approx(0.5) and infl[R].sFi == pytest.approx(1.5)
    f = {(r.emisor, r.receptor): r.f for r in P.prepare_edges(e).collect()}
    assert f[(A, R)] == pytest.approx(1 / 3, abs=1e-6) and f[(B, R)] == pytest.approx(1 / 6, abs=1e-6)
    res = P.propagate(e, seeds_df(spark, [A, B]), rounds=3)
    assert [scores(res, k)[R] for k in (1, 2, 3)] == pytest.approx([0.5, 0.75, 0.875])


def test_sole_issuer_fi_one(spark):
    e = edges_df(spark, [(A, R, 1.0)])
    assert P.receiver_influence(e).first().f0 == 0.0          # every factor skipped → null → 0
    res = P.propagate(e, seeds_df(spark, [A]), rounds=1)
    assert scores(res, 1)[R] == pytest.approx(1.0)


def test_chain(spark):
    e = edges_df(spark, [(A, B, 0.6), (C, B, 0.3), (B, D, 1.0)])
    infl = {r.receptor: r.f0 for r in P.receiver_influence(e).collect()}
    assert infl[B] == pytest.approx(0.28)
    res = P.propagate(e, seeds_df(spark, [A]), rounds=3)
    assert [scores(res, k)[B] for k in (1, 2, 3)] == pytest.approx([0.48, 0.6144, 0.652032])
    assert [scores(res, k)[D] for k in (1, 2, 3)] == pytest.approx([0.0, 0.48, 0.6144])


def test_zero_force_never_divides(spark):
    e = edges_df(spark, [(A, R, 0.0)])
    p = P.prepare_edges(e).first()
    assert p.f0 == pytest.approx(1.0) and p.f == 0.0
    res = P.propagate(e, seeds_df(spark, [A]), rounds=2)
    assert scores(res, 2)[R] == 0.0


def test_seed_receiver_never_decreases_and_edgeless_seed_absent(spark):
    e = edges_df(spark, [(A, R, 0.1), (B, R, 0.1)])
    res = P.propagate(e, seeds_df(spark, [R, Z]), rounds=3)
    s = scores(res, 3)
    assert s[R] == 1.0 and Z not in s and s[A] == 0.0


def test_overshoot_above_one(spark):
    e = edges_df(spark, [(A, R, 0.1497), (B, R, 0.21285), (C, R, 0.1374)])
    res = P.propagate(e, seeds_df(spark, [A, B, C]), rounds=15)
    assert scores(res, 14)[R] == pytest.approx(0.999997, abs=1e-6)
    assert scores(res, 15)[R] == pytest.approx(1.000191, abs=1e-6)
    clamped = P.propagate(e, seeds_df(spark, [A, B, C]), rounds=15, clamp=True)
    assert scores(clamped, 15)[R] <= 1.0


def test_hot_issuer_path_matches(spark):
    rows = [(A, n, 0.3) for n in range(20, 40)] + [(B, n, 0.5) for n in range(20, 30)] + [(C, A, 0.4)]
    e = edges_df(spark, rows)
    normal = P.propagate(e, seeds_df(spark, [C]), rounds=4)
    hot = P.propagate(e, seeds_df(spark, [C]), rounds=4, min_hot_degree=5, max_hot_keys=10)
    assert hot.graph.hot is not None and normal.graph.hot is None
    a, b = scores(normal, 4), scores(hot, 4)
    assert a.keys() == b.keys()
    assert all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


def test_round_plan_reads_edges_in_place(spark):
    e = edges_df(spark, [(A, B, 0.6), (C, B, 0.3), (B, D, 1.0)])
    res = P.propagate(e, seeds_df(spark, [A]), rounds=1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.autoBroadcastJoinThreshold", "-1")
    try:
        plan = P.propagate_step(res.graph, res.states[1])._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    # one exchange: the partial aggregate by receiver; both join sides are bucketed scans
    assert plan.count("Exchange") == 1, plan
    assert plan.count("Bucketed: true") >= 2


def test_states_never_decrease(spark):
    from riskgraph.plans.scenarios import run_scenario
    res = run_scenario(spark, "/root/testdata/sf0.001", "combined", rounds=5)
    prev = None
    for st in res.states:
        cur = {r.cont_rut: r.score for r in st.collect()}
        if prev is not None:
            assert all(cur[k] >= prev[k] - 1e-15 for k in prev)
        prev = cur
    assert len(res.states) == 6


def test_force_invariants_on_test_tables(spark):
    from pyspark.sql import functions as F
    from riskgraph.plans.scenarios import Inputs
    inp = Inputs(spark, "/root/testdata/sf0.001")
    # VAT shares of a receiver sum to 1 up to the 4-decimal rounding of each share
    vat = inp.force_vat().groupBy("receptor").agg(F.sum("Fi").alias("s"), F.count(F.lit(1)).alias("n")).collect()
    assert vat and all(abs(r.s - 1) <= r.n * 5e-5 + 1e-12 for r in vat)
    # Σ f over a receiver ≤ 1 − f0 + n·5e-5 / sFi  (t is rounded before dividing)
    p = P.prepare_edges(inp.force_combined())
    agg = p.groupBy("receptor").agg(F.sum("f").alias("sf"), F.first("f0").alias("f0"), F.count(F.lit(1)).alias("n"),
                                    F.sum("Fi").alias("sFi")).collect()
    assert agg and all(r.sf <= (1 - r.f0) + r.n * 5e-5 / r.sFi + 1e-12 for r in agg)


def test_hot_path_on_test_tables(spark):
    from riskgraph.plans.scenarios import Inputs
    inp = Inputs(spark, "/root/testdata/sf0.001")
    e, sd = inp.force_combined(), inp.seeds()
    normal = P.propagate(e, sd, rounds=3)
    # every issuer with more than 50 edges takes the broadcast path
    hot = P.propagate(e, sd, rounds=3, min_hot_degree=50, max_hot_keys=1000)
    assert hot.graph.hot is not None
    a, b = scores(normal, 3), scores(hot, 3)
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k], abs=1e-12) for k in a)


CHAIN = [(i, i + 1, 0.6) for i in range(1, 30)] + [(100 + i, 2, 0.1) for i in range(20)]


def test_frontier_rounds_equal_full_rounds(spark):
    for kw in ({}, {"min_hot_degree": 5, "max_hot_keys": 10}):
        rows = CHAIN + ([(C, n, 0.3) for n in range(200, 215)] if kw else [])
        e, sd = edges_df(spark, rows), seeds_df(spark, [1, C] if kw else [1])
        full, front = P.propagate(e, sd, rounds=6, **kw), P.propagate(e, sd, rounds=6, frontier=True, **kw)
        for k in range(7):
            a, b = scores(full, k), scores(front, k)
            assert a.keys() == b.keys() and all(a[n] == pytest.approx(b[n], abs=1e-12) for n in a)


def test_frontier_reads_less_on_a_chain(spark):
    e = edges_df(spark, [(i, i + 1, 1.0) for i in range(1, 40)])
    res = P.propagate(e, seeds_df(spark, [1]), rounds=5, frontier=True)
    assert scores(res, 5)[6] == pytest.approx(1.0) and len(res.edges_read) == 5
    # a full round reads every edge and self row; here only the receivers next to what changed
    assert max(res.edges_read) <= 6 < 39 + 40


def test_files_per_round_are_buckets(spark):
    from riskgraph.sources.io import write_bucketed
    st = spark.range(3000).selectExpr("id % 1000 as cont_rut", "cast(id as double) as score").groupBy("cont_rut").agg({"score": "sum"}).toDF("cont_rut", "score")
    df, _ = write_bucketed(st, "files", "cont_rut", 5, repartition=False)
    assert len(df.inputFiles()) == 5 and df.count() == 1000


class Lost(Exception):
    pass


def _run_until(monkeypatch, stop, *args, **kw):
    """The rounds that a run computes; from round ``stop`` on its driver is lost."""
    done, step = [], P.propagate_step

    def counted(graph, state):
        if len(done) + 1 == stop:
            raise Lost
        done.append(1)
        return step(graph, state)

    monkeypatch.setattr(P, "propagate_step", counted)
    try:
        return len(done), P.propagate(*args, **kw), len(done)
    except Lost:
        return None, None, len(done)
    finally:
        monkeypatch.setattr(P, "propagate_step", step)


@pytest.mark.parametrize("keep", [True, False])
def test_journal_goes_on_after_the_last_round(spark, monkeypatch, keep):
    from riskgraph.operators.journal import Journal
    from riskgraph.session import scratch_path
    from riskgraph.sources import io
    e, sd = edges_df(spark, CHAIN), seeds_df(spark, [1])
    folder = scratch_path(spark, "journal-test")
    whole = P.propagate(e, sd, rounds=10, keep_states=keep)
    _, none, n = _run_until(monkeypatch, 8, e, sd, rounds=10, journal=Journal(spark, folder, "a"), keep_states=keep)
    assert none is None and n == 7
    io.drop_cut_tables(spark)  # another process: no catalog entry is left
    _, res, n = _run_until(monkeypatch, None, e, sd, rounds=10, journal=Journal(spark, folder, "a"), keep_states=keep)
    assert n == 3 and res.rounds_run == 10
    a, b = ({r.cont_rut: r.score for r in x.state.collect()} for x in (whole, res))
    assert a == pytest.approx(b, abs=1e-12) and len(res.states) == (11 if keep else 2)
    if not keep:
        assert [r.iterations for r in res.metrics.collect()] == list(range(1, 11))
        assert sorted(map(tuple, res.metrics.collect())) == sorted(map(tuple, P.round_metrics(P.propagate(e, sd, rounds=10).states).collect()))
    _, res, n = _run_until(monkeypatch, None, e, sd, rounds=10, journal=Journal(spark, folder, "other inputs"), keep_states=keep)
    assert n == 10


def test_journal_ignores_what_was_not_committed(spark):
    from riskgraph.operators.journal import Journal
    from riskgraph.session import scratch_path
    j = Journal(spark, scratch_path(spark, "journal-half"), "x")
    assert j.read("layout") is None and j.last("round-", 15) is None
    for k in range(3):
        j.commit(f"round-{k}", path=f"p{k}")
    fs, p = io_fs(spark, f"{j.folder}/round-2/_SUCCESS")
    fs.delete(p, False)  # the driver was lost while it wrote the entry
    assert j.last("round-", 15) == (1, {"path": "p1"}) and j.last("round-", 0) == (0, {"path": "p0"})


def io_fs(spark, path):
    from riskgraph.sources.io import _filesystem
    return _filesystem(spark, path)


def test_rounds_as_asked(spark):
    from riskgraph.plans import scenarios
    sf = "/root/testdata/sf0.001"
    scenarios.clear_memo()
    one = scenarios.run_scenario(spark, sf, "vat", rounds=1)
    assert one.rounds_run == 1 and len(one.states) == 2
    three = scenarios.run_scenario(spark, sf, "vat", rounds=3)  # goes on
    assert three.rounds_run == 3 and sorted(three.states[1].inputFiles()) == sorted(one.states[1].inputFiles())
    assert scenarios.run_scenario(spark, sf, "vat", rounds=2).rounds_run == 2


def test_describe_rounds(spark):
    import pandas as pd
    res = P.propagate(edges_df(spark, CHAIN), seeds_df(spark, [1]), rounds=3)
    got = {r.iterations: r for r in P.describe_rounds(res.states).collect()}
    assert sorted(got) == [1, 2, 3]
    for k, r in got.items():
        want = pd.Series(list(scores(res, k).values())).describe()
        assert [r["count"], r["mean"], r["std"], r["min"], r.q25, r.q50, r.q75, r["max"]] == pytest.approx(list(want))


def test_edges_by_receiver_give_the_same_with_a_row_per_receiver(spark, monkeypatch):
    """Receivers of many edges: a round sends a receiver from one place, two if heavy, not from every bucket of issuers."""
    rows = [(i, r, 0.05 + (i * r % 9) / 10) for i in range(30) for r in range(100, 120) if (i + r) % 3] + [(110, 3, 0.4), (None, 100, 0.5)]
    e, sd = edges_df(spark, rows), seeds_df(spark, [2, 3, 110])
    for kw in ({}, {"min_hot_degree": 13, "max_hot_keys": 1000}):
        by_receiver = P.propagate(e, sd, rounds=4, **kw)
        graph = by_receiver.graph
        with monkeypatch.context() as m:
            m.setattr(P, "MAX_ISSUERS", 29)
            by_issuer = P.propagate(e, sd, rounds=4, **kw)
        assert graph.incoming is not None and by_issuer.graph.incoming is None and (graph.hot is None) == (not kw)
        places = graph.incoming.selectExpr("receptor", "input_file_name() as f").distinct().count()
        receivers = graph.incoming.select("receptor").distinct().count()
        assert places == receivers if not kw else places <= P.HEAVY_FILES * receivers
        for k in range(5):
            a, b = scores(by_receiver, k), scores(by_issuer, k)
            assert a.keys() == b.keys() and all(a[n] == pytest.approx(b[n], abs=1e-12) for n in a)


def test_layout_by_receiver_is_read_from_the_journal(spark, monkeypatch):
    from riskgraph.operators.journal import Journal
    from riskgraph.session import scratch_path
    e, sd = edges_df(spark, [(i, r, 0.3) for i in range(8) for r in (20, 21)] + [(20, 1, 0.4)]), seeds_df(spark, [2])
    monkeypatch.setattr(P, "MIN_IN_DEGREE", 2)
    journal = Journal(spark, scratch_path(spark, "journal-by-receiver"), "a")
    P.propagate(e, sd, rounds=2, journal=journal)
    res, whole = P.propagate(e, sd, rounds=4, journal=journal), P.propagate(e, sd, rounds=4)
    assert res.graph.incoming is not None and scores(res, 4) == pytest.approx(scores(whole, 4), abs=1e-12)
