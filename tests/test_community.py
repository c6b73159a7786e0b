import pytest
from pyspark.sql import functions as F

from conftest import edges_df
from riskgraph.operators import community as C

TWO_TRIANGLES = [(1, 2, 1), (2, 3, 1), (1, 3, 1), (4, 5, 1), (5, 6, 1), (4, 6, 1), (3, 4, 1)]


def test_reciprocal_sum(spark):
    und = C.to_undirected(edges_df(spark, [(1, 2, 0.2), (2, 1, 0.5)])).collect()
    assert len(und) == 1 and und[0].w == pytest.approx(0.7)


def test_modularity_two_triangles(spark):
    und = C.to_undirected(edges_df(spark, TWO_TRIANGLES))
    mb = spark.createDataFrame([(n, 1 if n <= 3 else 2) for n in range(1, 7)], "nodo long, comunidad long")
    q = C.modularity(und, mb, 1.0, node="nodo").first().modularidad
    assert q == pytest.approx(0.357142857, abs=1e-9)


def test_modularity_self_loop_brute_force(spark):
    rows = [(1, 1, 0.5), (1, 2, 0.3), (2, 3, 0.9), (3, 1, 0.2), (3, 4, 0.4)]
    und = C.to_undirected(edges_df(spark, rows))
    part = {1: 1, 2: 1, 3: 2, 4: 2}
    mb = spark.createDataFrame(list(part.items()), "nodo long, comunidad long")
    m = sum(w for _, _, w in rows)
    deg = {}
    for u, v, w in rows:
        deg[u] = deg.get(u, 0) + w
        deg[v] = deg.get(v, 0) + w
    exp = 0.0
    for c in set(part.values()):
        lc = sum(w for u, v, w in rows if part[u] == c and part[v] == c)
        dc = sum(deg[n] for n in part if part[n] == c)
        exp += lc / m - 0.5 * (dc / (2 * m)) ** 2
    assert C.modularity(und, mb, 0.5, node="nodo").first().modularidad == pytest.approx(exp, abs=1e-12)


def test_louvain_two_triangles(spark):
    und = C.to_undirected(edges_df(spark, TWO_TRIANGLES))
    mb = C.louvain(und, resolution=1.0, seed=0)
    rows = mb.collect()
    assert sorted(r.nodo for r in rows) == [1, 2, 3, 4, 5, 6]          # covers every node once
    groups = {}
    for r in rows:
        groups.setdefault(r.comunidad, set()).add(r.nodo)
    assert sorted(map(sorted, groups.values())) == [[1, 2, 3], [4, 5, 6]]
    assert sorted(groups) == [1, 2]                                      # labels 1..k
    q = C.modularity(und, mb, 1.0, node="nodo").first().modularidad
    assert rows[0].q_gamma == pytest.approx(q) == pytest.approx(0.357142857, abs=1e-9)


def test_resolution_zero_is_components(spark):
    und = C.to_undirected(edges_df(spark, TWO_TRIANGLES + [(7, 8, 1)]))
    cc = {r.node: r.c for r in C.connected_components(und).collect()}
    assert len({cc[n] for n in range(1, 7)}) == 1 and cc[7] == cc[8] != cc[1]
    lv = {r.nodo: r.comunidad for r in C.louvain(und, resolution=0.0, seed=0).collect()}
    assert len({lv[n] for n in range(1, 7)}) == 1 and lv[7] == lv[8] != lv[1]


def test_louvain_invariants_on_test_tables(spark):
    from riskgraph.plans.scenarios import Inputs, louvain_membership
    sf = "/root/testdata/sf0.001"
    und = C.to_undirected(Inputs(spark, sf).force_combined())
    mb = louvain_membership(spark, sf, 0.5, 0)
    rows = mb.collect()
    nodes = {r.node for r in C.degrees(und).collect()}
    assert sorted(r.nodo for r in rows) == sorted(nodes)                      # every node exactly once
    labels = {r.comunidad for r in rows}
    assert labels == set(range(1, len(labels) + 1))                           # labels 1..k
    q = C.modularity(und, mb, 0.5, node="nodo").first().modularidad
    assert rows[0].q_gamma == pytest.approx(q, abs=1e-12)                     # reported Q is the partition's Q
    singles = spark.createDataFrame([(n, n) for n in nodes], "nodo long, comunidad long")
    assert q >= C.modularity(und, singles, 0.5, node="nodo").first().modularidad


def test_resolution_study_and_wide_table(spark):
    und = C.to_undirected(edges_df(spark, TWO_TRIANGLES))
    long = C.resolution_study(und, gammas=(0.0, 1.0), seed=0)
    rows = {(r.nodo, r.gamma): r for r in long.collect()}
    assert len(rows) == 12
    assert len({rows[(n, 0.0)].comunidad for n in range(1, 7)}) == 1              # γ = 0: one component
    assert len({rows[(n, 1.0)].comunidad for n in range(1, 7)}) == 2              # γ = 1: two triangles
    assert rows[(1, 1.0)].modularidad == pytest.approx(0.357142857, abs=1e-9)     # Q at γ = 1 in both
    assert rows[(1, 0.0)].modularidad == pytest.approx(0.0, abs=1e-12)
    lab = spark.createDataFrame([(n, 0.1 * n) for n in range(1, 7)] * 2, "cont_rut long, score double")
    wide = C.study_table(lab, long, (0.0, 1.0))
    assert wide.count() == 6                                                      # exact duplicates removed
    assert {"comunidad_0.0", "modularidad_0.0", "comunidad_1.0", "modularidad_1.0"} <= set(wide.columns)


def test_louvain_ring_of_cliques(spark):
    cliques, size = 5, 6
    rows = []
    for c in range(cliques):
        base = c * size
        rows += [(base + i, base + j, 1.0) for i in range(size) for j in range(i + 1, size)]
        rows.append((base + size - 1, ((c + 1) % cliques) * size, 1.0))          # ring edge to the next clique
    und = C.to_undirected(edges_df(spark, rows))
    mb = C.louvain(und, resolution=1.0, seed=3)
    groups = {}
    for r in mb.collect():
        groups.setdefault(r.comunidad, set()).add(r.nodo)
    assert sorted(map(min, groups.values())) == [c * size for c in range(cliques)]
    assert all(len(g) == size for g in groups.values())
    q = C.modularity(und, mb, 1.0, node="nodo").first().modularidad
    assert q == pytest.approx(5 * (15 / 80 - (32 / 160) ** 2), abs=1e-9)


def test_long_path_is_one_component(spark):
    und = spark.range(0, 1000).select(F.col("id").alias("u"), (F.col("id") + 1).alias("v"), F.lit(1.0).alias("w"))
    assert C.connected_components(und).select("c").distinct().collect() == [(0,)]


def _planted(spark, sf="/root/testdata/sf0.001"):
    """The combined graph without the edges between groups of very different sizes (2 i + 1 of 400 ids belong to group
    i): it falls into components and communities that are not trivial."""
    from riskgraph.plans.scenarios import Inputs
    group = lambda c: F.floor(F.sqrt(F.col(c) % 400))
    e = Inputs(spark, sf).edges("combined").where(group("emisor") == group("receptor"))
    return C.to_undirected(e)


def _text(c):
    return F.concat(F.lit("id-"), F.lpad(F.col(c).cast("string"), 12, "0"))


@pytest.fixture(scope="module")
def planted(spark):
    from riskgraph.sources.io import cut
    return cut(_planted(spark), "planted")


@pytest.fixture(scope="module")
def study(planted):
    from riskgraph.sources.io import cut
    return cut(C.partitions(planted, [0.0, 0.5, 1.0]), "planted-study")


def test_text_ids_equal_numbers(spark, planted, study):
    """Ids as text of the same order: the same partition, for Louvain and for the study table."""
    und = planted.select(_text("u").alias("u"), _text("v").alias("v"), "w")
    text = C.partitions(und, [0.0, 0.5, 1.0])
    a = {(r.gamma, r.nodo): (r.comunidad, r.q_gamma, r.q_1) for r in text.collect()}
    b = {(r.gamma, "id-" + str(r.nodo).zfill(12)): (r.comunidad, r.q_gamma, r.q_1) for r in study.collect()}
    assert a.keys() == b.keys() and all(a[k][0] == b[k][0] and a[k][1:] == pytest.approx(b[k][1:], abs=1e-12) for k in a)
    nodes = study.select("nodo").distinct()
    lab = nodes.select(F.col("nodo").alias("cont_rut"), F.lit(0.5).alias("score"))
    long = study.withColumnRenamed("q_1", "modularidad")
    wide = C.study_table(lab, long, (0.0, 0.5, 1.0))
    wide_text = C.study_table(lab.withColumn("cont_rut", _text("cont_rut")), text.withColumnRenamed("q_1", "modularidad"), (0.0, 0.5, 1.0))
    n = wide.count()
    same = wide.withColumn("cont_rut", _text("cont_rut")).select("cont_rut", "`comunidad_0.5`", "`comunidad_1.0`")
    assert n == wide_text.count() and same.exceptAll(wide_text.select("cont_rut", "`comunidad_0.5`", "`comunidad_1.0`")).count() == 0


def test_certificate_of_planted_groups(planted, study):
    rows = {r.gamma: r for r in C.certificate(planted, study).collect()}
    nodes = C.degrees(planted).count()
    assert sorted(rows) == [0.0, 0.5, 1.0]
    for r in rows.values():
        assert r.n_nodes == nodes and r.once and r.gapless and r.connected and r.stable and r.q_stated
    assert rows[1.0].n_communities >= rows[0.0].n_communities > 1
    cc = C.connected_components(planted)
    assert rows[0.0].n_communities == cc.select("c").distinct().count()


def test_certificate_finds_faults(spark):
    und = C.to_undirected(edges_df(spark, TWO_TRIANGLES + [(7, 8, 1.0)]))
    good = {1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 3, 8: 3}

    def certified(part, q=None, extra=()):
        rows = [(1.0, n, c) for n, c in part.items()]
        df = spark.createDataFrame(rows + list(extra), "gamma double, nodo long, comunidad long")
        q = C.modularity(und, df.select("nodo", "comunidad"), 1.0, node="nodo").scalar() if q is None else F.lit(q)
        return C.certificate(und, df.withColumn("q_gamma", q)).first()

    r = certified(good)
    assert r.once and r.gapless and r.connected and r.stable and r.q_stated and r.n_communities == 3
    assert not certified(good, q=0.9).q_stated
    assert not certified(good | {7: 5, 8: 5}).gapless
    assert not certified(good | {3: 2}).stable and certified(good | {3: 2}).best_gain > 0
    apart = certified({1: 1, 2: 1, 3: 1, 4: 2, 5: 2, 6: 2, 7: 1, 8: 1})
    assert not apart.connected and apart.once
    assert not certified(good, q=0.1, extra=[(1.0, 1, 2)]).once
    assert not certified({k: v for k, v in good.items() if k != 2}, q=0.1).once


def test_pieces_are_named_by_their_smallest_node(spark):
    from riskgraph.operators.louvain import connected_parts
    und = spark.createDataFrame([(1, 2, 1.0), (3, 4, 1.0), (2, 3, 0.0), (5, 5, 1.0)], "u long, v long, w double")
    memb = spark.createDataFrame([(g, n, 9) for g in (0.5, 1.0) for n in range(1, 6)], "gamma double, node long, c long")
    got = {(r.gamma, r.node): r.c for r in connected_parts(und, memb, 5).collect()}
    assert got == {(g, n): c for g in (0.5, 1.0) for n, c in {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}.items()}


def _random_graph(spark, n=240, degree=8):
    rows = {(min(i, j), max(i, j)) for i in range(1, n + 1) for j in [(i * i * 7 + k * k * 131 + i * k * 17) % n + 1 for k in range(degree)]}
    return spark.createDataFrame([(u, v, 1.0 + (u * 31 + v * 17) % 5) for u, v in sorted(rows)], "u long, v long, w double")


def test_few_sweeps(spark, monkeypatch):
    """Nodes of a block see each other's moves, so that a level of a small graph takes a sweep or two and not dozens."""
    from riskgraph.operators import louvain
    sweeps, decisions = [], louvain._decisions
    monkeypatch.setattr(louvain, "_decisions", lambda *a: (sweeps.append(a[-1]), decisions(*a))[1])
    und = _random_graph(spark)
    study = C.partitions(und, [1.0])
    assert len(sweeps) <= 16
    r = C.certificate(und, study).first()
    assert r.once and r.gapless and r.connected and r.stable and r.q_stated and r.n_communities > 1


def test_walk_of_a_block():
    """Two triangles and a bridge: the nodes of a block see each other's moves, and of the others what the sweep began with."""
    import numpy as np
    from riskgraph.operators.louvain import _walk
    both = [(a, b) for x, y, _ in TWO_TRIANGLES for a, b in ((x, y), (y, x))]
    src, dst = (np.array(x) for x in zip(*both, strict=True))
    deg = np.bincount(src).astype(float)
    total = {i: deg[i] for i in range(1, 7)}
    now = {i: i for i in range(1, 7)} | _walk(1.0, src, dst, dst, np.ones(14), src, deg[src], dict(total), 7.0, 1e-7)
    assert len({now[i] for i in (1, 2, 3)}) == 1 and len({now[i] for i in (4, 5, 6)}) == 1 and now[1] != now[4]
    keep = src <= 2  # a block of 1 and 2: 3 stays, its community does not
    moves = _walk(1.0, src[keep], dst[keep], np.where(dst[keep] <= 2, dst[keep], 0), np.ones(keep.sum()), src[keep], deg[src[keep]], dict(total), 7.0, 1e-7)
    assert set(moves) <= {1, 2} and len({({1: 1, 2: 2} | moves)[i] for i in (1, 2)}) == 1


def test_modularities_of_a_constant_resolution_join_by_key(spark):
    from riskgraph.operators.louvain import modularities
    und = C.to_undirected(edges_df(spark, TWO_TRIANGLES))
    memb = spark.range(1, 7).select(F.lit(1.0).alias("gamma"), F.col("id").alias("node"), F.floor((F.col("id") - 1) / 3).alias("c"))
    q = modularities(und, memb, 7.0)
    assert "NestedLoopJoin" not in q._jdf.queryExecution().executedPlan().toString()
    assert q.first().q_1 == pytest.approx(0.357142857, abs=1e-9)


def test_first_sweep_of_a_level_looks_at_no_single_node(spark, monkeypatch):
    """A level of one block begins without the table of all nodes' best moves; only the level that nothing raises
    and the last one, on the nodes, make it."""
    from riskgraph.operators import louvain
    names, decisions = [], louvain._decisions
    monkeypatch.setattr(louvain, "_decisions", lambda *a: (names.append(a[-1]), decisions(*a))[1])
    und = _random_graph(spark)
    study = C.partitions(und, [0.5, 1.0])
    assert names and names[0] != "louvain-sweep-0-0"
    for r in C.certificate(und, study).collect():
        assert r.once and r.gapless and r.connected and r.stable and r.q_stated


def test_quality_of_a_state_is_that_of_its_decisions(spark):
    from riskgraph.operators.louvain import _decisions, _progress, _quality
    links = [(u, v, w) for a, b, w in TWO_TRIANGLES for u, v in ((a, b), (b, a)) if a != b]
    adj = spark.createDataFrame([(u, v, float(w)) for u, v, w in links], "src long, dst long, w double")
    k = {i: sum(w for u, _, w in links if u == i) for i in range(1, 7)}
    rows = [(g, i, 1 if i < 5 else 2, float(k[i]), 0.5 * i, 3) for g in (0.5, 1.0) for i in k]
    state = spark.createDataFrame(rows, "gamma double, node long, c long, k double, sl double, n long")
    m = sum(k.values()) / 2
    want = _progress(_decisions(state, adj, ["dst"], m, 1e-7, "quality-test"), m)
    got = _quality(state, adj, ["dst"], m)
    assert got == {g: pytest.approx(x, abs=1e-12) for g, (x, _) in want.items()}


def _cliques(spark, n=30, size=8):
    """Cliques in a ring, joined by weak links, with loops."""
    rows = [(a * size + i, a * size + j, 1.0) for a in range(n) for i in range(size) for j in range(i + 1, size)]
    rows += [(min(a * size, b), max(a * size, b), 0.5) for a in range(n) for b in [(a + 1) % n * size + 1]]
    rows += [(a * size, a * size, 0.25) for a in range(n)]
    return spark.createDataFrame(rows, "u long, v long, w double")


@pytest.mark.parametrize("whole", [4_000_000, 0])
def test_partitions_over_blocks_are_settled(spark, monkeypatch, whole):
    """In one task per γ, or over several blocks when the graph is too large for one. The study at several γ reads
    no joined table of links per γ: what is written are blocks, communities and labels."""
    from riskgraph.operators import louvain, packed
    monkeypatch.setattr(packed, "WHOLE", whole)
    monkeypatch.setattr(packed, "BLOCK_LINKS", 300)
    names, cut_ = [], packed.cut
    for module in (louvain, packed):
        monkeypatch.setattr(module, "cut", lambda df, name: (names.append(name), cut_(df, name))[1])
    levels, climbed = [], louvain._climbed
    monkeypatch.setattr(louvain, "_climbed", lambda g, *a: climbed(g, *a) if whole or not levels.append(g) and len(levels) < 3
                        else (monkeypatch.setattr(packed, "WHOLE", 4_000_000), climbed(g, *a))[1])
    und = _cliques(spark)
    gammas = (0.0, 0.5, 1.0, 3.0)
    study = C.partitions(und, gammas).localCheckpoint()
    assert "packed-blocks" in names and not {"louvain-adj-0", "louvain-start-0", "louvain-und"} & set(names)
    for r in C.certificate(und, study).collect():
        assert r.once and r.gapless and r.connected and r.stable and r.q_stated, r
    k = {r.gamma: r.k for r in study.groupBy("gamma").agg(F.max("comunidad").alias("k")).collect()}
    assert k[0.0] == 1 and k[1.0] > 5 and k[3.0] >= 29


def test_partitions_by_joins_beyond_the_bound(spark, monkeypatch):
    """Graphs of more nodes than may be broadcast go through joined tables; both certificates agree."""
    from riskgraph.operators import packed
    und = C.to_undirected(edges_df(spark, TWO_TRIANGLES))
    a = C.partitions(und, [0.0, 1.0]).localCheckpoint()
    over_blocks = {r.gamma: r for r in C.certificate(und, a).collect()}
    monkeypatch.setattr(packed, "NODES", 3)
    b = C.partitions(und, [0.0, 1.0]).localCheckpoint()
    assert sorted(map(tuple, a.collect())) == sorted((g, n, c, pytest.approx(q, abs=1e-12), pytest.approx(q1, abs=1e-12)) for g, n, c, q, q1 in b.collect())
    for r in C.certificate(und, a).collect():
        s = over_blocks[r.gamma].asDict()
        assert all(s[x] == (pytest.approx(y, abs=1e-12) if isinstance(y, float) else y) for x, y in r.asDict().items())


def test_a_block_has_all_links_of_its_nodes(spark):
    from riskgraph.operators.packed import Block, Graph, block_of
    from riskgraph.operators.ids import dictionary
    import numpy as np
    rows = [("a", "b", 1.0), ("b", "c", 2.0), ("b", "b", 0.5), ("c", "c", 4.0), ("d", "d", 3.0), (None, "a", 9.0), ("a", "d", None)]
    und = spark.createDataFrame(rows, "u string, v string, w double")
    g = Graph(und, 4, dictionary(und.select("u").union(und.select("v"))))
    assert g.k.tolist() == [0, 1, 4, 10, 6] and g.m == 10.5
    b = Block.load(block_of(np.array([1, 2, 2, 2]), np.array([2, 1, 3, 2]), np.array([1.0, 1.0, 2.0, 0.5])).dump())
    assert b.nodes.tolist() == [1, 2] and b.ptr.tolist() == [0, 1, 3] and b.loops.tolist() == [0, 0.5] and b.k.tolist() == [1, 4]
    assert b.dst.tolist() == [2, 1, 3] and b.w.tolist() == [1, 1, 2]


def test_a_written_table_is_not_written_again(spark):
    """a graph that is written already is read where it lies."""
    from riskgraph.sources.io import cut, kept
    und = cut(edges_df(spark, TWO_TRIANGLES), "kept-test")
    assert kept(und.select("receptor", "Fi"), "again").inputFiles() == und.inputFiles()
    for df in (und.where("Fi > 0.5"), und.select((F.col("Fi") * 2).alias("Fi")), edges_df(spark, TWO_TRIANGLES)):
        again = kept(df, "again")
        assert set(again.inputFiles()).isdisjoint(und.inputFiles()) and again.count() == df.count()


def test_shuffle_files_of_finished_statements_go(spark, tmp_path):
    """what a statement shuffled is removed once it is written, and not when the driver happens to need memory."""
    import glob
    import time
    from riskgraph.sources.io import cut, release
    local = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()[0].toString()
    files = lambda: set(glob.glob(f"{local}/*/shuffle_*"))
    before = files()
    cut(spark.range(1000).repartition(7, "id"), "release-test")
    made = files() - before
    assert made
    release(spark)
    for _ in range(100):
        if not made & files():
            break
        time.sleep(0.1)
    assert not made & files()
