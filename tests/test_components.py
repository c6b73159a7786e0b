import random

from riskgraph.operators.components import components


def brute(edges):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    return {x: find(x) for x in list(parent)}


def run(spark, edges):
    df = spark.createDataFrame(edges, "u long, v long")
    return {r.node: r.component for r in components(df).collect()}


def test_long_path_is_one_component(spark):
    ids = list(range(1000))
    random.Random(0).shuffle(ids)
    assert set(run(spark, list(zip(ids, ids[1:]))).values()) == {0}


def test_random_graphs_loops_and_repeats(spark):
    rng = random.Random(2)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(180)] + [(400, 400), (7, 8), (8, 7), (7, 8)]
    assert run(spark, edges) == brute(edges)


def test_star_and_empty(spark):
    edges = [(5, i) for i in range(6, 500)]
    assert run(spark, edges) == brute(edges)
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []
    assert components(spark.createDataFrame([(None, 1), (2, 3)], "u long, v long")).count() == 2
