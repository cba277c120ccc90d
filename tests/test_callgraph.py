import itertools

import pytest

from graphloom.operators import callgraph as G
from graphloom.operators import centrality, ranking
from graphloom.operators.components import connected_components

EDGES = [("main", "process_data"), ("main", "validate_input"), ("process_data", "format_output"), ("process_data", "helper_function"), ("validate_input", "helper_function")]
SCORES = {"main": 5.0, "process_data": 8.0, "validate_input": 3.0, "format_output": 2.0, "helper_function": 1.0}


@pytest.fixture(scope="module")
def small(spark):
    functions = spark.createDataFrame([(n, s) for n, s in SCORES.items()], "id string, complexity_score double")
    return functions, spark.createDataFrame(EDGES, "src string, dst string")


def test_pagerank_of_the_fixture(small):
    functions, edges = small
    got = {r.id: r["rank"] for r in ranking.pagerank(functions, edges, tolerance=1e-7).collect()}
    want = {"main": 0.120883, "process_data": 0.172257, "validate_input": 0.172257, "format_output": 0.194092, "helper_function": 0.340511}
    assert sum(got.values()) == pytest.approx(1) and got == pytest.approx(want, abs=1e-5)
    scores = {r.id: r.score for r in ranking.pagerank_importance(functions, edges, tolerance=1e-7).collect()}
    assert scores == pytest.approx({"main": 149.10, "process_data": 221.57, "validate_input": 203.37, "format_output": 221.87, "helper_function": 371.26}, abs=0.02)


def test_trails_repeat_no_edge_but_nodes(spark):
    ring = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a")], "src string, dst string")
    trails = {tuple(r.nodes) for r in G.paths(ring, 5).collect()}
    assert ("a", "b", "c", "a") in trails and max(map(len, trails)) == 4
    simple = {tuple(r.nodes) for r in G.paths(ring, 5, loops=False).collect()}
    assert max(map(len, simple)) == 3
    assert [(r.cycle, r.length) for r in G.simple_cycles(ring, 4).collect()] == [("a>b>c", 3)]


def test_closure_is_idempotent_and_has_cycles(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (3, 4), (5, 5)], "src int, dst int")
    reach = {(r.src, r.dst) for r in G.closure(edges).collect()}
    assert reach == {*itertools.product((1, 2, 3), (1, 2, 3, 4)), (5, 5)}
    again = G.closure(spark.createDataFrame(list(reach), "src int, dst int"))
    assert {(r.src, r.dst) for r in again.collect()} == reach


def test_last_of_a_name_wins(spark):
    f = spark.createDataFrame([(1, 1, "x"), (2, 2, "y"), (3, 3, "x")], "id long, seq long, name string")
    assert {(r.name, r.id, r.first_seq) for r in G.resolve_names(f).collect()} == {("x", 3, 1), ("y", 2, 2)}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (102, 101), (7, 7), (200, 200)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    assert got == {**{i: 1 for i in range(1, 41)}, 100: 100, 101: 100, 102: 100, 200: 200}
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_betweenness_and_communities(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (1, 4), (4, 3), (3, 5)], "src long, dst long")
    nodes = spark.createDataFrame([(i,) for i in range(1, 7)], "id long")
    assert {r.id: r.betweenness for r in centrality.betweenness(nodes, edges).collect()} == {1: 0.0, 2: 1.0, 3: 3.0, 4: 1.0, 5: 0.0, 6: 0.0}
    cliques = [(a, b) for base in (0, 10) for a, b in itertools.combinations(range(base, base + 4), 2)] + [(0, 10)]
    e = spark.createDataFrame(cliques, "src long, dst long")
    n = spark.createDataFrame([(i,) for i in (*range(4), *range(10, 14))], "id long")
    for found in (centrality.label_propagation(n, e), centrality.louvain_level(n, e)):
        got = {r.id: r.community for r in found.collect()}
        assert got.keys() == {*range(4), *range(10, 14)}
    assert centrality.modularity(e, centrality.label_propagation(n, e)) > 0.3


def test_empty_tables(spark):
    functions, edges = spark.createDataFrame([], "id long, complexity_score double"), spark.createDataFrame([], "src long, dst long")
    assert ranking.pagerank(functions, edges).count() == 0
    assert G.closure(edges).count() == 0 and G.paths(edges, 3).count() == 0
    assert {r.n for r in ranking.distribution(ranking.traditional(functions, edges)).collect()} == {0}
