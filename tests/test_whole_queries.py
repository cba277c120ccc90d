"""Registered queries against brute force over the whole graph, without a cut in depth, rounds or ids."""

from collections import Counter, defaultdict

import pytest

from graphloom import adapters as A
from graphloom.operators import centrality
from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
EDGES = [*((i, i + 1) for i in range(1, 13)), (13, 5), (14, 1), (3, 20), (20, 21), (21, 9), (22, 23), (23, 24), (24, 22), (25, 3), (26, 8), (27, 27), (28, 29), (25, 28), (29, 4)]


@pytest.fixture
def nodes(spark, monkeypatch):
    """Ids of a graph with long chains, in place of the driver's."""
    functions = A.functions(spark, SF).filter("id <= 30")
    monkeypatch.setattr(A, "functions", lambda spark, d: functions)
    monkeypatch.setattr(catalog, "_edges", lambda spark, d: spark.createDataFrame(EDGES, "src long, dst long"))
    return sorted(r.id for r in functions.select("id").collect())


def run(spark, name):
    return catalog.queries()[name](spark, SF).collect()


def distances(source):
    """Target -> (distance, number of shortest paths), the source with 0."""
    found, front, depth = {source: (0, 1)}, {source: 1}, 0
    while front:
        depth += 1
        step = Counter()
        for v, n in front.items():
            for s, t in EDGES:
                if s == v and t not in found:
                    step[t] += n
        found |= {t: (depth, n) for t, n in step.items()}
        front = step
    return found


def test_closure_goes_to_depth_twenty(spark, nodes):
    want = {(s, t): d for s in nodes for t, (d, _) in distances(s).items() if 0 < d <= 20}
    got = {(r.src, r.dst): r.depth for r in run(spark, "g3_closure_whole")}
    assert {k: d for k, d in got.items() if k[0] != k[1]} == want and max(want.values()) > 10
    count = Counter(s for s, _ in want)
    assert [(r.id, r.n_reachable) for r in run(spark, "g4_most_reaching_whole")] == sorted(count.items(), key=lambda x: (-x[1], x[0]))[:10]


def test_closeness_over_all_distances(spark, nodes):
    into = defaultdict(list)
    for s in nodes:
        for t, (d, _) in distances(s).items():
            into[t] += [d] if d else []
    want = {v: round(len(into[v]) ** 2 / sum(into[v]) / (len(nodes) - 1), 6) if into[v] else 0.0 for v in nodes}
    assert {r.id: r.closeness for r in run(spark, "r13_closeness")} == pytest.approx(want, abs=2e-6)


def test_pagerank_converges(spark, nodes):
    out, rank = Counter(s for s, _ in EDGES), dict.fromkeys(nodes, 1 / len(nodes))
    for _ in range(500):
        loose = sum(r for v, r in rank.items() if not out[v])
        rank = {v: (0.15 + 0.85 * loose) / len(nodes) + 0.85 * sum(rank[s] / out[s] for s, t in EDGES if t == v) for v in nodes}
    # the rounds stop when all ranks together move by less than 1e-6 a node, and shrink by 0.85 each
    assert {r.id: r["rank"] for r in run(spark, "r2_pagerank_converged")} == pytest.approx(rank, abs=2e-4)


def test_betweenness_from_all_sources_at_any_depth(spark, nodes):
    of, want = {s: distances(s) for s in nodes}, dict.fromkeys(nodes, 0.0)
    for s in nodes:
        for t, (d, n) in of[s].items():
            for v in nodes:
                if v not in (s, t) and v in of[s] and t in of[v] and of[s][v][0] + of[v][t][0] == d:
                    want[v] += of[s][v][1] * of[v][t][1] / n
    assert {r.id: r.betweenness for r in run(spark, "r13_betweenness")} == pytest.approx(want, abs=2e-6)


def test_betweenness_in_blocks(spark, nodes):
    f, e = A.functions(spark, SF).select("id"), catalog._edges(spark, SF)
    whole = centrality.betweenness(f, e, max_depth=None).collect()
    assert sorted(centrality.betweenness(f, e, max_depth=None, block=11).collect()) == sorted(whole)


def test_neighbours_of_every_function(spark, nodes):
    want = {x for s, t in EDGES for x in ((s, t), (t, s))}
    assert sorted((r.id, r.neighbour) for r in run(spark, "j7_neighbours")) == sorted(want)
