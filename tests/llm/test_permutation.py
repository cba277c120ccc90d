import math

import numpy as np
from pyspark.sql import functions as F

from graphloom.llm import permutation as P


def brute(rows, k=20, every=20):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for q, a in good:
        if q % every == 0:
            out[q] = sorted(((-float((a * b).sum()), i) for i, b in good if i != q))[:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    return out


def hits(got, want):
    return np.mean([len({i for _, i in got[q]} & {i for _, i in want[q]}) / len(want[q]) for q in want])


def test_recall_at_production_values(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in df.collect()])
    got = result(P.search(df, F.col("vec_id") % 20 == 0, 20))
    assert got.keys() == want.keys() and all(len(v) == 20 for v in got.values())
    assert 12 * math.sqrt(2000) < 2000 / 3  # so no query ranks more than a third of them again
    assert hits(got, want) >= 0.95


def test_recall_of_fifty_thousand_unstructured_vectors():
    """The hardest case: no direction is denser than another. One shard, production values."""
    rng = np.random.default_rng(4)
    v = rng.normal(size=(50_000, 64))
    base = np.hstack([v[:4096], np.zeros((4096, 1))])
    longest = float(np.sqrt((v**2).sum(1).max()))
    base[:, -1] = np.sqrt(longest**2 - (base**2).sum(1))
    shard = P.Shard(np.arange(len(v)), v, base, longest, 80)
    asked = np.arange(0, 4000, 20)
    query, found, score = shard.search(asked, v[asked], 20, math.ceil(12 * math.sqrt(len(v))))
    products = v[asked] @ v.T
    products[np.arange(len(asked)), asked] = -np.inf
    least = np.sort(products, 1)[:, -20]
    assert len(query) == 20 * len(asked) and np.mean(score >= least[query // 20] - 1e-9) >= 0.9


def test_several_shards_and_blocks_give_what_one_gives(spark, monkeypatch):
    rng = np.random.default_rng(1)
    rows = [(i, list(map(float, rng.normal(size=8)))) for i in range(4000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    monkeypatch.setattr(P, "VALUES", 8 * 1024)
    assert hits(result(P.search(df, F.col("vec_id") % 2 == 0, 20)), brute(rows, every=2)) >= 0.95


def test_exact_with_full_reach(spark, sf):
    df = spark.read.parquet(f"{sf}/embeddings.parquet")
    want = brute([(r.vec_id, list(r.embedding)) for r in df.collect()])
    got = result(P.search(df, F.col("vec_id") % 20 == 0, 20, reach=1000.0))
    assert {q: [i for _, i in v] for q, v in got.items()} == {q: [i for _, i in v] for q, v in want.items()}


def test_odd_vectors_copies_and_few_candidates(spark):
    rows = [(0, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [float("nan"), 1.0]), (4, [1.0, None]), (5, [1.0, float("inf")]), (6, [2.0, 1.0]), (7, [2.0, 1.0]), (8, [-1.0, 0.5]), (20, [2.0, 1.0]), (40, [0.0, 0.0])]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    got = result(P.search(df, F.col("vec_id") % 20 == 0, 3))
    assert got == brute(rows, 3)
    assert [i for _, i in got[20]] == [6, 7, 0]
    assert P.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_repeated_rows_are_one_and_lengths_are_apart(spark):
    rows = [(0, [1.0, 0.0]), (0, [1.0, 0.0]), (6, [2.0, 1.0]), (6, [2.0, 1.0]), (6, [3.0, 1.0]), (7, [0.5, 1.0]), (20, [1.0, 1.0, 1.0]), (21, [1.0, 2.0, 3.0]), (22, [4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = result(P.search(df, F.col("vec_id") % 20 == 0, 4))
    assert got == {0: [(-3.0, 6), (-2.0, 6), (-0.5, 7)], 20: [(-6.0, 21)]}


def test_a_crowd_of_copies_keeps_no_one_out(spark):
    rng = np.random.default_rng(0)
    crowd, others = rng.normal(size=8), rng.normal(size=(300, 8))
    rows = [(i, list(map(float, crowd if i % 2 else others[i // 2]))) for i in range(600)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert hits(result(P.search(df, F.col("vec_id") % 20 == 0, 20)), brute(rows)) >= 0.9
