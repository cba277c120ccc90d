"""Similar pairs against a brute force, and what they cost."""

import numpy as np
import pytest

from graphloom.operators import vectors


@pytest.mark.parametrize("cells", [None, 5])
def test_pairs_as_brute_force(spark, cells):
    x = np.random.default_rng(4).normal(size=(600, 12)).astype(np.float32)
    x[7], x[8] = x[3], 2 * x[3]
    rows = [(int(i), [float(c) for c in v]) for i, v in enumerate(x)]
    odd = [(1000, [0.0] * 12), (1001, None), (1002, [None] * 12), (1003, [1.0, 2.0]), (1004, [2.0, 4.0]), (None, [1.0] * 12)]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<float>")
    found = vectors.similar_pairs(df, 0.45, cells)
    # most cells are within reach at this threshold, so a join of vectors with them is one of all pairs, row by row
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString()
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    score = y @ y.T
    want = {(int(a), int(b)): score[a, b] for a, b in np.argwhere(np.triu(score >= 0.45, 1))} | {(1003, 1004): 1.0}
    got = found.collect()
    assert len(got) == len(want) and {(r.a, r.b): r.score for r in got} == pytest.approx(want)
