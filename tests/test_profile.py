from graphloom.plans import profile


def test_ecosystem_joins_by_key(spark):
    f = spark.createDataFrame([(i, i, "ab"[i % 2] if i < 4 else f"n{i}", "C", "f", 1.0) for i in range(8)], "id long, seq long, name string, parent_class string, file_path string, complexity_score double")
    e = spark.createDataFrame([(0, 4), (0, 5), (5, 2), (2, 0), (6, 7), (7, 2)], "src long, dst long")
    found = profile.ecosystem(f, e, "a", f.limit(3))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert " OR " not in plan
    got = {r.id: (r.callees, r.callers, r.n_similar) for r in found.collect()}
    assert got == {0: (["n4", "n5"], ["a"], 3), 2: (["a"], ["n5", "n7"], 3)}
