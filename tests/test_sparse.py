import random

from pyspark.sql import functions as F

from graphloom.operators import vectors


def test_a_query_of_few_components_reads_those_alone(spark):
    rng = random.Random(1)
    rows = [(i, [rng.choice([0.0, 0.0, 0.0, rng.random()]) for _ in range(16)]) for i in range(200)]
    df, query = spark.createDataFrame(rows, "vec_id long, embedding array<double>"), [0.0] * 16
    query[3], query[11] = 0.6, 0.8
    best = lambda sparse: [(r.vec_id, round(r.score, 9)) for r in vectors.top_k(df, query, 50, sparse=sparse).collect()]
    assert best(True) == best(False)
    # orthogonal
    apart = spark.createDataFrame([([1.0] + [0.0] * 15,)], "v array<double>").select(vectors.sparse_cosine(F.col("v"), query).alias("c"))
    assert apart.first().c == 0.0
