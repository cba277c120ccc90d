import duckdb
import numpy as np
import pytest

from graphloom.operators import vectors
from graphloom.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_its_sql(spark, duck, name):
    got, want = catalog.queries()[name](spark, SF).toPandas(), duck.execute(catalog.oracle_sql()[name]).df()
    columns = sorted(want.columns)
    assert sorted(got.columns) == columns
    order = lambda df: df[columns].astype(str).sort_values(columns).reset_index(drop=True)
    assert order(got).equals(order(want))


def test_hybrid_levels_and_ranks(spark):
    rows = catalog.queries()["r3_hybrid_importance"](spark, SF).collect()
    assert len(rows) == 200 and max(r.score for r in rows) <= 100 and min(r.score for r in rows) >= 0


def test_cell_search_recall(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").cache()
    found = []
    for vec_id in range(0, 200, 20):
        vector = vectors.vector_of(rows, vec_id)
        exact = {r.vec_id for r in vectors.top_k(rows, vector, 10, "ip").collect()}
        found.append(len(exact & {r.vec_id for r in vectors.cell_search(rows, vector, 10, 16, 8).collect()}) / 10)
    assert sum(found) / len(found) >= 0.7
    vector = vectors.vector_of(rows, 0)
    every = [r.vec_id for r in vectors.cell_search(rows, vector, 10, 16, 16).collect()]
    assert every == [r.vec_id for r in vectors.top_k(rows, vector, 10, "ip").collect()]


def test_clusters_are_those_of_the_nearest_centre(spark):
    rows = {r.vec_id: np.array(r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    cluster = {r.vec_id: r.cluster for r in catalog.queries()["v15_kmeans"](spark, SF).collect()}
    assert cluster.keys() == rows.keys() and len(set(cluster.values())) == 10

    def spread(of):
        """Sum of squared distances to the means, and the means."""
        centre = {c: np.mean([rows[i] for i in rows if of[i] == c], axis=0) for c in set(of.values())}
        return sum(((rows[i] - centre[of[i]]) ** 2).sum() for i in rows), centre

    found, centre = spread(cluster)
    shuffled = np.random.default_rng(0).permutation(list(cluster.values())).tolist()
    assert found < 0.95 * spread(dict(zip(cluster, shuffled, strict=True)))[0]  # the vectors have little structure
    near = sum(min(centre, key=lambda c: ((rows[i] - centre[c]) ** 2).sum()) == cluster[i] for i in rows)
    assert near / len(rows) >= 0.9  # all but those that a last round would move


def test_hybrid_search_as_brute_force(spark):
    """Both parts of the score by hand: the weights of shared terms, and where the word is found."""
    got = catalog.queries()["v10_hybrid_search"](spark, SF).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if r.text is not None}
    assert got and [r.rnk for r in got] == list(range(1, len(got) + 1)) and sorted((r.score for r in got), reverse=True) == [r.score for r in got]
    for r in got:
        keyword = 0.6 * ("license" in docs[r.id].source.lower()) + 0.4 * ("license" in docs[r.id].text.lower())
        assert 0.3 * keyword - 1e-9 <= r.score <= 0.3 * keyword + 0.7 + 1e-9
    assert all(h.removesuffix("...") in docs[r.id].text for r in got for h in r.highlights.split("|||"))
