import math
import random
import zlib

import numpy as np
import pytest

from graphloom.llm import quality as Q
from graphloom.llm import toxicity as T
from graphloom.llm.features import Rows, distinct_words, text_profile


def corpus(n=600, seed=0):
    rng = random.Random(seed)
    plain, rude = [f"word{c}{d}" for c in "abcdefghij" for d in "klmnop"], ["scoundrel", "knave", "villain"]
    plain = ["".join(c for c in w if c.isalpha()) for w in plain]
    docs, labels = [], []
    for i in range(n):
        toxic = rng.random() < 0.2
        text = [rng.choice(plain) for _ in range(rng.randint(20, 60))]
        if toxic:
            text.insert(rng.randrange(len(text)), rng.choice(rude))
        junk = rng.random() < 0.2
        docs.append((i, " ".join([text[0]] * 40) if junk and not toxic else " ".join(text)))
        labels.append((i, 0 if junk and not toxic else 1, int(toxic)))
    return docs, labels


@pytest.fixture(scope="module")
def tables(spark):
    docs, labels = corpus()
    odd = [(10_000, None), (10_001, ""), (None, "villain"), (3, docs[3][1])]
    return spark.createDataFrame([(i, t, 5) for i, t in docs + odd], "doc_id long, text string, toxic int"), spark.createDataFrame(labels + [(7, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int"), labels


def test_toxicity_on_the_held_out_fold(tables):
    docs, labels, known = tables
    got = T.score(docs, T.fit(docs, labels)).collect()
    assert len(got) == 604 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in got)
    by_id = {r.doc_id: r for r in got if r.doc_id is not None}
    held = [(by_id[i].predicted, t) for i, _, t in known if zlib.crc32(str(i).encode()) % 4 == 2]
    assert all(by_id[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in by_id)
    assert sum(p == t for p, t in held) / len(held) >= 0.95
    assert by_id[10_000].score == by_id[10_001].score and by_id[10_000].predicted == 0
    assert [r.predicted for r in got if r.doc_id is None] == [1]


def test_labels_of_the_held_out_fold_do_not_matter(spark, tables):
    docs, labels, known = tables
    flipped = spark.createDataFrame([(i, q, 1 - t if zlib.crc32(str(i).encode()) % 4 == 2 else t) for i, q, t in known], "doc_id long, quality int, toxic int")
    a, b = T.fit(docs, labels.filter("doc_id is not null and toxic is not null")), T.fit(docs, flipped)
    assert a.weights == b.weights and a.bias == b.bias


def test_no_labels_and_empty_tables(tables):
    docs, labels, _ = tables
    assert T.fit(docs, labels.limit(0)).score("villain") == 0.0
    assert T.score(docs.limit(0), T.fit(docs.limit(0), labels)).count() == 0
    model = Q.fit(docs.limit(0), labels, Q.grade_of_labels(), 3)
    assert Q.select(docs, model).count() == docs.count() and Q.rate(docs.limit(0), model).count() == 0


def brute_risks(z, marked, prior):
    """Confirmed and clean risk by plain loops."""
    clean = [math.log(1 + math.exp(x)) for x in z]
    toxic = [math.log(1 + math.exp(-x)) for x in z]
    p, u = [i for i in range(len(z)) if marked[i]], [i for i in range(len(z)) if not marked[i]]
    return prior * sum(toxic[i] for i in p) / len(p), sum(clean[i] for i in u) / len(u) - prior * sum(clean[i] for i in p) / len(p)


def test_the_risk_estimate_and_its_slopes_as_brute_force():
    rng = np.random.default_rng(0)
    marked = np.arange(12) < 5
    for shift, sign in ((0.0, 1), (8.0, -1)):  # with the confirmed far up and the rest far down, the estimate is negative
        z = rng.normal(size=12) + np.where(marked, shift, -shift)
        slope, clean = T.slopes(z, marked, 0.4)
        toxic_risk, clean_risk = brute_risks(z, marked, 0.4)
        assert clean == pytest.approx(clean_risk) and (clean_risk < 0) == (sign < 0)
        for i in range(12):
            up, down = z.copy(), z.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            a, b = brute_risks(up, marked, 0.4), brute_risks(down, marked, 0.4)
            want = (sum(a) - sum(b)) / 2e-5 if sign > 0 else -(a[1] - b[1]) / 2e-5
            assert slope[i] == pytest.approx(want, abs=1e-6)


def test_the_risk_stays_near_zero_or_above():
    """Without the correction the estimate falls far below zero on texts whose words tell all of them apart."""
    rows = Rows.of([np.array([i // 15, 100 + i // 15]) for i in range(90)])
    marked = np.arange(90) < 45
    model = T.train(rows, marked, 0.3, shrink=0.0)
    z = np.array([model.bias + sum(model.weights.get(k, 0.0) for k in (i // 15, 100 + i // 15)) for i in range(90)])
    assert model.weights and np.isfinite(z).all()
    assert brute_risks(z, marked, 0.3)[1] > -0.5  # the uncorrected risk goes below minus one here
    plain = np.zeros(2)
    for _ in range(400):  # the same fit without the correction, in the two sums that all rows have
        chance = 1 / (1 + np.exp(-plain))
        plain -= 0.1 * np.array([-0.3, chance[1]])
    assert brute_risks(np.where(marked, plain[0], plain[1]), marked, 0.3)[1] < -1


def test_quality_on_the_held_out_fold(tables):
    docs, labels, known = tables
    model = Q.fit(docs, labels, Q.grade_of_labels(), 3)
    assert (np.diff(model.thresholds) > 0).all()
    got = {r.doc_id: r for r in Q.rate(docs, model).collect()}
    held = [(got[i].tails[0] >= 0.5, q == 1) for i, q, _ in known if zlib.crc32(str(i).encode()) % 4 == 2]
    assert sum(a == b for a, b in held) / len(held) >= 0.97
    assert all(abs(r.expected_grade - sum(r.tails)) < 1e-9 and r.tails[0] >= r.tails[1] for r in got.values())
    kept = {r.doc_id for r in Q.select(docs, model).collect()}
    assert kept == {i for i, r in got.items() if r.tails[0] >= 0.5}


def test_slopes_of_the_likelihood_as_brute_force():
    rng = np.random.default_rng(2)
    sums, cuts, grades = rng.normal(size=20), np.array([-0.7, 0.4, 1.5]), rng.integers(0, 4, 20)

    def likelihood(sums, cuts):
        out = 0.0
        for x, g in zip(sums, grades, strict=True):
            tail = [1.0, *(1 / (1 + math.exp(c - x)) for c in cuts), 0.0]
            out += math.log(tail[g] - tail[g + 1])
        return out

    by_row, by_cut = Q.slopes(sums, cuts, grades)
    for values, got, of in ((sums, by_row, lambda v: likelihood(v, cuts)), (cuts, by_cut, lambda v: likelihood(sums, v))):
        for i in range(len(values)):
            up, down = values.copy(), values.copy()
            up[i] += 1e-5
            down[i] -= 1e-5
            assert got[i] == pytest.approx((of(up) - of(down)) / 2e-5, abs=1e-6)


def test_scores_as_brute_force(tables):
    """Every score is the sum of a text's weights, word by word, and very long texts are scored whole."""
    docs, labels, _ = tables
    model = T.fit(docs, labels)
    text = "plain " * 300_000 + "villain"
    want = 1 / (1 + math.exp(-(model.bias + sum(model.weights.get(k, 0.0) for k in set(distinct_words("plain villain", T.BITS))))))
    assert model.score(text) == pytest.approx(want) and model.score(text) > model.score("plain")
    rated = Q.fit(docs, labels, Q.grade_of_labels(), 3)
    profile = text_profile(text, Q.BITS)
    z = sum(rated.weights.get(k, 0.0) * v for k, v in profile.items())
    assert rated.tails(text).tolist() == pytest.approx([1 / (1 + math.exp(c - z)) for c in rated.thresholds])


def test_gradients_follow_the_likelihood():
    rng = np.random.default_rng(1)
    x = rng.normal(size=400)
    grades = np.digitize(x + rng.logistic(size=400) * 0.3, [-0.5, 0.5])
    rows = Rows.of([np.array([0])] * 400, [np.array([v]) for v in x])
    model = Q.train(rows, grades, 3, steps=800, shrink=0.0)
    assert model.weights[0] > 1 and -0.8 < model.thresholds[0] / model.weights[0] < -0.2 < 0.2 < model.thresholds[1] / model.weights[0] < 0.8


def test_features():
    assert distinct_words(None, 20) == [] and text_profile(None, 20) == text_profile("", 20)
    assert sorted(distinct_words("a A, a1a", 20)) == sorted(distinct_words("a", 20))
