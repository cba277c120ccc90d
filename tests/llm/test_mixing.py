from collections import Counter, defaultdict

import pytest

from graphloom.llm import mixing as M

from .test_lines import words


def brute_targets(sizes, weights=(5, 2, 1), share=1.5, cap=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + ([None] if None in sizes else [])
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in full]
        if not free:
            return {s: cap * sizes[s] for s in names}
        level = (budget - sum(cap * sizes[s] for s in full)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level >= cap * sizes[s]}
        if not over:
            return {s: cap * sizes[s] if s in full else weight[s] * level for s in names}
        full |= over


def rows():
    out = []
    for k, (source, n) in enumerate([("b", 40), ("a", 300), ("Z", 5), ("é", 60), (None, 50), ("", 30)]):
        out += [(1000 * k + i, "w " * (1 + (i * 7) % 23), source) for i in range(n)]
    return [*out, (9001, None, "a"), (9002, "", "b"), (None, "x y", "a"), (1, "w " * 8, "b")]


def test_targets_and_shares(spark):
    data = rows()
    df = spark.createDataFrame([(*r, 1) for r in data], "doc_id long, text string, source string, size int")
    queue = M.fair_queue(df)
    got = queue.rows.select("doc_id", "source", "size", "source_size", "target", queue.passes().alias("passes")).collect()
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len(words(t))
    want, taken = brute_targets(sizes), defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source] and r.target == pytest.approx(want[r.source]) and 0 <= r.passes <= 2
        taken[r.source] += r.size * r.passes
    assert len(got) == len(data)
    assert all(abs(taken[s] - want[s]) <= 24 for s in want), (taken, want)
    assert sum(taken.values()) <= 1.5 * sum(sizes.values())
    again = M.fair_queue(df.repartition(7))
    assert Counter(map(tuple, again.rows.select("doc_id", "size", again.passes()).collect())) == Counter((r.doc_id, r.size, r.passes) for r in got)
    mixed = M.mix(df)
    assert mixed.columns == df.columns
    assert sum(len(words(r.text)) for r in mixed.collect()) == sum(taken.values())


def test_the_cut_is_exact(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 8)
    data = [(float((i * 37) % 101) / 7, i, 1 + i % 5) for i in range(101)]
    df = spark.createDataFrame(data, "finish double, tie long, size long")
    for budget in (0.0, 1.0, 57.0, 200.0):
        (at, tie), upto, want = M._cut(df, budget), 0, set()
        for f, t, s in sorted(data):
            upto += s
            if upto <= budget:
                want.add((f, t))
        assert {(f, t) for f, t, _ in data if f < at or (f == at and t <= tie)} == want
    assert M._cut(df, 1e9) is None


def test_equal_finish_times_are_cut_by_their_ties(spark, monkeypatch):
    monkeypatch.setattr(M, "BUCKET_ROWS", 50)
    df = spark.range(3000).selectExpr("2.5D AS finish", "xxhash64(id) AS tie", "1 + id % 5 AS size")
    rows = sorted((r.tie, r["size"]) for r in df.collect())
    for budget in (0.0, 10.0, 4321.0):
        at, tie = M._cut(df, budget)
        upto, want = 0, []
        for t, s in rows:
            upto += s
            want += [t] * (upto <= budget)
        assert [t for t, _ in rows if 2.5 < at or (at == 2.5 and t <= tie)] == want


def test_empty_and_wordless_tables(spark):
    df = spark.createDataFrame([(1, "", "a"), (2, None, None)], "doc_id long, text string, source string")
    queue = M.fair_queue(df)
    assert {(r.doc_id, r.target) for r in queue.rows.collect()} == {(1, 0.0), (2, 0.0)}
    assert M.fair_queue(df.limit(0)).rows.count() == 0 and M.mix(df.limit(0)).count() == 0
