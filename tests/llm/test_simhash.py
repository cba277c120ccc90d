import itertools

import numpy as np
import pytest
import xxhash

from graphloom.llm import simhash as S


def brute_fingerprint(text, k=3):
    words = [w for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\r", " ").replace("\x0b", " ").replace("\x0c", " ").split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_classes(marks, bound):
    ids = {}
    for a, f in marks:
        ids.setdefault(f, []).append(a)
    fps = sorted(ids)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(fps, 2):
        if (a ^ b).bit_count() <= bound:
            root[find(a)] = find(b)
    least = {}
    for f in fps:
        known = [i for i in ids[f] if i is not None]
        if known:
            least[find(f)] = min(least.get(find(f), min(known)), min(known))
    return sorted((i is None, i or 0, f, least.get(find(f))) for f in fps for i in ids[f])


def test_fingerprints_as_brute_force(spark):
    texts = ["", None, "one", "A b C d", "x y z w x y z", "\ta b  c\n\nD É", "w " * 5000]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, fingerprint int")
    got = {r.doc_id: r.fingerprint for r in S.fingerprints(df).collect()}
    assert {i: brute_fingerprint(t) for i, t in enumerate(texts)} == {i: f % 2**64 for i, f in got.items()}


def dense(seed=0):
    rng = np.random.default_rng(seed)
    centres = [int(x) for x in rng.integers(0, 2**64, 6, dtype=np.uint64)]
    values = [c ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)) for c in centres for _ in range(60)]
    return values + [0, 0, 1, 3, 15] + [int(x) for x in rng.integers(0, 2**64, 200, dtype=np.uint64)]


@pytest.mark.parametrize(("bound", "most"), [(2, 1024), (2, 8), (0, 1024), (1, 4)])
def test_classes_as_brute_force(spark, bound, most):
    marks = [(i + 1, f) for i, f in enumerate(dense())] + [(None, 0)]
    df = spark.createDataFrame([(i, S._signed(f)) for i, f in marks], "doc_id long, fingerprint long")
    got = S.near_duplicate_classes(df, bound, most).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.fingerprint % 2**64, r.component_id) for r in got) == brute_classes(marks, bound)


def test_unequal_thresholds_lose_no_link(spark):
    marks = [(i, f) for i, f in enumerate(dense(1))]
    df = spark.createDataFrame([(S._signed(f), i) for f, i in {f: i for i, f in marks}.items()], "fingerprint long, rep long")
    masks = S.group_bits(*S.bit_statistics(df), 2)
    from graphloom.operators.components import connected_components

    links = S.posting_links(df, [(masks[0], 1), (masks[1], 0)], 2)
    got = {r.node: r.component for r in connected_components(links).collect()}
    want = {}
    for _, i, f, c in brute_classes([(i, f) for f, i in {f: i for i, f in marks}.items()], 2):
        want[i] = c
    assert all(got.get(i, i) == c for i, c in want.items())


def test_thresholds_are_the_cheapest():
    rng = np.random.default_rng(2)
    for _ in range(20):
        m, bound = int(rng.integers(1, 5)), 3
        costs = [sorted(map(float, rng.integers(1, 100, bound + 1))) for _ in range(m)]
        best = min((sum(c[t] for c, t in zip(costs, ts) if t >= 0), ts) for ts in itertools.product(range(-1, bound + 1), repeat=m) if sum(ts) == bound - m + 1)
        assert S.allocate(costs, bound)[0] == best[0]


def test_masks_cut_all_bits():
    rng = np.random.default_rng(3)
    bits = rng.integers(0, 2, (300, 64)).astype(float)
    bits[:, 1] = bits[:, 40]
    masks = S.group_bits(300, bits.T @ bits, 3)
    assert sum(masks) == 2**64 - 1 and not masks[0] & masks[1] and max(m.bit_count() for m in masks) <= 22
    assert any(m >> 1 & 1 and m >> 40 & 1 for m in masks)


def test_whole_table_as_brute_force(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: brute_fingerprint(r.text) for r in df.collect()}
    got = S.simhash_dedup(df).collect()
    assert {r.doc_id: int(r.fingerprint, 16) for r in got} == texts
    assert sorted((False, r.doc_id, int(r.fingerprint, 16), r.component_id) for r in got) == brute_classes(list(texts.items()), 2)


def test_empty_table(spark):
    df = spark.createDataFrame([], "doc_id long, text string, rep string")
    assert S.simhash_dedup(df).count() == 0


def test_rows_without_an_id_link_others(spark):
    rows = [(5, 0b0), (None, 0b11), (3, 0b1111), (None, 1 << 40), (None, 0b111 << 40), (9, (1 << 63) - (1 << 50))]
    got = S.near_duplicate_classes(spark.createDataFrame(rows, "doc_id long, fingerprint long"), 2).collect()
    want = {0b0: 3, 0b11: 3, 0b1111: 3, 1 << 40: 3, 0b111 << 40: 3, rows[5][1]: 9}
    assert {r.fingerprint: r.component_id for r in got} == want
