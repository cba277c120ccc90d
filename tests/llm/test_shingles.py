import numpy as np

from graphloom import session
from graphloom.llm import shingles, simhash, stages


def brute_set(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_kept(rows):
    """Rows that stay: the smallest id (null last) of each class of links at similarity 0.8."""
    sets = [brute_set(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                root[find(i)] = find(j)
    best = {}
    for i, (d, _) in enumerate(rows):
        best[find(i)] = min(best.get(find(i), (True, 0)), (d is None, d or 0))
    return sorted(best.values())


def varied(seed):
    """Texts with words replaced in, so that many pairs are on both sides of 0.8."""
    rng = np.random.default_rng(seed)
    texts = []
    for n in (3, 12, 60, 150, 400):
        base = [f"w{x}" for x in rng.integers(0, 500, n)]
        for _ in range(24):
            new = list(base)
            for at in rng.integers(0, n, int(rng.integers(0, 1 + n // 15))):
                new[at] = f"x{rng.integers(0, 10**6)}"
            texts.append(" ".join(new))
    return texts


def kept(rows, spark):
    df = spark.createDataFrame(rows, "doc_id long, text string")
    return sorted((r.doc_id is None, r.doc_id or 0) for r in stages.near_duplicates(spark, df, "").collect())


def test_stage_as_brute_force_at_five_words_and_four_fifths(spark):
    rows = list(enumerate(varied(1)))
    want = brute_kept(rows)
    assert 10 < len(want) < 100 and kept(rows, spark) == want


def test_rows_without_an_id_link_others(spark):
    w = [f"w{i}" for i in range(100)]
    a, b, c = w, [*w[:95], *"abcde"], [*"vwxyz", *w[5:95], *"abcde"]
    a, b, c = (" ".join([*x, *w]) for x in (a, b, c))
    rows = [(1, a), (None, b), (2, c), (None, "lone text"), (None, None), (5, " ")]
    assert kept(rows, spark) == brute_kept(rows)


def test_large_table_as_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert kept(rows, spark) == brute_kept(rows)


def test_no_pair_at_the_bound_is_without_a_key():
    rng = np.random.default_rng(2)
    for n in (9, 90, 900):
        for _ in range(20):
            both = rng.integers(0, 1 << 63, n, np.uint64)
            assert set(shingles.band_keys(both)) & set(shingles.band_keys(both[: -(n // 5)]))


def test_clusters_in_blocks_as_brute_force(spark, monkeypatch):
    rows = list(enumerate(varied(3)))
    want = brute_kept(rows)
    monkeypatch.setattr(shingles, "BLOCK", 5)
    monkeypatch.setattr(shingles, "BATCH", 300)
    assert kept(rows, spark) == want


def test_counts_of_shared_keys():
    rng = np.random.default_rng(6)
    keys = [np.unique(rng.integers(0, 20_000, int(n)).astype(np.uint32)) for n in rng.integers(0, 3000, 40)] + [np.zeros(0, np.uint32)]
    want = [[len(np.intersect1d(a, b)) for b in keys] for a in keys[7:19]]
    got = shingles._shared_counts(keys, 7, 19)
    assert all(got[i, j] == want[i][j] for i in range(12) for j in range(41) if j != i + 7)


def test_fingerprints_find_near_texts_by_themselves(spark, monkeypatch):
    rng = np.random.default_rng(9)
    base = [[f"w{x}" for x in rng.integers(0, 10**6, 400)] for _ in range(6)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)] + [(10 + i, " ".join([*w[:-2], "y", "z"])) for i, w in enumerate(base)]
    prefixes = shingles.prefixes
    monkeypatch.setattr(shingles, "prefixes", lambda sets: prefixes(sets).limit(0))
    assert kept(rows, spark) == brute_kept(rows) and len(brute_kept(rows)) == 6


def test_groups_of_fingerprints_as_brute_force(spark):
    prints = [simhash.majority(shingles.shingle_set(t.encode())) for t in varied(4)]
    root = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 6 and root[i] != root[j]:
                root = [root[j] if r == root[i] else r for r in root]
    nodes = spark.createDataFrame(list(enumerate(np.array(prints, np.uint64).view(np.int64).tolist())), "node long, fingerprint long")
    got = {r.node: r.cluster for r in shingles.fingerprint_groups(nodes, shingles.NEAR_BITS).collect()}
    assert len(set(root)) < len(set(prints)) and len(got) == len(prints)
    assert all((got[i] == got[j]) == (root[i] == root[j]) for i in got for j in got)


def test_the_driver_lets_go_of_finished_steps(spark):
    full = lambda: sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Young" not in b.getName() and "Concurrent" not in b.getName())
    rows = list(enumerate(varied(1)[:40]))
    before = full()
    assert kept(rows, spark) == brute_kept(rows)
    assert full() - before >= 4


def test_last_links_join_classes_not_nodes(spark, monkeypatch):
    counts, components = [], shingles.connected_components

    def counted(edges, **how):
        counts.append(edges.count())
        return components(edges, **how)

    monkeypatch.setattr(shingles, "connected_components", counted)
    rows = list(enumerate(varied(1)))
    assert kept(rows, spark) == brute_kept(rows)
    assert len(counts) == 4 and counts[-1] < counts[1]


def test_classes_joined_by_further_links(spark):
    classes = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (5, 2), (3, 3), (9, 3)], "node long, component long")
    links = spark.createDataFrame([(4, 1), (5, 7), (7, 9), (11, 10)], "src long, dst long")
    got = sorted(map(tuple, shingles._joined(classes, links).collect()))
    assert got == [(1, 1), (2, 2), (3, 2), (4, 1), (5, 2), (7, 2), (9, 2), (10, 10), (11, 10)]


def test_a_release_returns_the_heap_and_leaves_the_setting(spark):
    beans = spark._jvm.java.lang.management.ManagementFactory
    flags = beans.getPlatformMXBean(spark._jvm.java.lang.Class.forName("com.sun.management.HotSpotDiagnosticMXBean"))
    before = flags.getVMOption("MaxHeapFreeRatio").getValue()
    session.release(spark)
    heap = beans.getMemoryMXBean().getHeapMemoryUsage()
    assert heap.getCommitted() < 2 * heap.getUsed() + (32 << 20)
    assert flags.getVMOption("MaxHeapFreeRatio").getValue() == before
