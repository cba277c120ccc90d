"""Near-duplicates by SimHash, verified by the exact Jaccard similarity of word shingles, and an exact way for the rest.

Two texts are linked if their sets of five-word shingles have a Jaccard similarity of 0.8 or more, and links are closed
to classes. A shingle is the 64-bit hash of its words; A-Z count as a-z.

Every text with a word has the fingerprint of its set, and fingerprints within `NEAR_BITS` bits are found as op6 finds
its own: by the generalised pigeonhole principle with thresholds by dynamic programming. The texts that a path of such
fingerprints joins are a group, and all pairs of a group are verified on their whole sets.

A pair at 0.8 may be further apart than any radius that can be probed, so pairs of different groups have a way of their
own. Which texts can have a partner at all is told by MinHash: `BANDS` keys for each text, each of `ROWS` minima. Two texts
of similarity s share no key with chance (1 - s ** ROWS) ** BANDS, which is 5e-8 at 0.8 and less above. Among those that
share a key with another, candidates come from prefixes, without loss: shingles are put in the order of how many of these
texts have them, the rarest first. Sets of n shingles at 0.8 or more share one of the first n - ceil(4n/5) + 1 of the
larger and the first n - ceil(8n/9) + 1 of the smaller. So copies that differ in more than that part of their shingles
meet nobody, however many of them there are. Every link is verified on the two whole sets, in which a shingle is 32 bits
of its hash: two different shingles count as one with chance 2.3e-10.

Documents may come with the texts that they had before an earlier stage changed them. Then two documents are also
linked if those texts are within the bound, or one's with the other's present text: what line dedup leaves of a copy no
longer resembles the whole. A former text counts for an id that names one document and one former text.

Texts of equal sets are one node from the start. In each posting of a shingle all nodes are first compared with one of
them, but for those of its group. What is then left in postings of more than one class is put together in clusters. Each
group and each cluster is counted out at once: a task holds the sets of at most two blocks of it, counts what every two share by a matrix product, and passes
on one link for each node at most. So every candidate is verified or already of one class, a large group of copies costs
a comparison for each of them, and pairs are never rows.

Edge cases: a null text is empty; texts without words are one node, linked to no other; fewer words than a shingle give
one shingle; repeated rows are copies; rows without an id take part in links, and the smallest id of a class names it.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.session import discard, materialize, release

from .simhash import majority, only, plan_probes, posting_links

SHINGLE = 5
#: Bits in which the fingerprints of two texts differ at most that are found by probing.
NEAR_BITS = 6
BANDS, ROWS = 32, 4
#: Shingles that a batch of sets, and a bucket of keys, holds about.
BATCH, BUCKET = 1 << 20, 1 << 22
#: Sets, and shingles, that a block of a cluster holds about.
BLOCK, BLOCK_KEYS = 1024, 1 << 20
_FACTORS = np.random.default_rng(42).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) << np.uint64(1) | np.uint64(1)
_SHIFTS = np.random.default_rng(43).integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def shingle_set(text: bytes, shingle: int = SHINGLE) -> np.ndarray:
    """Sorted different hashes of a text's word shingles."""
    words = text.lower().split()  # on bytes, both know ASCII alone
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])[: max(1, len(words) - shingle + 1)]
    last = ends[min(shingle, len(words)) - 1 :]
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(line[a:b]) for a, b in zip(starts.tolist(), last.tolist(), strict=True)), np.uint64, len(starts)))


def band_keys(hashes: np.ndarray) -> list[int]:
    """A signed key for each band of minima; none for an empty set."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 2048):
        np.minimum(least, (hashes[None, at : at + 2048] * _FACTORS + _SHIFTS).min(1), out=least)
    bands = least.astype("<u8").reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(b.tobytes(), k) for k, b in enumerate(bands)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def _marks(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        nodes, sizes, prints, keys = [], [], [], []
        for x in batch["text"]:
            found = shingle_set(x.as_py() or b"")
            prints.append(majority(found))
            nodes.append(xxhash.xxh64_intdigest(found.astype("<u8").tobytes()))
            sizes.append(len(found))
            keys.append(band_keys(found))
        signed = lambda x: pa.array(np.array(x, np.uint64).view(np.int64))
        columns = [batch["doc_id"], batch["content"], signed(nodes), pa.array(sizes, pa.int64()), signed(prints), pa.array(keys, pa.list_(pa.int64()))]
        yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "content", "node", "n", "fingerprint", "keys"])


def shingle_keys(text: bytes) -> np.ndarray:
    """Sorted different 32-bit keys of a text's shingles."""
    return np.unique((shingle_set(text) >> np.uint64(32)).astype(np.uint32))


def _sets(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sets in batches of their own, which are named by the task and their number."""
    first, held, size = TaskContext.get().partitionId() << 32, [], 0

    def flush() -> pa.RecordBatch:
        nonlocal first, held, size
        nodes, keys = zip(*held, strict=True)
        columns = [pa.array([first] * len(held), pa.int64()), pa.array(range(len(held)), pa.int32()), pa.array(nodes, pa.int64()), pa.array([len(k) for k in keys], pa.int32()), pa.array([k.tobytes() for k in keys], pa.binary())]
        first, held, size = first + 1, [], 0
        return pa.RecordBatch.from_arrays(columns, names=["batch", "row", "node", "n", "keys"])

    for batch in batches:
        for node, text in zip(batch["node"].to_pylist(), batch["text"], strict=True):
            held.append((node, shingle_keys(text.as_py() or b"")))
            size += len(held[-1][1])
            if size >= BATCH or len(held) == 1 << 16:
                yield flush()
    if held:
        yield flush()


def _entries(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Number of each batch of sets, and the keys in it with their rows."""
    for batch in batches:
        numbers, rows = batch["batch"].to_numpy(), batch["row"].to_numpy()
        for number in np.unique(numbers).tolist():
            at = np.flatnonzero(numbers == number)
            keys = [np.frombuffer(batch["keys"][i].as_py(), np.uint32) for i in at.tolist()]
            yield number, np.concatenate(keys), np.repeat(rows[at], [len(k) for k in keys]).astype(np.uint16)


def _dealt(batches: Iterable[pa.RecordBatch], hot: np.ndarray, buckets: int) -> Iterator[pa.RecordBatch]:
    """bucket, batch, keys, rows: the keys that are not hot, by bucket."""
    for number, keys, rows in _entries(batches):
        cold = ~np.isin(keys, hot, kind="sort")
        keys, rows = keys[cold], rows[cold]
        bucket = keys % buckets
        order = np.argsort(bucket, kind="stable")
        keys, rows, bucket = keys[order], rows[order], bucket[order]
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        parts = list(zip(np.split(keys, cuts), np.split(rows, cuts), strict=True)) if len(keys) else []
        columns = [pa.array([int(k[0] % buckets) for k, _ in parts], pa.int64()), pa.array([number] * len(parts), pa.int64()), pa.array([k.tobytes() for k, _ in parts], pa.binary()), pa.array([r.tobytes() for _, r in parts], pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["bucket", "batch", "keys", "rows"])


def _hot_entries(batches: Iterable[pa.RecordBatch], hot: np.ndarray) -> Iterator[pa.RecordBatch]:
    for number, keys, rows in _entries(batches):
        warm = np.isin(keys, hot, kind="sort")
        yield _packed([number], [keys[warm]], [rows[warm]], [np.full(int(warm.sum()), 65_535, np.uint16)])


def _packed(numbers: list[int], keys: list[np.ndarray], rows: list[np.ndarray], counts: list[np.ndarray]) -> pa.RecordBatch:
    columns = [pa.array(numbers, pa.int64()), *(pa.array([x.tobytes() for x in part], pa.binary()) for part in (keys, rows, counts))]
    return pa.RecordBatch.from_arrays(columns, names=["batch", "keys", "rows", "counts"])


def _counted(table: pa.Table) -> pa.Table:
    """batch, keys, rows, counts of the keys of one bucket that several sets have; counts are cut at 65,534."""
    keys = [np.frombuffer(k.as_py(), np.uint32) for k in table["keys"]]
    sizes = [len(k) for k in keys]
    keys = np.concatenate(keys)
    rows = np.concatenate([np.frombuffer(r.as_py(), np.uint16) for r in table["rows"]])
    batch = np.repeat(table["batch"].to_numpy(), sizes)
    _, place, counts = np.unique(keys, return_inverse=True, return_counts=True)
    counts = np.minimum(counts, 65_534).astype(np.uint16)[place]
    several = np.flatnonzero(counts > 1)
    several = several[np.argsort(batch[several], kind="stable")]
    cuts = np.flatnonzero(np.diff(batch[several])) + 1
    parts = np.split(several, cuts) if len(several) else []
    return pa.Table.from_batches([_packed([int(batch[p[0]]) for p in parts], [keys[p] for p in parts], [rows[p] for p in parts], [counts[p] for p in parts])])


def _prefixes(entries: pa.Table, sets: pa.Table) -> pa.Table:
    """key, node, n, short of one batch of sets."""
    flat = lambda name, kind: np.concatenate([np.frombuffer(x.as_py(), kind) for x in entries[name]] or [np.zeros(0, kind)])
    keys, rows, counts = flat("keys", np.uint32), flat("rows", np.uint16), flat("counts", np.uint16)
    node, n = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64)
    at = sets["row"].to_numpy()
    node[at], n[at] = sets["node"].to_numpy(), sets["n"].to_numpy()
    order = np.lexsort((keys, counts, rows))
    keys, rows = keys[order], rows[order].astype(np.int64)
    shared = np.bincount(rows, minlength=1 << 16)
    place = np.arange(len(rows)) - (np.cumsum(shared) - shared)[rows]
    alone = n - shared
    long, short = n - -(-4 * n // 5) + 1 - alone, n - -(-8 * n // 9) + 1 - alone
    held = place < long[rows]
    keys, rows, place = keys[held], rows[held], place[held]
    return pa.table({"key": pa.array(keys.view(np.int32)), "node": pa.array(node[rows]), "n": pa.array(n[rows].astype(np.int32)), "short": pa.array(place < short[rows])})


def _alike_enough(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        good = []
        for a, b in zip(batch["a"], batch["b"], strict=True):
            a, b = np.frombuffer(a.as_py(), np.uint32), np.frombuffer(b.as_py(), np.uint32)
            good.append(9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)))
        yield pa.RecordBatch.from_arrays([batch["src"], batch["dst"]], names=["src", "dst"]).filter(pa.array(good, pa.bool_()))


def _shared_counts(keys: list[np.ndarray], first: int, last: int) -> np.ndarray:
    """How many keys the sets from first to last share with each set."""
    flat, owner = np.concatenate(keys), np.repeat(np.arange(len(keys), dtype=np.int32), [len(k) for k in keys])
    _, place, counts = np.unique(flat, return_inverse=True, return_counts=True)
    several = counts > 1
    column = (np.cumsum(several) - 1)[place]
    held = several[place]
    owner, column, width = owner[held], column[held], int(several.sum())
    some = (owner >= first) & (owner < last)
    out = np.zeros((last - first, len(keys)), np.float32)
    order = np.argsort(column, kind="stable")
    owner, column, some = owner[order], column[order], some[order]
    for at in range(0, width, 4096):  # as many columns at a time
        a, b = np.searchsorted(column, [at, at + 4096])
        here, there = owner[a:b], column[a:b] - at
        mine = some[a:b]
        rows, where = np.unique(here, return_inverse=True)
        dense = np.zeros((len(rows), min(4096, width - at)), np.float32)
        dense[where, there] = 1
        left = np.flatnonzero(np.isin(rows, np.unique(here[mine])))
        if len(left):
            out[np.ix_(rows[left] - first, rows)] += dense[left] @ dense.T
    return out


def _counted_out(table: pa.Table) -> pa.Table:
    """src, dst: a link for each node of a block, or two, that a path of links joins to an earlier one."""
    table = table.sort_by("node")
    nodes, size = table["node"].to_numpy(), table["n"].to_numpy().astype(np.int64)
    keys = [np.frombuffer(k.as_py(), np.uint32) for k in table["keys"]]
    near = np.zeros((len(nodes), len(nodes)), bool)
    for at in range(0, len(nodes), 512):
        end = min(at + 512, len(nodes))
        near[at:end] = 9 * _shared_counts(keys, at, end) >= 4 * (size[at:end, None] + size[None, :])
    left, src, dst = np.ones(len(nodes), bool), [], []
    for first in range(len(nodes)):
        if not left[first]:
            continue
        left[first] = False
        edge = np.array([first])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(0) & left)
            left[edge] = False
            src += [nodes[first]] * len(edge)
            dst += nodes[edge].tolist()
    return pa.table({"src": pa.array(src, pa.int64()), "dst": pa.array(dst, pa.int64())})


def fingerprint_groups(nodes: DataFrame, bound: int) -> DataFrame:
    """node, cluster of nodes (node, fingerprint): one cluster for fingerprints that a path of links within the bound joins."""
    distinct = materialize(nodes.select("fingerprint").distinct(), "fingerprints").select("fingerprint", F.col("fingerprint").alias("rep"))
    read = []
    links = materialize(posting_links(distinct, plan_probes(distinct, bound), bound, read=read), "fingerprint-links")
    for done in read:
        discard(done)
    release(nodes.sparkSession)
    classes = connected_components(links, tidy=True).select(F.col("node").alias("fingerprint"), "component")
    return nodes.join(classes, "fingerprint", "left").select("node", F.coalesce("component", "fingerprint").alias("cluster"))


def _cluster_links(left: DataFrame, sets: DataFrame) -> DataFrame:
    """src, dst: links between the nodes of postings (key, node), enough to join their classes."""
    least = left.groupBy("key").agg(F.min("node").alias("least"))
    clusters = connected_components(left.join(least, "key").select(F.col("least").alias("src"), F.col("node").alias("dst")).distinct(), tidy=True)
    release(left.sparkSession)
    return _links_within(materialize(clusters.select("node", F.col("component").alias("cluster")), "clusters"), sets)


def _links_within(clusters: DataFrame, sets: DataFrame) -> DataFrame:
    """src, dst: links between the nodes of each cluster (node, cluster), enough to join their classes."""
    held = clusters.join(sets.select("node", "n"), "node")
    blocks = F.ceil(F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_KEYS)).cast("int")
    sizes = held.groupBy("cluster").agg(blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = clusters.join(sizes, "cluster").withColumn("own", own).withColumn("other", other)
    dealt = dealt.select("node", "cluster", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return dealt.join(sets.select("node", "n", "keys"), "node").groupBy("cluster", "i", "j").applyInArrow(_counted_out, "src long, dst long")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).cast("binary").alias("text"))


def _sets_of(nodes: DataFrame, texts: DataFrame) -> DataFrame:
    """batch, row, node, n, keys of nodes (node, doc_id, content)."""
    mark = F.xxhash64(F.col("doc_id").isNull(), "doc_id", "content").alias("mark")
    # rows that share a mark, and so a text, are neighbours once they are joined
    found = texts.select(mark, "text").join(nodes.select(mark, "node"), "mark").dropDuplicates(["mark"]).select("node", "text")
    return materialize(found.mapInArrow(_sets, "batch long, row int, node long, n int, keys binary"), "shingle-sets")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """src, dst: the pairs of nodes of similarity 0.8 or more: nine times what they share is four times both or more."""
    of = lambda end, keys: sets.select(F.col("node").alias(end), F.col("keys").alias(keys)).join(pairs.select(end).distinct(), end, "left_semi")
    both = pairs.join(of("dst", "b"), "dst").join(of("src", "a"), "src")
    return both.select("src", "dst", "a", "b").mapInArrow(_alike_enough, "src long, dst long")


def hot_keys(sets: DataFrame, sample: int = 4000, share: float = 0.002) -> np.ndarray:
    """Sorted keys that so large a share (at least 8) of a sample of the sets has: a bounded number of them.

    sample: sets that come to the driver, those with the smallest hashes, of at most 50,000 shingles.
    """
    some = sets.filter("n <= 50000").select("node").orderBy(F.xxhash64("node")).limit(sample)
    drawn = sets.join(F.broadcast(some), "node", "left_semi").select("keys").toArrow()["keys"]
    keys, counts = np.unique(np.concatenate([np.frombuffer(k.as_py(), np.uint32) for k in drawn] or [np.zeros(0, np.uint32)]), return_counts=True)
    return keys[counts >= max(8, share * len(drawn))]


def prefixes(sets: DataFrame) -> DataFrame:
    """key, node, n, short: the rarest shingles of each set, as many as it shares one of with a similar set.

    short: whether the shingle is among those by which the smaller of two sets is found. The order is by the number of
    sets that have a shingle; hot ones come last, without being counted, so that no task holds all that have one.
    Shingles of one set alone are counted, not posted. Sets travel packed, as the keys of a bucket in a batch of sets.
    """
    hot = hot_keys(sets)
    buckets = max(64, -(-(sets.agg(F.sum("n")).first()[0] or 0) // BUCKET))
    packed = "batch long, keys binary, rows binary, counts binary"
    dealt = sets.mapInArrow(lambda b: _dealt(b, hot, buckets), "bucket long, batch long, keys binary, rows binary")
    entries = dealt.groupBy("bucket").applyInArrow(_counted, packed).unionByName(sets.mapInArrow(lambda b: _hot_entries(b, hot), packed))
    return entries.groupBy("batch").cogroup(sets.select("batch", "row", "node", "n").groupBy("batch")).applyInArrow(_prefixes, "key int, node long, n int, short boolean")


def _alike(a: str, b: str) -> F.Column:
    """Whether sets of two sizes can be of similarity 0.8."""
    return 5 * F.least(a, b) >= 4 * F.greatest(a, b)


def _across(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """The pairs (src, dst) of which not both are of one group."""
    of = lambda end: groups.select(F.col("node").alias(end), F.col("cluster").alias(f"{end}_group"))
    both = pairs.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    return both.filter("not (src_group <=> dst_group) or src_group is null").select("src", "dst")


def _components(links: DataFrame) -> DataFrame:
    return materialize(connected_components(links, tidy=True).select("node", "component"), "near-classes")


def _joined(classes: DataFrame, links: DataFrame) -> DataFrame:
    """classes (node, component) closed over further links (src, dst), which are followed between classes, not nodes."""
    of = lambda end: classes.select(F.col("node").alias(end), F.col("component").alias(f"{end}_class"))
    ends = links.join(of("src"), "src", "left").join(of("dst"), "dst", "left")
    ends = ends.select(F.coalesce("src_class", "src").alias("src"), F.coalesce("dst_class", "dst").alias("dst")).filter("src != dst").distinct()
    tops = connected_components(materialize(ends, "class-links"), tidy=True)
    tops = materialize(tops.select(F.col("node").alias("component"), F.col("component").alias("top")), "class-tops")
    lone = tops.join(classes.select(F.col("node").alias("component")), "component", "left_anti")  # nodes that had no class
    named = classes.join(tops, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    return materialize(named.unionByName(lone.select(F.col("component").alias("node"), F.col("top").alias("component"))), "near-classes")


def near_classes(marks: DataFrame, texts: DataFrame, known: DataFrame | None = None, spent: DataFrame | None = None) -> DataFrame:
    """node, component of the nodes that have a link.

    texts: doc_id, content, text; known: src, dst of nodes that are one; spent: a table that nothing needs after the texts.
    """
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")).alias("first")
    nodes = marks.groupBy("node", "n", "fingerprint").agg(first).select("node", "n", "fingerprint", "first.doc_id", "first.content")
    nodes = materialize(nodes, "nodes")
    near = fingerprint_groups(nodes.filter("n > 0").select("node", "fingerprint"), NEAR_BITS)
    banded = marks.select("node", F.explode("keys").alias("band")).repartition("band")  # both sides below are dealt by it
    several = banded.groupBy("band").agg(F.min("node").alias("a"), F.max("node").alias("b")).filter("a != b").select("band")
    partnered = materialize(banded.join(several, "band", "left_semi").select("node").distinct(), "partnered")
    release(marks.sparkSession)
    sets = _sets_of(nodes.join(partnered, "node"), texts)
    if spent is not None:
        discard(spent)
    near = materialize(near.join(partnered, "node"), "fingerprint-groups")
    near = near.join(near.groupBy("cluster").agg(F.count("*").alias("n")).filter("n > 1").select("cluster"), "cluster")
    groups = materialize(near.select("node", "cluster"), "groups")
    found = materialize(_links_within(groups, sets), "group-links")
    known = found if known is None else found.unionByName(known)
    release(marks.sparkSession)
    posted = materialize(prefixes(sets), "postings")
    hubs = posted.groupBy("key").agg(F.min(F.when(F.col("short"), F.struct("node", "n"))).alias("hub"), F.count("*").alias("rows")).filter("rows > 1 and hub is not null")
    shared = posted.join(hubs, "key").select("key", "node", "n", "short", F.col("hub.node").alias("hub"), F.col("hub.n").alias("hub_n"))
    shared = materialize(shared, "shared-postings")
    discard(posted)
    release(marks.sparkSession)
    pairs = shared.filter((F.col("hub") != F.col("node")) & _alike("n", "hub_n")).select(F.col("hub").alias("src"), F.col("node").alias("dst"))
    links = _verified(materialize(_across(pairs.distinct(), groups), "hub-pairs"), sets)
    links = materialize(links.unionByName(known), "near-links")
    joined = _components(links)
    named = shared.join(joined, "node", "left").withColumn("component", F.coalesce("component", "node"))
    mixed = named.groupBy("key").agg(F.min("component").alias("a"), F.max("component").alias("b")).filter("a != b").select("key")
    left = materialize(named.filter("node != hub").join(mixed, "key").select("key", "node"), "left-postings")
    rest = materialize(_cluster_links(left, sets), "left-links")
    classes = _joined(joined, rest)
    for done in (nodes, partnered, groups, found, sets, shared, left, joined):
        discard(done)
    release(marks.sparkSession)
    return classes


def _changed(source: DataFrame, marks: DataFrame) -> DataFrame:
    """doc_id, content, text of the former texts that differ from the present ones, of ids that are unique in both."""
    alone = marks.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n"), F.min("content").alias("present")).filter("n = 1").drop("n")
    unique = source.filter("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n = 1").select("doc_id")
    return source.join(alone.join(unique, "doc_id"), "doc_id").filter("content != present").select("doc_id", "content", "text")


def keep_one(docs: DataFrame, source: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class with its own columns: that with the smallest id; of rows equal in id and text, any one.

    source: the documents with their former texts, under the same column names.
    """
    texts = _rows(docs, doc_id, text)
    schema = "doc_id long, content long, node long, n long, fingerprint long, keys array<long>"
    marks = materialize(texts.mapInArrow(_marks, schema), "marks")
    former, known, changed = marks.limit(0), None, None
    if source is not None:
        changed = materialize(_changed(_rows(source, doc_id, text), marks), "former-texts")
        former = materialize(changed.mapInArrow(_marks, schema), "former-marks")
        texts = texts.unionByName(changed)
        both = marks.alias("m").join(former.alias("f"), "doc_id").filter("m.n > 0 and f.n > 0 and m.node != f.node")
        known = both.select(F.col("m.node").alias("src"), F.col("f.node").alias("dst")).distinct()
    classes = near_classes(marks.unionByName(former), texts, known, changed)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")).alias("first")
    named = marks.select("node", "doc_id", "content").join(classes, "node", "left")
    kept = named.groupBy(F.coalesce("component", "node").alias("component")).agg(first).select("first.doc_id", "first.content")
    return only(docs, kept, doc_id, text)
