"""Near-duplicates by SimHash, found with the generalised pigeonhole principle.

A fingerprint has a bit for each bit of a shingle's hash that is set in over half of them. Equal fingerprints are one
class from the start. For the others, the 64 bits are cut into partitions, correlated bits together, so that what one
partition has already matched is not matched again by the next; each partition gets a threshold of its own, and if the
thresholds sum to bound - partitions + 1, two fingerprints within the bound are within the threshold in at least one
partition. The allocation is found by dynamic programming over the number of candidates that each threshold would give,
estimated from counts over all fingerprints. Fingerprints are posted under their bits in each partition, probe all keys
within the threshold, and candidates are verified on all 64 bits.

A posting with more than `most` fingerprints is split by the same principle on its other bits, again and again until
no bit is left, so no link is lost and no task compares an unbounded group. Of the links in a posting, those that join
its classes are passed on, one for each fingerprint.

Edge cases: a null text is empty; a text without words has fingerprint zero, which is linked like any other; fewer words
than a shingle give one shingle; repeated rows are copies; rows with a null doc_id take part in links, and get
their class if any row of it has an id, else null; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphloom.operators.components import connected_components
from graphloom.session import materialize

BITS = 64
ONE = np.uint64(1)


# --- fingerprints


def majority(hashes: np.ndarray) -> int:
    """The bits that are set in over half of the hashes; none of no hashes."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<u8")[0])


def fingerprint(text: bytes, shingle: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles; A-Z count as a-z."""
    words = text.lower().split()  # on bytes, both know ASCII alone
    if not words:
        return 0
    line = b" ".join(words)
    n = max(1, len(words) - shingle + 1)
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(sizes + 1) - 1
    starts = ends - sizes
    last = ends[min(shingle, len(words)) - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in zip(starts[:n].tolist(), last, strict=True)), np.uint64, n)
    return majority(hashes)


def _fingerprints(batches: Iterable[pa.RecordBatch], shingle: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint((x.as_py() or b""), shingle, seed) for x in batch["text"]]
        yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["content"], pa.array(np.array(found, np.uint64).view(np.int64))], names=["doc_id", "content", "fingerprint"])


def fingerprints(docs: DataFrame, shingle: int = 3, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, content (a hash of the text), fingerprint (as a signed long) of every row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("content"), F.col(text).cast("binary").alias("text"))
    return rows.mapInArrow(lambda b: _fingerprints(b, shingle, seed), "doc_id long, content long, fingerprint long")


# --- partitions and thresholds


def _gram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    both = np.zeros((BITS, BITS))
    for batch in batches:
        values = batch["fingerprint"].to_numpy(zero_copy_only=False).astype("<i8")
        for at in range(0, len(values), 1 << 16):
            bits = np.unpackbits(np.ascontiguousarray(values[at : at + (1 << 16)]).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += bits.T @ bits
    cells = np.arange(BITS * BITS)
    yield pa.RecordBatch.from_arrays([pa.array(cells), pa.array(both.ravel())], names=["cell", "n"])


def bit_statistics(distinct: DataFrame) -> tuple[int, np.ndarray]:
    """Number of fingerprints, and for each two bits how many have both set (64 x 64, whatever the number)."""
    cells = distinct.mapInArrow(_gram, "cell long, n double").groupBy("cell").agg(F.sum("n").alias("n")).collect()
    both = np.zeros(BITS * BITS)
    for cell, n in cells:
        both[cell] = n
    return distinct.count(), both.reshape(BITS, BITS)


def group_bits(n: int, both: np.ndarray, parts: int) -> list[int]:
    """Masks of `parts` partitions of near-equal size, the most correlated bits together first."""
    share = np.diag(both) / max(n, 1)
    cover = both / max(n, 1) - np.outer(share, share)
    spread = np.sqrt(np.maximum(np.outer(np.diag(cover), np.diag(cover)), 1e-12))
    strength = np.triu(np.abs(cover / spread), 1)
    room = -(-BITS // parts)
    group = {i: [i] for i in range(BITS)}
    for cell in np.argsort(-strength, axis=None, kind="stable")[: BITS * (BITS - 1) // 2]:
        i, j = divmod(int(cell), BITS)
        if group[i] is not group[j] and len(group[i]) + len(group[j]) <= room // 2:
            joined = group[i] + group[j]
            for k in joined:
                group[k] = joined
    bins: list[list[int]] = [[] for _ in range(parts)]
    for bits in sorted({id(g): g for g in group.values()}.values(), key=lambda g: (-len(g), min(g))):
        for bit in bits:  # a group that no bin has room for is cut
            fits = [b for b in bins if len(b) < room]
            at = next((b for b in fits if b and b[-1] in bits), min(fits, key=len))
            at.append(bit)
    return [sum(1 << b for b in bits) for bits in bins]


def within(share: np.ndarray, most: int) -> np.ndarray:
    """Chance that two fingerprints differ in at most 0, 1, ... most of some bits, if the bits were independent."""
    chance = np.array([1.0])
    for p in share:
        chance = np.convolve(chance, [1 - 2 * p * (1 - p), 2 * p * (1 - p)])[: most + 1]
    return np.cumsum(np.pad(chance, (0, most + 1 - len(chance))))


def allocate(costs: list[list[float]], bound: int) -> tuple[float, list[int]]:
    """Thresholds from -1 (never probed) to the bound, of sum bound - partitions + 1, of the lowest total cost.

    costs: for each partition, the cost of threshold 0, 1, ... bound.
    """
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for cost in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for total, (paid, chosen) in best.items():
            for t in range(-1, bound + 1):
                now = (paid + (cost[t] if t >= 0 else 0.0), [*chosen, t])
                if total + t not in step or now < step[total + t]:
                    step[total + t] = now
        best = step
    return best[bound - len(costs) + 1]


def plan_probes(distinct: DataFrame, bound: int) -> list[tuple[int, int]]:
    """(mask, threshold) of each partition that is probed."""
    n, both = bit_statistics(distinct)
    share = np.diag(both) / max(n, 1)
    plans = {m: group_bits(n, both, m) for m in range(1 + (bound > 0), bound + 2)}
    cells = F.explode(F.array(*[F.struct(F.lit(m).alias("m"), F.lit(i).alias("i"), F.col("fingerprint").bitwiseAND(F.lit(_signed(mask))).alias("key")) for m, masks in plans.items() for i, mask in enumerate(masks)]))
    sizes = distinct.select(cells.alias("c")).groupBy("c.m", "c.i", "c.key").agg(F.count("*").alias("n")).groupBy("m", "i").agg(F.sum(F.col("n").cast("double") * F.col("n")).alias("pairs"))
    pairs = {(m, i): p for m, i, p in sizes.collect()}
    found = []
    for m, masks in plans.items():
        costs = []
        for i, mask in enumerate(masks):
            bits = [b for b in range(BITS) if mask >> b & 1]
            near = within(share[bits], bound)
            keys = np.cumsum([float(np.prod([(len(bits) - k) / (k + 1) for k in range(t)])) for t in range(bound + 1)])
            costs.append([pairs.get((m, i), 0.0) * near[t] / max(near[0], 1e-300) + n * keys[t] for t in range(bound + 1)])
        paid, chosen = allocate(costs, bound)
        found.append((paid, m, [(mask, t) for mask, t in zip(masks, chosen, strict=True) if t >= 0]))
    return min(found)[2]


# --- posting, probing and verifying


def _signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def flips(mask: int, most: int) -> list[int]:
    """Every change of at most `most` bits of the mask."""
    found = {0}
    for _ in range(most):
        found |= {f ^ (1 << b) for f in found for b in range(BITS) if mask >> b & 1}
    return sorted(f for f in found if f.bit_count() <= most)


def linked(values: np.ndarray, own: np.ndarray, bound: int) -> list[tuple[int, int]]:
    """(place of the first, place) for each value that a path of links in this posting joins to an earlier one."""
    near = (np.bitwise_count(values[:, None] ^ values[None, :]) <= bound) & (own[:, None] | own[None, :])
    left, out = np.ones(len(values), bool), []
    for first in range(len(values)):
        if not left[first]:
            continue
        left[first] = False
        edge = np.array([first])
        while len(edge):
            edge = np.flatnonzero(near[edge].any(0) & left)
            left[edge] = False
            out += [(first, int(k)) for k in edge]
    return out


def _verify(batches: Iterable[pa.RecordBatch], bound: int) -> Iterator[pa.RecordBatch]:
    """Links in each posting; rows come sorted by path and key."""
    held: dict[str, np.ndarray] | None = None
    names = ("path", "key", "fingerprint", "rep", "own")

    def links(rows: dict[str, np.ndarray], ends: np.ndarray) -> pa.RecordBatch:
        values, reps = rows["fingerprint"].view(np.uint64), rows["rep"]
        starts = np.concatenate([[0], ends[:-1]])
        twos = starts[ends - starts == 2]
        good = twos[(np.bitwise_count(values[twos] ^ values[twos + 1]) <= bound) & (rows["own"][twos] | rows["own"][twos + 1])]
        pairs = [(reps[good], reps[good + 1])]
        for a, b in zip(starts[ends - starts > 2].tolist(), ends[ends - starts > 2].tolist(), strict=True):
            if found := linked(values[a:b], rows["own"][a:b], bound):
                at = np.array(found) + a
                pairs.append((reps[at[:, 0]], reps[at[:, 1]]))
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in pairs])) for k in (0, 1)], names=["src", "dst"])

    for batch in batches:
        rows = {c: batch[c].to_numpy(zero_copy_only=False) for c in names}
        if held is not None:
            rows = {c: np.concatenate([held[c], rows[c]]) for c in names}
        if not len(rows["key"]):
            continue
        ends = np.flatnonzero((rows["key"][1:] != rows["key"][:-1]) | (rows["path"][1:] != rows["path"][:-1])) + 1
        if len(ends):
            yield links({c: rows[c][: ends[-1]] for c in names}, ends)
        cut = ends[-1] if len(ends) else 0
        held = {c: rows[c][cut:] for c in names}
    if held is not None and len(held["key"]):
        yield links(held, np.array([len(held["key"])]))


def posting_links(distinct: DataFrame, probes: list[tuple[int, int]], bound: int, most: int = 1024, read: list[DataFrame] | None = None) -> DataFrame:
    """src, dst: links between the reps of fingerprints within the bound, enough to join each class.

    distinct: fingerprint, rep. most: fingerprints of a posting that are compared with each other; larger postings are
    split by further bits. read: gets the tables that the links are made of, to be discarded once they are written.
    """
    read = [] if read is None else read
    paths = {p: mask for p, (mask, _) in enumerate(probes)}
    post = F.explode(
        F.array(*[F.struct(F.lit(p).cast("long").alias("path"), F.lit(_signed(f)).alias("flip")) for p, (mask, t) in enumerate(probes) for f in flips(mask, t)])
    )
    masked = lambda: F.col("fingerprint").bitwiseXOR(F.col("flip")).bitwiseAND(F.col("mask"))
    mask_of = lambda: F.create_map(*[F.lit(x).cast("long") for p, m in paths.items() for x in (p, _signed(m))])[F.col("path")]
    rows = distinct.select("fingerprint", "rep", post.alias("at")).select("fingerprint", "rep", "at.*")
    rows = materialize(rows.withColumn("mask", mask_of()).withColumn("key", masked()), "postings")
    found = []
    while True:
        counts = rows.groupBy("path", "key").agg(F.count("*").alias("n")).filter("n > 1")
        counts = materialize(counts, "posting-counts")
        read += [rows, counts]
        few = rows.join(counts.filter(F.col("n") <= most).select("path", "key"), ["path", "key"], "left_semi")
        few = few.select("path", "key", "fingerprint", "rep", (F.col("flip") == 0).alias("own"))
        few = few.repartition("path", "key").sortWithinPartitions("path", "key")
        found.append(few.mapInArrow(lambda b: _verify(b, bound), "src long, dst long"))
        many = counts.filter(F.col("n") > most).select("path", "key")
        if many.isEmpty():
            break
        children = {}
        for p, mask in paths.items():
            rest = [b for b in range(BITS) if not mask >> b & 1]
            for k in range(bound + 1):
                children[p * (bound + 1) + k + len(probes)] = mask | sum(1 << b for b in rest[k :: bound + 1])
        split = F.explode(F.sequence(F.lit(0), F.lit(bound)))
        rows = rows.join(many, ["path", "key"], "left_semi").withColumn("part", split)
        rows = rows.withColumn("path", F.col("path") * (bound + 1) + F.col("part") + len(probes)).drop("part", "mask", "key")
        paths = children
        rows = materialize(rows.withColumn("mask", mask_of()).withColumn("key", masked()), "postings")
    links = found[0]
    for more in found[1:]:
        links = links.unionByName(more)
    return links


def near_duplicate_classes(marks: DataFrame, bound: int = 2, most: int = 1024) -> DataFrame:
    """marks (any columns with doc_id and fingerprint) with component_id: the smallest doc_id reachable by links."""
    return _classed(marks, bound, most).drop("class_")


def _classed(marks: DataFrame, bound: int, most: int = 1024) -> DataFrame:
    """near_duplicate_classes with class_, a fingerprint of the class, for classes that no id names."""
    distinct = materialize(marks.groupBy("fingerprint").agg(F.min("doc_id").alias("least")), "fingerprints")
    nodes = distinct.select("fingerprint", F.col("fingerprint").alias("rep"))
    links = materialize(posting_links(nodes, plan_probes(nodes, bound), bound, most), "near-links")
    classes = connected_components(links).select(F.col("node").alias("fingerprint"), "component")
    named = distinct.join(classes, "fingerprint", "left").withColumn("class_", F.coalesce("component", "fingerprint"))
    named = materialize(named.select("fingerprint", "class_", "least"), "named")
    ids = named.groupBy("class_").agg(F.min("least").alias("component_id"))
    return marks.join(named.drop("least").join(ids, "class_").select("fingerprint", "class_", "component_id"), "fingerprint")


def simhash_dedup(docs: DataFrame, shingle: int = 3, bound: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row."""
    marks = materialize(fingerprints(docs, shingle, seed, doc_id, text), "marks")
    classes = near_duplicate_classes(marks, bound)
    return classes.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, shingle: int = 3, bound: int = 2, seed: int = 42, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each class with its own columns: that with the smallest id; of rows equal in id and text, any one."""
    marks = materialize(fingerprints(docs, shingle, seed, doc_id, text), "marks")
    classes = _classed(marks, bound)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "content")).alias("first")
    kept = classes.groupBy("class_").agg(first).select("first.doc_id", "first.content")
    return only(docs, kept, doc_id, text)


def only(docs: DataFrame, kept: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that kept (doc_id, content) names, one of those equal in both."""
    kept = kept.alias("k")
    rows = docs.select(F.struct("*").alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.xxhash64(text).alias("content")).alias("r")
    found = rows.join(kept, F.col("r.doc_id").eqNullSafe(F.col("k.doc_id")) & (F.col("r.content") == F.col("k.content"))).select("row", "r.doc_id", "r.content")
    place = F.row_number().over(Window.partitionBy("doc_id", "content").orderBy(F.lit(0)))
    return found.withColumn("place", place).filter("place = 1").select("row.*")
