"""Byte-level BPE as a monoid: encodings of neighbours are joined in a tree.

A piece of text (a match of the splitting pattern) is cut in halves until they are short; each half is encoded, and
neighbours are joined by encoding a window around the seam anew. The window grows until what lies outside is proven
stable: a sequence of tokens is the encoding of its bytes if and only if each two neighbours in it are the encoding of
theirs, so it is enough that the new tokens agree with the tokens on either side of the window. Pieces of a text never
merge, so above them the tree is plain concatenation, as is decoding all the way up.

Edge cases: a null text is empty, and has no ids; very long pieces take memory in proportion to their length; repeated
rows get equal results; an empty table gives an empty result. Only the two named columns are read.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes up to which a piece is a leaf of the tree.
LEAF = 32
#: Different pieces whose ids a worker remembers.
REMEMBERED = 400_000


class ByteBPE:
    """Encoder and decoder for ranks: bytes of a token -> its id, which is also its priority."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, leaf: int = LEAF) -> None:
        self.ranks = ranks
        self.tokens = {i: b for b, i in ranks.items()}
        self.split: Callable[[str], list[str]] = regex.compile(pattern).findall
        self.leaf = max(1, leaf)
        self.seen: dict[str, tuple[int, ...]] = {}
        self._agree: dict[tuple[int, int], bool] = {}

    def merge(self, piece: bytes) -> list[int]:
        """The encoding of a short piece: of all neighbours that form a token, the first of the lowest rank merge."""
        ranks = self.ranks
        whole = ranks.get(piece)
        if whole is not None:
            return [whole]
        if len(piece) > 128:
            return self.merge_long(piece)
        parts = [piece[i : i + 1] for i in range(len(piece))]
        pairs = [ranks.get(piece[i : i + 2]) for i in range(len(piece) - 1)]
        while True:
            best, at = None, -1
            for i, rank in enumerate(pairs):
                if rank is not None and (best is None or rank < best):
                    best, at = rank, i
            if best is None:
                return [ranks[p] for p in parts]
            parts[at] += parts.pop(at + 1)
            pairs.pop(at)
            if at:
                pairs[at - 1] = ranks.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ranks.get(parts[at] + parts[at + 1])

    def merge_long(self, piece: bytes) -> list[int]:
        """The same for many bytes: candidates wait in a heap by rank and place, and stale ones are passed over."""
        ranks, n = self.ranks, len(piece)
        after, before, end = list(range(1, n + 1)), list(range(-1, n - 1)), list(range(1, n + 1))
        alive = [True] * n
        rank_at = [ranks.get(piece[i : i + 2]) if i + 1 < n else None for i in range(n)]
        heap = [(r, i) for i, r in enumerate(rank_at) if r is not None]
        heapify(heap)

        def look(i: int) -> None:
            j = after[i]
            rank_at[i] = ranks.get(piece[i : end[j]]) if j < n else None
            if rank_at[i] is not None:
                heappush(heap, (rank_at[i], i))

        while heap:
            rank, i = heappop(heap)
            if not alive[i] or rank_at[i] != rank:
                continue
            j = after[i]
            alive[j], end[i], after[i] = False, end[j], after[j]
            if after[j] < n:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]

    def agree(self, left: int, right: int) -> bool:
        """Whether two tokens side by side are the encoding of their bytes."""
        known = self._agree.get((left, right))
        if known is None:
            if len(self._agree) > 1_000_000:
                self._agree.clear()
            known = self._agree[left, right] = self.merge(self.tokens[left] + self.tokens[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of two encodings."""
        if not left or not right:
            return left + right
        if self.agree(left[-1], right[0]):
            return left + right
        a = b = 1
        while True:
            a, b = min(a, len(left)), min(b, len(right))
            window = self.merge(b"".join(self.tokens[t] for t in left[len(left) - a :] + right[:b]))
            fits_left = a == len(left) or self.agree(left[len(left) - a - 1], window[0])
            fits_right = b == len(right) or self.agree(window[-1], right[b])
            if fits_left and fits_right:
                return left[: len(left) - a] + window + right[b:]
            a, b = (a if fits_left else 2 * a), (b if fits_right else 2 * b)

    def encode_piece(self, piece: bytes) -> list[int]:
        """The encoding of one piece, by halves."""
        if len(piece) <= self.leaf:
            return self.merge(piece) if piece else []
        half = len(piece) // 2
        return self.join(self.encode_piece(piece[:half]), self.encode_piece(piece[half:]))

    def encode(self, text: str) -> list[int]:
        """The ids of a text."""
        out: list[int] = []
        seen = self.seen
        for piece in self.split(text):
            ids = seen.get(piece)
            if ids is None:
                ids = tuple(self.encode_piece(piece.encode()))
                if len(piece) <= 64:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an unknown id raises KeyError."""
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=4)
def load(path: str, pattern: str) -> ByteBPE:
    """The encoder of a rank file: a line for each token, with its bytes in base64 and its rank."""
    with open(path, "rb") as file:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
    return ByteBPE(ranks, pattern)


def _encode(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):  # ids of 256 texts at a time
            part = batch.slice(at, 256)
            ids = [bpe.encode(t.as_py() or "") for t in part["text"]]
            # an id is at most a 32-bit number, stored in a signed column
            yield pa.RecordBatch.from_arrays([*(part[c] for c in part.schema.names if c != "text"), pa.array(ids, pa.list_(pa.int32()))], names=[*(c for c in part.schema.names if c != "text"), "ids"])


def _decode(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    for batch in batches:
        out = [None if ids is None else bpe.decode(ids) for ids in batch["ids"].to_pylist()]
        yield pa.RecordBatch.from_arrays([*(batch[c] for c in batch.schema.names if c != "ids"), pa.array(out, pa.binary())], names=[*(c for c in batch.schema.names if c != "ids"), "decoded"])


def encode(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids of each row. path: a rank file that every executor has."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: _encode(b, path, pattern), "doc_id long, ids array<int>")


def decode(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, decoded (bytes) of rows with doc_id and ids."""
    return encoded.select("doc_id", "ids").mapInArrow(lambda b: _decode(b, path, pattern), "doc_id long, decoded binary")


def _digests(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    for batch in _encode(batches, path, pattern):
        flat, ends = batch["ids"].flatten().to_numpy().astype("<u4"), batch["ids"].offsets.to_numpy()
        ends = ends - ends[0]
        spans = [flat[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
        rows = [(len(s), hashlib.sha256(s.tobytes()).hexdigest(), hashlib.sha256(bpe.decode(s.tolist())).hexdigest()) for s in spans]
        columns = list(zip(*rows, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays(
            [batch["doc_id"], pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())],
            names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
        )


def round_trip(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (of 32-bit little-endian ids), decoded_sha256 (of the bytes decoded from the ids).

    Encoding and decoding run in one pass, so that no ids travel between them.
    """
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: _digests(b, path, pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def _checked(batches: Iterable[pa.RecordBatch], path: str, pattern: str) -> Iterator[pa.RecordBatch]:
    bpe = load(path, pattern)
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            texts = [t.as_py() or "" for t in part["text"]]
            ids = [bpe.encode(t) for t in texts]
            same = [bpe.decode(i) == t.encode() for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [part["doc_id"], pa.array(ids, pa.list_(pa.int32())), pa.array(list(map(len, ids)), pa.int64()), pa.array(same, pa.bool_())],
                names=["doc_id", "ids", "n_tokens", "decodes"],
            )


def encode_checked(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, ids, n_tokens, decodes (whether the ids decode to the text's bytes) of each row."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(lambda b: _checked(b, path, pattern), "doc_id long, ids array<int>, n_tokens long, decodes boolean")
