"""Hashed words of a text, and sparse rows of them, for the linear classifiers."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa

#: Runs of letters.
LETTERS = re.compile(r"[^\W\d_]+")
#: How many first letters make a word family.
FAMILIES = (4, 5)


def distinct_words(text: str | None, bits: int) -> list[int]:
    """Hashes (of so many bits) of the different words of a text in lower case, and of their first letters."""
    words = set(LETTERS.findall((text or "").lower()))
    mask = (1 << bits) - 1
    families = {w[:n] for n in FAMILIES for w in words}
    return list({zlib.crc32(w.encode()) & mask for w in words} | {zlib.crc32(b"^" + f.encode()) & mask for f in families})


_SHAPES = {i: "9" if chr(i).isdigit() else "X" if chr(i).isupper() else "x" if chr(i).isalpha() else chr(i) for i in range(0x250)}
_RUN = re.compile(r"(.)\1+")


def text_profile(text: str | None, bits: int) -> dict[int, float]:
    """Hashed words with the logarithm of their number, the shares of word shapes, and how far the text repeats itself.

    A shape has a letter for each kind of character, runs drawn together: 'Word!!' is 'Xx!'. Values of the words have
    length 1 together, whatever the size of the text.
    """
    words = (text or "").split()
    mask = (1 << bits) - 1
    counts = Counter(words)
    out: dict[int, float] = {}
    shapes: Counter[str] = Counter()
    for w, n in counts.items():
        shapes[_RUN.sub(r"\1", w.translate(_SHAPES))] += n
    values = {w: 1 + np.log(n) for w, n in counts.items()}
    length = float(np.sqrt(sum(v * v for v in values.values()))) or 1.0
    for w, v in values.items():
        key = zlib.crc32(w.lower().encode()) & mask
        out[key] = out.get(key, 0.0) + v / length
    for shape, n in shapes.items():
        key = zlib.crc32(b"\x00shape " + shape.encode("utf-8", "replace")) & mask
        out[key] = out.get(key, 0.0) + 2.0 * n / len(words)
    different = len(counts) / len(words) if words else 0.0
    most = max(counts.values()) / len(words) if words else 0.0
    size = min(12, len(words).bit_length())
    for name in (f"different {int(10 * different)}", f"most {int(20 * most)}", f"size {size}", f"size {size} different {int(5 * different)}"):
        out[zlib.crc32(b"\x00" + name.encode()) & mask] = 1.0
    return out


class Rows:
    """Sparse rows of feature numbers, with values of 1 unless given.

    ends: where each row ends in columns. Arrays are kept as they are, and temporaries are of the size of columns.
    """

    def __init__(self, ends: np.ndarray, columns: np.ndarray, values: np.ndarray | None = None) -> None:
        self.n, self.columns, self.values = len(ends), columns, values
        self.at = np.repeat(np.arange(self.n, dtype=np.int32), np.diff(ends, prepend=0))

    @classmethod
    def of(cls, rows: list, values: list | None = None) -> Rows:
        flat = np.concatenate([np.asarray(r, np.int32) for r in rows]) if rows else np.zeros(0, np.int32)
        return cls(np.cumsum([len(r) for r in rows], dtype=np.int64), flat, None if values is None else np.concatenate([np.asarray(v, float) for v in values] or [np.zeros(0)]))

    @classmethod
    def of_bytes(cls, columns: pa.ChunkedArray, values: pa.ChunkedArray | None = None) -> Rows:
        """From binary columns of 32-bit numbers, without a copy for each row."""

        def flat(column: pa.ChunkedArray, kind: str) -> tuple[np.ndarray, np.ndarray]:
            parts = [(np.frombuffer(c.buffers()[1], np.int32)[c.offset : c.offset + len(c) + 1], c.buffers()[2]) for c in column.chunks if len(c)]
            ends = [np.diff(o.astype(np.int64)) // 4 for o, _ in parts]
            data = [np.frombuffer(b, kind)[o[0] // 4 : o[-1] // 4] if b is not None else np.zeros(0, kind) for o, b in parts]
            return np.cumsum(np.concatenate(ends or [np.zeros(0, np.int64)])), np.concatenate(data or [np.zeros(0, kind)])

        ends, numbers = flat(columns, "<i4")
        return cls(ends, numbers, None if values is None else flat(values, "<f4")[1])

    def _weigh(self, x: np.ndarray) -> np.ndarray:
        return x if self.values is None else x * self.values

    def select(self, target: np.ndarray, least: float = 4.0, min_rows: int = 5) -> np.ndarray:
        """Keep the features that go with the target by at least so many standard errors; returns their former numbers."""
        found, counts = np.unique(self.columns, return_counts=True)
        place = np.searchsorted(found, self.columns)
        off = target - target.mean() if len(target) else target
        both = np.bincount(place, self._weigh(off[self.at]), len(found))
        size = counts.astype(float) if self.values is None else np.bincount(place, self.values.astype(float) ** 2, len(found))
        good = (counts >= min_rows) & (np.abs(both) > least * np.sqrt(size * max(float(np.var(off)), 1e-12))) if len(found) else np.zeros(0, bool)
        held = good[place]
        self.columns = (np.cumsum(good) - 1)[place[held]].astype(np.int32)
        self.at = self.at[held]
        self.values = None if self.values is None else self.values[held]
        return found[good]

    def times(self, weights: np.ndarray) -> np.ndarray:
        return np.bincount(self.at, self._weigh(weights[self.columns]), self.n)

    def gather(self, of_rows: np.ndarray, size: int) -> np.ndarray:
        """The transposed product."""
        return np.bincount(self.columns, self._weigh(of_rows[self.at]), size)


class Adam:
    """Adam's steps for one array."""

    def __init__(self, size: int, rate: float) -> None:
        self.m, self.v, self.t, self.rate = np.zeros(size), np.zeros(size), 0, rate

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.t += 1
        self.m = 0.9 * self.m + 0.1 * gradient
        self.v = 0.999 * self.v + 0.001 * gradient**2
        return self.rate * (self.m / (1 - 0.9**self.t)) / (np.sqrt(self.v / (1 - 0.999**self.t)) + 1e-8)


def sigmoid(z: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def total(weights: dict[int, float], features: Iterable[int]) -> float:
    """Sum of the weights of features."""
    get = weights.get
    return sum(get(f, 0.0) for f in features)
