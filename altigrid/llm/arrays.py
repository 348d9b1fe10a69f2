"""Array helpers that run inside tasks: words of many texts at once, hashes, minimal perfect hashing."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
BASE = 0x9E3779B97F4A7C15 | 1
BASE_INVERSE = pow(BASE, -1, 1 << 64)
CHUNK_BYTES = 2_000_000


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        steps = np.full(max(n, CHUNK_BYTES + 65_536), base, np.uint64)
        steps[0] = 1
        have = np.cumprod(steps, dtype=np.uint64)
        if n <= CHUNK_BYTES + 65_536:
            _POWERS[base] = have
    return have[:n]


class Words:
    """Words (runs of anything but ASCII white space) of a list of texts, as offsets into one buffer.

    In ``buf`` words are separated by exactly one space. ``first[d]:first[d + 1]`` are the words of text d.
    """

    def __init__(self, texts: list[bytes], lower: bool = False):
        raw = b" ".join(texts) + b" "
        raw = np.frombuffer(raw.lower() if lower else raw, np.uint8)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        if len(raw) and blank[0]:
            keep[0] = False
        buf = raw[keep]
        space = blank[keep]
        self.buf = np.where(space, np.uint8(32), buf)
        self.end = np.flatnonzero(space)
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else np.zeros(0, np.int64)
        ends = np.cumsum(lengths)
        # a word belongs to the text whose bytes hold its end mark
        marks = np.flatnonzero(keep)[self.end]
        self.first = np.concatenate([[0], np.searchsorted(marks, ends, side="left")])

    def __len__(self) -> int:
        return len(self.end)

    def hashes(self) -> np.ndarray:
        """64-bit hash per word: a polynomial over its bytes, finalised."""
        if not len(self):
            return np.zeros(0, np.uint64)
        n = len(self.buf)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((self.buf.astype(np.uint64) + U(1)) * powers(BASE, n), dtype=np.uint64)])
        value = (total[self.end] - total[self.start]) * powers(BASE_INVERSE, n)[self.start]
        return mix(value + (self.end - self.start).astype(np.uint64) * U(0xD6E8FEB86659FD93))

    def doc_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive word hashes (array shorter by n - 1)."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = mix(out * U(0x9FB21C651E98DF25) + h[j : j + m])
    return out


def texts_of(column: pa.Array) -> list[bytes]:
    """UTF-8 bytes per value; null is empty."""
    return [x or b"" for x in column.cast(pa.large_binary()).to_pylist()]


def tidy() -> None:
    """Hand freed memory back at the end of a task: workers idle between stages and would keep it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches that hold about ``limit`` bytes of text (one row at least)."""
    for batch in batches:
        at, size = 0, 0
        # by the lengths alone, so that only one slice's texts are copied at a time
        for i, n in enumerate(pc.binary_length(batch.column(text)).fill_null(0).to_pylist()):
            if size and size + n > limit:
                part = batch.slice(at, i - at)
                yield part, texts_of(part.column(text))
                at, size = i, 0
            size += n
        if at < batch.num_rows:
            part = batch.slice(at)
            yield part, texts_of(part.column(text))
            del part
    tidy()


class PerfectHash:
    """Minimal perfect hash of distinct 64-bit keys: levels of bit arrays, and ranks of their bits.

    On each level a key takes the bit its hash points at if no other key points there; the others go
    to the next level. A key's slot is the rank of its bit over all levels. Keys that were not put in
    get any slot or -1, so callers compare a stored fingerprint.
    """

    def __init__(self, levels: list[np.ndarray], sizes: list[int]):
        self.levels, self.sizes = levels, sizes
        counts = [np.bitwise_count(x) for x in levels]
        self.before = []
        base = 0
        for c in counts:
            run = np.concatenate([[0], np.cumsum(c, dtype=np.int64)])
            self.before.append(run + base)
            base += int(run[-1])
        self.n = base

    @staticmethod
    def place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + U(0x9E3779B97F4A7C15 * (level + 1) & 0xFFFFFFFFFFFFFFFF)) % U(size)).astype(np.int64)

    @classmethod
    def build(cls, keys: np.ndarray, gamma: float = 1.7) -> PerfectHash:
        levels, sizes, left = [], [], np.asarray(keys, np.uint64)
        while len(left):
            if len(levels) > 200:
                raise ValueError("keys are not distinct")
            size = max(64, int(len(left) * gamma) // 64 * 64 + 64)
            at = cls.place(left, len(levels), size)
            times = np.bincount(at, minlength=size)
            alone = times == 1
            levels.append(np.packbits(alone, bitorder="little").view(np.uint64))
            sizes.append(size)
            left = left[~alone[at]]
        return cls(levels, sizes)

    def slots(self, keys: np.ndarray) -> np.ndarray:
        keys = np.asarray(keys, np.uint64)
        out = np.full(len(keys), -1, np.int64)
        open_ = np.arange(len(keys))
        for level, (bits, size) in enumerate(zip(self.levels, self.sizes, strict=True)):
            if not len(open_):
                break
            at = self.place(keys[open_], level, size)
            word, bit = at >> 6, (at & 63).astype(np.uint64)
            hit = (bits[word] >> bit) & U(1) == 1
            w, b = word[hit], bit[hit]
            below = np.bitwise_count(bits[w] & ((U(1) << b) - U(1)))
            out[open_[hit]] = self.before[level][w] + below
            open_ = open_[~hit]
        return out

    def to_bytes(self) -> bytes:
        head = np.array([len(self.sizes), *self.sizes], np.int64).tobytes()
        return head + b"".join(x.tobytes() for x in self.levels)

    @classmethod
    def from_bytes(cls, raw: bytes) -> PerfectHash:
        n = int(np.frombuffer(raw, np.int64, 1)[0])
        sizes = np.frombuffer(raw, np.int64, n, 8).tolist()
        levels, at = [], 8 * (n + 1)
        for s in sizes:
            levels.append(np.frombuffer(raw, np.uint64, s // 64, at))
            at += s // 8
        return cls(levels, sizes)
