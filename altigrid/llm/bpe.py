"""Byte-level BPE with two tiers of look-up.

Tier one: a minimal perfect hash over the vocabulary's byte strings resolves whole pre-tokens that are
tokens themselves; the stored string decides. Tier two, for the rest: bytes linked in a list and a heap
of adjacent pairs by rank, so each merge costs a logarithm. Workers keep what they have resolved.

Defined results: a null or empty text has no ids. Input columns pass through.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from altigrid.llm.arrays import PerfectHash, chunks

CACHE_TOKENS = 150_000


class Vocabulary:
    """Ranks of byte strings: a perfect hash's slots hold the string and its rank."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            pairs = [line.split() for line in f if line.strip()]
        self.tokens = {int(r): base64.b64decode(t) for t, r in pairs}
        names = list(self.tokens.values())
        self.fine = PerfectHash.build(self.keys(names))
        self.names: list[bytes] = [b""] * self.fine.n
        self.ranks = np.zeros(self.fine.n, np.int64)
        at = self.fine.slots(self.keys(names))
        for i, (r, t) in zip(at.tolist(), self.tokens.items(), strict=True):
            self.names[i] = t
            self.ranks[i] = r
        # what the merges ask, one pair at a time
        self.rank_of = {t: r for r, t in self.tokens.items()}

    @staticmethod
    def keys(names: list[bytes]) -> np.ndarray:
        return np.fromiter((xxhash.xxh3_64_intdigest(x) for x in names), np.uint64, len(names))

    def whole(self, pieces: list[bytes]) -> list[int | None]:
        """Rank of each piece that is a token, else None."""
        at = self.fine.slots(self.keys(pieces))
        ranks = self.ranks[at].tolist()
        return [r if i >= 0 and self.names[i] == p else None for p, i, r in zip(pieces, at.tolist(), ranks, strict=True)]

    def merge(self, piece: bytes) -> list[int]:
        """Lowest-ranked adjacent pair first, leftmost among equals, until no pair is a token."""
        n = len(piece)
        rank = self.rank_of.get
        end = list(range(1, n + 1))  # end[i]: where the symbol that starts at i stops; 0 once merged away
        back = list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (r := rank(piece[i : i + 2])) is not None:
                heap.append((r, i, i + 2))
        heapq.heapify(heap)
        while heap:
            r, i, stop = heapq.heappop(heap)
            j = end[i]
            if not j or j >= n or end[j] != stop:
                continue  # one of the two has changed since
            end[i], end[j] = stop, 0
            if stop < n:
                back[stop] = i
                if (q := rank(piece[i : end[stop]])) is not None:
                    heapq.heappush(heap, (q, i, end[stop]))
            h = back[i]
            if h >= 0 and (q := rank(piece[h:stop])) is not None:
                heapq.heappush(heap, (q, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.rank_of[piece[i : end[i]]])
            i = end[i]
        return out


class Codec:
    def __init__(self, path: str, pattern: str):
        self.vocab = Vocabulary(path)
        self.split = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.token = [self.vocab.tokens.get(i, b"") for i in range(max(self.vocab.tokens) + 1)]

    def resolve(self, pieces: list[str]) -> None:
        raw = [p.encode() for p in pieces]
        merged = [[r] if r is not None else self.vocab.merge(b) for b, r in zip(raw, self.vocab.whole(raw), strict=True)]
        ids = np.fromiter(chain.from_iterable(merged), np.int32).tobytes()
        ends = np.cumsum([4 * len(m) for m in merged]).tolist()
        self.known.update(zip(pieces, [ids[i:j] for i, j in zip([0, *ends], ends)]))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as int32. New pre-tokens of all texts are resolved together."""
        if len(self.known) > CACHE_TOKENS:  # what was used since the last turn stays within reach
            self.old, self.known = self.known, {}
        pieces = [self.split(t) for t in texts]
        new = set().union(*pieces).difference(self.known)
        again = new.intersection(self.old)
        self.known.update(zip(again, map(self.old.__getitem__, again), strict=True))
        new -= again
        if new:
            self.resolve(list(new))
        return [b"".join(map(self.known.__getitem__, p)) for p in pieces]

    def decode(self, ids: np.ndarray) -> bytes:
        return b"".join(map(self.token.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    """One per worker process and vocabulary."""
    return Codec(path, pattern)


def _extended(docs: DataFrame, name: str, kind: T.DataType, run) -> DataFrame:
    names = [c for c in docs.columns if c != name]
    schema = T.StructType([*(docs.schema[c] for c in names), T.StructField(name, kind)])
    return docs.mapInArrow(run, schema)


def encode(docs: DataFrame, path: str, pattern: str, out: str = "ids") -> DataFrame:
    """Adds the array of ids of ``text``; a column of that name is overwritten."""
    names = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            c = codec(path, pattern)
            raw = c.encode([t.decode() for t in texts])
            offsets = np.cumsum([0, *(len(x) // 4 for x in raw)]).astype(np.int32)
            ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(raw), np.int32)))
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), ids], names=[*names, out])

    return _extended(docs, out, T.ArrayType(T.IntegerType()), run)


def decode(docs: DataFrame, path: str, pattern: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds the bytes that an array of ids stands for; a column of that name is overwritten."""
    names = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                c = codec(path, pattern)
                raw = [c.decode(x.values.to_numpy(zero_copy_only=False)) if x.is_valid else b"" for x in batch.column(ids)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(raw, pa.binary())], names=[*names, out])

    return _extended(docs, out, T.BinaryType(), run)
