"""Packing along a space-filling curve.

Each document's hashed word vector is projected to ``DIMS`` numbers; the quantised direction of that
projection gives a Hilbert key, so documents with like words lie near each other on the curve, whatever
their lengths. Documents are
range-partitioned and sorted by (key, doc_id), encoded, and laid end to end; a sequence is the next
``length`` tokens of that line. Pieces follow from a document's place by arithmetic, so only the last
sequence of all can need padding.

Defined results: a null text encodes as an empty one (a piece of one end token). Rows with equal
doc_id are documents of their own. Other columns are not carried.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altigrid.llm.arrays import U, Words, chunks
from altigrid.llm.tokens import END_ID, encoded, part_starts
from altigrid.model import cut, scratch_path

DIMS, BITS, HASHED = 4, 12, 1 << 14
SEQUENCE = 2048


def hilbert_key(x: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of integer points (rows of ``x``, each below 2**bits).

    Going from the highest bit down, a point's lower bits are exchanged or inverted as the curve turns
    inside each cube; the transposed bits, Gray-decoded, are then read across dimensions.
    """
    x = x.astype(np.int64).copy()
    n = x.shape[1]
    bit = 1 << (bits - 1)
    while bit > 1:
        below = bit - 1
        for d in range(n):
            high = (x[:, d] & bit) != 0
            swap = np.where(high, 0, (x[:, 0] ^ x[:, d]) & below)
            x[:, 0] ^= np.where(high, below, swap)
            x[:, d] ^= swap
        bit >>= 1
    for d in range(1, n):
        x[:, d] ^= x[:, d - 1]
    turn = np.zeros(len(x), np.int64)
    bit = 1 << (bits - 1)
    while bit > 1:
        turn ^= np.where(x[:, n - 1] & bit, bit - 1, 0)
        bit >>= 1
    x ^= turn[:, None]
    key = np.zeros(len(x), np.int64)
    for b in range(bits - 1, -1, -1):
        for d in range(n):
            key = (key << 1) | ((x[:, d] >> b) & 1)
    return key


def projection(seed: int = 3) -> np.ndarray:
    """Hashed dimensions to a few: one random direction per hash cell."""
    return np.random.default_rng(seed).standard_normal((HASHED, DIMS)).astype(np.float32)


def curve_keys(texts: list[bytes]) -> np.ndarray:
    """Hilbert keys of whole texts; a text without words has key 0."""
    table, out = projection(), np.zeros(len(texts), np.int64)
    at, size = 0, 0
    for i in range(len(texts) + 1):
        if i == len(texts) or (size and size + len(texts[i]) > 1_000_000):
            w = Words(texts[at:i], lower=True)
            n = np.diff(w.first)
            some = np.flatnonzero(n)
            if len(some):
                rows = table[(w.hashes() >> U(64 - 14)).astype(np.int64)]
                total = np.add.reduceat(rows, w.first[:-1][some], axis=0, dtype=np.float64)
                # the direction alone, so that length does not steer the curve
                unit = total / np.maximum(np.sqrt((total * total).sum(axis=1)), 1e-9)[:, None]
                cell = np.clip(np.floor((unit / 2 + 0.5) * (1 << BITS)), 0, (1 << BITS) - 1).astype(np.int64)
                out[at + some] = hilbert_key(cell, BITS)
            at, size = i, 0
        if i < len(texts):
            size += len(texts[i])
    return out


def along_curve(docs: DataFrame, path: str, end_id: int = END_ID) -> DataFrame:
    """Stored rows (part, doc_id, local, ids) in curve order: each partition is a stretch of the curve."""
    spark = docs.sparkSession

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(curve_keys(texts))], names=[*batch.schema.names, "_key"])

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    # stored, as the range partitioner reads the keys once more to find its bounds
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).mapInArrow(keys, "doc_id bigint, text string, _h bigint, _key bigint")
    path_of_keys = scratch_path(spark, "curve")
    keyed.write.option("compression", "zstd").parquet(path_of_keys)
    keyed = spark.read.parquet(path_of_keys)
    ordered = keyed.repartitionByRange(n, "_key", "doc_id", "_h").sortWithinPartitions("_key", "doc_id", "_h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at = TaskContext.get().partitionId(), 0
        for batch, ids in encoded(path, end_id)(batches):
            n = np.array([len(a) for a in ids], np.int64)
            local = at + np.cumsum(n) - n
            at += int(n.sum())
            small = [a.astype(np.uint16).tobytes() if a.max() < 1 << 16 else a.tobytes() for a in ids]
            yield pa.RecordBatch.from_arrays([pa.array([part] * len(ids), pa.int32()), batch.column("doc_id"), pa.array(local), pa.array(n), pa.array(small, pa.binary())], names=["part", "doc_id", "local", "tokens", "ids"])

    return cut(ordered.mapInArrow(run, "part int, doc_id bigint, local bigint, tokens bigint, ids binary"))


PIECES = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64()), ("ids", pa.list_(pa.int32()))])


def _pieces(length: int, with_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols = {c: [] for c in PIECES.names}
            for d, n, at, raw in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "tokens", "at", "ids")), strict=True):
                ids = np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32).astype(np.uint32)
                lo = 0
                while lo < n:
                    seq, off = divmod(at + lo, length)
                    hi = min(n, lo + length - off)
                    part = ids[lo:hi]
                    for c, v in zip(PIECES.names, (d, lo, hi - lo, zlib.crc32(part.tobytes()), n, seq, off, part.astype(np.int32) if with_ids else None), strict=True):
                        cols[c].append(v)
                    lo = hi
            yield pa.RecordBatch.from_arrays([pa.array(cols[f.name], f.type) for f in PIECES], schema=PIECES)

    return run


def pack(docs: DataFrame, path: str, length: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = True) -> DataFrame:
    """Pieces of all documents: where each run of ids lies in its document and in its sequence."""
    line = along_curve(docs, path, end_id)
    placed = line.join(F.broadcast(part_starts(line.select("part", "tokens"))), "part")
    placed = placed.select("doc_id", "tokens", (F.col("local") + F.col("earlier")).alias("at"), "ids")
    types = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids array<int>"
    return placed.mapInArrow(_pieces(length, with_ids), types)
