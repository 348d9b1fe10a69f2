"""Line dedup: sharded minimal perfect hashes over distinct line hashes, probed by the documents.

1. Every text gives the 128-bit hash of each long enough line; hashes are counted (map-side combined)
   with the largest doc_id that holds them.
2. Hashes found in enough documents are dealt to shards. A shard is one row: a minimal perfect hash,
   a fingerprint array, a count array and an array of keepers, a few bytes a line.
3. Documents send packed packets of line hashes to the shards (never line texts), where whole packets
   are looked up at once. Shards that hold a very frequent line are copied and their packets dealt over
   the copies, by the measured load.
4. The few hits go back to their documents.

A row is a document; rows with equal doc_id and text get equal results. Defined results: a null or
empty text has one empty line; a null doc_id is smaller than any other; input columns pass through,
``text`` is replaced, and columns named ``n_lines`` or ``n_dropped`` are overwritten.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from altigrid.llm.arrays import PerfectHash, chunks
from altigrid.model import cut, cut_measured

SHARD_LOAD = 400_000


def doc_key(doc_id: str = "doc_id", text: str = "text") -> tuple[Column, Column]:
    """96 bits that name a document row by its id and text; null-safe."""
    return F.xxhash64(doc_id, text).alias("_k1"), F.hash(text, doc_id).alias("_k2")


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """16-byte hash of a line's key, None for short lines."""
    key = line.strip().lower()  # on bytes both touch ASCII only
    if len(key) < min_chars or (len(key) < 4 * min_chars and not key.isascii() and len(key.decode()) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


def _halves(digests: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)


def _found(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            digests, rows = [], []
            for i, t in enumerate(texts):
                own = {k for k in (line_key(x, min_chars) for x in t.split(b"\n")) if k}
                digests += own
                rows += [i] * len(own)
            h = _halves(digests)
            yield pa.RecordBatch.from_arrays(
                [pa.array(h[:, 0]), pa.array(h[:, 1]), batch.column("doc_id").take(pa.array(rows, pa.int64()))], names=["h1", "h2", "doc_id"])

    return run


def _build(table: pa.Table) -> pa.Table:
    """One shard: [perfect hash][fingerprints][counts][keepers], each slot by the hash."""
    h1 = table["h1"].to_numpy().view(np.uint64)
    # keys of one shard may, however unlikely, share h1; both halves make the key
    h2 = table["h2"].to_numpy().view(np.uint64)
    keys = h1 ^ (h2 << np.uint64(1))
    fine = PerfectHash.build(keys)
    at = fine.slots(keys)
    prints, counts, keepers, known = np.zeros(fine.n, np.int64), np.zeros(fine.n, np.int64), np.zeros(fine.n, np.int64), np.zeros(fine.n, np.int8)
    prints[at] = h2.view(np.int64)
    counts[at] = table["n"].to_numpy()
    keeper = table["keeper"].combine_chunks()
    keepers[at] = keeper.fill_null(0).to_numpy(zero_copy_only=False)
    known[at] = keeper.is_valid().to_numpy(zero_copy_only=False)
    return pa.table({"shard": table["shard"][:1], "mph": pa.array([fine.to_bytes()], pa.binary()), "prints": pa.array([prints.tobytes()], pa.binary()),
                     "counts": pa.array([counts.astype(np.uint32).tobytes()], pa.binary()), "keepers": pa.array([keepers.tobytes()], pa.binary()),
                     "known": pa.array([known.tobytes()], pa.binary())})


def _packets(min_chars: int, shards: int, copies: dict[int, int]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turn = 0
        for batch, texts in chunks(batches, limit=8_000_000):
            digests, rows, lines = [], [], []
            for i, t in enumerate(texts):
                for j, x in enumerate(t.split(b"\n")):
                    if len(x) >= min_chars and (k := line_key(x, min_chars)):
                        digests.append(k)
                        rows.append(i)
                        lines.append(j)
            if not digests:
                continue
            h = _halves(digests)
            rows, lines = np.array(rows), np.array(lines, np.int32)
            k1, k2 = batch.column("_k1").to_numpy()[rows], batch.column("_k2").to_numpy()[rows]
            to = h[:, 0] % shards
            order = np.argsort(to, kind="stable")
            cuts = np.flatnonzero(np.diff(to[order])) + 1
            out = {n: [] for n in ("shard", "copy", "h1", "h2", "k1", "k2", "line")}
            for part in np.split(order, cuts):
                s = int(to[part[0]])
                out["shard"].append(s)
                out["copy"].append((turn + int(k1[part[0]] & 0xFFFF)) % copies.get(s, 1))
                for n, a in (("h1", h[:, 0]), ("h2", h[:, 1]), ("k1", k1), ("k2", k2), ("line", lines)):
                    out[n].append(np.ascontiguousarray(a[part]).tobytes())
            turn += 1
            yield pa.RecordBatch.from_arrays([pa.array(out["shard"], pa.int32()), pa.array(out["copy"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in ("h1", "h2", "k1", "k2", "line"))], names=list(out))

    return run


_HITS = pa.schema([("_k1", pa.int64()), ("_k2", pa.int32()), ("line", pa.int32()), ("keeper", pa.int64()), ("n", pa.int64())])


def _probe(asked: pa.Table, index: pa.Table) -> pa.Table:
    if not index.num_rows or not asked.num_rows:
        return _HITS.empty_table()
    one = {n: index[n][0].as_py() for n in ("mph", "prints", "counts", "keepers", "known")}
    fine = PerfectHash.from_bytes(one["mph"])
    prints, keepers, known = np.frombuffer(one["prints"], np.int64), np.frombuffer(one["keepers"], np.int64), np.frombuffer(one["known"], np.int8)
    counts = np.frombuffer(one["counts"], np.uint32)
    col = lambda n, kind: np.frombuffer(b"".join(asked[n].to_pylist()), kind)
    h1, h2 = col("h1", np.uint64), col("h2", np.uint64)
    at = fine.slots(h1 ^ (h2 << np.uint64(1)))
    hit = np.flatnonzero((at >= 0) & (prints[at] == h2.view(np.int64)))
    at = at[hit]
    return pa.table([pa.array(col("k1", np.int64)[hit]), pa.array(col("k2", np.int32)[hit]), pa.array(col("line", np.int32)[hit]),
                     pa.array(keepers[at], mask=known[at] == 0), pa.array(counts[at].astype(np.int64))], schema=_HITS)


def line_index(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> tuple[DataFrame, int, dict[int, int]]:
    """The stored shard table, the number of shards, and the copies wanted of heavily probed shards."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    found = docs.select("doc_id", "text").mapInArrow(_found(min_chars), "h1 bigint, h2 bigint, doc_id bigint")
    counted = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper")).where(F.col("n") >= min_docs)
    keys, got = cut_measured(counted, F.count(F.lit(1)).alias("keys"))
    # no more lines are asked for than the texts' bytes can hold
    shards = max(1, math.ceil(max(size / (2 * min_chars), got["keys"] or 0) / SHARD_LOAD))
    keys = keys.withColumn("shard", F.pmod("h1", F.lit(shards)).cast("int"))
    # at most (lines / SHARD_LOAD) shards can be over the load, so this stays as small as the shard count
    heavy = keys.groupBy("shard").agg(F.sum("n").alias("n")).where(F.col("n") > SHARD_LOAD // 4).collect()
    copies = {r.shard: math.ceil(r.n / (SHARD_LOAD // 4)) for r in heavy}
    index = keys.groupBy("shard").applyInArrow(_build, "shard int, mph binary, prints binary, counts binary, keepers binary, known binary")
    return cut(index), shards, copies


def _rewrite(text: pd.Series, gone: pd.Series) -> pd.DataFrame:
    out, total, dropped = [], [], []
    for t, g in zip(text, gone, strict=True):
        lines = (t or "").split("\n")
        total.append(len(lines))
        drop = set(g) if g is not None else ()
        dropped.append(len(drop))
        out.append("\n".join([x for i, x in enumerate(lines) if i not in drop]) if drop else t or "")
    return pd.DataFrame({"text": out, "n_lines": total, "n_dropped": dropped})


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """Documents without the lines that ``min_docs`` documents or more share, except in the largest doc_id."""
    index, shards, copies = line_index(docs, min_chars, min_docs)
    often = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in copies.items() for x in kv]), F.col("shard")), F.lit(1)) if copies else F.lit(1)
    index = index.withColumn("copy", F.explode(F.sequence(F.lit(0), often - 1)))
    asked = docs.select(*doc_key(), "text").mapInArrow(
        _packets(min_chars, shards, copies), "shard int, copy int, h1 binary, h2 binary, k1 binary, k2 binary, line binary")
    hits = asked.groupBy("shard", "copy").cogroup(index.groupBy("shard", "copy")).applyInArrow(_probe, "_k1 bigint, _k2 int, line int, keeper bigint, n bigint")
    gone = hits.groupBy("_k1", "_k2").agg(F.collect_set(F.struct("line", "keeper")).alias("_gone"))
    names = [c for c in docs.columns if c not in ("text", "n_lines", "n_dropped")]
    fix = F.pandas_udf(_rewrite, "text string, n_lines bigint, n_dropped bigint")
    own = F.transform(F.filter("_gone", lambda x: ~x["keeper"].eqNullSafe(F.col("_row.doc_id"))), lambda x: x["line"])
    # input columns travel in one struct, so their names meet none of these
    wide = docs.select(F.struct("*").alias("_row"), *doc_key()).join(gone, ["_k1", "_k2"], "left").withColumn("_fixed", fix("_row.text", own))
    order = [F.col("_fixed.text").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in docs.columns if c in names or c == "text"]
    return wide.select(*order, "_fixed.n_lines", "_fixed.n_dropped")
