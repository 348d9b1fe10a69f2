"""Substring dedup by super-k-mers.

A window is ``window`` consecutive words. Every window has a minimiser, the run of ``GRAM`` words with
the smallest hash inside it; consecutive windows with the same minimiser travel together as one packed
string of words to the minimiser's bucket, so equal windows always meet. A bucket numbers its words
exactly, sorts window hashes, compares equal neighbours word by word, and returns the stretches that
were found again. Packed strings that occur twice within a map task are settled there; one copy still
travels, marked, so a passage held by very many documents adds one string per task to its bucket.

Windows are judged on the input. A row is a document; rows with equal doc_id and text get equal
results. Defined results: null texts have no words; other columns pass through; ``text`` becomes the
kept words joined by one space; columns named ``n_words`` or ``n_removed`` are overwritten.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altigrid.llm.arrays import U, Words, chunks, grams, mix
from altigrid.llm.lines import doc_key

GRAM = 4
BUCKET_BYTES = 3_000_000
POSITION = 24


def minimisers(g: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` values the smallest, as (40 hash bits, position).

    Positions count from the start of a stretch that they fit into; stretches share ``width - 1`` values.
    """
    most = 1 << POSITION
    if len(g) > most:
        return np.concatenate([minimisers(g[a : a + most], width) for a in range(0, len(g) - width + 1, most - width + 1)])
    key = (g & ~U((1 << POSITION) - 1)) | np.arange(len(g), dtype=np.uint64)
    done = 1
    while done * 2 <= width:
        key = np.minimum(key[:-done], key[done:])
        done *= 2
    rest = width - done
    return np.minimum(key[: len(key) - rest], key[rest:]) if rest else key


def super_kmers(words: Words, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, last window, minimiser hash) of each super-k-mer; windows are numbered by first word."""
    n = len(words) - window + 1
    if n <= 0:
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    low = minimisers(grams(words.hashes(), GRAM), window - GRAM + 1)
    doc = words.doc_of()
    valid = doc[:n] == doc[window - 1 :]
    edge = np.ones(n, bool)
    edge[1:] = (low[1:] != low[:-1]) | (doc[1:n] != doc[: n - 1])
    first = np.flatnonzero(edge & valid)
    if not len(first):
        return (np.zeros(0, np.int64),) * 2 + (np.zeros(0, np.uint64),)
    # a stretch ends before the next edge or the first window that leaves its document
    stop = np.flatnonzero(np.concatenate([edge | ~valid, [True]]))
    last = stop[np.searchsorted(stop, first, side="right")] - 1
    return first, last, low[first] >> U(POSITION)


def _pack(window: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch, texts in chunks(batches):
            w = Words(texts)
            first, last, low = super_kmers(w, window)
            if not len(first):
                continue
            doc = w.doc_of()[first]
            k1, k2 = batch.column("_k1").to_numpy()[doc], batch.column("_k2").to_numpy()[doc]
            at = (first - w.first[doc]).astype(np.int32)
            raw = w.buf.tobytes()
            strings = [raw[a:b] for a, b in zip(w.start[first].tolist(), w.end[last + window - 1].tolist(), strict=True)]
            seen: dict[bytes, int] = {}
            twice = np.zeros(len(strings), bool)
            alone = np.ones(len(strings), bool)
            for i, s in enumerate(strings):
                j = seen.setdefault(s, i)
                if j != i:
                    twice[i] = twice[j] = True
                    alone[i] = False
            size = (last - first + 1).astype(np.int32)
            settled = np.flatnonzero(twice)
            to = (mix(low) % U(buckets)).astype(np.int64)
            order = np.flatnonzero(alone)
            order = order[np.argsort(to[order], kind="stable")]
            parts = np.split(order, np.flatnonzero(np.diff(to[order])) + 1)
            out = {n: [] for n in ("bucket", "k1", "k2", "at", "twice", "packed", "done")}
            for p, part in enumerate(parts):
                out["bucket"].append(int(to[part[0]]))
                for n, a in (("k1", k1), ("k2", k2), ("at", at), ("twice", twice)):
                    out[n].append(a[part].tobytes())
                out["packed"].append(press.compress(b"\n".join([strings[i] for i in part.tolist()])))
                mine = settled[p :: len(parts)]  # settled stretches are spread over this task's rows
                out["done"].append(k1[mine].tobytes() + k2[mine].tobytes() + at[mine].tobytes() + (at[mine] + size[mine] + window - 1).astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), *(pa.array(out[n], pa.binary()) for n in list(out)[1:])], names=list(out))

    return run


def repeated(ids: np.ndarray, start: np.ndarray, weight: np.ndarray, window: int) -> np.ndarray:
    """Which windows occur twice or more, exactly.

    Hashes are sorted; equal neighbours are compared word by word. Should two different windows ever
    share a hash, the windows of that hash are grouped by their words instead.
    """
    h = np.zeros(len(start), np.uint64)
    spread = mix(ids.astype(np.uint64) + U(1))
    for j in range(window):
        h = h * U(0x9FB21C651E98DF25) + spread[start + j]
    h = mix(h)
    order = np.argsort(h, kind="stable")
    hs, ss = h[order], start[order]
    near = np.flatnonzero(hs[1:] == hs[:-1])
    same = np.ones(len(near), bool)
    for j in range(window):
        same &= ids[ss[near] + j] == ids[ss[near + 1] + j]
    hit = np.zeros(len(start), bool)
    hit[order[near]] = True
    hit[order[near + 1]] = True
    hit |= weight > 1
    for bad in np.unique(hs[near[~same]]):
        rows = np.flatnonzero(h == bad)
        by: dict[bytes, list[int]] = {}
        for r in rows.tolist():
            by.setdefault(ids[start[r] : start[r] + window].tobytes(), []).append(r)
        for group in by.values():
            hit[group] = len(group) > 1 or weight[group[0]] > 1
    return hit


_SPANS = pa.schema([("_k1", pa.int64()), ("_k2", pa.int32()), ("lo", pa.int32()), ("hi", pa.int32())])


def _count(window: int):
    def run(table: pa.Table) -> pa.Table:
        done = [x for x in table["done"].to_pylist() if x]
        k1s, k2s, los, his = [], [], [], []
        for x in done:
            n = len(x) // 20
            k1s.append(np.frombuffer(x, np.int64, n))
            k2s.append(np.frombuffer(x, np.int32, n, 8 * n))
            los.append(np.frombuffer(x, np.int32, n, 12 * n))
            his.append(np.frombuffer(x, np.int32, n, 16 * n))
        col = lambda n, kind: np.frombuffer(b"".join(table[n].to_pylist()), kind)
        k1, k2, at, twice = col("k1", np.int64), col("k2", np.int32), col("at", np.int32), col("twice", bool)
        unpress = zstandard.ZstdDecompressor()
        w = Words([s for x in table["packed"].to_pylist() for s in unpress.decompress(x).split(b"\n")])
        # exact word numbers: each value is a word with the space after it
        offsets = np.concatenate([w.start, [len(w.buf)]]).astype(np.int32)
        ids = pa.StringArray.from_buffers(len(w), pa.py_buffer(offsets), pa.py_buffer(w.buf)).dictionary_encode().indices.to_numpy()
        size = np.diff(w.first) - window + 1
        owner = np.repeat(np.arange(len(size)), size)
        inner = np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size)
        start = w.first[:-1][owner] + inner
        hit = repeated(ids, start, np.where(twice[owner], 2, 1), window) & ~twice[owner]
        # runs of repeated windows within one super-k-mer
        edge = hit.copy()
        edge[1:] &= ~(hit[:-1] & (owner[1:] == owner[:-1]))
        close = hit.copy()
        close[:-1] &= ~(hit[1:] & (owner[1:] == owner[:-1]))
        a, b = np.flatnonzero(edge), np.flatnonzero(close)
        o = owner[a]
        k1s.append(k1[o])
        k2s.append(k2[o])
        los.append((at[o] + inner[a]).astype(np.int32))
        his.append((at[o] + inner[b] + window).astype(np.int32))
        return pa.table([pa.array(np.concatenate(x)) for x in (k1s, k2s, los, his)], schema=_SPANS)

    return run


def repeated_spans(docs: DataFrame, window: int = 35) -> DataFrame:
    """(_k1, _k2, lo, hi): word stretches covered by windows that start somewhere else too."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(16, math.ceil(size / BUCKET_BYTES))
    packed = docs.select(*doc_key(), "text").mapInArrow(
        _pack(window, buckets), "bucket int, k1 binary, k2 binary, at binary, twice binary, packed binary, done binary")
    return packed.groupBy("bucket").applyInArrow(_count(window), "_k1 bigint, _k2 int, lo int, hi int")


def _strip(text: pd.Series, lo: pd.Series, hi: pd.Series) -> pd.DataFrame:
    out, n, gone = [], [], []
    for t, a, b in zip(text, lo, hi, strict=True):
        w = (t or "").encode().split()
        n.append(len(w))
        if a is not None and len(a):
            step = np.zeros(len(w) + 1, np.int64)
            np.add.at(step, np.asarray(a, np.int64), 1)
            np.add.at(step, np.asarray(b, np.int64), -1)
            keep = np.cumsum(step)[:-1] == 0
            w = [x for x, k in zip(w, keep.tolist(), strict=True) if k]
        gone.append(n[-1] - len(w))
        out.append(b" ".join(w).decode())
    return pd.DataFrame({"text": out, "n_words": n, "n_removed": gone})


def dedup_substrings(docs: DataFrame, window: int = 35) -> DataFrame:
    """Documents without the words that repeated windows cover; all copies lose them."""
    spans = repeated_spans(docs, window).groupBy("_k1", "_k2").agg(F.collect_set(F.struct("lo", "hi")).alias("_spans"))
    names = [c for c in docs.columns if c not in ("n_words", "n_removed")]
    strip = F.pandas_udf(_strip, "text string, n_words bigint, n_removed bigint")
    # input columns travel in one struct, so their names meet none of these
    wide = docs.select(F.struct("*").alias("_row"), *doc_key()).join(spans, ["_k1", "_k2"], "left")
    wide = wide.withColumn("_kept", strip("_row.text", F.col("_spans.lo"), F.col("_spans.hi")))
    cols = [F.col("_kept.text").alias("text") if c == "text" else F.col("_row").getField(c).alias(c) for c in names]
    return wide.select(*cols, "_kept.n_words", "_kept.n_removed")
