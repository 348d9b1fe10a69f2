"""Quality classifier: a convolutional network over the bytes of whole texts, in numpy.

A text is cut into chunks of ``CHUNK`` bytes, each with the next ``WIDTH`` bytes added, so that every run of
``WIDTH`` bytes lies in one chunk. Each byte has a learned vector; learned filters look at ``WIDTH`` bytes
at a time, and a chunk keeps each filter's largest answer. The document keeps the largest and the mean
answer over its chunks; a logistic layer makes one probability of these.

Fitting takes a bounded sample: at most ``TRAIN_ROWS`` labelled rows of each class, of ``TRAIN_BYTES`` of
text at most, chosen by hash; the share of the classes among all labels then shifts the odds. It runs in
one task on that sample and returns the weights. Scoring is one pass over all documents without a shuffle.

Defined results: an empty or null text is one chunk of zero bytes; labels without a matching document,
null labels and labels other than 0 and 1 teach nothing, a doc_id with two labels is taught as both;
without rows of both classes every score is the smoothed share of label 1. A null doc_id counts as held
out. Other columns pass through; columns named like the results are overwritten.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from altigrid.llm.arrays import chunks, texts_of

CHUNK, WIDTH, EMBED, FILTERS = 512, 8, 6, 24
TRAIN_ROWS, TRAIN_BYTES = 2_000, 100_000
#: Few rows are gone through more often, until so many batches have been seen.
EPOCHS, LEAST_BATCHES, BATCH_CHUNKS, RATE, DECAY = 6, 400, 192, 0.01, 1e-4
SLAB = 2_048
THRESHOLD = 0.3
FOLDS = 5


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from: a fifth, by the checksum of the id as text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def cut_up(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bytes of all texts, start of each chunk, end of its text, first chunk of each text)."""
    raw = np.frombuffer(b"".join(texts) + b"\0", np.uint8)
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    pieces = np.maximum(1, -(-size // CHUNK))
    first = np.concatenate([[0], np.cumsum(pieces)])
    begin = np.cumsum(size) - size
    inside = np.arange(first[-1]) - np.repeat(first[:-1], pieces)
    return raw, np.repeat(begin, pieces) + inside * CHUNK, np.repeat(begin + size, pieces), first


def chunk_bytes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Bytes of the chunks, zero beyond their text."""
    at = start[:, None] + np.arange(CHUNK + WIDTH)
    return np.where(at < end[:, None], raw[np.minimum(at, len(raw) - 1)], 0)


class Net:
    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        draw = lambda *shape: rng.standard_normal(shape).astype(np.float32)
        self.p = {
            "embed": draw(256, EMBED) * 0.5, "conv": draw(WIDTH * EMBED, FILTERS) * np.float32((WIDTH * EMBED) ** -0.5),
            "bias": np.zeros(FILTERS, np.float32), "out": draw(2 * FILTERS) * np.float32(0.1), "shift": np.zeros(1, np.float32),
        }

    def windows(self, b: np.ndarray) -> np.ndarray:
        """Vectors of the bytes, flat, with a tail so that every phase has whole rows."""
        x = self.p["embed"][b].reshape(-1, EMBED)
        return np.concatenate([x, np.zeros((WIDTH, EMBED), np.float32)])

    def answers(self, flat: np.ndarray, n: int, phase: int) -> np.ndarray:
        """Filters on the windows that start at ``phase`` modulo the width: (chunks, windows, filters), no copy of the windows."""
        rows = n * (CHUNK // WIDTH + 1)
        seen = flat[phase : phase + rows * WIDTH].reshape(rows, WIDTH * EMBED)
        return (seen @ self.p["conv"]).reshape(n, -1, FILTERS)[:, :-1]

    def strongest(self, b: np.ndarray) -> np.ndarray:
        flat, n = self.windows(b), len(b)
        best = self.answers(flat, n, 0)
        for phase in range(1, WIDTH):
            np.maximum(best, self.answers(flat, n, phase), out=best)
        return best.max(axis=1)

    def pooled(self, top: np.ndarray, first: np.ndarray) -> np.ndarray:
        h = np.tanh(top + self.p["bias"])
        return np.concatenate([np.maximum.reduceat(h, first[:-1]), np.add.reduceat(h, first[:-1]) / np.diff(first)[:, None]], axis=1)

    def score(self, texts: list[bytes]) -> np.ndarray:
        """Probability of label 1 for each text."""
        if not texts:
            return np.zeros(0)
        raw, start, end, first = cut_up(texts)
        top = np.concatenate([self.strongest(chunk_bytes(raw, start[i : i + SLAB], end[i : i + SLAB])) for i in range(0, len(start), SLAB)])
        z = self.pooled(top, first).astype(np.float64) @ self.p["out"] + self.p["shift"][0]
        return np.round(1 / (1 + np.exp(-np.clip(z, -30, 30))), 6)

    def gradients(self, b: np.ndarray, first: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss. Only the window with a chunk's largest answer is taught."""
        n, p = len(b), self.p
        flat = self.windows(b)
        every = np.stack([self.answers(flat, n, k) for k in range(WIDTH)], axis=2).reshape(n, CHUNK, FILTERS)  # by start
        at = every.argmax(axis=1)
        h = np.tanh(np.take_along_axis(every, at[:, None], axis=1)[:, 0] + p["bias"])
        size = np.diff(first)
        most, mean = np.maximum.reduceat(h, first[:-1]), np.add.reduceat(h, first[:-1]) / size[:, None]
        seen = np.concatenate([most, mean], axis=1)
        dz = ((1 / (1 + np.exp(-(seen @ p["out"] + p["shift"][0]))) - y) / len(y)).astype(np.float32)
        own = np.repeat(np.arange(len(y)), size)
        won = (h == most[own]).astype(np.float32)
        won /= np.add.reduceat(won, first[:-1])[own]  # equal chunks share
        dh = dz[own, None] * (p["out"][FILTERS:] / size[own, None].astype(np.float32) + p["out"][:FILTERS] * won)
        da = dh * (1 - h * h)
        start = np.arange(n)[:, None] * (CHUNK + WIDTH) + at
        rows = (start[..., None] + np.arange(WIDTH)).reshape(n, FILTERS, WIDTH)
        x = flat[rows].reshape(n, FILTERS, WIDTH * EMBED)
        dx = (da[..., None] * p["conv"].T[None]).reshape(-1, EMBED)
        codes = b.reshape(-1)[np.minimum(rows, b.size - 1)].reshape(-1)
        embed = np.stack([np.bincount(codes, dx[:, e], 256) for e in range(EMBED)], axis=1).astype(np.float32)
        return {"embed": embed, "conv": np.einsum("cf,cfk->kf", da, x), "bias": da.sum(0), "out": seen.T @ dz, "shift": dz.sum(keepdims=True)}

    def fit(self, texts: list[bytes], y: np.ndarray, seed: int = 5) -> Net:
        """Adam over batches of whole texts, each of about ``BATCH_CHUNKS`` chunks (one text at least)."""
        rng = np.random.default_rng(seed)
        mean, square = ({k: np.zeros_like(v) for k, v in self.p.items()} for _ in range(2))
        step = 0
        need = np.array([max(1, -(-len(t) // CHUNK)) for t in texts])
        epochs = max(EPOCHS, -(-LEAST_BATCHES * BATCH_CHUNKS // int(need.sum())))
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            group = np.cumsum(need[order]) // BATCH_CHUNKS
            for own in np.split(order, np.flatnonzero(np.diff(group)) + 1):
                raw, start, end, first = cut_up([texts[i] for i in own])
                step += 1
                rate = RATE * (1 - epoch / epochs)
                for k, g in self.gradients(chunk_bytes(raw, start, end), first, y[own]).items():
                    g = g + DECAY * self.p[k]
                    mean[k] += 0.1 * (g - mean[k])
                    square[k] += 0.01 * (g * g - square[k])
                    self.p[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
        return self


class Share:
    """What stands in for a network where one class has no rows."""

    def __init__(self, share: float):
        self.share = share

    def score(self, texts: list[bytes]) -> np.ndarray:
        return np.full(len(texts), self.share)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> DataFrame:
    """(text, y): at most ``rows`` of each class, in the order of a hash."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull()).select("doc_id", F.col(label).cast("int").alias("y"))
    out = None
    for y in (0, 1):
        ids = known.where(F.col("y") == y).distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * rows)
        # at most 2 * rows ids
        found = docs.where(F.octet_length("text") <= most_bytes).select("doc_id", "text").join(F.broadcast(ids), "doc_id")
        found = found.orderBy(F.xxhash64("doc_id", "text"), "text").limit(rows).select("text", "y")
        out = found if out is None else out.unionAll(found)
    return out


def train(docs: DataFrame, labels: DataFrame, label: str = "quality") -> Net | Share:
    """The network for a 0/1 column of ``labels``. Runs when called; what comes back is the weights."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("doc_id").isNotNull())
    n = known.agg(*[F.count(F.when(F.col(label) == y, 1)).alias(f"n{y}") for y in (0, 1)]).first()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        texts, y = [], []
        for batch in batches:
            texts += texts_of(batch.column("text"))
            y += batch.column("y").to_pylist()
        y = np.array(y, np.float32)
        if len(set(y.tolist())) == 2:
            net = Net().fit(texts, y)
            taught = float(y.sum() / (len(y) - y.sum()))
            net.p["shift"] = net.p["shift"] + np.float32(np.log((n.n1 + 1) / (n.n0 + 1)) - np.log(taught))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(net.p)], pa.binary())], names=["weights"])

    got = training_rows(docs, labels, label).coalesce(1).mapInArrow(run, "weights binary").first()
    if got is None:
        return Share((n.n1 + 1) / (n.n0 + n.n1 + 2))
    net = Net()
    net.p = pickle.loads(bytes(got.weights))
    return net


def score(docs: DataFrame, net: Net | Share, out: str = "score") -> DataFrame:
    """Adds the probability of label 1 to every row."""
    names = [c for c in docs.columns if c != out]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(net.score(texts), pa.float64())], names=[*names, out])

    return docs.mapInArrow(run, T.StructType([*(docs.schema[c] for c in names), T.StructField(out, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame, label: str = "quality") -> DataFrame:
    """All documents with held_out, score and predicted."""
    scored = score(docs, train(docs, labels, label))
    return scored.withColumn("held_out", held_out(F.col("doc_id"))).withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
