"""Ranked lexical search by dense blocked multiplication: item tiles times document tiles.

1. Items become (term, times) rows and are taken in groups of bounded size. A group has one vocabulary.
2. One pass over the documents keeps, for each, its length in terms and its counts of the group's terms;
   the number of documents, their total length and each term's document frequency follow from that table.
3. A tile of items has a compact vocabulary of its own, cut into blocks. Documents are taken in tiles:
   per block, a dense matrix of document impacts is multiplied by the dense matrix of item weights in
   float64. All numbers are whole and a block's sums stay below 2**53, so each product is exact in any
   order of summation; blocks are added as 64-bit integers.
4. Every task keeps the best ``k`` documents of each item, those tied with the last one compared by id,
   and the tasks' lists are ranked once more.

The one thing that is broadcast is a group (at most ``GROUP_BYTES`` of item terms); more items mean more
groups, each with its own pass. Scores are those of the contract of ``op11``: ``weight`` and ``impact``.

Defined results: a text without terms (null included) is no candidate, an item without terms has no
rows; items of equal item_id are ranked separately, each with its own rows; documents of equal doc_id
are candidates of their own; a null doc_id comes after all others of its score. Other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from altigrid.llm.arrays import chunks
from altigrid.model import cut

TOP = 20
GROUP_BYTES = 32_000_000
TILE_ITEMS, TILE_DOCS, BLOCK_TERMS = 256, 512, 2_048
#: An impact is below a million, so weights of a block may add up to this.
BLOCK_WEIGHT = (1 << 53) // 1_000_000 - 1
#: ASCII but for digits and letters parts terms; A to Z are folded; bytes of other characters stay.
FOLD = bytes(c if c > 127 or chr(c).isalnum() else 32 for c in range(256)).lower()


def terms(text: bytes) -> list[bytes]:
    return text.translate(FOLD).split()


def weight(df: int, n_docs: int) -> int:
    """Rarity of a term, as a whole number."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def item_terms(items: DataFrame) -> DataFrame:
    """item_id with its distinct terms and how often it has each; items without terms have no row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            found = [Counter(terms(t)) for t in texts]
            keep = [i for i, c in enumerate(found) if c]
            yield pa.RecordBatch.from_arrays(
                [batch.column("item_id").take(pa.array(keep, pa.int64())), pa.array([list(found[i]) for i in keep], pa.list_(pa.binary())),
                 pa.array([list(found[i].values()) for i in keep], pa.list_(pa.int64()))], names=["item_id", "terms", "times"])

    return items.select("item_id", "text").mapInArrow(run, "item_id bigint, terms array<binary>, times array<bigint>")


@dataclass
class Group:
    """Items with one vocabulary: entry j says that ``item[j]`` has ``term[j]`` ``times[j]`` times."""

    ids: list[int | None]
    vocab: dict[bytes, int]
    item: np.ndarray
    term: np.ndarray
    times: np.ndarray


def item_groups(items: DataFrame, limit: int = GROUP_BYTES) -> Iterator[Group]:
    """Groups of items as they stream by; the driver holds one group at a time."""
    ids, rows, size = [], [], 0

    def group() -> Group:
        vocab: dict[bytes, int] = {}
        entries = [(i, vocab.setdefault(bytes(t), len(vocab)), n) for i, r in enumerate(rows) for t, n in zip(r.terms, r.times, strict=True)]
        item, term, times = np.array(entries, np.int64).reshape(-1, 3).T
        return Group(ids, vocab, item, term, times)

    for r in item_terms(items).toLocalIterator():
        ids.append(r.item_id)
        rows.append(r)
        size += sum(len(t) + 40 for t in r.terms)
        if size >= limit:
            yield group()
            ids, rows, size = [], [], 0
    if rows:
        yield group()


def term_counts(docs: DataFrame, vocab: dict[bytes, int]) -> DataFrame:
    """Per document with a term: doc_id, n (its terms, repeats included), and its counts of the vocabulary's terms."""
    shared = docs.sparkSession.sparkContext.broadcast(vocab)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = shared.value.get
        for batch, texts in chunks(batches):
            keep, n, size, at, tf = [], [], [], [], []
            for i, t in enumerate(texts):
                own = terms(t)
                if own:
                    hits = Counter(map(place, own))
                    hits.pop(None, None)
                    keep.append(i)
                    n.append(len(own))
                    size.append(len(hits))
                    at += hits
                    tf += hits.values()
            ends = pa.array(np.cumsum([0, *size]), pa.int32())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").take(pa.array(keep, pa.int64())), pa.array(n, pa.int64()), pa.ListArray.from_arrays(ends, pa.array(at, pa.int32())),
                 pa.ListArray.from_arrays(ends, pa.array(tf, pa.int64()))], names=["doc_id", "n", "term", "tf"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id bigint, n bigint, term array<int>, tf array<bigint>")


def blocks(item: np.ndarray, term: np.ndarray, value: np.ndarray, n_items: int, most: int = BLOCK_WEIGHT, width: int = BLOCK_TERMS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(sorted terms, dense terms x items) of a tile: no column of a block adds up to more than ``most``.

    An entry over ``most`` is dealt over several layers; a block holds terms of one layer.
    """
    layers = np.maximum(1, -(-value // most))
    part = np.repeat(np.arange(len(value)), layers)
    layer = np.arange(len(part)) - np.repeat(np.cumsum(layers) - layers, layers)
    item, term = item[part], term[part]
    value = np.minimum(most, value[part] - layer * most)
    for one in range(int(layers.max(initial=1))):
        own = layer == one
        names, col = np.unique(term[own], return_inverse=True)
        heaviest = np.zeros(len(names), np.int64)
        np.maximum.at(heaviest, col, value[own])
        first, total = [0], 0
        for j, h in enumerate(heaviest.tolist()):
            if j - first[-1] == width or total + h > most:
                first.append(j)
                total = 0
            total += h
        for lo, hi in zip(first, [*first[1:], len(names)], strict=True):
            if hi > lo:
                dense = np.zeros((hi - lo, n_items))
                here = (col >= lo) & (col < hi)
                dense[col[here] - lo, item[own][here]] = value[own][here]
                yield names[lo:hi], dense


class Best:
    """The best ``k`` (score, doc_id) of each item so far; a null id is last among equals."""

    def __init__(self, n_items: int, k: int):
        self.k, self.n = k, n_items
        self.item, self.score, self.id = (np.zeros(0, np.int64) for _ in range(3))
        self.blank = np.zeros(0, bool)
        self.least = np.ones(n_items, np.int64)

    def add(self, item: np.ndarray, score: np.ndarray, ids: np.ndarray, blank: np.ndarray) -> None:
        item, score = np.concatenate([self.item, item]), np.concatenate([self.score, score])
        ids, blank = np.concatenate([self.id, ids]), np.concatenate([self.blank, blank])
        order = np.lexsort((ids, blank, -score, item))
        start = np.searchsorted(item[order], np.arange(self.n))
        rank = np.arange(len(order)) - start[item[order]]
        stay = order[rank < self.k]
        self.item, self.score, self.id, self.blank = item[stay], score[stay], ids[stay], blank[stay]
        last = order[rank == self.k - 1]
        self.least[item[last]] = score[last]  # an equal score may still win by its id


def _scored(group: Group, value: np.ndarray, n_docs: int, length: int, k: int):
    """Task side: every document tile against every item tile; the best of each item at the end."""
    tiles = [(lo, min(lo + TILE_ITEMS, len(group.ids))) for lo in range(0, len(group.ids), TILE_ITEMS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(len(group.ids), k)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, blank = batch.column("doc_id").fill_null(0).to_numpy(), ~batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            m = np.array([75 + 25 * n * n_docs // length for n in batch.column("n").to_pylist()], np.int64)
            hits = batch.column("term")
            ends = hits.offsets.to_numpy()
            term, tf = (batch.column(c).values.to_numpy()[ends[0] : ends[-1]] for c in ("term", "tf"))
            ends = ends - ends[0]
            row = np.repeat(np.arange(batch.num_rows), np.diff(ends))
            impact = (1_000_000_000 * tf) // (1_000 * tf + 12 * m[row])
            for lo, hi in tiles:
                own = (group.item >= lo) & (group.item < hi)
                parts = list(blocks(group.item[own] - lo, group.term[own], value[own], hi - lo))
                for a in range(0, batch.num_rows, TILE_DOCS):
                    b = min(a + TILE_DOCS, batch.num_rows)
                    t, i, x = term[ends[a] : ends[b]], row[ends[a] : ends[b]] - a, impact[ends[a] : ends[b]]
                    total = np.zeros((b - a, hi - lo), np.int64)
                    for names, dense in parts:
                        at = np.minimum(np.searchsorted(names, t), len(names) - 1)
                        there = names[at] == t
                        used, col = np.unique(at[there], return_inverse=True)
                        if len(used):
                            tile = np.zeros((b - a, len(used)))
                            tile[i[there], col] = x[there]
                            total += (tile @ dense[used]).astype(np.int64)
                    r, c = np.nonzero(total >= best.least[lo:hi])
                    if len(r):
                        best.add(c + lo, total[r, c], ids[a + r], blank[a + r])
        names = ["item", "item_id", "doc_id", "score"]
        yield pa.RecordBatch.from_arrays(
            [pa.array(best.item), pa.array([group.ids[i] for i in best.item.tolist()], pa.int64()), pa.array(best.id, mask=best.blank), pa.array(best.score)], names=names)

    return run


def search(docs: DataFrame, items: DataFrame, k: int = TOP, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """item_id, rank, doc_id, score of the ``k`` best documents of every item. Runs its counting passes when called."""
    spark = docs.sparkSession
    out = spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    for group in item_groups(items, group_bytes):
        counts = cut(term_counts(docs, group.vocab))
        n_docs, length = counts.agg(F.count(F.lit(1)), F.sum("n")).first()
        if not n_docs:
            continue
        # a row per term of the group at most
        df = np.zeros(len(group.vocab), np.int64)
        for r in counts.select(F.explode("term").alias("term")).groupBy("term").count().collect():
            df[r["term"]] = r["count"]
        weights = np.array([weight(x, n_docs) for x in df.tolist()], np.int64)
        found = counts.mapInArrow(_scored(group, weights[group.term] * group.times, n_docs, length, k), "item bigint, item_id bigint, doc_id bigint, score bigint")
        best = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        found = found.withColumn("_some", F.spark_partition_id() % 64)
        for by in (["item", "_some"], ["item"]):  # first the lists of some tasks, then theirs
            found = found.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*best))).where(F.col("rank") <= k)
        out = out.unionByName(found.select("item_id", "rank", "doc_id", "score"))
    return out
