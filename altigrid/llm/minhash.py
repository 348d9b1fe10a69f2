"""MinHash near-dedup by a multi-index Hamming join.

1. Every text gives its set of word shingles, the set's 128-bit name and a signature of ``SYMBOLS``
   minima, ``8`` bits each. Texts with equal sets form a class; one representative goes on.
2. Pairs at the similarity threshold differ in at most ``plan(threshold)`` symbols but for the stated
   chance. By pigeonhole, with that many errors over the chunks some chunk has one error at most; a
   chunk's allowed error is enumerated by leaving out each of its symbols in turn. So all pairs within
   the signature distance share a key.
3. Each representative is verified on full sets against the nearest of its keys' smallest members.
   These links leave few components apart.
4. Keys that still hold more than one component: their members are compared by signature (in blocks,
   what is outside the largest component against all), and components with a pair in reach form
   clusters. Within clusters all pairs across components are verified on full sets, in blocks.
   Tasks return links between components only, never all pairs of a group.
5. Components of all links, by alternating stars with a stored table per round.

A node is a class, so a row's result follows from its own text: rows with equal doc_id and unlike texts
may lie in different components, whatever the order of the rows.

Defined results: texts without words have an empty set and are linked with nothing. A component is
named by its smallest doc_id; a null doc_id names it only if all are null. Other input columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from altigrid.llm.arrays import U, Words, chunks, grams, mix
from altigrid.llm.lines import doc_key
from altigrid.model import cut, cut_measured

SYMBOLS = 64
MISS = 1e-6
BLOCK = 1024
PAIR_BLOCK = 512
#: Small groups share tasks of about so many rows, or bytes of text.
TASK_ROWS, TASK_BYTES = 20_000, 8_000_000
JUMPS = 3


def reach(threshold: float, symbols: int = SYMBOLS, miss: float = MISS) -> int:
    """Largest signature distance to search: a pair at the threshold exceeds it with chance ``miss``."""
    p, tail, d = 1 - threshold, 1.0, -1
    while tail > miss:
        d += 1
        tail -= math.comb(symbols, d) * p**d * (1 - p) ** (symbols - d)
    return d


def chunk_bounds(distance: int, symbols: int = SYMBOLS) -> list[tuple[int, int]]:
    """Chunks so many that ``distance`` errors leave one of them with a single error at most."""
    n = distance // 2 + 1
    edges = [symbols * i // n for i in range(n + 1)]
    return list(zip(edges, edges[1:], strict=False))


def sets_of(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle hash), distinct and sorted; short texts have one shingle of all their words."""
    w = Words(texts, lower=True)
    h, doc = w.hashes(), w.doc_of()
    g = grams(h, n)
    whole = doc[: len(g)] == doc[n - 1 :] if len(g) else np.zeros(0, bool)
    count = np.diff(w.first)
    short = np.flatnonzero((count > 0) & (count < n))
    extra = np.zeros(len(short), np.uint64)
    for i, d in enumerate(short.tolist()):
        part = h[w.first[d] : w.first[d + 1]]
        extra[i] = mix(grams(part, len(part)) + U(len(part)))[0]
    owner = np.concatenate([doc[: len(g)][whole], short])
    value = np.concatenate([g[whole], extra])
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    new = np.ones(len(value), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (value[1:] != value[:-1])
    return owner[new], value[new]


def signatures(value: np.ndarray, first: np.ndarray, symbols: int = SYMBOLS) -> np.ndarray:
    """One row of 8-bit symbols per run of ``value`` that starts at ``first``."""
    rng = np.random.default_rng(17)
    out = np.empty((len(first), symbols), np.uint8)
    low = (value >> U(32)).astype(np.uint32)
    for j, (a, b) in enumerate(rng.integers(1, 1 << 32, (symbols, 2), dtype=np.uint32)):
        v = (low ^ b) * np.uint32(a | 1)
        v ^= v >> np.uint32(15)
        v *= np.uint32(0x85EBCA6B)
        v ^= v >> np.uint32(13)
        out[:, j] = (np.minimum.reduceat(v, first) * np.uint32(0x9E3779B1)) >> np.uint32(24)
    return out


def _sketch(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in chunks(batches):
            owner, value = sets_of(texts, n)
            size = np.bincount(owner, minlength=len(texts))
            some = np.flatnonzero(size)
            first = (np.cumsum(size) - size)[some]
            s1, s2 = np.zeros(len(texts), np.int64), np.zeros(len(texts), np.int64)
            sig: list[bytes | None] = [None] * len(texts)
            if len(some):
                s1[some] = np.add.reduceat(mix(value), first).view(np.int64)
                s2[some] = np.add.reduceat(mix(value ^ U(0xA5A5A5A55A5A5A5A)), first).view(np.int64)
                for i, row in zip(some.tolist(), signatures(value, first), strict=True):
                    sig[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "_k1", "_k2")), pa.array(size.astype(np.int64)), pa.array(s1), pa.array(s2), pa.array(sig, pa.binary())],
                names=["doc_id", "k1", "k2", "n_shingles", "s1", "s2", "sig"])

    return run


def _keys(bounds: list[tuple[int, int]]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for lo in range(0, whole.num_rows, 4096):
                batch = whole.slice(lo, 4096)
                sig = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(batch.num_rows, -1).astype(np.uint64)
                keys = []
                for c, (a, b) in enumerate(bounds):
                    for gap in range(a, b):
                        k = np.full(len(sig), c * 256 + gap, np.uint64)
                        for j in range(a, b):
                            if j != gap:
                                k = mix(k * U(0x9FB21C651E98DF25) + sig[:, j] + U(1))
                        keys.append(k)
                n = len(keys)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.stack(keys, 1).ravel().view(np.int64)), pa.array(np.repeat(batch.column("rep").to_numpy(), n))], names=["key", "rep"])

    return run


def shingles(text: str | None, n: int) -> frozenset:
    """The full set, on words themselves."""
    w = (text or "").encode().lower().split()
    if 0 < len(w) < n:
        return frozenset([tuple(w)])
    return frozenset(zip(*(w[i:] for i in range(n)), strict=False))


def similar(a: frozenset, b: frozenset, percent: int) -> bool:
    """100 * intersection >= percent * union, in whole numbers."""
    both = len(a & b)
    return bool(a) and 100 * both >= percent * (len(a) + len(b) - both)


def verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The (a, b) whose full sets are similar. ``texts`` is (rep, text)."""

    @F.pandas_udf("boolean")
    def check(x: pd.Series, y: pd.Series) -> pd.Series:
        last, held, out = None, frozenset(), []
        for s, t in zip(x, y, strict=True):
            if t != last:
                last, held = t, shingles(t, n)
            out.append(similar(shingles(s, n), held, percent))
        return pd.Series(out, dtype=bool)

    one = pairs.join(texts.select(F.col("rep").alias("a"), F.col("text").alias("_ta")), "a")
    two = one.join(texts.select(F.col("rep").alias("b"), F.col("text").alias("_tb")), "b")
    return two.where(check("_ta", "_tb")).select("a", "b")


class Joined:
    """Union-find over the component numbers that one task sees."""

    def __init__(self):
        self.up: dict[int, int] = {}

    def root(self, x: int) -> int:
        while (y := self.up.get(x, x)) != x:
            self.up[x] = self.up.get(y, y)
            x = y
        return x

    def link(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


CONTRACT = 400_000


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of a stretch of rows become one link per node, to the smallest node that the stretch ties it to."""
    out, n = Joined(), 0

    def star() -> pa.RecordBatch:
        rows = [(x, out.root(x)) for x in list(out.up)]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in rows], pa.int64()), pa.array([y for _, y in rows], pa.int64())], names=["a", "b"])

    for batch in batches:
        for x, y in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            out.link(x, y)
        n += batch.num_rows
        if n >= CONTRACT:
            yield star()
            out, n = Joined(), 0
    yield star()


def components(links: DataFrame, rounds: int = 60) -> DataFrame:
    """(id, comp): the smallest id reachable, for every id that has a link.

    Each round contracts bounded stretches of rows, then makes a large and a small star (a minimum per
    node and a join each) and stores the result.
    """
    spark = links.sparkSession
    say = [F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")]
    edges, seen = cut_measured(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b"), *say)
    for _ in range(rounds):
        if not seen["n"]:
            return spark.createDataFrame([], "id bigint, comp bigint")
        near = edges.select("a", "b").mapInArrow(_contract, "a bigint, b bigint").where("a <> b")
        both = near.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("e")).select("e.*")
        # each node's smallest neighbour (or itself): first over all neighbours, then over the smaller ones
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(down, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges, now = cut_measured(small.select("e.*").where("a <> b").distinct(), *say)
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("a").alias("id"), F.col("b").alias("comp")).union(edges.select(F.col("b").alias("id"), F.col("b").alias("comp")).distinct())


def grid(members: DataFrame, by: str, block: int, shared: int) -> DataFrame:
    """Members dealt to (row block, column block) tasks so that each pair across components meets once or more.

    The largest component of a group needs no comparison with itself: only the others are rows; all are
    columns. Small groups have one block; they are dealt over ``shared`` tasks.
    """
    sizes = members.groupBy(by, "comp").agg(F.count(F.lit(1)).alias("n"))
    shape = sizes.groupBy(by).agg(F.sum("n").alias("_all"), F.max_by("comp", F.struct("n", "comp")).alias("_anchor"), F.max("n").alias("_most"), F.count(F.lit(1)).alias("_c"))
    shape = shape.where("_c > 1").select(by, "_anchor", F.ceil(F.col("_all") / block).cast("int").alias("_cols"), F.ceil((F.col("_all") - F.col("_most")) / block).cast("int").alias("_rows"))
    m = members.join(shape, by).withColumn("_h", F.abs(F.xxhash64("rep", F.lit(3)) % 1_000_003))
    row = m.where(F.col("comp") != F.col("_anchor")).select("*", (F.col("_h") % F.col("_rows")).cast("int").alias("_i"), F.explode(F.sequence(F.lit(0), F.col("_cols") - 1)).alias("_j"), F.lit(True).alias("_row"))
    col = m.select("*", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)).alias("_i"), (F.col("_h") % F.col("_cols")).cast("int").alias("_j"), F.lit(False).alias("_row"))
    task = F.when(F.col("_cols") == 1, F.pmod(F.xxhash64(by), F.lit(shared))).otherwise(F.xxhash64(by))
    return row.union(col).withColumn("_task", task)


_LINKS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def _each(table: pa.Table, by: str) -> Iterator[tuple[pa.Table, np.ndarray, np.ndarray, np.ndarray]]:
    """The groups of one task: (rows of the table, their components, row places, column places)."""
    key = table[by].to_numpy()
    order = np.argsort(key, kind="stable")
    for part in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        t = table.take(pa.array(part))
        row = t["_row"].to_numpy()
        yield t, t["comp"].to_numpy(), np.flatnonzero(row), np.flatnonzero(~row)


def _near(distance: int):
    def run(table: pa.Table) -> pa.Table:
        """Components with a pair of signatures in reach."""
        out = Joined()
        a, b = [], []
        for t, comp, rows, cols in _each(table, "key"):
            sig = np.frombuffer(b"".join(t["sig"].to_pylist()), np.uint8).reshape(len(comp), -1)
            for r in rows.tolist():
                c = comp[r]
                apart = cols[comp[cols] != c]
                for other in np.unique(comp[apart[(sig[apart] != sig[r]).sum(axis=1) <= distance]]).tolist():
                    if out.link(int(c), other):
                        a.append(int(c))
                        b.append(other)
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)

    return run


def _exact(n: int, percent: int):
    def run(table: pa.Table) -> pa.Table:
        """Components with a pair of similar full sets; one link per pair of components that are not yet joined here."""
        out = Joined()
        a, b = [], []
        for t, comp, rows, cols in _each(table, "cluster"):
            own = [shingles(x, n) for x in t["text"].to_pylist()]
            sizes = np.array([len(s) for s in own])
            where: dict[tuple, list[int]] = {}
            for c in cols.tolist():
                for s in own[c]:
                    where.setdefault(s, []).append(c)
            for r in rows.tolist():
                mine = out.root(int(comp[r]))
                if all(out.root(int(c)) == mine for c in np.unique(comp[cols])):
                    continue
                # intersections with every column at once, from the shingles' lists
                lists = [where[s] for s in own[r] if s in where]
                both = np.bincount(np.concatenate(lists), minlength=len(own)) if lists else np.zeros(len(own), np.int64)
                hit = cols[100 * both[cols] >= percent * (sizes[r] + sizes[cols] - both[cols])]
                for c in hit.tolist():
                    if both[c] and out.link(int(comp[r]), int(comp[c])):
                        a.append(int(comp[r]))
                        b.append(int(comp[c]))
        return pa.table([pa.array(a, pa.int64()), pa.array(b, pa.int64())], schema=_LINKS)

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept."""
    distance = reach(percent / 100)
    named = docs.select("doc_id", "text", *doc_key())
    sketch = cut(named.mapInArrow(_sketch(words), "doc_id bigint, k1 bigint, k2 int, n_shingles bigint, s1 bigint, s2 bigint, sig binary"))
    name = ["s1", "s2", "n_shingles"]
    # the row that stands for a class: of the smallest doc_id, null last
    stand = F.min(F.struct(F.col("doc_id").isNull().alias("blank"), "doc_id", "k1", "k2")).alias("stand")
    classes = sketch.where("n_shingles > 0").groupBy(*name).agg(stand, F.first("sig").alias("sig"))
    classes = cut(classes.select(*name, "stand", "sig", F.monotonically_increasing_id().alias("rep")))
    nodes = classes.select("rep", "sig")

    keys = nodes.mapInArrow(_keys(chunk_bounds(distance)), "key bigint, rep bigint")
    shared = keys.groupBy("key").agg(F.min("rep").alias("leader"), F.max("rep").alias("_top")).where("leader < _top").select("key", "leader")
    members = cut(keys.join(shared, "key"))

    @F.pandas_udf("int")
    def apart(x: pd.Series, y: pd.Series) -> pd.Series:
        m = lambda s: np.frombuffer(b"".join(s), np.uint8).reshape(len(s), -1)
        return pd.Series((m(x) != m(y)).sum(axis=1) if len(x) else [], dtype="int32")

    pairs = members.where("rep > leader").select(F.col("rep").alias("a"), F.col("leader").alias("b")).distinct()
    pairs = pairs.join(nodes.select(F.col("rep").alias("a"), F.col("sig").alias("_sa")), "a").join(nodes.select(F.col("rep").alias("b"), F.col("sig").alias("_sb")), "b")
    pairs = pairs.select("a", "b", apart("_sa", "_sb").alias("d")).where(F.col("d") <= distance)
    nearest = cut(pairs.groupBy("a").agg(F.min(F.struct("d", "b")).alias("m")).select("a", F.col("m.b").alias("b")))

    # texts of all members: what later steps verify on
    wanted = members.select("rep").distinct()
    wanted = classes.join(wanted, "rep", "left_semi").select("rep", F.col("stand.k1").alias("_k1"), F.col("stand.k2").alias("_k2"))
    texts = named.join(wanted, ["_k1", "_k2"]).groupBy("rep").agg(F.first("text").alias("text"))
    texts, held = cut_measured(texts, F.sum(F.octet_length("text")).alias("bytes"))
    links = cut(verified(nearest, texts, words, percent))
    # each text has one link at most, to a smaller id; following it a few times joins most of a component,
    # and what is left apart is only compared once more below
    first = links.select(F.col("a").alias("rep"), F.col("b").alias("comp"))
    for _ in range(JUMPS):
        onward = first.select(F.col("rep").alias("comp"), F.col("comp").alias("_on"))
        first = first.join(onward, "comp", "left").select("rep", F.coalesce("_on", "comp").alias("comp"))
    first = cut(first)
    first = first.union(first.select(F.col("comp").alias("rep"), "comp").distinct().join(first.select("rep"), "rep", "left_anti"))

    rest = members.select("key", "rep").join(first, "rep", "left").select("key", "rep", F.coalesce("comp", "rep").alias("comp"))
    mixed = rest.groupBy("key").agg(F.min("comp").alias("_lo"), F.max("comp").alias("_hi")).where("_lo < _hi").select("key")
    apart_rows, size = cut_measured(rest.join(mixed, "key").join(nodes, "rep"), F.count(F.lit(1)).alias("rows"))
    close = grid(apart_rows, "key", BLOCK, max(1, (size["rows"] or 0) // TASK_ROWS)).groupBy("_task", "_i", "_j").applyInArrow(_near(distance), "a bigint, b bigint")
    clusters = components(close).select(F.col("id").alias("comp"), F.col("comp").alias("cluster"))
    inside = apart_rows.select("rep", "comp").distinct().join(clusters, "comp")
    # every member of a clustered component may hold the link, also those whose keys were not mixed
    inside = first.join(clusters, "comp").select("rep", "comp", "cluster").union(inside.select("rep", "comp", "cluster")).distinct()
    ready = inside.join(texts, "rep")
    more = grid(ready, "cluster", PAIR_BLOCK, max(16, (held["bytes"] or 0) // TASK_BYTES)).groupBy("_task", "_i", "_j").applyInArrow(_exact(words, percent), "a bigint, b bigint")
    final = components(links.union(more)).withColumnRenamed("id", "rep")

    by_class = classes.select(*name, "rep", F.struct("stand.blank", "stand.doc_id").alias("own")).join(final, "rep", "left")
    first_id = by_class.where("comp is not null").groupBy("comp").agg(F.min("own").alias("least"))
    by_class = by_class.join(first_id, "comp", "left").select(*name, F.coalesce("least", "own")["doc_id"].alias("component_id"))
    known = sketch.select("doc_id", *name).join(by_class, name, "left")
    return known.select(
        "doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
