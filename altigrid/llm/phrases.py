"""Phrase collocation mining by sampling, a full pass and a closing of the border.

1. A sample of the rows (by hash) proposes phrases that are frequent in it at a lowered threshold, of fewer
   than ``MOST_WORDS`` words (longer ones admit nothing). The set is closed: parts of a member are members.
2. One pass over all rows counts exactly every member and the negative border: all single words, and the
   phrases whose first part and last part are members while they are not.
3. A border phrase found to be frequent is a failure of the sample. The failures join the members, and a
   pass counts the phrases that this newly admits, until no failure is left. Then every frequent phrase has
   been counted, whatever the sample held.

Members reach the tasks as a bitmap of hashes of fixed largest size; a false member only means that some
more phrases are counted. Phrases are counted per batch first and travel as texts with their counts.
Texts are cut at piece ends, so a long text is taken in stretches of ``STRETCH`` bytes (a longer piece whole).

Defined results: a null text has no words, a null language is ``und``; rows are counted as often as they
are there; no frequent phrase means no row. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.broadcast import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from altigrid.llm.arrays import BASE, BASE_INVERSE, U, chunks, mix, powers, texts_of
from altigrid.model import cut

MOST_WORDS = 4
LEAST_COUNT = 30
TOP = 2_000
SAMPLE_SHARE = 0.25
#: The sample's threshold as a share of what it would expect of a phrase at the threshold. A phrase that misses
#: it costs part of a further pass; one that passes it needlessly costs the counts of what it admits.
LOWERED = 0.8
STRETCH, BATCH_BYTES, BATCH_ROWS = 1_000_000, 2_500_000, 50_000
BITMAP_BITS = 1 << 27
HASHED_BYTES = 1_000_000
_STOPS = b".,;:!?\x0b\x0c\r"
#: A to Z folded, tab as space, every piece end as line end.
FOLD = bytes(10 if c in _STOPS else 32 if c == 9 else c for c in range(256)).lower()
ODD = U(0x9FB21C651E98DF25)


def stretches(text: bytes, limit: int = STRETCH) -> Iterator[bytes]:
    """The folded text in parts of about ``limit`` bytes, cut at piece ends only."""
    text = text.translate(FOLD)
    at = 0
    while len(text) - at > limit:
        end = text.rfind(b"\n", at, at + limit)
        if end < 0:
            end = text.find(b"\n", at + limit)
        if end < 0:
            break
        yield text[at:end]
        at = end + 1
    yield text[at:]


class Pieces:
    """Words of folded texts as offsets into one buffer, in which words are parted by one space.

    ``room[i]`` is the number of words from word i to the end of its piece.
    """

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        blank = (raw == 32) | (raw == 10)
        keep = ~blank
        keep[1:] |= blank[1:] & ~blank[:-1]
        keep[0] = not blank[0]
        self.buf = np.where(blank, np.uint8(32), raw)[keep]
        self.end = np.flatnonzero(blank[keep])
        self.start = np.concatenate([[0], self.end[:-1] + 1]) if len(self.end) else np.zeros(0, np.int64)
        # the piece of a word is the number of line ends before its end mark; a line end that is the mark itself comes after it
        mark = np.flatnonzero(keep & blank)
        lines = np.cumsum(raw == 10, dtype=np.int32)
        piece = lines[mark] - (raw[mark] == 10)
        last = np.flatnonzero(np.append(piece[1:] != piece[:-1], True)) if len(piece) else np.zeros(0, np.int64)
        self.room = np.repeat(last, np.diff(np.concatenate([[-1], last]))) - np.arange(len(piece)) + 1

    def hashes(self) -> np.ndarray:
        """One per word, in stretches of words, as the sums are eight times as large as the text."""
        out, i = np.zeros(len(self.end), np.uint64), 0
        while i < len(out):
            base = self.start[i]
            j = max(i + 1, int(np.searchsorted(self.end, base + HASHED_BYTES)))
            own = self.buf[base : self.end[j - 1]]
            total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((own.astype(np.uint64) + U(1)) * powers(BASE, len(own)), dtype=np.uint64)])
            lo, hi = self.start[i:j] - base, self.end[i:j] - base
            out[i:j] = mix((total[hi] - total[lo]) * powers(BASE_INVERSE, len(own))[lo] + (hi - lo).astype(np.uint64))
            i = j
        return out

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """Texts of the k-word phrases that begin at the given words."""
        lo, size = self.start[at], self.end[at + k - 1] - self.start[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        out = np.empty(ends[-1], np.uint8)
        for i in range(0, len(at), 65_536):
            j = min(i + 65_536, len(at))
            take = np.arange(ends[i], ends[j]) + np.repeat(lo[i:j] - ends[i:j], size[i:j])
            out[ends[i] : ends[j]] = self.buf[take]
        return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(out)])


def longer(h: np.ndarray, words: np.ndarray, k: int) -> np.ndarray:
    """Hashes of k-word phrases from those of k - 1 words and of words (shorter by one)."""
    return mix(h[:-1] * ODD + words[k - 1 :][: len(h) - 1]) if len(h) > 1 else np.zeros(0, np.uint64)


def phrase_hash(phrases: list[bytes]) -> np.ndarray:
    """The same hashes, of space-joined phrases."""
    p = Pieces(phrases)
    h = words = p.hashes()
    room = p.room
    first = np.flatnonzero(np.append(True, room[:-1] == 1)) if len(room) else np.zeros(0, np.int64)
    size = room[first] if len(room) else room
    out = np.zeros(len(first), np.uint64)
    for k in range(1, int(size.max(initial=0)) + 1):
        h = words if k == 1 else longer(h, words, k)
        out[size == k] = h[first[size == k]]
    return out


class Members:
    """Bitmap of phrase hashes."""

    def __init__(self, bits: int, words: np.ndarray | None = None):
        self.shift = U(64 - (bits.bit_length() - 1))
        self.words = np.zeros(bits // 64, np.uint64) if words is None else words

    def has(self, h: np.ndarray) -> np.ndarray:
        at = (h * ODD) >> self.shift
        return (self.words[(at >> U(6)).astype(np.int64)] >> (at & U(63))) & U(1) == 1


def bitmap(phrases: DataFrame, bits: int) -> Members:
    """Members of a table's phrases; each segment is made in a task, and all together have ``bits`` bits."""
    out = Members(bits)
    per = min(bits, 1 << 20)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (phrase_hash(texts_of(batch.column("phrase"))) * ODD) >> out.shift
            at = np.unique(at).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at // per), pa.array(at % per)], names=["segment", "at"])

    def gather(t: pd.DataFrame) -> pd.DataFrame:
        flags = np.zeros(per, np.uint8)
        flags[t["at"].to_numpy()] = 1
        return pd.DataFrame({"segment": t["segment"][:1], "raw": [np.packbits(flags, bitorder="little").tobytes()]})

    at = phrases.select("phrase").mapInArrow(place, "segment bigint, at bigint").distinct()
    for r in at.groupBy("segment").applyInPandas(gather, "segment bigint, raw binary").toLocalIterator():
        out.words[r.segment * per // 64 : (r.segment + 1) * per // 64] = np.frombuffer(bytes(r.raw), np.uint64)
    return out


@dataclass
class Plan:
    """Which phrases a pass counts: of ``first`` to ``most`` words, with members, if any, of up to ``known`` words.

    A phrase counts if its first and its last part (all but one word) are members; beyond ``known`` words, if
    these parts count themselves. With ``had``, what those members admitted already is left out.
    """

    have: Broadcast | None = None
    had: Broadcast | None = None
    known: int = MOST_WORDS
    first: int = 1
    most: int = MOST_WORDS


def counted(texts: list[bytes], plan: Plan) -> Iterator[tuple[int, pa.Array, np.ndarray]]:
    """(words, phrases, counts) of folded texts for each number of words."""
    have, had = plan.have and plan.have.value, plan.had and plan.had.value
    p = Pieces(texts)
    words = h = p.hashes()
    left = before = None  # of the phrases of k - 1 words: do they admit longer ones, and did they before
    for k in range(1, plan.most + 1):
        if k > 1:
            h = longer(h, words, k)
        if not len(h):
            break
        ok = p.room[: len(h)] >= k
        if k > 1 and have is not None:
            ok &= left[:-1] & left[1:]
        new = ok
        if have is not None:
            if had is not None:
                new = ok & ~(before[:-1] & before[1:]) if k > 1 else np.zeros(len(h), bool)
                before = had.has(h)
            left = have.has(h) if k <= plan.known else ok
        at = np.flatnonzero(new)
        if len(at) and k >= plan.first:
            own = h[at]
            order = np.argsort(own, kind="stable")
            head = np.flatnonzero(np.append(True, own[order][1:] != own[order][:-1]))
            yield k, p.phrases(at[order[head]], k), np.diff(np.append(head, len(at)))


def phrase_counts(docs: DataFrame, plan: Plan) -> DataFrame:
    """(lang, phrase, n) summed over all rows; where single words are counted, the empty phrase has their number."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        size: dict[str, int] = {}

        def flush(lang: str) -> Iterator[pa.RecordBatch]:
            size.pop(lang)
            for k, names, n in counted(held.pop(lang), plan):
                if k == 1:
                    yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([""]), pa.array([int(n.sum())])], names=["lang", "phrase", "n"])
                own = pa.RecordBatch.from_arrays([pa.array([lang]).take(pa.array(np.zeros(len(n), np.int32))), names, pa.array(n)], names=["lang", "phrase", "n"])
                for at in range(0, len(n), BATCH_ROWS):
                    yield own.slice(at, BATCH_ROWS)

        for batch, texts in chunks(batches, limit=STRETCH):
            for lang, t in zip(batch.column("lang").to_pylist(), texts, strict=True):
                for part in stretches(t):
                    held.setdefault(lang, []).append(part)
                    size[lang] = size.get(lang, 0) + len(part)
                    if size[lang] >= BATCH_BYTES:
                        yield from flush(lang)
            while sum(size.values()) > 2 * BATCH_BYTES:  # many languages
                yield from flush(max(size, key=size.get))
        for lang in list(held):
            yield from flush(lang)

    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text")
    # batches are counted already and most of their phrases are in no other of the task, so rows go to their key at once
    return rows.mapInArrow(run, "lang string, phrase string, n bigint").repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def n_words(phrase: str = "phrase") -> F.Column:
    return F.length(phrase) - F.length(F.replace(phrase, F.lit(" "))) + 1


def lacking(have: Broadcast):
    """Phrases that the bitmap does not have."""
    return F.pandas_udf(lambda phrase: pd.Series(~have.value.has(phrase_hash([x.encode() for x in phrase]))), "boolean")


def frequent_phrases(docs: DataFrame, least: int = LEAST_COUNT, share: float = SAMPLE_SHARE, bits: int = BITMAP_BITS) -> DataFrame:
    """(lang, phrase, n) of all phrases of up to ``MOST_WORDS`` words found ``least`` times or more; the empty phrase has all words.

    Runs its passes when called. Every count is over all rows.
    """
    spark = docs.sparkSession
    drawn = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) < int(share * (1 << 20)))
    low = max(1, int(least * share * LOWERED))

    def shared(rows: DataFrame) -> tuple[Broadcast, int]:
        # eight bits a member, as far as the largest size goes
        wide = min(bits, max(1 << 16, 1 << (8 * rows.count()).bit_length()))
        return spark.sparkContext.broadcast(bitmap(rows, wide)), wide

    # the sample is mined in two steps: what is rare as a pair is not counted in longer phrases
    members = cut(phrase_counts(drawn, Plan(most=2)).where((F.col("n") >= low) & (F.col("phrase") != "")).select("phrase"))
    pairs, _ = shared(members)
    members = members.union(cut(phrase_counts(drawn, Plan(pairs, known=2, first=3, most=MOST_WORDS - 1)).where(F.col("n") >= low).select("phrase")))
    have, wide = shared(members)
    counts = cut(phrase_counts(docs, Plan(have)).where((F.col("n") >= least) | (F.col("phrase") == "")))
    parts, new = [counts], counts.where(F.col("phrase") != "")
    while True:
        # a phrase of most words is part of no other
        failed = cut(new.where(n_words() < MOST_WORDS).where(lacking(have)("phrase")))
        if failed.isEmpty():
            break
        more, had = bitmap(failed, wide), have
        more.words |= had.value.words
        have = spark.sparkContext.broadcast(more)
        new = cut(phrase_counts(docs, Plan(have, had)).where(F.col("n") >= least))
        parts.append(new)
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def collocations(docs: DataFrame, least: int = LEAST_COUNT, top: int = TOP, share: float = SAMPLE_SHARE) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: each language's best phrases of two words or more."""
    known = cut(frequent_phrases(docs, least, share).withColumn("k", F.when(F.col("phrase") == "", 0).otherwise(n_words())))
    total = known.where("k = 0").select("lang", F.col("n").alias("total"))
    a = known.where("k > 1").withColumnRenamed("n", "a")
    head = lambda k: F.call_function("substring_index", F.col("phrase"), F.lit(" "), k)
    cuts = a.select("lang", "phrase", "a", "k", F.explode(F.sequence(F.lit(1), F.col("k") - 1)).alias("at"))
    cuts = cuts.withColumn("first", head(F.col("at"))).withColumn("rest", head(F.col("at") - F.col("k")))
    half = lambda name, out: known.select("lang", F.col("phrase").alias(name), F.col("n").alias(out))
    cuts = cuts.join(half("first", "l"), ["lang", "first"]).join(half("rest", "r"), ["lang", "rest"])
    # whole numbers over 64 bits
    wide = lambda c: c.cast("decimal(20,0)")
    cuts = cuts.withColumn("_a", wide(F.col("a")) * F.lit(2_000_000).cast("decimal(8,0)")).withColumn("_b", wide(F.col("l") + F.col("r")))
    cuts = cuts.withColumn("score", F.expr("_a div _b").cast("bigint"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "a", "l", "r")).alias("c")).select("lang", "phrase", "c.*")

    def inside(k: int, of: int) -> list:
        return [F.substring_index(head(F.lit(i + k)), " ", -k) for i in range(of - k + 1)]

    parts = F.when(F.col("k") == 3, F.array(*inside(2, 3))).otherwise(F.array(*inside(2, 4), *inside(3, 4)))
    hull = a.where("k > 2").select("lang", F.explode(parts).alias("phrase"), "a").groupBy("lang", "phrase").agg(F.max("a").alias("_hull"))
    left = best.join(hull, ["lang", "phrase"], "left").where(F.col("_hull").isNull() | (100 * F.col("_hull") < 80 * F.col("a")))
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    # as a plain row number, so that the limit also holds before the shuffle by language
    ranked = left.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(total, "lang").select("lang", F.col("rank").cast("bigint").alias("rank"), "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
