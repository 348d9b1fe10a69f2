"""Token ids as binary files: a shared zstandard dictionary, one frame per document, an offset index.

The encoder runs the tokenizers library once per distinct word of a chunk (white space always ends a
token of this kind of vocabulary) and takes each word's ids by its number among them. Documents are range-partitioned by doc_id,
so blocks are in ascending order; each block row holds the dictionary's hash, the documents' ids,
offsets and lengths, and one compressed frame per document. A short document is read by slicing its
frame out of the block. Files are written with Spark's own writer: a lost executor's block is written
again, and no task touches a local file.

Defined results: a null text encodes as an empty one; rows with equal doc_id stay in the order of
their text's hash; a null doc_id comes first.
"""

from __future__ import annotations

import itertools
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from altigrid.llm.arrays import chunks
from altigrid.model import scratch_path

END_ID = 1
CACHE_WORDS = 150_000
SAMPLE_DOCS = 2_000
DICTIONARY_BYTES = 65_536
BLOCK_BYTES = 1_000_000
LINE_WORDS = 256
#: Words of visible ASCII and of letters below U+0530 that are letters in every Unicode version in use, and stay one letter each when normalised.
STABLE = r"^[!-~\x{C0}-\x{D6}\x{D8}-\x{F6}\x{F8}-\x{12F}\x{131}-\x{24F}\x{388}-\x{38A}\x{38E}-\x{3A1}\x{3A3}-\x{3F5}\x{400}-\x{481}\x{48A}-\x{52F}]+$"
#: The vocabulary's own split of a word into parts.
PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"
#: How its special tokens begin.
SPECIAL = "<|"
#: Texts whose case the tokenizer alone may fold: a special token counts only as it is written, and T with a mark is not composed as t with it is.
UNFOLDED = r"<\||[A-Z]\p{M}"
#: Words that the vocabulary's normalisation leaves as they are: visible ASCII without capitals.
BARE = r"^[!-@\[-~]+$"
#: One token of the vocabulary; parts words whose number of tokens is not known beforehand.
PARTING = b"the"


def _bytes(column: pa.Array) -> list[bytes]:
    return column.view(pa.binary()).to_numpy(zero_copy_only=False).tolist()


class WordEncoder:
    """Ids of whole texts by the tokenizers library, with the ids of words kept between texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers

        self.tok, self.bare = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.bare.normalizer = normalizers.Sequence([])
        vocab = self.tok.get_vocab()
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        self.parting = np.zeros(len(self.ends), bool)
        self.parting[vocab[PARTING.decode() + "</w>"]] = True
        self.words: dict[bytes, bytes] = {}
        self.old: dict[bytes, bytes] = {}

    def _one(self, word: str) -> bytes:
        return np.array(self.tok.encode(word, add_special_tokens=False).ids, np.uint32).tobytes()

    def _batch(self, names: list[bytes], joint: str, stop: np.ndarray, keep: int, parts: np.ndarray | None = None, tok=None) -> None:
        """Words that share calls: ``joint`` parts them. A word's ids end with as many ids flagged by ``stop`` as ``parts``
        gives (one each, if not given); with keep 0 the flagged id follows them."""
        parts = np.ones(len(names), np.int64) if parts is None else parts
        for i in range(0, len(names), LINE_WORDS):
            group, last = names[i : i + LINE_WORDS], np.cumsum(parts[i : i + LINE_WORDS])
            line = joint.join([w.decode() for w in group]) + joint
            # one line at a time, as the library keeps text and place of every token
            ids = np.array((tok or self.tok).encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
            at = np.flatnonzero(stop[ids])
            if len(at) == last[-1]:
                raw, at = ids.tobytes(), at[last - 1]
                ends = 4 * (at + keep)
                starts = np.concatenate([[0], 4 * (at[:-1] + 1)])
                self.words.update(zip(group, [raw[a:b] for a, b in zip(starts.tolist(), ends.tolist(), strict=True)], strict=True))
            else:
                self.words.update((w, self._one(w.decode())) for w in group)

    def _learn(self, missing: list[bytes]) -> None:
        """A word of stable letters has a known number of parts, each with one end-of-word id; other words are parted by a word that none of them holds."""
        column = pa.array(missing, pa.binary()).view(pa.string())
        known = pc.and_(pc.match_substring_regex(column, STABLE), pc.invert(pc.match_substring(column, SPECIAL)))
        bare = pc.and_(known, pc.match_substring_regex(column, BARE))
        for own, tok in ((bare, self.bare), (pc.and_not(known, bare), self.tok)):
            plain = column.filter(own)
            self._batch(_bytes(plain), " ", self.ends, 1, pc.count_substring_regex(plain, PARTS).to_numpy().astype(np.int64), tok)
        others = _bytes(column.filter(pc.invert(known)))
        self._batch([w for w in others if PARTING not in w], f" {PARTING.decode()} ", self.parting, 0)
        self.words.update((w, self._one(w.decode())) for w in others if PARTING in w)

    def encode(self, texts: list[bytes]) -> list[np.ndarray]:
        """uint32 ids of each text."""
        if len(self.words) > CACHE_WORDS:  # what was used since the last turn stays within reach
            self.old, self.words = self.words, {}
        column = pa.array(texts, pa.binary()).view(pa.string())
        # the tokenizer folds case; A to Z are folded here, so fewer words are learned
        low, as_is = pc.ascii_lower(column), pc.match_substring_regex(column, UNFOLDED)
        split = pc.ascii_split_whitespace(pc.if_else(as_is, column, low) if pc.any(as_is).as_py() else low)
        coded = split.values.dictionary_encode()
        names = _bytes(coded.dictionary)
        del column, low
        missing = set(names).difference(self.words)
        missing.discard(b"")
        again = missing.intersection(self.old)
        self.words.update(zip(again, map(self.old.__getitem__, again), strict=True))
        missing -= again
        if missing:
            self._learn(list(missing))
        self.words[b""] = b""  # beside white space at an end of a text, and for an empty one
        ids = list(map(self.words.__getitem__, names))
        store = np.frombuffer(b"".join(ids), np.uint32)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        start, code, out = np.cumsum(size) - size, coded.indices.to_numpy(), []
        for a, b in itertools.pairwise(split.offsets.to_numpy().tolist()):
            own = code[a:b]
            each = size[own]
            upto = np.cumsum(each)
            out.append(store[np.repeat(start[own] - upto + each, each) + np.arange(upto[-1])])
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and vocabulary."""
    return WordEncoder(path)


def encoded(path: str, end_id: int, limit: int = 2_500_000):
    """Iterator helper: (rows, ids with the end id as uint32 arrays) per chunk of text."""
    end = np.array([end_id], np.uint32)

    def run(batches: Iterator[pa.RecordBatch]):
        for batch, texts in chunks(batches, limit=limit):
            yield batch, [np.concatenate([x, end]) for x in encoder(path).encode(texts)]

    return run


def train_dictionary(docs: DataFrame, path: str, sample_docs: int = SAMPLE_DOCS, size: int = DICTIONARY_BYTES) -> bytes:
    """Dictionary over the serialized ids of about ``sample_docs`` documents; empty if they are too few to train on.

    The sample bounds what the driver sees; the dictionary changes file size only, never a result.
    """
    n = docs.count()
    few = docs.select("text").sample(min(1.0, sample_docs / max(n, 1)), seed=11).limit(2 * sample_docs)
    ids = F.pandas_udf(lambda t: pd.Series([x.astype(np.uint16).tobytes()[:32_768] for x in encoder(path).encode([(s or "").encode() for s in t])]), "binary")
    rows = [bytes(r.ids) for r in few.select(ids("text").alias("ids")).toLocalIterator() if r.ids]
    try:
        return zstandard.train_dictionary(size, rows).as_bytes()
    except zstandard.ZstdError:
        return b""


def _press(dictionary: bytes):
    return zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None, write_content_size=True)


def _unpress(dictionary: bytes):
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary) if dictionary else None)


BLOCKS = "part int, block int, before bigint, tokens bigint, dictionary_crc32 bigint, width int, doc_ids array<bigint>, lengths array<bigint>, offsets array<bigint>, payload binary"
_BLOCK_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]
_BLOCK_NAMES = [x.split()[0] for x in BLOCKS.split(", ")]


def write_blocks(docs: DataFrame, folder: str, path: str, end_id: int = END_ID) -> None:
    """Encode, sort by doc_id and write ``folder``/blocks and ``folder``/dictionary."""
    spark = docs.sparkSession
    dictionary = train_dictionary(docs, path)
    spark.createDataFrame([(bytearray(dictionary), zlib.crc32(dictionary))], "dictionary binary, crc32 bigint").coalesce(1).write.parquet(f"{folder}/dictionary")
    width = 2 if len(encoder(path).ends) <= 1 << 16 else 4

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, part, block, before = _press(dictionary), TaskContext.get().partitionId(), 0, 0
        held: list[tuple[int | None, int, bytes]] = []
        size = 0

        def flush() -> pa.RecordBatch:
            row = [part, block, before, sum(n for _, n, _ in held), zlib.crc32(dictionary), width, [d for d, _, _ in held], [n for _, n, _ in held],
                   np.cumsum([0, *(len(x) for _, _, x in held)]).tolist(), b"".join(x for _, _, x in held)]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row, _BLOCK_TYPES, strict=True)], names=_BLOCK_NAMES)

        for batch, ids in encoded(path, end_id)(batches):
            for d, a in zip(batch.column("doc_id").to_pylist(), ids, strict=True):
                x = press.compress(a.astype(np.uint16).tobytes() if width == 2 else a.tobytes())
                held.append((d, len(a), x))
                size += len(x)
                if size >= BLOCK_BYTES:
                    yield flush()
                    before += sum(n for _, n, _ in held)
                    held, size, block = [], 0, block + 1
        if held:
            yield flush()

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = docs.select("doc_id", "text", F.xxhash64("text").alias("_h")).repartitionByRange(n, "doc_id", "_h").sortWithinPartitions("doc_id", "_h")
    ordered.mapInArrow(run, BLOCKS).write.parquet(f"{folder}/blocks")


def part_starts(parts: DataFrame) -> DataFrame:
    """(part, earlier): what lies in all earlier partitions. One row per partition, not per document, so it may be broadcast."""
    total = parts.groupBy("part").agg(F.sum("tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    return total.select("part", F.coalesce(before, F.lit(0)).alias("earlier"))


def read_dictionary(spark: SparkSession, folder: str) -> bytes:
    row = spark.read.parquet(f"{folder}/dictionary").first()
    raw = bytes(row.dictionary)
    if zlib.crc32(raw) != row.crc32:
        raise ValueError("dictionary file is damaged")
    return raw


def read_blocks(spark: SparkSession, folder: str, with_ids: bool = True) -> DataFrame:
    """One row per document, from the files alone: doc_id, start, n_tokens, ids_crc32, ids (little-endian uint32)."""
    dictionary = read_dictionary(spark, folder)
    crc = zlib.crc32(dictionary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpress = _unpress(dictionary)
        for batch in batches:
            for i in range(batch.num_rows):
                r = batch.slice(i, 1).to_pylist()[0]
                if r["dictionary_crc32"] != crc:
                    raise ValueError("block was written with another dictionary")
                ids = []
                for a, b in zip(r["offsets"], r["offsets"][1:]):
                    x = unpress.decompress(r["payload"][a:b])
                    ids.append(np.frombuffer(x, np.uint16).astype(np.uint32).tobytes() if r["width"] == 2 else x)
                n = [len(x) // 4 for x in ids]
                k = len(n)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r["part"]] * k, pa.int32()), pa.array(r["doc_ids"], pa.int64()), pa.array(r["before"] + np.cumsum([0, *n[:-1]]), pa.int64()),
                     pa.array(n, pa.int64()), pa.array([zlib.crc32(x) for x in ids], pa.int64()), pa.array(ids if with_ids else [None] * k, pa.binary())],
                    names=["part", "doc_id", "local", "n_tokens", "ids_crc32", "ids"])

    blocks = spark.read.parquet(f"{folder}/blocks")
    docs = blocks.mapInArrow(run, "part int, doc_id bigint, local bigint, n_tokens bigint, ids_crc32 bigint, ids binary")
    placed = docs.join(F.broadcast(part_starts(blocks.select("part", "tokens"))), "part")
    return placed.select("doc_id", (F.col("local") + F.col("earlier")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * with_ids)


def fetch(spark: SparkSession, folder: str, doc_id: int) -> DataFrame:
    """Ids of one document: its block is found by the index, and only its frame is decompressed."""
    dictionary = read_dictionary(spark, folder)
    hit = spark.read.parquet(f"{folder}/blocks").where(F.array_contains("doc_ids", F.lit(doc_id).cast("bigint")))
    at = F.explode(F.filter(F.sequence(F.lit(1), F.size("doc_ids")), lambda i: F.element_at("doc_ids", i) == doc_id))
    off = hit.select("*", at.alias("_i")).withColumn("_a", F.element_at("offsets", F.col("_i")))
    frame = off.select(F.lit(doc_id).cast("bigint").alias("doc_id"), "width", F.expr("substring(payload, int(_a + 1), int(element_at(offsets, _i + 1) - _a))").alias("frame"))

    @F.pandas_udf("array<bigint>")
    def open_frame(frame: pd.Series, width: pd.Series) -> pd.Series:
        unpress = _unpress(dictionary)
        return pd.Series([np.frombuffer(unpress.decompress(x), np.uint16 if w == 2 else np.uint32).astype(np.int64) for x, w in zip(frame, width, strict=True)])

    return frame.select("doc_id", open_frame("frame", "width").alias("ids"))


def round_trip(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """Write the files to the session's shared folder and read every document back from them."""
    folder = scratch_path(docs.sparkSession, "tokens")
    write_blocks(docs, folder, path)
    return read_blocks(docs.sparkSession, folder, with_ids)
