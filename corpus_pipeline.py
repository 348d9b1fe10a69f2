"""The corpus pipeline: documents to packed training sequences, stage by stage.

Each stage takes what the one before kept, written as Parquet and read again. All but the last return
the columns of the documents table; ``n_chars`` follows the text where a stage changes it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altigrid.llm import lines, minhash, packing, pii, quality
from altigrid.llm.queries import vocabulary
from altigrid.model import cut, scratch_path

#: A short text can be clean, so the pipeline asks for few words only; all other rules hold at any length.
MIN_WORDS = 1


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects."""
    order = quality.cascade_order(docs, min_words=MIN_WORDS)
    judged = quality.judge(docs, order, out="_rejected_by", min_words=MIN_WORDS)
    return judged.where(F.col("_rejected_by").isNull()).drop("_rejected_by")


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that five documents or more share stay in the largest doc_id only."""
    out = lines.dedup_lines(docs)
    return out.withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group (five-word shingles, similarity 0.8) stays.

    Every row is a node of its own, so rows with equal or null doc_id are judged by their texts like all
    others. The smallest doc_id stays, null last, then the smallest text hash. Texts without words stay.
    """
    rows = cut(docs.withColumn("_row", F.monotonically_increasing_id()))
    found = minhash.near_duplicates(rows.select(F.col("_row").alias("doc_id"), "text"), words=5, percent=80)
    place = rows.select("_row", F.struct(F.col("doc_id").isNull(), "doc_id", F.xxhash64("text"), "_row").alias("_place"))
    groups = found.select(F.col("doc_id").alias("_row"), "component_id").join(place, "_row").groupBy("component_id")
    stay = groups.agg(F.min("_place").alias("_place")).select("_place._row")
    return rows.join(stay, "_row", "left_semi").select(docs.columns)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is replaced by its kind."""
    return pii.mask(docs).withColumn("n_chars", F.char_length("text").cast("bigint")).select(docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the packed sequences, with their ids."""
    return packing.pack(docs, vocabulary("word_bpe_49k.json"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("near duplicates", near_dedup),
    ("personal data", personal_data),
    ("packing", pack_sequences),
]

#: Tokenizer, similarity search and trained classifier are not SQL; tests hold run() against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stored before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch_path(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return STAGES[-1][1](spark, docs, sf_dir)
