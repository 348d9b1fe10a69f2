"""Structured Streaming forms of the catalogue and the comparison (ST1, ST2)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from altigrid.model import finite, scratch_path
from altigrid.sources.files import catalogue_rows, read_results


def stream_results(spark: SparkSession, root: str, files_per_trigger: int = 1000) -> DataFrame:
    """ST1: new metadata files appear as catalogue rows without a rescan (append)."""
    return catalogue_rows(read_results(spark.readStream.option("maxFilesPerTrigger", files_per_trigger), root))


def stream_accuracy(stream: DataFrame, by: list[str], pred: str = "pred", ref: str = "ref") -> DataFrame:
    """ST2: running sums per group as cell batches land, with the metrics derived from them.

    State is five numbers per group. Medians have no bounded mergeable state and stay batch-only.
    """
    e = finite(pred) - finite(ref)
    sums = stream.groupBy(*by).agg(
        F.count(e).alias("n"), F.sum(e).alias("sum_e"), F.sum(e * e).alias("sum_e2"), F.sum(F.abs(e)).alias("sum_abs"), F.max(F.abs(e)).alias("max_abs")
    )
    n = F.col("n")
    return sums.select(
        *by, F.sqrt(F.try_divide(F.col("sum_e2"), n)).alias("rmse"), F.try_divide(F.col("sum_abs"), n).alias("mae"),
        F.try_divide(F.col("sum_e"), n).alias("bias"), n.alias("count"), "max_abs",
    )


def run_to_table(stream: DataFrame, mode: str) -> DataFrame:
    """Process everything available now and return the stored result.

    Append results accumulate in a file sink; complete results replace the table of the last batch.
    """
    spark = stream.sparkSession
    base = scratch_path(spark, "stream")
    writer = stream.writeStream.trigger(availableNow=True).option("checkpointLocation", f"{base}/state").outputMode(mode)
    if mode == "append":
        query = writer.format("parquet").option("path", f"{base}/out").start()
    else:
        query = writer.foreachBatch(lambda df, _: df.write.mode("overwrite").parquet(f"{base}/out")).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
