"""Files that arrive, converted as a stream.

File streams report additions, never deletions; so the stream only feeds the conversion table, by content
hash, and identities are settled by the batch comparison of snapshots (operators.ledger). Each batch is
written under its own number, so that a batch that runs again after a lost executor replaces itself.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.session import ship_package
from corvane.sources.convert import convert, converter_of


def stream_conversions(spark: SparkSession, folder: str, target: str, checkpoint: str, available_now: bool = True):
    """Start a stream from files below folder to conversion rows below target (a folder per batch)."""
    ship_package(spark)
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length bigint, content binary").option("recursiveFileLookup", "true").load(folder)
    files = files.where(~F.col("path").rlike(r"/(?:\.[^/]*|cache)(?:/|$)")).withColumn("converter", converter_of(F.col("path"))).where(F.col("converter").isNotNull())

    def write(batch: DataFrame, number: int) -> None:
        once = batch.select(F.sha2("content", 256).alias("sha256"), "converter", "content").dropDuplicates(["sha256", "converter"])
        once.select("sha256", "converter", convert("converter", "content").alias("c")).select("sha256", "converter", "c.*").write.mode("overwrite").parquet(f"{target}/batch={number}")

    w = files.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if available_now else w).start()


def conversions(spark: SparkSession, target: str) -> DataFrame:
    """All conversions so far, one row per content and converter."""
    return spark.read.parquet(target).drop("batch").dropDuplicates(["sha256", "converter"])
