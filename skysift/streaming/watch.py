"""Streams over arriving reports: candidate watch, live progress and duplicate removal.

The file source keeps the list of files it has seen, so each report is read once. State and
offsets live under the shared folder and survive the loss of executors.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skysift.session import scratch_path
from skysift.sources.readers import REPORT_SCHEMA, scored_rows


def report_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    """Scored rows of reports as they arrive; broken records are dropped."""
    raw = (
        spark.readStream.schema(REPORT_SCHEMA).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt")
        .option("maxFilesPerTrigger", files_per_trigger).json(folder)
    )
    return scored_rows(raw.filter(F.col("_corrupt").isNull()))


def candidates(rows: DataFrame) -> DataFrame:
    """Rows worth a look: several channels, and unexplained or significant."""
    return rows.filter((F.col("n_active") >= 2) & ((F.col("unexplainability") > 0.5) | F.col("is_fdr")))


def drain(stream: DataFrame, spark: SparkSession, label: str) -> DataFrame:
    """Run a stream over everything that has arrived and return what it wrote."""
    out = scratch_path(spark, label)
    query = (
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", scratch_path(spark, f"{label}-state"))
        .trigger(availableNow=True).start()
    )
    query.awaitTermination()
    return spark.read.parquet(out)


def live_progress(rows: DataFrame, sizes: DataFrame, spark: SparkSession) -> DataFrame:
    """Latest state of each run: rows gathered so far, expected total and best score.

    The totals come from a static table; updated runs are written batch by batch and the
    newest batch of a run wins.
    """
    out = scratch_path(spark, "progress")
    agg = rows.groupBy("report").agg(F.count("*").alias("gathered"), F.max("total_score").alias("best"))
    joined = agg.join(sizes, "report")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("append").parquet(out)

    query = (
        joined.writeStream.outputMode("update").option("checkpointLocation", scratch_path(spark, "progress-state"))
        .foreachBatch(keep).trigger(availableNow=True).start()
    )
    query.awaitTermination()
    seen = spark.read.parquet(out)
    latest = seen.groupBy("report").agg(F.max(F.struct("batch", "gathered", "total", "best")).alias("s"))
    return latest.select("report", "s.gathered", "s.total", "s.best")


def first_seen(stream: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each key once within the watermark delay."""
    return stream.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])
