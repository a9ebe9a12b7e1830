"""Streams (extensions: the batch operators' counterparts for data that keeps coming)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from prefforge.operators.judge import upsert_scores
from prefforge.sources.files import SCORE_SCHEMA


def read_score_stream(spark: SparkSession, folder: str) -> DataFrame:
    """Score records of JSON files as they arrive in a folder."""
    return spark.readStream.schema(SCORE_SCHEMA).option("maxFilesPerTrigger", 1).json(folder)


def upsert_stream(stream: DataFrame, table: str, checkpoint: str) -> StreamingQuery:
    """Each batch is appended to a Parquet folder under its number, so a batch that is run again replaces itself."""

    def write(batch: DataFrame, number: int) -> None:
        numbered = batch.withColumn("line_no", F.lit(number).cast("long") * (1 << 33) + F.monotonically_increasing_id() % (1 << 33))
        numbered.write.mode("overwrite").parquet(f"{table}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_scores(spark: SparkSession, table: str) -> DataFrame:
    """The latest record of each key."""
    return upsert_scores(spark.read.parquet(table).drop("batch"))


def windowed_means(stream: DataFrame, time: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Mean and number of values of each time window, late rows within the watermark included."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w")).agg(F.avg(value).alias("mean"), F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("start"), "mean", "n")
