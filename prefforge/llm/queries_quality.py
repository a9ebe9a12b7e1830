"""op10: quality of documents by importance resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import table
from prefforge.llm.quality import resample


def op10_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {"op10_quality_resampling": op10_quality_resampling}
#: No SQL for hashed n-grams of bytes: tests/llm measures held-out accuracy.
SQL = {}
