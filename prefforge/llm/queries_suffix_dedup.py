"""op1: removal of repeated 100-byte strings of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import table
from prefforge.llm.suffix_dedup import suffix_dedup


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))


QUERIES = {"op1_suffix_dedup": op1_suffix_dedup}
#: SQL cannot slide over bytes of long texts: tests/llm holds the query against brute force.
SQL = {}
