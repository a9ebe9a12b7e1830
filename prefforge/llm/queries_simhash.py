"""op2: SimHash near-dedup of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import table
from prefforge.llm.simhash import near_duplicates


def op2_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


QUERIES = {"op2_simhash_near_dedup": op2_simhash_near_dedup}
#: SQL has no XXH64 over shingles with bit votes: tests/llm holds the query against brute force.
SQL = {}
