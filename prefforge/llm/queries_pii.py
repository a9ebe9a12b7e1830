"""op3: personal data in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import table
from prefforge.llm.pii import find_pii


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


QUERIES = {"op3_pii": op3_pii}
#: Positions of all matches and the scoring rounds are beyond DuckDB's SQL: tests/llm holds the query against Python's re.
SQL = {}
