"""op12: runs of repeated word sequences in documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import table
from prefforge.llm.periodic import periodic_runs, run_digests


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), repeats=True))


QUERIES = {"op12_periodic_runs": op12_periodic_runs}
#: No SQL: tests/llm holds the query against a loop over all starts and periods.
SQL = {}
