"""op7: toxicity of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import table
from prefforge.llm.toxicity import score_toxicity, train_on


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score_toxicity(docs, train_on(docs, table(spark, sf_dir, "labels"), "doc_id", "text"))


QUERIES = {"op7_toxicity": op7_toxicity}
#: No SQL for a trained network: tests/llm measures held-out accuracy.
SQL = {}
