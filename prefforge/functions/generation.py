"""Generation of candidates as a table function for SQL."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf
from pyspark.sql.types import IntegerType, StringType, StructType
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, PartitioningColumn


def candidate_function(generate: Callable[[list[str], int], list[list[str]]]) -> type:
    """A table function: candidates(TABLE(rows), k, text column, key column) gives each row k candidates. All columns of the
    rows stay, whatever they are; candidate_id and expansion come behind them. Rows of a key are dealt to the same call, which
    numbers their candidates on and leaves out those that the key has already."""

    class Candidates:
        def __init__(self):
            self._seen: set[str] = set()

        @staticmethod
        def analyze(rows: AnalyzeArgument, k: AnalyzeArgument, text: AnalyzeArgument, key: AnalyzeArgument) -> AnalyzeResult:
            if not rows.isTable:
                raise ValueError("candidates take a table first")
            names = rows.dataType.fieldNames()
            for name in (text.value, key.value):
                if name not in names:
                    raise ValueError(f"{name} is not one of {', '.join(names)}")
            if k.value is None or k.value < 1:
                raise ValueError("k must be 1 at least")
            schema = StructType([*rows.dataType.fields]).add("candidate_id", IntegerType()).add("expansion", StringType())
            return AnalyzeResult(schema=schema, partitionBy=[PartitioningColumn(key.value)])

        def eval(self, rows: Row, k: int, text: str, key: str) -> Iterator[tuple]:
            for made in generate([rows[text]], k)[0]:
                if made not in self._seen:
                    self._seen.add(made)
                    yield (*rows, len(self._seen) - 1, made)

    return Candidates


def register_candidates(spark: SparkSession, generate: Callable[[list[str], int], list[list[str]]], name: str = "candidates") -> None:
    """Make the table function known to the session's SQL under a name."""
    spark.udtf.register(name, udtf(candidate_function(generate)))
