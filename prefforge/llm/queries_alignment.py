"""op13: alignment of the tokens of two tokenizers."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import table
from prefforge.llm.alignment import align_tokens
from prefforge.llm.vocab import read_file


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (read_file(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return align_tokens(table(spark, sf_dir, "documents"), a, b)


QUERIES = {"op13_token_alignment": op13_token_alignment}
#: SQL has no tokenizers: tests/llm holds the query against loops over bytes.
SQL = {}
