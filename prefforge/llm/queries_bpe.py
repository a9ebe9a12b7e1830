"""op9: byte-level BPE encoding and decoding of documents."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import table
from prefforge.llm.bpe import encode_texts, read_ranks


def encode_documents(docs: DataFrame) -> DataFrame:
    return encode_texts(docs, read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), public_tokenizers.PATTERN)


def op9_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents"))


QUERIES = {"op9_bpe_encode": op9_bpe_encode}
#: SQL has no BPE: tests/llm holds the query against tiktoken.
SQL = {}
