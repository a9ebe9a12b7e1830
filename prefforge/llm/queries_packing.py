"""op11: packing of documents into sequences of at most 2048 ids."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefforge.functions.tables import table
from prefforge.llm.packing import pack
from prefforge.llm.vocab import read_file


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = pack(table(spark, sf_dir, "documents"), read_file(public_tokenizers.path("byte_bpe_50k.json")))
    return parts.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


QUERIES = {"op11_packing": op11_packing}
#: SQL has no BPE: tests/llm holds the query against `tokenizers` and the rules of packing.
SQL = {}
