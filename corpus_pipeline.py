"""A corpus from documents to token ids, in five stages.

Each stage takes (spark, docs, sf_dir), where docs has the columns of documents, and works on all rows that the stage
before it kept. All stages but the last return the columns of documents; the last returns one row of digests for each
document of the mix. Documents that the mix takes more than once come out as often.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.tables import shared_table, table
from prefforge.llm.exact_dedup import drop_exact_copies
from prefforge.llm.mixing import take_mix
from prefforge.llm.near_copies import drop_similar
from prefforge.llm.quality import keep_good
from prefforge.llm.queries_bpe import encode_documents


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the resampling keeps. Empty texts weigh nothing, which is enough; equal keys are kept together."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts (empty ones too) the row with the largest id; of rows that repeat it, one."""
    return drop_exact_copies(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (chains of texts with a 5-word similarity of 0.8 at least) the document with the smallest
    id. Rows without an id stay."""
    return drop_similar(docs)


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix: rows as often as it takes them, one row of a source in part. Rows without words are not taken; a null
    source is a source of its own; rows equal in id, source and size share what they take."""
    return take_mix(docs)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of each row."""
    return encode_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("mixing sources", mixing),
    ("byte-level BPE", encoding),
]
#: SQL can express neither the classifier nor SimHash nor BPE: tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = shared_table(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
