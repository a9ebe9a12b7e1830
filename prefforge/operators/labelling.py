"""Labelling of prompts: log replay, what is left to do, cost and training texts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions import numeric as n
from prefforge.functions import text as t
from prefforge.functions.constants import NO_OBJECT
from prefforge.functions.tables import prefix_sums
from prefforge.operators.dedup import last_wins


def parse_log(lines: DataFrame, line: str = "value", position: str = "line_no") -> DataFrame:
    """Fields of `time: prompt | description | tokens | total` lines; the first line is a header, and a line that does not
    have exactly four fields raises, as a log like that must not be trusted."""
    body = F.substring(F.col(line), F.instr(line, ": ") + 2, 1 << 30)
    fields = F.split(body, r" \| ", -1)
    checked = F.when(F.size(fields) == 4, fields).otherwise(F.raise_error(F.concat(F.lit("bad log line: "), F.col(line))).cast("array<string>"))
    return lines.filter(F.col(position) > 0).select(F.col(position), F.substring_index(line, ": ", 1).alias("asctime"), checked.alias("f")).select(position, "asctime", F.col("f")[0].alias("prompt"), F.col("f")[1].alias("description"), F.col("f")[2].cast("int").alias("tokens"), F.col("f")[3].cast("int").alias("total_tokens"))


def replay(log: DataFrame, position: str = "line_no") -> DataFrame:
    """The last description of each prompt."""
    return last_wins(log, ["prompt"], position)


def total_tokens(log: DataFrame) -> DataFrame:
    return log.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens")).withColumn("cost", n.cost(F.col("tokens")))


def running_tokens(log: DataFrame, position: str = "line_no", partition: str | None = None) -> DataFrame:
    """Tokens so far, as they are written to the log of one labeller, or of each labeller (`partition`)."""
    if partition:
        return log.withColumn("running", F.sum("tokens").over(Window.partitionBy(partition).orderBy(position).rowsBetween(Window.unboundedPreceding, 0)))
    return prefix_sums(log, position, "tokens", "_before").withColumn("running", F.col("_before") + F.coalesce("tokens", F.lit(0))).drop("_before")


def to_label(prompts: DataFrame, log: DataFrame) -> DataFrame:
    return prompts.join(log.select("prompt").distinct(), "prompt", "left_anti")


def with_object(labels: DataFrame) -> DataFrame:
    return labels.filter(F.col("description") != NO_OBJECT)


def sft_strings(labels: DataFrame) -> DataFrame:
    return with_object(labels).withColumn("text", t.sft_template(F.col("description"), F.col("prompt")))
