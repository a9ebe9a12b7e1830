"""Sources and sinks: CSV, TSV, JSONL, text and log files, caches and reports."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefforge.functions.constants import OBJECTIVE_FIELDS
from prefforge.functions.tables import number_rows
from prefforge.operators.evaluate import FLAGS

#: Old records have score, new ones overall and the objectives: one schema holds both.
SCORE_SCHEMA = T.StructType(
    [T.StructField(c, T.LongType()) for c in ("prompt_id", "candidate_id")]
    + [T.StructField(c, T.StringType()) for c in ("prompt", "expansion")]
    + [T.StructField(c, T.IntegerType()) for c in ("score", "overall", *OBJECTIVE_FIELDS)]
    + [T.StructField("failure_modes", T.ArrayType(T.StringType())), T.StructField("reason", T.StringType())]
)
TEXT_EXTENSIONS = ("csv", "json", "txt")
#: How CSV is read. The last option is for NUL characters, which the parser else takes for its escape of escapes and drops.
CSV_OPTIONS = {"header": True, "multiLine": True, "escape": '"', "charToEscapeQuoteEscaping": '"'}
#: What the reader takes for a missing value, if empty texts are not missing. No file holds it: texts like it, with any number
#: of backslashes, have one more there.
MISSING = "\\N"


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def _slashes(df: DataFrame, least: int, change: Callable[[Column], Column]) -> DataFrame:
    """df with texts of `least` backslashes or more and an N changed."""
    like = lambda x: x.startswith("\\") & x.rlike(rf"\A\\{{{least},}}N\z")
    columns = [(F.col(f"`{f.name}`"), f) for f in df.schema]
    return df.select(*[F.when(like(x), change(x)).otherwise(x).alias(f.name) if isinstance(f.dataType, T.StringType) else x for x, f in columns])


def read_csv(spark: SparkSession, path: str, sep: str = ",", schema: T.StructType | str | None = None, empty_texts: bool = False) -> DataFrame:
    """With header; quoted line breaks and doubled quotes survive. Empty texts are missing values, as for pandas; with
    empty_texts they are not, if the file was written with it too."""
    reader = spark.read.options(**CSV_OPTIONS, sep=sep, **({"nullValue": MISSING} if empty_texts else {}))
    df = reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", True).csv(path)
    return _slashes(df, 2, lambda x: F.substr(x, F.lit(2))) if empty_texts else df


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str | None = None, empty_texts: bool = False) -> DataFrame:
    return read_csv(spark, path, "\t", schema, empty_texts)


def read_channels(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """All CSV exports of a folder, column names in lower case, with channel dreambot-1, -2, ... by the order of their names.
    An export is a file, or a folder of part files."""
    read = spark.read.options(**CSV_OPTIONS, recursiveFileLookup=True).schema(schema).csv(folder)
    df = read.withColumn("_file", F.regexp_extract(F.col("_metadata.file_path"), r"/([^/]+)(?:/part-[^/]*)?$", 1))
    names = sorted(r["_file"] for r in df.select("_file").distinct().collect())
    numbers = spark.createDataFrame([(f, f"dreambot-{i + 1}") for i, f in enumerate(names)] or [("", "")], "_file string, channel string")
    return df.drop("channel").join(numbers, "_file").drop("_file").toDF(*[c.lower() for c in df.columns if c not in ("_file", "channel")], "channel")


def read_lines(spark: SparkSession, path: str, ends: str | None = None) -> DataFrame:
    """(line_no, value) of the lines of a text, numbered from 0 by file and place; large files are read in splits. ends: what
    ends a line, if only that does."""
    reader = spark.read if ends is None else spark.read.option("lineSep", ends)
    lines = reader.text(path).select("value", F.struct(F.col("_metadata.file_path"), F.col("_metadata.file_block_start"), F.monotonically_increasing_id().alias("i")).alias("place"))
    numbered, _ = number_rows(lines, "place")
    return numbered.select(F.col("at").alias("line_no"), "value")


def read_text(spark: SparkSession, path: str, extension: str | None = None) -> DataFrame:
    """One row for each line of a plain text (column text), or of the file types that a corpus may have."""
    extension = extension or path.rsplit(".", 1)[-1]
    if extension not in TEXT_EXTENSIONS:
        raise ValueError(f"{extension} is not one of {', '.join(TEXT_EXTENSIONS)}")
    if extension == "csv":
        return read_csv(spark, path)
    return spark.read.json(path) if extension == "json" else spark.read.text(path).withColumnRenamed("value", "text")


def read_jsonl_strict(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """Blank lines are skipped, a bad line raises; prompt_id is the number of the record."""
    lines = read_lines(spark, path).filter(F.trim("value") != "")
    rows = lines.withColumn("r", F.from_json("value", schema, {"mode": "FAILFAST"}))
    numbered, _ = number_rows(rows.select("line_no", "r"), "line_no")
    return numbered.select(F.col("at").alias("row_no"), "r.*")


def read_scores(spark: SparkSession, path: str) -> DataFrame:
    """Score records with their line numbers; none if the file is missing, without its malformed lines."""
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([T.StructField("line_no", T.LongType()), *SCORE_SCHEMA.fields]))
    return parse_scores(read_lines(spark, path))


def parse_scores(lines: DataFrame) -> DataFrame:
    ok = F.try_parse_json("value")
    rows = lines.filter(ok.isNotNull() & F.ltrim("value").startswith("{")).withColumn("r", F.from_json("value", SCORE_SCHEMA))
    return rows.select("line_no", "r.*")


def split_percent(df: DataFrame, position: str, n_rows: int, percent: int = 5) -> tuple[DataFrame, DataFrame]:
    """(train, validation): the first `percent` of the rows in order are the validation part. position counts from 0."""
    cut = round(n_rows * percent / 100)
    return df.filter(F.col(position) >= cut), df.filter(F.col(position) < cut)


def first_rows(df: DataFrame, position: str, n_rows: int) -> DataFrame:
    return df.orderBy(position).limit(n_rows)


def skip_rows(df: DataFrame, position: str, offset: int, order: Column, n_rows: int) -> DataFrame:
    """n rows of those behind the first `offset`, in the order of a key."""
    return df.filter(F.col(position) >= offset).orderBy(order).limit(n_rows)


def cached_candidates(spark: SparkSession, path: str, schema: T.StructType | str, n_prompts: int, generate) -> DataFrame:
    """The cache if it has a row for each prompt at least, else what generate() gives, which is written to it."""
    if exists(spark, path):
        cache = read_jsonl_strict(spark, path, schema)
        if cache.count() >= n_prompts:
            return cache
    write_jsonl(generate(), path)
    return read_jsonl_strict(spark, path, schema)


def zip_rows(a: DataFrame, b: DataFrame, position: str) -> DataFrame:
    """Rows side by side by position; the longer table is cut."""
    return a.join(b, position)


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), frames)


def write_csv(df: DataFrame, path: str, sep: str = ",", index: str | None = None, empty_texts: bool = False) -> None:
    """With header. index names a column that orders the rows and goes first, under an empty name. Every part file begins with
    the header, as readers of a folder expect. Missing values are nothing and empty texts a pair of quotes; empty_texts is for
    files that are read with it."""
    if empty_texts:
        df = _slashes(df, 1, lambda x: F.concat(F.lit("\\"), x))
    options = {"sep": sep, "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
    if index is None:
        df.write.mode("overwrite").options(header=True, **options).csv(path)
        return
    names = [index, *[c for c in df.columns if c != index]]
    # Spark writes no header for an unnamed column: it is a line in front of a part's first row
    head = sep.join(["", *names[1:]]) + "\n"
    line = F.to_csv(F.struct(*[F.col(f"`{c}`").alias(f"_{i}") for i, c in enumerate(names)]), options)
    rows = df.select(line.alias("value"), F.col(f"`{index}`").alias("o")).repartitionByRange("o").sortWithinPartitions("o")
    first = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1) == 0
    rows.select(F.when(first, F.concat(F.lit(head), "value")).otherwise(F.col("value")).alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, index: str | None = None, empty_texts: bool = False) -> None:
    write_csv(df, path, "\t", index, empty_texts)


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line; nested columns stay nested and nulls are written."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """At least once: readers take the last record of a key."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def concat_text(df: DataFrame, column: str, position: str, rows: int = 100_000) -> DataFrame:
    """(block, text): all strings in order with nothing between them, a block for every `rows` of them, so that no task holds
    more; the blocks in order are the whole text."""
    numbered, _ = number_rows(df.select(F.col(position).alias("o"), F.col(column).alias("x")), "o")
    blocks = numbered.groupBy(F.floor(F.col("at") / rows).alias("block")).agg(F.array_sort(F.collect_list(F.struct("at", "x"))).alias("s"))
    return blocks.select("block", F.array_join(F.transform("s", lambda r: r["x"]), "").alias("text"))


def audit_json(pairs: DataFrame, position: str, n_rows: int = 50) -> DataFrame:
    """(position, json): the first pairs, pretty-printed."""
    cols = [c for c in pairs.columns if c != position]
    return first_rows(pairs, position, n_rows).select(position, F.to_json(F.struct(*cols), {"pretty": "true", "ignoreNullFields": "false"}).alias("json"))


def json_value(x: Column) -> Column:
    """A value as JSON."""
    text = F.to_json(F.struct(x.alias("v")), {"ignoreNullFields": "false"})
    return F.substr(text, F.lit(6), F.length(text) - 6)


def pretty_json(x: Column, kind: T.DataType, level: int = 0) -> Column:
    """A value as JSON, two blanks a level; a null struct is an empty object."""
    if not isinstance(kind, T.StructType):
        return json_value(x)
    gap = "  " * (level + 1)
    fields = [F.concat(F.lit(f'{gap}"{f.name}": '), pretty_json(x[f.name], f.dataType, level + 1)) for f in kind.fields]
    return F.when(x.isNull(), F.lit("{}")).otherwise(F.concat(F.lit("{\n"), F.concat_ws(",\n", *fields), F.lit("\n" + "  " * level + "}")))


def audit_json_blocks(pairs: DataFrame, position: str, n_rows: int = 50) -> DataFrame:
    """(place, block): each of the first pairs as JSON with a blank line behind it; the blocks in order are the file. Letters
    beyond ASCII are written as they are. position is unique."""
    cols = [c for c in pairs.columns if c != position]
    row = F.struct(*cols)
    kind = T.StructType([pairs.schema[c] for c in cols])
    return first_rows(pairs, position, n_rows).select(F.col(position).cast("long").alias("place"), F.concat(pretty_json(row, kind), F.lit("\n\n")).alias("block"))


#: Heading and prose of the audit file.
AUDIT_HEAD = """# DPO Pair Audit Sample

Showing first %d pairs. Manually inspect these before training.

"""


def audit_markdown_blocks(pairs: DataFrame, position: str, n_rows: int = 100) -> DataFrame:
    """(place, block): the head and a block for each of the first pairs, with the scores of both sides (chosen_scores and
    rejected_scores, structs) as JSON; the blocks in order are the file. position is unique."""
    numbered, total = number_rows(first_rows(pairs, position, n_rows), position)

    scores = lambda side: F.concat(F.lit("```json\n"), pretty_json(F.col(side), pairs.schema[side].dataType), F.lit("\n```\n\n"))
    c = lambda name: F.coalesce(F.col(name).cast("string"), F.lit("None"))
    block = F.concat(
        F.lit("## Pair "), (F.col("at") + 1).cast("string"), F.lit("\n\n**Prompt**: `"), c("prompt"), F.lit("`\n\n**Chosen** ("), c("chosen_score"), F.lit("): "), c("chosen"),
        F.lit("\n\n**Rejected** ("), c("rejected_score"), F.lit("): "), c("rejected"), F.lit("\n\n**Chosen scores**:\n\n"), scores("chosen_scores"), F.lit("**Rejected scores**:\n\n"), scores("rejected_scores"),
    )
    head = pairs.sparkSession.createDataFrame([(-1, AUDIT_HEAD % total)], "place long, block string")
    return head.unionByName(numbered.select(F.col("at").alias("place"), block.alias("block")))


def audit_markdown(pairs: DataFrame, position: str, n_rows: int = 100) -> DataFrame:
    """(position, block): a Markdown block for each of the first pairs."""
    rows = first_rows(pairs, position, n_rows)
    block = F.concat(
        F.lit("## Pair "), (F.col(position) + 1).cast("string"), F.lit("\n\n**Prompt**: `"), F.col("prompt"), F.lit("`\n\n**Chosen** ("), F.col("chosen_score").cast("string"), F.lit("): "), F.col("chosen"),
        F.lit("\n\n**Rejected** ("), F.col("rejected_score").cast("string"), F.lit("): "), F.col("rejected"), F.lit("\n\n"),
    )
    return rows.select(position, block.alias("block"))


#: Headings, prose and table of the review file.
REVIEW_HEAD = """# Layer 3 Review: SFT vs Judge-DPO

This file is sorted with the most suspicious DPO outputs first. Use it for manual inspection, not as an automatic pass/fail.

## Aggregate diagnostics

| Metric | SFT avg | DPO avg |
|---|---:|---:|
"""


def layer3_markdown(reviewed: DataFrame, averages: DataFrame, position: str) -> DataFrame:
    """(place, block): the head, a line of averages for each flag, and a block for each example, which position numbers from 0.
    The blocks in order are the file."""
    order = F.array_position(F.array(*map(F.lit, FLAGS)), F.col("metric")) - 1
    end = F.when(F.col("metric") == FLAGS[-1], "\n").otherwise("")
    lines = averages.select((order - 100).cast("long").alias("place"), F.concat(F.format_string("| %s | %.3f | %.3f |\n", "metric", "sft", "dpo"), end).alias("block"))
    head = reviewed.sparkSession.createDataFrame([(-1000, REVIEW_HEAD)], "place long, block string")
    fields = lambda s: F.concat_ws(",\n", *[F.concat(F.lit(f'    "{k}": '), F.col(f"{s}_{k}").cast("string")) for k in FLAGS])
    flags = F.concat(F.lit('{\n  "sft": {\n'), fields("sft"), F.lit('\n  },\n  "dpo": {\n'), fields("dpo"), F.lit("\n  }\n}"))
    title = F.concat(F.lit("## Example "), (F.col(position) + 1).cast("string"), F.lit("\n\n**Prompt**: `"), F.col("prompt"))
    block = F.concat(title, F.lit("`\n\n**SFT output**\n\n> "), F.col("sft"), F.lit("\n\n**DPO output**\n\n> "), F.col("dpo"), F.lit("\n\n**Flags**\n\n```json\n"), flags, F.lit("\n```\n\n"))
    return head.unionByName(lines).unionByName(reviewed.select(F.col(position).cast("long").alias("place"), block.alias("block")))
