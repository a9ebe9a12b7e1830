"""Human comparison tasks: image maps, sampled pairs and wide task rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions.tables import number_rows

#: Tasks that one row is exploded to.
TASKS_AT_ONCE = 10_000


def image_map(prompts: DataFrame, position: str, copies: int = 4, name: Column | None = None) -> DataFrame:
    """`copies` rows of each prompt: img_idx = copies * place + number in the prompt, from 0. position numbers the prompts
    from 0 without gaps. The name defaults to a uuid."""
    rows = prompts.withColumn("img_id_in_prompt", F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
    return rows.withColumn("img_idx", F.col(position) * copies + F.col("img_id_in_prompt")).withColumn("image_name", F.expr("uuid()") if name is None else name)


def n_comparisons(n: Column) -> Column:
    """int(3 * n * log2(n)), 0 for a single prompt."""
    return F.floor(3 * n * F.log2(n)).cast("long")


def sample_comparisons(images: DataFrame, draw, order: str = "img_idx") -> DataFrame:
    """(descr, task, left, right): of each description, first the chain of neighbouring prompts (in the order in which they
    appear) with a drawn side, then drawn pairs of different prompts up to n_comparisons.

    draw(descr, prompts' number, task number, salt) is an integer column. Pairs of which a side has fewer than four
    images count but are dropped.
    """
    return _sampled(images, draw, order, lambda numbered: numbered, lambda side: [F.col("prompt").alias(side)])


def _sampled(images: DataFrame, draw, order: str, extend, columns) -> DataFrame:
    """Sampled comparisons (descr, task, ...) with columns(side) of both sides' prompts, which extend may widen."""
    spark = images.sparkSession
    first = images.groupBy("descr", "prompt").agg(F.min(F.struct(order)).alias("_o"), F.count(F.lit(1)).alias("n_images"))
    # places come from ranges over all descriptions, so that no description is sorted in one task
    lined, _ = number_rows(first.withColumn("_place", F.struct("descr", "_o", "prompt")), "_place")
    lined = lined.select("descr", "prompt", "n_images", "at")
    groups = lined.groupBy("descr").agg(F.min("at").alias("_first"), F.count(F.lit(1)).alias("n"))
    # tasks are dealt out by number: a row for some of them each, and these in turn to rows. The number of partitions is given, as
    # these few rows would be put together in one partition, and one task would make all that they are exploded to
    many = groups.filter("n > 1").select("descr", "_first", "n", n_comparisons(F.col("n")).alias("_tasks"))
    dealt = many.withColumn("_part", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_tasks") - 1) / TASKS_AT_ONCE))))
    dealt = dealt.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "descr", "_part")
    begin = F.col("_part") * TASKS_AT_ONCE
    tasks = dealt.withColumn("task", F.explode(F.sequence(begin, F.least(begin + TASKS_AT_ONCE, F.col("_tasks")) - 1))).drop("_part", "_tasks")
    d = lambda salt: draw(F.col("descr"), F.col("n"), F.col("task"), salt)
    chain = F.col("task") < F.col("n") - 1
    swap = F.pmod(d(0), F.lit(2)) == 1
    a = F.when(chain, F.col("task") + swap.cast("int")).otherwise(F.pmod(d(1), F.col("n")))
    # the second prompt of a drawn pair is one of the others
    other = F.pmod(F.col("a") + 1 + F.pmod(d(2), F.col("n") - 1), F.col("n"))
    b = F.when(chain, F.col("task") + 1 - swap.cast("int")).otherwise(other)
    tasks = tasks.withColumn("a", a.cast("long")).withColumn("b", b.cast("long"))
    # places over all descriptions are the keys of both joins, so rows travel as numbers and the description comes with a side;
    # hash tables are of the prompts, each once, and the many tasks are not sorted
    tasks = tasks.select("task", (F.col("_first") + F.col("a")).alias("_a"), (F.col("_first") + F.col("b")).alias("_b"))
    sides = extend(lined.filter("n_images >= 4 and descr is not null and prompt is not null"))
    left, right = (sides.select("descr", F.col("at").alias(key), *columns(side)).hint("shuffle_hash") for key, side in (("_a", "left"), ("_b", "right")))
    out = tasks.join(left, "_a").join(right.drop("descr"), "_b")
    return out.select("descr", "task", *[f"`{c}`" for x in (left, right) for c in x.columns[2:]])


def _four_images(images: DataFrame, base_url: str, order: str) -> DataFrame:
    """(descr, prompt, image_0, ..., image_3) of each prompt."""
    w = Window.partitionBy("descr", "prompt").orderBy(order)
    four = images.withColumn("k", F.row_number().over(w)).filter("k <= 4")
    link = F.concat(F.lit(base_url + "/"), F.col("image_name")) if base_url else F.col("image_name")
    return four.groupBy("descr", "prompt").agg(*[F.max(F.when(F.col("k") == k + 1, link)).alias(f"image_{k}") for k in range(4)])


def _inputs(side: str) -> list[Column]:
    return [F.col(f"image_{k}").alias(f"INPUT:{side}_{k}") for k in range(4)]


def wide_tasks(comparisons: DataFrame, images: DataFrame, base_url: str = "", order: str = "img_idx") -> DataFrame:
    """A row for each comparison with the first four images of both sides."""
    wide = _four_images(images, base_url, order)
    out = comparisons
    for side in ("left", "right"):
        out = out.join(wide.select("descr", F.col("prompt").alias(side), *_inputs(side)), ["descr", side])
    return out.select("descr", "task", *[f"`INPUT:{s}_{k}`" for s in ("left", "right") for k in range(4)], F.col("descr").alias("INPUT:prompt"))


def sampled_wide_tasks(images: DataFrame, draw, base_url: str = "", order: str = "img_idx") -> DataFrame:
    """wide_tasks of sample_comparisons: the images come with the prompts, so the many tasks are not joined again."""
    wide = _four_images(images, base_url, order)
    out = _sampled(images, draw, order, lambda numbered: numbered.join(wide, ["descr", "prompt"]), _inputs)
    return out.withColumn("INPUT:prompt", F.col("descr"))


def with_both_images(comparisons: DataFrame, images: DataFrame, least: int = 4) -> DataFrame:
    enough = images.groupBy("descr", "prompt").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least).drop("n")
    for side in ("left", "right"):
        comparisons = comparisons.join(enough.withColumnRenamed("prompt", side), ["descr", side], "left_semi")
    return comparisons


def expected_comparisons(n: int) -> int:
    return int(3 * n * math.log2(n)) if n > 1 else 0
