"""Token packing, labels, and the data side of training logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions import numeric as n
from prefforge.functions.tables import number_rows, running, shared_table


def pack_blocks(df: DataFrame, tokens: str, position: str, block: int, batch_rows: int = 1000) -> DataFrame:
    """(batch, block, input_ids, labels): the token arrays of every `batch_rows` rows in a row, cut into blocks. A batch's
    remainder is dropped, but a batch shorter than a block stays whole. position numbers the rows from 0."""
    batches = df.groupBy(F.floor(F.col(position) / batch_rows).alias("batch")).agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct(position, tokens))), lambda x: x[tokens])).alias("ids"))
    size = F.size("ids")
    cuts = F.when(size >= block, F.transform(F.sequence(F.lit(0), F.floor(size / block).cast("int") - 1), lambda i: F.slice("ids", i * block + 1, F.lit(block)))).otherwise(F.array("ids"))
    out = batches.filter(size > 0).select("batch", F.posexplode(cuts).alias("block", "input_ids"))
    return out.withColumn("labels", F.col("input_ids"))


def dpo_examples(df: DataFrame, prompt: str, completion: str, max_length: int = 256) -> DataFrame:
    ids, labels = n.dpo_encode(F.col(prompt), F.col(completion), max_length)
    return df.withColumn("input_ids", ids).withColumn("labels", labels)


def pad_batches(df: DataFrame, batch: Column, value: int = 0) -> DataFrame:
    """Padded to the longest of each batch, with the attention mask."""
    w = Window.partitionBy(batch)
    most = F.max(F.size("input_ids")).over(w)
    out = df.withColumn("_to", most)
    mask = F.concat(F.array_repeat(F.lit(1), F.size("input_ids")), F.array_repeat(F.lit(0), F.col("_to") - F.size("input_ids")))
    return out.select("*", mask.alias("attention_mask")).withColumn("input_ids", n.pad(F.col("input_ids"), F.col("_to"), value)).withColumn("labels", n.pad(F.col("labels"), F.col("_to"), n.IGNORED_LABEL)).drop("_to")


def dpo_metrics(df: DataFrame, beta: float = 0.1) -> DataFrame:
    """Mean loss, share of positive logits (strictly) and mean margin."""
    logit = n.dpo_logit(F.col("chosen_logp"), F.col("rejected_logp"), F.col("ref_chosen_logp"), F.col("ref_rejected_logp"), beta)
    return df.agg(F.avg(n.dpo_loss(logit)).alias("loss"), F.avg((logit > 0).cast("int")).alias("accuracy"), F.avg(logit).alias("margin"))


def running_best(steps: DataFrame, step: str = "step", value: str = "mean_reward", after: int = 20, partition: str | None = None) -> DataFrame:
    """Best value so far and whether a step is saved: a strict improvement from the warm-up on. One run is one ordered
    sequence of unique steps, which ranges of steps share out; several runs go by `partition`."""
    seen = F.when(F.col(step) >= after, F.col(value))
    if partition:
        before = Window.partitionBy(partition).orderBy(step).rowsBetween(Window.unboundedPreceding, -1)
        out = steps.withColumn("best_before", F.max(seen).over(before))
    else:
        out = running(steps.withColumn("_seen", seen), step, "_seen", "best_before", "max").drop("_seen")
    best = F.col("best_before")
    return out.withColumn("is_best", seen.isNotNull() & (best.isNull() | (seen > best)))


def keep_last(steps: DataFrame, every: int = 500, last: int = 3, step: str = "step") -> DataFrame:
    """The newest `last` of the periodic checkpoints."""
    return steps.filter((F.col(step) % every == 0) & (F.col(step) > 0)).orderBy(F.desc(step)).limit(last)


def group_advantage(df: DataFrame, group: str, reward: str, epsilon: float = 1e-4) -> DataFrame:
    """(reward - group's mean) / (group's sample deviation + epsilon); 0 for a group of one."""
    w = Window.partitionBy(group)
    x = F.col(reward)
    return df.withColumn("advantage", (x - F.avg(x).over(w)) / (F.coalesce(F.stddev_samp(x).over(w), F.lit(0.0)) + epsilon))


def step_reward(df: DataFrame, step: str, reward: str) -> DataFrame:
    return df.groupBy(step).agg(F.avg(reward).alias("mean_reward"))


def every_nth(df: DataFrame, step: str, column: str, every: int) -> DataFrame:
    """A text only at every nth step (from 0), else blank."""
    return df.withColumn(column, F.when(F.col(step) % every == 0, F.col(column)).otherwise(F.lit("")))


def sweep_best(runs: DataFrame) -> DataFrame:
    """The run with the lowest loss (ties: the first name)."""
    return runs.agg(F.min(F.struct("loss", "run")).alias("b")).select("b.run", "b.loss")


def hyperband_stop(steps: DataFrame, min_iter: int = 20, eta: int = 3, run: str = "run", step: str = "step", loss: str = "loss") -> DataFrame:
    """(run, rung, at_step, loss, stopped) by successive halving: rungs are at min_iter, min_iter * eta, ... steps, and at each
    one the best 1/eta (rounded up; ties: the first name) of the runs that got there without being stopped go on, the others
    stop. A run's loss at a rung is that of its last step up to it; runs that end before a rung are not decided there.

    Rungs are visited one after the other, as a run that stops takes no part in later ones; places come from range sorts, so
    there may be any number of runs.
    """
    # one row for each run and rung that it reaches, from one pass over the steps
    last = steps.agg(F.max(step)).first()[0]
    rungs = []
    while last is not None and min_iter * eta ** len(rungs) <= last:
        rungs.append(min_iter * eta ** len(rungs))
    known = [F.max_by(F.when(F.col(step) <= r, F.col(loss)), F.when(F.col(step) <= r, F.col(step))).alias(f"_{i}") for i, r in enumerate(rungs)]
    alive = shared_table(steps.groupBy(F.col(run).alias("run")).agg(F.max(step).alias("_last"), *known), "runs")
    out = []
    for i, r in enumerate(rungs):
        here = alive.filter(F.col("_last") >= r).select("run", F.struct(F.col(f"_{i}").alias("loss"), "run").alias("_place"))
        ranked, n_runs = number_rows(here, "_place")
        decided = ranked.select("run", F.lit(i).alias("rung"), F.lit(r).cast("long").alias("at_step"), F.col("_place.loss").alias("loss"), (F.col("at") >= -(-n_runs // eta)).alias("stopped"))
        out.append(shared_table(decided, "rung"))
        alive = alive.join(out[-1].filter("not stopped").select("run"), "run", "left_semi")
    if not out:
        return alive.select("run", F.lit(0).alias("rung"), F.col("_last").cast("long").alias("at_step"), F.lit(None).cast("double").alias("loss"), F.lit(False).alias("stopped")).limit(0)
    return reduce(DataFrame.unionByName, out)


def with_replacement(df: DataFrame, place: str, n_rows: int, draws: DataFrame) -> DataFrame:
    """Rows at the drawn places (column `draw`, taken modulo the number of rows), repeats included."""
    return draws.withColumn(place, F.pmod("draw", F.lit(n_rows))).join(df, place)


def checkpoint_rows(steps: DataFrame, every: int = 500, last: int = 3, after: int = 20) -> DataFrame:
    """(name, step, best_reward) of the periodic checkpoints that are kept, as the metadata beside the weights."""
    best = running_best(steps, after=after)
    reached = best.withColumn("best_reward", F.greatest("best_before", F.when(F.col("step") >= after, F.col("mean_reward"))))
    return keep_last(reached, every, last).select(F.format_string("step-%06d", "step").alias("name"), "step", "best_reward")
