"""Preference pairs out of scored candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions import numeric as n
from prefforge.functions.constants import CORE_FIELDS, HARD_FAILURE_MODES, LOOSE_GUARDRAILS, STRICT_GUARDRAILS


def by_prompt():
    return Window.partitionBy("prompt_id")


def scored_enough(scored: DataFrame, score: str = "overall", least: int = 2) -> DataFrame:
    """Rows with a score, of prompts that have enough of them."""
    return scored.filter(F.col(score).isNotNull()).withColumn("n_scored", F.count(F.lit(1)).over(by_prompt())).filter(F.col("n_scored") >= least)


def best_worst(scored: DataFrame, score: str = "overall", min_gap: float | None = 2, last_of_tied_worst: bool = False, text: str = "expansion", different: bool = False) -> DataFrame:
    """One pair of each prompt: the best candidate (lowest id of ties) against the worst one.

    Of tied worst ones the lowest id is taken, or the highest where candidates were sorted by falling score
    (last_of_tied_worst). different drops pairs of equal texts.
    """
    cid = F.col("candidate_id")
    rows = scored.filter(F.col(score).isNotNull())
    found = rows.groupBy("prompt_id").agg(
        F.count(F.lit(1)).alias("n"),
        F.max(F.struct(F.col(score).alias("score"), (-cid).alias("c"), F.col(text).alias("t"))).alias("best"),
        F.min(F.struct(F.col(score).alias("score"), (-cid if last_of_tied_worst else cid).alias("c"), F.col(text).alias("t"))).alias("worst"),
    )
    out = found.filter("n >= 2").select(
        "prompt_id",
        (-F.col("best.c")).alias("chosen_id"),
        (-F.col("worst.c") if last_of_tied_worst else F.col("worst.c")).alias("rejected_id"),
        F.col("best.t").alias("chosen"),
        F.col("worst.t").alias("rejected"),
        F.col("best.score").alias("chosen_score"),
        F.col("worst.score").alias("rejected_score"),
        (F.col("best.score") - F.col("worst.score")).alias("score_gap"),
    )
    out = out if min_gap is None else out.filter(F.col("score_gap") >= min_gap)
    return out.filter("chosen <> rejected") if different else out


def best_worst_skips(scored: DataFrame, score: str = "overall", min_gap: float = 2) -> DataFrame:
    """(reason, n) of prompts that give no pair."""
    s = scored.groupBy("prompt_id").agg(F.count(score).alias("n"), (F.max(score) - F.min(score)).alias("gap"))
    reason = F.when(F.col("n") < 2, "no_scores").when(F.col("gap") < min_gap, "small_gap")
    return s.select(reason.alias("reason")).filter("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def guardrail_failure(minimums: dict[str, int], hard: list[str] = HARD_FAILURE_MODES, at: Column | None = None) -> Column:
    """The first reason for which a candidate must not be chosen, or null. at: a struct column that holds the scores."""
    get = (lambda f: F.col(f)) if at is None else (lambda f: at[f])
    checks = [(get(f) < m, F.lit(f"chosen_{f}_below_{m}")) for f, m in minimums.items()]
    bad = n.hard_modes(get("failure_modes"), hard)
    return n.first_failure([*checks, (bad != "", F.concat(F.lit("chosen_hard_failure_"), bad))])


def core_failure(chosen: Column, rejected: Column) -> Column:
    """The first core objective on which the chosen one loses, or null; missing scores never lose."""
    return n.first_failure([(chosen[f] < rejected[f], F.lit(f"chosen_loses_{f}")) for f in CORE_FIELDS])


def ranked(scored: DataFrame, score: str = "overall") -> DataFrame:
    """Position of each candidate that has a record, best first, from 0; records without a score come last and count."""
    rows = scored.withColumn("n_scored", F.count(F.lit(1)).over(by_prompt())).filter("n_scored >= 2")
    return rows.withColumn("rank", F.row_number().over(by_prompt().orderBy(F.desc_nulls_last(score), "candidate_id")) - 1)


def pair_quality(chosen_rank: Column, rejected_rank: Column, n_scored: Column, gap: Column) -> Column:
    return F.when((chosen_rank == 0) & (rejected_rank == n_scored - 1), "best_vs_worst").when(gap >= 4, "high_gap").when(gap >= 2, "medium_gap").otherwise("low_gap")


def _edges(scored: DataFrame, minimums: dict[str, int], hard: list[str]) -> DataFrame:
    """Every candidate pair (better rank, worse rank) of a prompt, with the reasons against it."""
    fields = ["candidate_id", "expansion", "overall", "rank", *minimums, *CORE_FIELDS, "failure_modes"]
    rows = ranked(scored).select("prompt_id", "n_scored", F.struct(*[F.col(f).alias(f) for f in dict.fromkeys(fields)]).alias("c"))
    c, r = F.col("c"), F.col("r")
    both = rows.join(rows.select("prompt_id", F.col("c").alias("r")), "prompt_id").filter((r["rank"] > c["rank"]) & c["overall"].isNotNull() & r["overall"].isNotNull())
    return both.withColumn("gap", c["overall"] - r["overall"]).withColumn("guard", guardrail_failure(minimums, hard, c)).withColumn("core", core_failure(c, r))


def greedy_multi(scored: DataFrame, min_gap: int = 2, minimums: dict[str, int] = STRICT_GUARDRAILS, hard: list[str] = HARD_FAILURE_MODES, most: int = 4) -> DataFrame:
    """Pairs of each prompt by greedy matching: chosen ones from the best rank on, each against the worst one that is not
    rejected yet and passes gap and core checks, up to `most` pairs. A prompt's edges are one array that a fold goes through.
    """
    edges = _edges(scored, minimums, hard).filter(F.col("guard").isNull() & F.col("core").isNull() & (F.col("gap") >= min_gap))
    c, r = F.col("c"), F.col("r")
    edge = F.struct(c["rank"].alias("a"), (-r["rank"]).alias("b"), c["candidate_id"].alias("chosen_id"), r["candidate_id"].alias("rejected_id"), c["expansion"].alias("chosen"), r["expansion"].alias("rejected"), c["overall"].alias("chosen_score"), r["overall"].alias("rejected_score"))
    lists = edges.groupBy("prompt_id").agg(F.array_sort(F.collect_list(edge)).alias("e"), F.first("n_scored").alias("n_scored"))
    kind = lists.schema["e"].dataType.simpleString()
    free = lambda acc, x: (F.size(acc) < most) & ~F.exists(acc, lambda y: (y["a"] == x["a"]) | (y["b"] == x["b"]))
    taken = F.aggregate("e", F.array().cast(kind), lambda acc, x: F.when(free(acc, x), F.concat(acc, F.array(x))).otherwise(acc))
    out = lists.select("prompt_id", "n_scored", F.posexplode(taken).alias("slot", "x")).select("prompt_id", "slot", "n_scored", "x.*")
    gap = F.col("chosen_score") - F.col("rejected_score")
    out = out.withColumn("score_gap", gap).withColumn("chosen_rank", F.col("a")).withColumn("rejected_rank", -F.col("b"))
    return out.withColumn("pair_quality", pair_quality(F.col("chosen_rank"), F.col("rejected_rank"), F.col("n_scored"), gap)).drop("a", "b", "n_scored")


def greedy_skips(scored: DataFrame, min_gap: int = 2, minimums: dict[str, int] = STRICT_GUARDRAILS, hard: list[str] = HARD_FAILURE_MODES, most: int = 4) -> DataFrame:
    """(reason, n): of candidates that no guardrail lets be chosen, and of pairs that the matching looked at in vain."""
    pairs = greedy_multi(scored, min_gap, minimums, hard, most).select("prompt_id", "slot", "chosen_rank", "rejected_rank")
    edges = _edges(scored, minimums, hard).select("prompt_id", F.col("c.rank").alias("a"), F.col("r.rank").alias("b"), "gap", "guard", "core")
    full = pairs.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n_pairs"), F.max("chosen_rank").alias("last"))
    seen = edges.join(full, "prompt_id", "left").filter((F.coalesce("n_pairs", F.lit(0)) < most) | (F.col("a") <= F.col("last")))
    own = pairs.select("prompt_id", F.col("chosen_rank").alias("a"), F.col("rejected_rank").alias("at"))
    used = pairs.select("prompt_id", F.col("rejected_rank").alias("b"), F.col("chosen_rank").alias("by"))
    looked = seen.filter("guard is null").join(own, ["prompt_id", "a"], "left").join(used, ["prompt_id", "b"], "left")
    looked = looked.filter((F.col("at").isNull() | (F.col("b") > F.col("at"))) & (F.col("by").isNull() | (F.col("by") >= F.col("a"))))
    against = F.when(F.col("gap") < min_gap, "gap_too_small").otherwise(F.col("core"))
    by_pair = looked.select(against.alias("reason")).filter("reason is not null")
    # a candidate is met once, also the last one, which has no pair
    guard = ranked(scored).withColumn("guard", guardrail_failure(minimums, hard)).join(full, "prompt_id", "left")
    by_candidate = guard.filter("guard is not null and overall is not null").filter((F.coalesce("n_pairs", F.lit(0)) < most) | (F.col("rank") <= F.col("last"))).select(F.col("guard").alias("reason"))
    return by_pair.unionByName(by_candidate).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


def round_robin(pairs: DataFrame, target: int = 3000) -> DataFrame:
    """The first pair of every prompt in prompt order, then the second ones, until the target is met."""
    return pairs.orderBy("slot", "prompt_id").limit(target)


def priority_multi(scored: DataFrame, min_gap: int = 1, minimums: dict[str, int] = LOOSE_GUARDRAILS, hard: list[str] = HARD_FAILURE_MODES, most: int = 4, target: int | None = 3000) -> DataFrame:
    """The `most` ordered pairs of each prompt with the highest priority, and of all prompts the `target` highest."""
    fields = list(dict.fromkeys(["candidate_id", "expansion", "overall", *minimums, *CORE_FIELDS, "failure_modes"]))
    rows = scored_enough(scored).select("prompt_id", F.struct(*[F.col(f).alias(f) for f in fields]).alias("c"))
    c, r = F.col("c"), F.col("r")
    # what may be chosen is known before the join
    chosen = rows.filter(guardrail_failure(minimums, hard, c).isNull())
    both = chosen.join(rows.select("prompt_id", F.col("c").alias("r")), "prompt_id").withColumn("score_gap", c["overall"] - r["overall"])
    both = both.filter((c["candidate_id"] != r["candidate_id"]) & (F.col("score_gap") >= min_gap) & core_failure(c, r).isNull())
    both = both.withColumn("priority", n.pair_priority(F.col("score_gap"), r["failure_modes"], c["overall"], c["anti_magic_word_score"]))
    out = both.select("prompt_id", c["candidate_id"].alias("chosen_id"), r["candidate_id"].alias("rejected_id"), c["expansion"].alias("chosen"), r["expansion"].alias("rejected"), c["overall"].alias("chosen_score"), r["overall"].alias("rejected_score"), "score_gap", "priority")
    out = out.withColumn("place", F.row_number().over(by_prompt().orderBy(F.desc("priority"), "chosen_id", "rejected_id"))).filter(F.col("place") <= most)
    return out if target is None else out.orderBy(F.desc("priority"), "prompt_id", "place").limit(target)


def pair_summary(scored: DataFrame, pairs: DataFrame) -> DataFrame:
    """Prompts with enough scores, pairs, prompts with a pair, and pairs for each of the former."""
    valid = scored_enough(scored).select("prompt_id").distinct()
    counts = pairs.groupBy("prompt_id").agg(F.count(F.lit(1)).alias("n"))
    per = valid.join(counts, "prompt_id", "left")
    return per.agg(F.count(F.lit(1)).alias("valid_prompts"), F.coalesce(F.sum("n"), F.lit(0)).alias("pairs"), F.count("n").alias("prompts_with_pairs"), F.round(F.coalesce(F.sum("n"), F.lit(0)) / F.nullif(F.count(F.lit(1)), F.lit(0)), 6).alias("mean_pairs"))
