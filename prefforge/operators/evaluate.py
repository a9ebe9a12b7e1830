"""Comparison of checkpoints and diagnostics of reward hacking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions import numeric as n
from prefforge.functions import text as t
from prefforge.functions.constants import ARTIST_WORDS, MAGIC_WORDS
from prefforge.functions.tables import prefix_sums, shared_table

FLAGS = ["tokens", "magic_word_hits", "artist_hits", "repeated_3grams", "prompt_copy_ratio"]


def rm_summary(scores: DataFrame) -> DataFrame:
    """Of each checkpoint: mean, deviation over all and over prompts' means (population), range, shares above 0.5 and 0.9."""
    x = F.col("rm_score")
    # one pass: sums of each prompt, from which all of it follows
    per = scores.groupBy("checkpoint", "prompt_idx").agg(F.count(x).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"), F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum((x > 0.5).cast("int")).alias("a"), F.sum((x > 0.9).cast("int")).alias("b"))
    total = F.sum("n")
    mean = F.sum("s") / total
    spread = F.sqrt(F.greatest(F.lit(0.0), F.sum("q") / total - mean * mean))
    return per.groupBy("checkpoint").agg(mean.alias("rm_mean"), spread.alias("rm_std_overall"), F.stddev_pop(F.col("s") / F.col("n")).alias("rm_std_across_prompts"), F.min("lo").alias("rm_min"), F.max("hi").alias("rm_max"), (F.sum("a") / total).alias("frac_above_0_5"), (F.sum("b") / total).alias("frac_at_ceiling_0_9"))


def wide_checkpoints(scores: DataFrame, names: list[str], value: str = "rm_score") -> DataFrame:
    """One row of each (prompt, sample) with a column for each checkpoint."""
    wide = scores.groupBy("prompt_idx", "sample_idx").pivot("checkpoint", names).agg(F.first(value))
    return wide.select("prompt_idx", "sample_idx", *[F.col(c).alias(f"{c}__{value}") for c in names])


def hacking_flags(summary: DataFrame, order: str = "ord") -> DataFrame:
    """(flag, raised) over checkpoints in order: gains that accelerate at the end, a collapsed spread, a saturated ceiling,
    and whether none of the last two holds. No rows for fewer than three checkpoints."""
    one = Window.partitionBy(F.lit(0)).orderBy(order)
    every = one.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    m = F.col("rm_mean")
    lined = summary.withColumns({"m1": F.lag(m, 1).over(one), "m2": F.lag(m, 2).over(one), "s0": F.first("rm_std_overall").over(every), "c0": F.first("frac_at_ceiling_0_9").over(every), "place": F.row_number().over(one), "n": F.count(F.lit(1)).over(every)})
    last = lined.filter("place = n and n >= 3")
    gain, gain_before = m - F.col("m1"), F.col("m1") - F.col("m2")
    spread, ceiling = F.col("rm_std_overall"), F.col("frac_at_ceiling_0_9")
    flags = {
        "accelerating_reward": (gain > 1.5 * gain_before) & (gain > 0.1),
        "std_collapsed": spread < 0.5 * F.col("s0"),
        "ceiling_saturated": (ceiling > 0.3) & (F.col("c0") < 0.05),
        "no_strong_flags": (spread >= 0.5 * F.col("s0")) & (ceiling <= 0.3),
    }
    return last.select(F.explode(F.array(*[F.struct(F.lit(k).alias("flag"), v.alias("raised")) for k, v in flags.items()])).alias("f")).select("f.*")


def reward_stats(scores: DataFrame, column: str = "rm_score") -> DataFrame:
    x = F.col(column)
    return scores.agg(F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"), F.stddev_pop(x).alias("std"), F.avg((x > 0).cast("int")).alias("frac_positive"), F.count(x).alias("n"))


def paired(base: DataFrame, other: DataFrame, keys: list[str], column: str = "rm_score") -> DataFrame:
    """Scores of two checkpoints side by side, by position."""
    return base.select(*keys, F.col(column).alias("base")).join(other.select(*keys, F.col(column).alias("other")), keys)


def paired_stats(pairs: DataFrame) -> DataFrame:
    win = (F.col("other") > F.col("base")).cast("int")
    return pairs.agg((F.avg("other") - F.avg("base")).alias("delta"), F.sum(win).alias("wins"), F.avg(win).alias("win_rate"))


def theta_win_rate(good: DataFrame, bad: DataFrame, column: str = "score") -> DataFrame:
    """Share of all (good, bad) pairs in which the good one scores higher, by ranks instead of a cross join: each good score
    beats as many bad ones as have a smaller score. Scores are counted by value, and the counts summed up by ranges."""
    counts = good.select(F.col(column).alias("x"), F.lit(1).alias("g"), F.lit(0).alias("b")).unionByName(bad.select(F.col(column).alias("x"), F.lit(0).alias("g"), F.lit(1).alias("b"))).groupBy("x").agg(F.sum("g").alias("g"), F.sum("b").alias("b"))
    won = prefix_sums(counts.filter("x is not null"), "x", "b").withColumn("won", F.col("g") * F.col("before")).agg(F.sum("won").alias("wins"), (F.sum("g") * F.sum("b")).alias("pairs"))
    return won.select("wins", "pairs", (F.col("wins") / F.nullif(F.col("pairs"), F.lit(0))).alias("win_rate"))


def good_bad(labelled: DataFrame) -> DataFrame:
    x = F.col("score")
    return labelled.groupBy("label").agg(F.count(x).alias("n"), F.avg(x).alias("mean"), F.min(x).alias("min"), F.max(x).alias("max"))


def top_reward(wide: DataFrame, column: str, least: float = 0.9) -> DataFrame:
    return wide.filter(F.col(column) > least).orderBy(F.desc(column))


def degenerate(texts: DataFrame, key: str, column: str, share: float = 0.6, least: int = 5) -> DataFrame:
    """(key, n_tokens, top_share, degenerate): whether one token is more than `share` of more than `least` tokens. A text's
    tokens are counted within its row: sorted, equal ones follow each other."""

    def counted(tokens: Column) -> Column:
        start = F.struct(F.lit(None).cast("string").alias("token"), F.lit(0).alias("run"), F.lit(0).alias("top"))

        def step(acc: Column, token: Column) -> Column:
            run = F.when(acc["token"] == token, acc["run"] + 1).otherwise(1)
            return F.struct(token.alias("token"), run.alias("run"), F.greatest(acc["top"], run).alias("top"))

        return F.struct(F.size(tokens).cast("long").alias("n"), F.aggregate(F.array_sort(tokens), start, step, lambda acc: acc["top"]).cast("long").alias("top"))

    found = texts.select(key, t.bound(F.coalesce(t.tokens(F.col(column)), F.array().cast("array<string>")), counted).alias("c"))
    n_tokens = F.col("c.n")
    top = F.when(n_tokens > 0, F.col("c.top") / F.nullif(n_tokens, F.lit(0))).otherwise(0.0)
    return found.select(key, n_tokens.alias("n_tokens"), top.alias("top_share"), ((n_tokens > least) & (top > share)).alias("degenerate"))


def check_rows(checks: list[tuple[str, Column, Column]]) -> Column:
    """Array of (check_name, status, detail): status of a boolean column, null being a warning."""
    status = lambda c: F.when(c.isNull(), "warn").when(c, "pass").otherwise("fail")
    return F.array(*[F.struct(F.lit(k).alias("check_name"), status(c).alias("status"), d.alias("detail")) for k, c, d in checks])


def sanity_checks(texts: DataFrame, pairs: DataFrame, kl: DataFrame, key: str, column: str) -> DataFrame:
    """(check_name, status, detail) of outputs, of rewards against a base model's by prompt, and of the divergence."""
    out = texts.join(degenerate(texts, key, column).select(key, "degenerate", "n_tokens"), key)
    quality = out.agg(F.sum((F.trim(column) == "").cast("int")).alias("empty"), F.sum(F.col("degenerate").cast("int")).alias("bad"), F.count(F.lit(1)).alias("n"), F.avg("n_tokens").alias("len"))
    stats = reward_stats(pairs, "other").join(F.broadcast(paired_stats(pairs))).join(F.broadcast(quality.withColumnRenamed("n", "n_texts"))).join(F.broadcast(kl.agg(F.avg("kl").alias("kl"))))
    c = F.col
    text = lambda f, *a: F.format_string(f, *a)
    true = F.lit(True)
    checks = [
        ("empty_outputs", c("empty") == 0, text("%d/%d empty", c("empty"), c("n_texts"))),
        ("repetition_check", c("bad") == 0, text("%d/%d degenerate", c("bad"), c("n_texts"))),
        ("reward_mean", c("mean") > 0, text("mean %.3f", c("mean"))),
        ("reward_diversity", F.when(c("std") >= 0.01, true), text("std %.3f", c("std"))),
        ("reward_improvement", c("delta") > 0, text("delta %.3f", c("delta"))),
        ("win_rate", c("win_rate") >= 0.5, text("%d wins", c("wins"))),
        ("kl_divergence", F.when((c("kl") >= 0.1) & (c("kl") <= 20), true), text("kl %.3f", c("kl"))),
        ("val_frac_positive", c("frac_positive") >= 0.5, text("%.2f positive", c("frac_positive"))),
    ]
    return stats.select(F.explode(check_rows(checks)).alias("x")).select("x.*")


def overall_status(checks: DataFrame) -> DataFrame:
    """Counts by status, and fail if any fails, else warn if any warns, else pass (exit code 1 for fail)."""
    count = lambda s: F.sum((F.col("status") == s).cast("int"))
    out = checks.agg(count("pass").alias("n_pass"), count("warn").alias("n_warn"), count("fail").alias("n_fail"))
    return out.withColumn("overall", F.when(F.col("n_fail") > 0, "fail").when(F.col("n_warn") > 0, "warn").otherwise("pass")).withColumn("exit_code", (F.col("n_fail") > 0).cast("int"))


def rm_separation(labelled: DataFrame) -> DataFrame:
    """Gap of the labels' means and win rate; passed if the gap is positive and more than 0.9 of pairs are won."""
    wide = labelled.groupBy().agg((F.avg(F.when(F.col("label") == "good", F.col("score"))) - F.avg(F.when(F.col("label") == "bad", F.col("score")))).alias("gap"))
    rate = theta_win_rate(labelled.filter("label = 'good'"), labelled.filter("label = 'bad'"))
    return wide.join(F.broadcast(rate)).withColumn("passed", (F.col("gap") > 0) & (F.col("win_rate") > 0.9))


def text_flags(prompt: Column, text: Column) -> Column:
    """The flags of a text as a struct; it is cut into words once for all of them."""
    flags = lambda x: F.struct(
        F.size(x["words"]).alias("tokens"),
        t.hits_in(x["low"], MAGIC_WORDS).alias("magic_word_hits"),
        t.hits_in(x["low"], ARTIST_WORDS).alias("artist_hits"),
        t.repeated_in(x["words"], 3).alias("repeated_3grams"),
        t.round_half_even(t.share_known(x["words"], x["known"]), 3).alias("prompt_copy_ratio"),
    )
    parts = lambda low: F.struct(t.tokens(low).alias("words"), t.known_words(prompt).alias("known"), low.alias("low"))
    return t.bound(F.lower(text), lambda low: t.bound(parts(low), flags))


def reviewed(texts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """prompt, sft and dpo texts with their flags and risks. keep: the columns that stay, if not all; texts that are not wanted are
    not written."""
    sides = ("sft", "dpo")
    # written once: a range sort reads its input twice, first to find the ranges
    made = texts.withColumns({f"_{s}": text_flags(F.col("prompt"), F.col(s)) for s in sides})
    out = shared_table(made if keep is None else made.select(*keep, *[f"_{s}" for s in sides]), "flags")
    for s in sides:
        c = lambda k, s=s: F.col(f"_{s}")[k]
        risk = n.heuristic_risk(c("magic_word_hits"), c("artist_hits"), c("repeated_3grams"), c("tokens"), c("prompt_copy_ratio"))
        out = out.withColumns({f"{s}_{k}": c(k) for k in FLAGS} | {f"{s}_risk": risk})
    return out.drop(*[f"_{s}" for s in sides])


def layer3(texts: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """`reviewed` texts, those first whose dpo text is most suspicious."""
    return reviewed(texts, keep).orderBy(F.desc(F.col("dpo_risk") - F.col("sft_risk")), F.desc("dpo_risk"))


def layer3_averages(reviewed: DataFrame) -> DataFrame:
    """(metric, sft, dpo) means of the flags; 0 for no rows."""
    means = reviewed.agg(*[F.coalesce(F.avg(f"{s}_{k}"), F.lit(0.0)).alias(f"{s}_{k}") for s in ("sft", "dpo") for k in FLAGS])
    rows = F.array(*[F.struct(F.lit(k).alias("metric"), F.col(f"sft_{k}").alias("sft"), F.col(f"dpo_{k}").alias("dpo")) for k in FLAGS])
    return means.select(F.explode(rows).alias("x")).select("x.*")


def shared_tails(texts: DataFrame, column: str, n_tokens: int = 10, least: int = 2) -> DataFrame:
    """(tail, n): ends that several texts share (an extension: a sign of a template)."""
    return texts.groupBy(t.tail_tokens(F.col(column), n_tokens).alias("tail")).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least)
