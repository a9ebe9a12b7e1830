"""Reward-model data: annotations, pairwise scores, training pairs and splits."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefforge.functions import numeric as n
from prefforge.functions import text as t
from prefforge.functions.tables import number_rows, shared_buckets, shared_table
from prefforge.operators.dedup import exact_first, last_wins

#: Different judgements (winner, loser) of a description that one task fits by itself.
LOCAL_PAIRS = 1_000_000


def join_prompts(annotations: DataFrame, images: DataFrame) -> DataFrame:
    """Annotations with the prompts of their two first images (a later row of an image's name wins). Spark broadcasts the
    map where it is small."""
    names = last_wins(images, ["image_name"], "img_idx").select("image_name", "prompt")
    out = annotations
    for side in ("left", "right"):
        own = names.select(F.col("image_name").alias(f"{side}_0"), F.col("prompt").alias(f"{side}_prompt"))
        out = out.join(own, f"{side}_0")
    return out


def not_golden(annotations: DataFrame, column: str = "golden") -> DataFrame:
    return annotations.filter(F.col(column).isNull())


def comparisons(annotations: DataFrame) -> DataFrame:
    """(descr, winner, loser) of each judged pair."""
    left = F.col("result") == "left"
    return annotations.select("descr", F.when(left, F.col("left_prompt")).otherwise(F.col("right_prompt")).alias("winner"), F.when(left, F.col("right_prompt")).otherwise(F.col("left_prompt")).alias("loser"))


def bradley_terry(wins: DataFrame, iterations: int = 100, tolerance: float = 0.0, local_pairs: int = LOCAL_PAIRS) -> DataFrame:
    """(descr, prompt, score) of (descr, winner, loser): strengths that sum to 1 within a description, by the
    minorise-maximise steps p_i <- W_i / sum_j n_ij / (p_i + p_j), until none of a description moves by `tolerance`.

    Wins are counted in Spark. Descriptions of at most local_pairs different judgements are fitted in a task each; larger
    ones together by steps over all their pairs, which need no more memory however many prompts one has. Both give the
    same. Rows with a null in any column do not count.
    """
    counts = wins.filter("descr is not null and winner is not null and loser is not null").groupBy("descr", "winner", "loser").agg(F.count(F.lit(1)).alias("n"))
    counts = shared_table(counts, "judgements")
    large = counts.groupBy("descr").agg(F.count(F.lit(1)).alias("c")).filter(F.col("c") > local_pairs).select("descr")
    if large.isEmpty():
        return _fitted(counts, iterations, tolerance)
    return _fitted(counts.join(large, "descr", "left_anti"), iterations, tolerance).unionByName(_stepped(counts.join(large, "descr", "left_semi"), iterations, tolerance))


def _fitted(counts: DataFrame, iterations: int, tolerance: float) -> DataFrame:
    """Each description in a task of its own."""

    def fit(key, pdf: pd.DataFrame) -> pd.DataFrame:
        names, code = np.unique(np.concatenate([pdf["winner"], pdf["loser"]]).astype(str), return_inverse=True)
        w, l = code[: len(pdf)], code[len(pdf) :]
        k, m = pdf["n"].to_numpy(float), len(names)
        own = np.bincount(w, k, m)
        p = np.full(m, 1 / m)
        for _ in range(iterations):
            share = k / (p[w] + p[l])
            below = np.bincount(w, share, m) + np.bincount(l, share, m)
            new = np.where(below > 0, own / np.maximum(below, 1e-300), 0)
            new = new / new.sum()
            moved = np.abs(new - p).max()
            p = new
            if moved < tolerance:
                break
        return pd.DataFrame({"descr": key[0], "prompt": names, "score": p})

    return counts.groupBy("descr").applyInPandas(fit, "descr string, prompt string, score double")


def _stepped(counts: DataFrame, iterations: int, tolerance: float) -> DataFrame:
    """All descriptions together: a step joins the pairs with the strengths of both sides and sums up what each prompt meets.
    Pairs are written once, dealt by one side; strengths (a number and three values for each prompt) are written at each step,
    which cuts the lineage. Descriptions that have come to rest leave the pairs."""
    sides = counts.select("descr", F.col("winner").alias("prompt"), F.col("n").alias("won")).unionByName(counts.select("descr", F.col("loser").alias("prompt"), F.lit(0).cast("long").alias("won")))
    nodes = sides.groupBy("descr", "prompt").agg(F.sum("won").cast("double").alias("won")).withColumn("id", F.monotonically_increasing_id())
    nodes = shared_table(nodes, "prompts")
    number = lambda side, c: nodes.select("descr", F.col("prompt").alias(side), F.col("id").alias(c))
    pairs = counts.join(number("winner", "w"), ["descr", "winner"]).join(number("loser", "l"), ["descr", "loser"])
    # a description is known by a number too, that of one of its prompts
    of = nodes.groupBy("descr").agg(F.min("id").alias("g"), F.count(F.lit(1)).alias("m"))
    pairs = pairs.groupBy("descr", F.least("w", "l").alias("a"), F.greatest("w", "l").alias("b")).agg(F.sum("n").alias("n"))
    pairs = shared_buckets(pairs.join(of.select("descr", "g"), "descr").select("a", "b", "n", "g"), "judged_pairs", "a")
    p = shared_table(nodes.join(of, "descr").select("id", "g", "won", (1 / F.col("m")).alias("p"), F.lit(True).alias("moves")), "strengths")
    for _ in range(iterations):
        both = pairs.join(p.filter("moves").select(F.col("id").alias("a"), F.col("p").alias("pa")), "a").join(p.select(F.col("id").alias("b"), F.col("p").alias("pb")), "b")
        share = F.col("n") / (F.col("pa") + F.col("pb"))
        ends = both.select(F.explode(F.array(F.struct(F.col("a").alias("id"), share.alias("s")), F.struct(F.col("b").alias("id"), share.alias("s")))).alias("e"))
        below = ends.groupBy("e.id").agg(F.sum("e.s").alias("below"))
        raw = p.filter("moves").join(below, "id").select("id", "g", "won", F.col("p").alias("old"), (F.col("won") / F.col("below")).alias("raw"))
        raw = shared_table(raw, "raw-strengths")
        total = raw.groupBy(F.col("g").alias("_g")).agg(F.sum("raw").alias("total"))
        new = raw.join(total, F.col("g") == F.col("_g")).select("id", "g", "won", "old", (F.col("raw") / F.col("total")).alias("p"))
        if tolerance <= 0:
            p = shared_table(new.select("id", "g", "won", "p", F.lit(True).alias("moves")), "strengths")
            continue
        new = shared_table(new, "new-strengths")
        far = new.groupBy(F.col("g").alias("_g")).agg((F.max(F.abs(F.col("p") - F.col("old"))) >= tolerance).alias("moves"))
        rest = p.filter("not moves")
        p = shared_table(new.join(far, F.col("g") == F.col("_g")).select("id", "g", "won", "p", "moves").unionByName(rest), "strengths")
        if p.filter("moves").isEmpty():
            break
    return nodes.join(p.select("id", F.col("p").alias("score")), "id").select("descr", "prompt", "score")


def all_pairs(scores: DataFrame) -> DataFrame:
    """(descr, left, right, y): every unordered pair of prompts of a description once, and how likely the left one wins."""
    a, b = scores.alias("a"), scores.alias("b")
    both = a.join(b, (F.col("a.descr") == F.col("b.descr")) & (F.col("a.prompt") < F.col("b.prompt")))
    text = lambda s: t.reward_text(F.col(f"{s}.descr"), F.col(f"{s}.prompt"))
    return both.select(F.col("a.descr").alias("descr"), text("a").alias("left"), text("b").alias("right"), n.win_probability(F.col("a.score"), F.col("b.score")).alias("y"))


def oriented(pairs: DataFrame) -> DataFrame:
    """(chosen, rejected): the left one is chosen where it wins at least half the time."""
    first = F.col("y") >= 0.5
    return pairs.select(F.when(first, F.col("left")).otherwise(F.col("right")).alias("chosen"), F.when(first, F.col("right")).otherwise(F.col("left")).alias("rejected"))


def held_out(key: Column, share: int = 20, of: int = 100) -> Column:
    """Whether a group is held out; a hash of the group's key decides, so a group never straddles the split."""
    return F.pmod(F.xxhash64(key), F.lit(of)) < share


def split_groups(df: DataFrame, group: str, share: int = 20) -> tuple[DataFrame, DataFrame]:
    out = held_out(F.col(group), share)
    return df.filter(~out), df.filter(out)


def sample_rows(df: DataFrame, order: Column, n_rows: int) -> DataFrame:
    """Exactly n rows, by the order of a key (a hash, for a random sample)."""
    return df.orderBy(order).limit(n_rows)


def eval_size(n_rows: int, fraction: float | None = None, most: int = 200) -> int:
    """Rows to hold out: a tenth up to `most`, or a fraction but one at least."""
    return min(most, n_rows // 10) if fraction is None else max(1, int(n_rows * fraction))


def without_leaks(df: DataFrame, held: DataFrame, key: str) -> DataFrame:
    """Rows whose key the held-out rows do not have."""
    return df.join(held.select(key).distinct(), key, "left_anti")


def one_of_group(df: DataFrame, group: str, order: Column) -> DataFrame:
    return exact_first(df, [group], [order])


def mismatched(prompts: DataFrame, seed: Column) -> DataFrame:
    """Own prompt against one of another description: descriptions in hash order, each with the next one's."""
    own = one_of_group(prompts, "descr", seed).select("descr", "prompt", F.struct(F.pmod(seed, F.lit(1 << 30)).alias("k"), "descr").alias("place"))
    lined, total = number_rows(own, "place")
    other = lined.select(F.pmod(F.col("at") - 1, F.lit(max(1, total))).alias("at"), F.col("prompt").alias("other"))
    return lined.join(other, "at").select("descr", t.reward_text(F.col("descr"), F.col("prompt")).alias("left"), t.reward_text(F.col("descr"), F.col("other")).alias("right"), F.lit(1.0).alias("y"))


def doubled(prompts: DataFrame, seed: Column, other_seed: Column) -> DataFrame:
    """Own prompt against another prompt of the same description in front of it (the same one, if it is alone)."""
    own = one_of_group(prompts, "descr", seed).select("descr", "prompt")
    rest = prompts.join(own.withColumnRenamed("prompt", "p"), "descr").filter("prompt <> p").drop("p")
    other = one_of_group(rest, "descr", other_seed).select("descr", F.col("prompt").alias("other"))
    both = own.join(other, "descr", "left").withColumn("other", F.coalesce("other", "prompt"))
    return both.select("descr", t.reward_text(F.col("descr"), F.col("prompt")).alias("left"), t.reward_text(F.col("descr"), F.concat_ws(" ", "other", "prompt")).alias("right"), F.lit(1.0).alias("y"))


def vocabulary(prompts: DataFrame, column: str = "prompt") -> DataFrame:
    """Distinct words."""
    return prompts.select(F.explode(t.words(F.col(column))).alias("word")).distinct()


def word_salad(prompts: DataFrame, seed: Column, draw, most: int = 9) -> DataFrame:
    """Own prompt against 0 to `most` random words of all prompts. draw(seed, i) gives the place of the i-th word; words
    are numbered in their order by ranges, and only the drawn ones are joined."""
    own = one_of_group(prompts, "descr", seed).withColumn("s", F.pmod(seed, F.lit(1 << 30)))
    numbered, n_words = number_rows(vocabulary(prompts), "word")
    drawn = own.select("descr", F.explode_outer(F.transform(F.sequence(F.lit(0), F.lit(most)), lambda i: F.when(i < F.pmod(F.col("s"), F.lit(most + 1)), F.struct(i.alias("i"), F.pmod(draw(F.col("s"), i), F.lit(max(1, n_words))).alias("at"))))).alias("x")).filter("x is not null").select("descr", "x.*")
    found = drawn.join(numbered, "at").groupBy("descr").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "word"))), lambda x: x["word"]), " ").alias("salad"))
    both = own.join(found, "descr", "left")
    return both.select("descr", t.reward_text(F.col("descr"), F.col("prompt")).alias("left"), t.reward_text(F.col("descr"), F.coalesce("salad", F.lit(""))).alias("right"), F.lit(1.0).alias("y"))
