"""Numeric, date, array and null functions, as expressions of Spark columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from prefforge.functions.constants import COST_PER_1000_TOKENS, GENERIC_FAILURE_MODES, HARD_FAILURE_MODES, IGNORED_LABEL, OBJECTIVE_FIELDS, OVERALL_WEIGHTS
from prefforge.functions.text import bound


def win_probability(mine: Column, other: Column) -> Column:
    """mine / (mine + other); 0 where both are next to nothing."""
    total = mine + other
    return F.when(total < 1e-9, F.lit(0.0)).otherwise(mine / F.nullif(total, F.lit(0.0)))


def pair_priority(gap: Column, rejected_modes: Column, chosen_score: Column, chosen_anti_magic: Column) -> Column:
    """3 * gap, 2 for a hard failure of the rejected one, 1 for a generic one, and a tenth of the chosen one's scores."""
    has = lambda names: F.arrays_overlap(rejected_modes, F.array(*[F.lit(n) for n in names]))
    anti = F.when(chosen_anti_magic.isNull() | (chosen_anti_magic == 0), 5).otherwise(chosen_anti_magic)
    return 3.0 * gap + F.when(has(HARD_FAILURE_MODES), 2.0).otherwise(0.0) + F.when(has(GENERIC_FAILURE_MODES), 1.0).otherwise(0.0) + F.coalesce(chosen_score, F.lit(0)) / 10.0 + anti / 10.0


def weighted_overall() -> Column:
    """The overall score by the judge's weights and caps (on columns named like the objectives and failure_modes)."""
    total = sum((F.col(f) * w for f, w in OVERALL_WEIGHTS.items()), F.lit(0.0))
    has = lambda name: F.array_contains("failure_modes", name)
    caps = [
        F.when(F.col("fidelity") <= 4, 5.0),
        F.when(F.col("anti_magic_word_score") <= 4, 5.0),
        F.when(has("restatement"), 6.0),
        F.when(has("irrelevant_artist"), 5.0),
        F.when(has("off_topic") | has("contradiction"), 4.0),
    ]
    return F.when(total.isNotNull(), F.least(total, *caps))


def heuristic_risk(magic: Column, artists: Column, repeated: Column, n_tokens: Column, copied: Column) -> Column:
    return 2.0 * magic + 2.5 * artists + repeated + F.greatest(F.lit(0), n_tokens - 70) / 10 + F.greatest(F.lit(0.0), copied - 0.45) * 4


def cost(tokens: Column) -> Column:
    return F.bround(tokens / 1000 * COST_PER_1000_TOKENS, 2)


def perplexity(loss: Column) -> Column:
    """exp(loss), infinite where that overflows."""
    return F.exp(loss)


def dpo_logit(chosen: Column, rejected: Column, ref_chosen: Column, ref_rejected: Column, beta: float = 0.1) -> Column:
    return F.lit(beta) * ((chosen - rejected) - (ref_chosen - ref_rejected))


def dpo_loss(logit: Column) -> Column:
    """-log(sigmoid(logit)), without overflow on either side."""
    return F.greatest(-logit, F.lit(0.0)) + F.log1p(F.exp(-F.abs(logit)))


def token_accuracy(predicted: Column, labels: Column) -> Column:
    """Share of positions where the prediction before a label is that label; masked labels count as errors."""
    n = F.size(labels) - 1
    hits = F.zip_with(F.slice(predicted, F.lit(1), n), F.slice(labels, F.lit(2), n), lambda p, y: (p == y).cast("int"))
    return F.when(n > 0, F.aggregate(hits, F.lit(0), lambda a, x: a + x) / n)


def sequence_logp(logps: Column, labels: Column) -> Column:
    """Sum of log-probabilities over labels that are not masked; logps[i] belongs to labels[i + 1]."""
    n = F.size(labels) - 1
    kept = F.zip_with(F.slice(logps, F.lit(1), n), F.slice(labels, F.lit(2), n), lambda p, y: F.when(y != IGNORED_LABEL, p).otherwise(0.0))
    return F.when(n > 0, F.aggregate(kept, F.lit(0.0), lambda a, x: a + x)).otherwise(0.0)


def token_kl(target_logp: Column, input_logp: Column) -> Column:
    """Sum of target * (log target - input): the divergence of the base from the trained model, as it is reported."""
    return F.aggregate(F.zip_with(target_logp, input_logp, lambda t, i: F.exp(t) * (t - i)), F.lit(0.0), lambda a, x: a + x)


def reward_logit(logits: Column) -> Column:
    """One logit: itself; two: the second less the first; more: the largest."""
    return F.when(F.size(logits) == 1, logits[0]).when(F.size(logits) == 2, F.element_at(logits, 2) - logits[0]).otherwise(F.array_max(logits))


def int_1_to_10(json: Column, path: str) -> Column:
    """A whole number from 1 to 10 out of a JSON text (fractions are cut, numbers in quotes and true count); else null."""
    got = F.try_variant_get(F.try_parse_json(json), path, "int")
    return F.when(got.between(1, 10), got)


def within(later: Column, earlier: Column, interval: str = "1 HOUR") -> Column:
    return (later - earlier) < F.expr(f"INTERVAL {interval}")


def normalise_modes(modes: Column, allowed: list[str] | None = None) -> Column:
    """Failure modes in one spelling, those allowed, each once in order, `none` only where it is alone."""
    each = F.transform(modes, lambda m: F.translate(F.lower(F.trim(m)), " -", "__"))
    each = F.filter(each, lambda m: m.isNotNull() & (m != ""))
    if allowed is not None:
        each = F.filter(each, lambda m: m.isin(allowed))
    each = F.array_distinct(each)
    return F.when(F.size(each) > 1, F.array_remove(each, "none")).otherwise(F.coalesce(each, F.array().cast("array<string>")))


def default_modes(modes: Column) -> Column:
    return F.when(F.coalesce(F.size(modes), F.lit(0)) <= 0, F.array(F.lit("none"))).otherwise(modes)


def hard_modes(modes: Column, hard: list[str] = HARD_FAILURE_MODES) -> Column:
    """The hard ones among modes, sorted and joined by +."""
    return F.array_join(F.array_sort(F.array_intersect(modes, F.array(*[F.lit(m) for m in hard]))), "+")


def score_payload(overall: str = "overall") -> Column:
    return F.struct(F.col(overall).alias("overall"), *[F.col(f) for f in OBJECTIVE_FIELDS], F.col("failure_modes"), F.col("reason"))


def at_least(x: Column, least: int) -> Column:
    """A missing score passes."""
    return F.coalesce(x >= least, F.lit(True))


def first_failure(checks: list[tuple[Column, Column]]) -> Column:
    """The reason of the first check that holds; null if none does."""
    return F.coalesce(*[F.when(c, r) for c, r in checks])


def block_size(requested: int | None, model_max: int, cap: int = 1024) -> int:
    return min(cap if requested is None else requested, model_max)


def mask_prompt_labels(labels: Column, separator: int) -> Column:
    """Labels up to the first separator are masked; nothing is if it is missing or comes first."""

    def mask(x: Column) -> Column:
        return F.when(x["at"] > 1, F.transform(x["y"], lambda y, i: F.when(i + 1 <= x["at"], IGNORED_LABEL).otherwise(y))).otherwise(x["y"])

    return bound(labels, lambda y: bound(F.struct(y.alias("y"), F.array_position(y, separator).alias("at")), mask))


def dpo_encode(prompt: Column, completion: Column, max_length: int = 256) -> tuple[Column, Column]:
    """(ids, labels) of prompt and completion, the prompt masked, cut on the left to max_length."""
    cut = lambda x: F.slice(x, F.greatest(F.lit(1), F.size(x) - max_length + 1), F.lit(max_length))
    ids = F.concat(prompt, completion)
    labels = F.concat(F.transform(prompt, lambda _: F.lit(IGNORED_LABEL)), completion)
    return bound(ids, cut), bound(labels, cut)


def pad(x: Column, to: Column, value: int) -> Column:
    return F.concat(x, F.array_repeat(F.lit(value), F.greatest(F.lit(0), to - F.size(x))))
