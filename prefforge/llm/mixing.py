"""Mixing sources to target weights, with DataFrame functions only.

Every row gets a hash-random key. Within a source the rows are range-sorted by it: equal ranges of the key are summed up by
themselves, and prefix sums of the ranges' totals tell in which range the source's budget ends. Rows of the ranges before it
are taken, rows of those behind it are not, and only the rows of that one range are sorted and summed up one by one, to cut
at the exact word. Rows move neither for the ranges (sums do) nor for the cut (one range of each source does).
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions.tables import number_rows, prefix_sums, shared_table
from prefforge.llm.textops import n_words, named_columns, numbered_columns, whole

#: Weights of the sources in code-point order, repeating; the mix's size and each source's most, as shares of what there is.
WEIGHTS = (3, 1, 2)
TOTAL_SHARE = 1.5
MOST_EPOCHS = 2
#: Fewest hexadecimal digits of the key that tell its range.
RANGE_DIGITS = 2


def source_targets(sources: DataFrame, weights=WEIGHTS, total_share: float = TOTAL_SHARE, most: int = MOST_EPOCHS) -> DataFrame:
    """(source, source_size) -> also target (double).

    A target is min(most * size, level * weight): what sources cannot take is reshared by weight among the others until
    none is above its most. The level is found by going through the sources by most * size / weight, ties by their place;
    places and sums come from range sorts, so there may be any number of sources.
    """
    numbered, _ = number_rows(sources.withColumn("_o", F.struct(F.col("source").isNull(), "source")), "_o")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("at") % len(weights) + 1).cast("int"))
    ranked = numbered.withColumn("weight", weight).withColumn("most", F.col("source_size") * F.lit(float(most)))
    ranked = ranked.withColumn("ratio", F.struct((F.col("most") / F.col("weight")).alias("r"), F.col("at").alias("p")))
    lined = prefix_sums(prefix_sums(ranked.drop("_o", "at"), "ratio", "most", "_most"), "ratio", "weight", "_weight")
    all_ = lined.agg(F.sum("source_size").alias("s"), F.sum("weight").alias("w")).first()
    left, weights_left = F.lit(float(all_["s"] or 0) * total_share) - F.col("_most"), F.lit(all_["w"] or 0.0) - F.col("_weight")
    # the first source that the level leaves below its most fixes the level for all after it
    open_ = lined.select("ratio", left.alias("l"), weights_left.alias("w")).filter(F.col("l") / F.col("w") <= F.col("ratio.r"))
    first = open_.agg(F.min(F.struct("ratio", "l", "w")).alias("f")).first()["f"]
    share = F.col("most") if first is None else F.col("weight") * F.lit(first["l"]) / F.lit(first["w"])
    return lined.select("source", "source_size", F.least("most", share).alias("target"))


def mix_key(row_id: Column, text: Column, seed: int) -> Column:
    """The key of a row: rows without an id, or with the same one, are told apart by their texts."""
    return F.md5(F.concat(F.coalesce(row_id.cast("string"), F.lit("")), F.lit(":"), F.md5(whole(text)), F.lit(f":{seed}")))


def range_digits(rows: int) -> int:
    """Digits of the key that tell its range: there are about as many ranges of a source as rows in one of them, so that both
    what is summed up by ranges and what is sorted at the cut grow as the square root of the rows."""
    return max(RANGE_DIGITS, math.ceil(math.log(max(rows, 1), 16) / 2))


def _cuts(keyed: DataFrame, digits: int) -> tuple[DataFrame, DataFrame]:
    """keyed (source, size, key) -> ((_s, source_size, target, epochs, budget, cut): where each source's budget ends; (_gs,
    _gk, rows, before): the keys of the ranges in which they end, how many rows have each, and the words before them)."""
    ranges = shared_table(keyed.groupBy("source", F.left("key", F.lit(digits)).alias("range")).agg(F.sum("size").alias("words")), "mix-ranges")
    targets = shared_table(source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size"))), "mix-targets")
    budget = F.floor(F.col("target") + F.lit(0.5)).cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = targets.select(F.col("source").alias("_s"), "source_size", "target", epochs.alias("epochs"), (budget - epochs * F.col("source_size")).alias("rest"))
    along = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)  # at most 16 ** digits ranges
    placed = ranges.withColumn("offset", F.coalesce(F.sum("words").over(along), F.lit(0))).join(plan, F.col("source").eqNullSafe(F.col("_s")))
    # the range whose words hold the end: at or before it is the rest, behind it is not
    ends = placed.filter((F.col("offset") <= F.col("rest")) & (F.col("rest") < F.col("offset") + F.col("words")))
    cuts = ends.select("_s", "source_size", "target", "epochs", "rest", F.col("range").alias("cut"), "offset")
    # sources without words have no such range, and nothing is taken of them
    empty = plan.filter("source_size = 0").select("_s", "source_size", "target", "epochs", "rest", F.lit("").alias("cut"), F.lit(0).cast("long").alias("offset"))
    cuts = shared_table(cuts.unionByName(empty), "mix-cuts")
    at_end = keyed.join(cuts, F.col("source").eqNullSafe(F.col("_s")) & (F.left("key", F.lit(digits)) == F.col("cut")))
    groups = at_end.groupBy(F.col("source").alias("_gs"), F.col("key").alias("_gk")).agg(F.count(F.lit(1)).alias("rows"), F.first("size").alias("each"), F.first("offset").alias("offset"))
    inside = Window.partitionBy("_gs").orderBy("_gk").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.withColumn("before", F.col("offset") + F.coalesce(F.sum(F.col("rows") * F.col("each")).over(inside), F.lit(0)))
    return cuts, shared_table(groups.select("_gs", "_gk", "rows", "before"), "mix-ends")


def _taken(slim: DataFrame, keyed: DataFrame) -> DataFrame:
    """keyed (source, size, key, ...) with source_size, target and taken; slim is its written (source, size, key). Only rows of
    the ranges at which budgets end are joined by their key."""
    digits = range_digits(slim.count())
    cuts, groups = _cuts(slim, digits)
    rows = keyed.join(cuts.drop("offset"), F.col("source").eqNullSafe(F.col("_s")))
    range_ = F.left("key", F.lit(digits))
    whole_epochs = F.col("epochs") * F.col("size")
    apart = rows.filter(range_ != F.col("cut")).withColumn("taken", whole_epochs + F.when(range_ < F.col("cut"), F.col("size")).otherwise(F.lit(0).cast("long")))
    at_end = rows.filter(range_ == F.col("cut")).join(groups, F.col("source").eqNullSafe(F.col("_gs")) & (F.col("key") == F.col("_gk")))
    # rows that repeat id and text share what is left of the budget for them evenly; the first ones take an odd word
    left = F.greatest(F.lit(0).cast("long"), F.least(F.col("rows") * F.col("size"), F.col("rest") - F.col("before")))
    at_end = _numbered(at_end.withColumn("_left", left))
    odd = (F.col("_number") < F.col("_left") % F.col("rows")).cast("long")
    at_end = at_end.withColumn("taken", whole_epochs + F.floor(F.col("_left") / F.col("rows")).cast("long") + odd)
    columns = [*keyed.columns, "source_size", "target", "taken"]
    return apart.select(*columns).unionByName(at_end.select(*columns))


def _numbered(rows: DataFrame) -> DataFrame:
    """The rows with `_number`, from 0 for each source and key: within the parts in which they are written, and behind the
    parts before. However many rows repeat a key, none sorts more than a part of them."""
    written = shared_table(rows.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id()), "mix-at-end")
    key = ["source", "key"]
    counts = written.groupBy(*key, "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*key).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # at most as many rows as parts
    base = counts.select(F.col("source").alias("_bs"), F.col("key").alias("_bk"), F.col("_part").alias("_bp"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy(*key, "_part").orderBy("_at")) - 1
    placed = written.withColumn("_inside", inside).join(base, F.col("source").eqNullSafe(F.col("_bs")) & (F.col("key") == F.col("_bk")) & (F.col("_part") == F.col("_bp")))
    return placed.withColumn("_number", F.col("_base") + F.col("_inside"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", size: Column | None = None, seed: int = 42) -> DataFrame:
    """One row for each row of docs: id, size, source_size, target, taken, with source beside them.

    A null text has size 0, a null source is a source of its own (the last), an empty table gives no rows. Rows that repeat
    both id and text are interchangeable, and share what the mix takes of them evenly, the odd words going one each to some of
    them; all others are taken in the order of their keys. So reruns agree, however the rows are dealt out.
    """
    row_id, text = F.col(f"`{id_col}`"), F.col(f"`{text_col}`")
    # no text from here on
    keyed = docs.select(row_id.alias("_id"), F.col(f"`{source_col}`").alias("source"), (n_words(text) if size is None else size).alias("size"), mix_key(row_id, text, seed).alias("key"))
    keyed = shared_table(keyed, "mix-keys")
    out = _taken(keyed.select("source", "size", "key"), keyed)
    return out.select(F.col("_id").alias(id_col), "source", "size", "source_size", "target", "taken")


def take_mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", seed: int = 42) -> DataFrame:
    """The mix itself: docs with each row as often as whole epochs take it, and the first words of the row at which a
    source's budget ends (joined by single spaces). The columns are those of docs. Rows without words are not taken."""
    plain, at = numbered_columns(docs)
    text = F.col(at[text_col])
    keyed = plain.select("*", F.col(at[source_col]).alias("source"), n_words(text).alias("size"), mix_key(F.col(at[id_col]), text, seed).alias("key"))
    joined = _taken(shared_table(keyed.select("source", "size", "key"), "mix-keys"), keyed).filter("taken > 0")
    part = F.col("taken") % F.col("size")
    copies = F.floor(F.col("taken") / F.col("size")).cast("int")
    cut = F.array_join(F.slice(F.filter(F.split(F.translate(whole(text), "\t\n\x0b\x0c\r", "     "), " "), lambda w: w != ""), F.lit(1), part.cast("int")), " ")
    out = joined.withColumn("_copy", F.explode(F.sequence(F.lit(1), copies + F.when(part > 0, 1).otherwise(0)))).withColumn("_cut", F.when(F.col("_copy") > copies, cut))
    out = out.withColumn(at[text_col], F.coalesce("_cut", text))
    if "n_chars" in at:
        out = out.withColumn(at["n_chars"], F.coalesce(F.length("_cut").cast("long"), F.col(at["n_chars"])))
    return named_columns(out, at)
