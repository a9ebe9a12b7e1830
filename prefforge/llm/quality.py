"""Quality classifier by importance resampling.

Two generative models of hashed n-grams are counted, one over target texts (labelled good) and one over all texts. A
text's log weight is the sum of the log ratios of its n-grams. Gumbel top-k then resamples: of weight plus Gumbel noise
the k largest are kept, k being the number of texts whose weight reaches the level that the labelled texts set.

n-grams are 4-grams of bytes, and 3-grams of word shapes (case, punctuation, length, same as the word before).
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefforge.functions.tables import bounded_batches, releasing, shared_table
from prefforge.llm.sampling import least_hashes
from prefforge.llm.textops import named_columns, numbered_columns, whole
from prefforge.llm.wordscan import Words, as_bytes, by_space, pieces

#: Hash buckets of each of the two kinds of n-grams; parts in which the counts travel.
BUCKETS = 1 << 16
PARTS = 32
#: Labelled rows that the target model and the level are fitted on, at most; the raw model counts all rows.
LABEL_ROWS = 20_000
#: Counts that draw a bucket's ratio towards 1.
SHRINK = 20.0
#: n-grams of a text that count in full. The sum over a longer text is tempered towards its mean times this number: with few
#: labels the ratios drift a little for rarer languages, and over long texts drift would add up to more than junk's evidence.
TEMPER = 500.0
_KIND = by_space()
_CLASS = np.zeros(256, np.uint8)
_CLASS[[ord(c) for c in ".,;:?"]] = 1
_CLASS[[ord(c) for c in "!%$#&*|=<>{}[]~^_\\/+"]] = 2
_UPPER = np.zeros(256, np.int64)
_UPPER[65:91] = 1


def features(parts: list[bytes], own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of all n-grams of some parts of texts and, for either kind, where those begin and end that begin within a
    part's own range: (byte buckets, byte bounds, shape buckets, shape bounds); part i has bounds[2i] up to bounds[2i + 1]."""
    w = Words(parts, _KIND)
    raw = w.raw
    x = raw.astype(np.uint32)
    gram = x[:-3] | x[1:-2] << 8 | x[2:-1] << 16 | x[3:] << 24 if len(raw) > 3 else np.empty(0, np.uint32)
    gram = (gram * np.uint32(0x9E3779B1)) >> np.uint32(16)
    ends = w.text_ends - 1
    starts = np.concatenate([[0], w.text_ends[:-1]])
    low = starts + own[:, 0]
    byte_bounds = np.stack([low, np.maximum(low, np.minimum(ends - 3, starts + own[:, 1]))], axis=1).ravel()
    byte_bounds = np.minimum(byte_bounds, len(gram))  # of empty texts at the end
    n = len(w.starts)
    if n:
        upper = np.add.reduceat(_UPPER[raw], w.starts)
        length = w.ends - w.starts
        same = np.concatenate([[0], (w.hashes[1:] == w.hashes[:-1])]).astype(np.int64)
        same[w.first[:-1][w.first[:-1] < n]] = 0  # a text's first word follows none
        shape = same | (_UPPER[raw[w.starts]] << 1) | ((upper > 1).astype(np.int64) << 2) | (_CLASS[raw[w.ends - 1]].astype(np.int64) << 3) | (_CLASS[raw[w.starts]].astype(np.int64) << 5) | (np.minimum(length // 4, 3) << 7)
        s = shape.astype(np.uint32)
        tri = (s[:-2] + s[1:-1] * np.uint32(521) + s[2:] * np.uint32(521 * 521)) if n > 2 else np.empty(0, np.uint32)
        tri = (tri * np.uint32(0x85EBCA6B)) >> np.uint32(16)
    else:
        tri = np.empty(0, np.uint32)
    first, last = w.of_parts(own)
    last = np.maximum(first, np.minimum(last, w.first[1:] - 2))
    return gram.astype(np.int64), byte_bounds, tri.astype(np.int64) + BUCKETS, np.minimum(np.stack([first, last], axis=1).ravel(), len(tri))


def _within(bounds: np.ndarray, n: int, texts: np.ndarray | None = None) -> np.ndarray:
    """Which of n n-grams lie in a text (of those chosen)."""
    marks = np.zeros(n + 1, np.int64)
    b = bounds.reshape(-1, 2)
    b = b if texts is None else b[texts]
    b = b[b[:, 1] > b[:, 0]]
    np.add.at(marks, b[:, 0], 1)
    np.add.at(marks, b[:, 1], -1)
    return np.cumsum(marks[:-1]) > 0


def _counts(sample: dict):
    """Of each task: how often each bucket occurs in all of its texts, and in those of the target sample."""

    def run(batches):
        total = np.zeros((2, 2 * BUCKETS), np.int64)
        for batch in batches:
            good = np.array([sample.get(i) == 1 for i in batch.column(0).to_pylist()], bool)
            for index, parts, own in pieces(as_bytes(batch.column(1))):
                g, gb, s, sb = features(parts, own)
                chosen = np.flatnonzero(good[index])
                for f, b in ((g, gb), (s, sb)):
                    total[0] += np.bincount(f[_within(b, len(f))], minlength=2 * BUCKETS)
                    if len(chosen):
                        total[1] += np.bincount(f[_within(b, len(f), chosen)], minlength=2 * BUCKETS)
        cut = total.reshape(2, PARTS, -1)
        yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array([cut[:, p].tobytes() for p in range(PARTS)], pa.binary())], ["part", "counts"])

    return run


def _add(pdf: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(x, np.int64) for x in pdf["counts"])
    return pd.DataFrame({"part": [pdf["part"].iloc[0]], "counts": [total.tobytes()]})


def label_sample(labels: DataFrame, column: str, rows: int = LABEL_ROWS, only=None) -> dict[int, int]:
    """At most `rows` labelled ids, those of the least hashes."""
    found = labels.select("doc_id", F.col(column).cast("int").alias("y")).filter("doc_id is not null and y is not null")
    found = found if only is None else found.filter(only)
    return {r["doc_id"]: r["y"] for r in least_hashes(found, "doc_id", rows, 5).toLocalIterator()}


def log_ratios(docs: DataFrame, sample: dict[int, int], id_col: str, text_col: str) -> np.ndarray:
    """log(target / raw) of each bucket."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(sample)  # at most LABEL_ROWS ids
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), whole(F.col(f"`{text_col}`")).alias("_text"))
    parts = rows.mapInArrow(releasing(lambda it: _counts(shared.value)(it)), "part int, counts binary").groupBy("part").applyInPandas(_add, "part int, counts binary")
    total = np.zeros((2, PARTS, 2 * BUCKETS // PARTS), np.int64)
    for r in parts.toLocalIterator():  # PARTS rows, whatever the input
        total[:, r["part"]] = np.frombuffer(r["counts"], np.int64).reshape(2, -1)
    raw, target = total.reshape(2, 2, BUCKETS).astype(float)
    ratio = np.zeros((2, BUCKETS))
    for kind in range(2):
        if raw[kind].sum() and target[kind].sum():
            expected = raw[kind] * (target[kind].sum() / raw[kind].sum())
            ratio[kind] = np.log((target[kind] + SHRINK) / (expected + SHRINK))
    return ratio.ravel()


def weigh(docs: DataFrame, ratio: np.ndarray, id_col: str, text_col: str, carry: list[str]) -> DataFrame:
    """_id, n_grams, log_weight, _noise (of rows without an id a hash of the text) and the columns to carry, as _c0, _c1, ..."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(ratio)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), whole(F.col(f"`{text_col}`")).alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(carry)])
    rows = rows.select("_id", "_text", F.when(F.col("_id").isNull(), F.xxhash64("_text")).alias("_noise"), *[f"_c{i}" for i in range(len(carry))])
    names = ["_id", "n_grams", "log_weight", "_noise", *[f"_c{i}" for i in range(len(carry))]]
    kinds = [rows.schema["_id"].dataType.simpleString(), "long", "double", "long", *[rows.schema[f"_c{i}"].dataType.simpleString() for i in range(len(carry))]]

    def run(batches):
        table = shared.value
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            weight = np.zeros(batch.num_rows)
            for index, parts, own in pieces(as_bytes(batch.column(1))):
                g, gb, s, sb = features(parts, own)
                for f, b in ((g, gb), (s, sb)):
                    along = np.concatenate([[0.0], np.cumsum(table[f])])
                    np.add.at(weight, index, along[b[1::2]] - along[b[::2]])
                    np.add.at(n, index, b[1::2] - b[::2])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(np.round(weight * (TEMPER / (n + TEMPER)), 6)), *batch.columns[2:]], names)

    return rows.mapInArrow(releasing(run), ", ".join(f"{a} {b}" for a, b in zip(names, kinds, strict=True)))


def level_of(pairs: list[tuple[float, int]]) -> float:
    """The log weight that tells good texts from others with the fewest errors (a lost good text counts as two); 0
    evidence is always enough. Without labels of both kinds every text reaches it."""
    y = np.array([p[1] for p in pairs], bool)
    x = np.array([p[0] for p in pairs])
    if not len(pairs) or y.all() or not y.any():
        return -np.inf
    cuts = np.unique(np.concatenate([x[x <= 0], [0.0]]))
    middles = np.concatenate([[cuts[0] - 1], (cuts[1:] + cuts[:-1]) / 2, [0.0]])
    good, bad = np.sort(x[y]), np.sort(x[~y])
    cost = 2 * np.searchsorted(good, middles) + len(bad) - np.searchsorted(bad, middles)
    best = np.flatnonzero(cost == cost.min())
    return float(middles[best].mean())


def kth_largest(keys: DataFrame, k: int, bins: int = 2048, few: int = 10_000) -> tuple[float, int] | None:
    """(value, number of rows above it) of the k-th largest of the one double column `key`: histograms, each within one bin
    of the one before, until few rows are left. Nothing that grows with the rows reaches the driver."""
    at = keys.agg(F.min("key").alias("a"), F.max("key").alias("b"), F.count("key").alias("n")).first()
    if not at["n"] or k <= 0:
        return None
    low, high, above, k = at["a"], at["b"], 0, min(k, at["n"])
    while True:
        inside = keys.filter((F.col("key") >= low) & (F.col("key") <= high))
        width = (high - low) / bins
        if width <= 0 or low + width <= low:
            return low, above
        slot = F.least(F.floor((F.col("key") - low) / width), F.lit(bins - 1)).cast("int")
        counts = {r["slot"]: r for r in inside.groupBy(slot.alias("slot")).agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()}
        for s in sorted(counts, reverse=True):
            if above + counts[s]["n"] >= k:
                break
            above += counts[s]["n"]
        low, high = counts[s]["a"], counts[s]["b"]
        if counts[s]["n"] <= few:
            rest = sorted((r["key"] for r in keys.filter((F.col("key") >= low) & (F.col("key") <= high)).collect()), reverse=True)
            value = rest[k - above - 1]
            return value, above + sum(x > value for x in rest)


def resample(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", carry: list[str] | None = None, seed: int = 42, held_out: bool = True) -> DataFrame:
    """id, n_grams, log_weight, gumbel_key, kept and the columns to carry, for each row of docs.

    Labels are learnt only from rows whose crc32(id as text) mod 5 is not 0 (all rows with held_out=False). A null text
    counts as empty: its weight is 0, and such texts are kept as far as the noise allows. Equal keys are kept together. Rows
    without an id get their noise from their texts; of rows that repeat a labelled id, the least weight counts for the level.
    An empty table gives no rows; without labels of both kinds every row is kept.
    """
    bounded_batches(docs.sparkSession)
    carry = carry or []
    sample = label_sample(labels, label_col, only=F.expr("crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0") if held_out else None)
    weighed = weigh(docs, log_ratios(docs, sample, id_col, text_col), id_col, text_col, carry)
    # uniform in (0, 1) from the id, or from the text where there is none
    u = (F.shiftrightunsigned(F.when(F.col("_id").isNull(), F.xxhash64("_noise", F.lit(seed))).otherwise(F.xxhash64("_id", F.lit(seed))), 12).cast("double") + 0.5) / F.lit(float(1 << 52))
    scored = shared_table(weighed.withColumn("key", F.col("log_weight") - F.log(-F.log(u))), "weights")
    spark = docs.sparkSession
    wanted = spark.createDataFrame([(int(i), int(y)) for i, y in sample.items()] or [], "_i long, _y int")
    labelled = scored.select("_id", "log_weight").join(F.broadcast(wanted), F.col("_id") == F.col("_i")).groupBy("_i", "_y").agg(F.min("log_weight").alias("w"))
    level = level_of([(r["w"], r["_y"]) for r in labelled.toLocalIterator()])  # one row of each labelled id
    k = scored.filter(F.col("log_weight") >= F.lit(level)).count()
    cut = kth_largest(scored.select("key"), k)
    kept = F.lit(False) if cut is None else F.col("key") >= F.lit(cut[0])
    return scored.select(F.col("_id").alias(id_col), "n_grams", "log_weight", F.col("key").alias("gumbel_key"), kept.alias("kept"), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(carry) if c != id_col])


def keep_good(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that the resampling keeps, with all their columns."""
    plain, at = numbered_columns(docs)
    out = resample(plain.withColumn("doc_id", F.col(at[id_col])), labels, "doc_id", at[text_col], carry=plain.columns)
    return named_columns(out.filter("kept"), at)
