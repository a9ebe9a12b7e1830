"""Exact dedup by two-pass Bloom filtering.

Pass 1 puts two positions of every text's hash into a filter that tells "hit once" from "hit again". Pass 2 tests
every row: one whose two positions were both hit again may be a repeat, every other row is certainly the only one of its
text and passes straight through. Only the possible repeats shuffle, and there the SHA-256 of the whole text decides.

The filter has a bounded size (`max_bits`). More rows than it is good for cost speed (more rows shuffle), never rows.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefforge.functions.tables import bounded_batches, shared_table
from prefforge.llm.textops import lower_ascii, named_columns, numbered_columns, whole

#: Filter bits for each row, and the most bits: 2**28 bits are 32 MB, which is what the driver and each task hold at most.
BITS_PER_ROW = 32
MAX_BITS = 1 << 28
#: Bits of one segment; segments are merged by different tasks.
SEGMENT_BITS = 1 << 16


def _positions(h: np.ndarray, bits: int) -> np.ndarray:
    """Two filter positions of each hash."""
    u = h.view(np.uint64)
    mask = np.uint64(bits - 1)
    return np.stack([u & mask, (u >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20) & mask])


def _hits(bits: int):
    """Of each task: the positions that it hit, by segment, and those that it hit again."""

    def run(batches):
        once, again = [], []
        for batch in batches:
            p = _positions(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64), bits)
            # a row's two positions can coincide; it then hits that one once
            once.append(np.concatenate([p[0], p[1][p[0] != p[1]]]))
            if len(once) >= 64:
                once, more = _fold(once)
                again.append(more)
        once, more = _fold(once)
        again = np.unique(np.concatenate([*again, more])) if again or len(more) else more
        if not once:
            return
        for kind, values in ((0, once[0]), (1, again)):
            segments = (values // np.uint64(SEGMENT_BITS)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(segments)) + 1
            starts = np.concatenate([[0], cuts]) if len(values) else []
            parts = np.split((values % np.uint64(SEGMENT_BITS)).astype(np.uint16), cuts) if len(values) else []
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([int(segments[s]) for s in starts], pa.int64()),
                    pa.array([kind] * len(parts), pa.int32()),
                    pa.array([x.tobytes() for x in parts], pa.binary()),
                ],
                ["segment", "kind", "places"],
            )

    def _fold(parts):
        if not parts:
            return [], np.empty(0, np.uint64)
        values, counts = np.unique(np.concatenate(parts), return_counts=True)
        return [values], values[counts > 1]

    return run


def _merge(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """The places of a segment that several rows hit."""
    seen = np.concatenate([np.frombuffer(x, np.uint16) for x in pdf.places[pdf.kind == 0]])
    sure = [np.frombuffer(x, np.uint16) for x in pdf.places[pdf.kind == 1]]
    counts = np.bincount(seen, minlength=SEGMENT_BITS)
    for x in sure:
        counts[x] = 2
    flags = counts > 1
    places = np.flatnonzero(flags).astype(np.uint16)
    return pd.DataFrame({"segment": [key[0]], "places": [places.tobytes()]}) if len(places) else pd.DataFrame({"segment": [], "places": []})


def repeat_filter(hashes: DataFrame, bits: int) -> np.ndarray:
    """The filter, one bit a position, of what is hit by more than one row of the one-column table hashes."""
    marks = hashes.mapInArrow(_hits(bits), "segment long, kind int, places binary")
    merged = marks.groupBy("segment").applyInPandas(_merge, "segment long, places binary")
    flags = np.zeros(bits // 8, np.uint8)
    for row in merged.toLocalIterator():
        p = row["segment"] * SEGMENT_BITS + np.frombuffer(row["places"], np.uint16).astype(np.int64)
        np.bitwise_or.at(flags, p >> 3, (1 << (p & 7)).astype(np.uint8))
    return flags


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: list[str] | None = None, max_bits: int = MAX_BITS) -> DataFrame:
    """One row for each row of docs: keep_id, group_size, kept and text_sha256 beside id_col and the columns in carry.

    Texts are equal when identical after lower-casing A-Z only; a null text counts as empty. Of equal texts the row with
    the largest id stays (a null id is smaller than any; of rows that also repeat the id exactly one stays). An empty
    table gives no rows. Columns of docs that are not named are left alone, whatever their names.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = lower_ascii(whole(F.col(f"`{text_col}`")))
    extra = [c for c in carry or [] if c != id_col]
    # sha2 of the normalised UTF-8 bytes; its own 64-bit hash feeds the filter
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.sha2(text, 256).alias("_sha"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(extra)])
    hashes = base.select(F.xxhash64("_sha").alias("h"))
    n = docs.count()
    bits = min(max_bits, max(SEGMENT_BITS, 1 << int(np.ceil(np.log2(max(1, n) * BITS_PER_ROW)))))
    flags = spark.sparkContext.broadcast(repeat_filter(hashes, bits))

    @F.pandas_udf("boolean")
    def may_repeat(h: pd.Series) -> pd.Series:
        p = _positions(h.to_numpy(np.int64), bits).astype(np.int64)
        bit = flags.value[p >> 3] >> (p & 7).astype(np.uint8) & 1
        return pd.Series(bit.all(axis=0))

    tested = base.withColumn("_maybe", may_repeat(F.xxhash64("_sha")))
    names = [F.col("_id").alias(id_col), *[F.col(f"_c{i}").alias(c) for i, c in enumerate(extra)]]
    single = tested.filter(~F.col("_maybe")).select(*names, F.col("_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), F.col("_sha").alias("text_sha256"))
    # written once: the row numbers below stay what they are, and the scan is not repeated
    maybe = shared_table(tested.filter("_maybe").drop("_maybe").withColumn("_row", F.monotonically_increasing_id()), "exact-maybe")
    best = maybe.groupBy(F.col("_sha").alias("_key")).agg(F.max(F.struct("_id", "_row")).alias("_best"), F.count(F.lit(1)).alias("_n"))
    joined = maybe.join(best, maybe["_sha"] == best["_key"])
    repeated = joined.select(*names, F.col("_best._id").alias("keep_id"), F.col("_n").alias("group_size"), (F.col("_best._row") == F.col("_row")).alias("kept"), F.col("_sha").alias("text_sha256"))
    return single.unionByName(repeated)


def drop_exact_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    plain, at = numbered_columns(docs)
    out = exact_dedup(plain.withColumn("doc_id", F.col(at[id_col])), "doc_id", at[text_col], carry=plain.columns)
    return named_columns(out.filter("kept"), at)
