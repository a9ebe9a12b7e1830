"""Bounded samples that do not depend on how rows are dealt out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def least_hashes(df: DataFrame, key: str, rows: int, salt: int) -> DataFrame:
    """The rows with the least hashes of a key, at most `rows`: all rows, if there are no more.

    Of a larger table, rows with a hash beyond 1.2 times the wanted share are left out before anything is sorted, so what
    meets in the final sort is about 1.2 * rows however large the table is.
    """
    n = df.count()
    h = F.shiftrightunsigned(F.xxhash64(key, F.lit(salt)), 1)
    if n > rows:
        df = df.filter(h < F.lit(int((1 << 63) * min(1.0, 1.2 * rows / n)) - 1))
    return df.orderBy(h, *df.columns).limit(rows)
