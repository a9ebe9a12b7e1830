"""Near-duplicates of each user as rows arrive.

The batch operator visits rows from the latest to the earliest, which a stream cannot: here the earliest row of similar ones
stays, so this is another operator. Rows wait until the watermark has passed them and are then visited by their times, so
the result does not depend on how rows are dealt to batches. What stays is remembered for `interval`, as only that long it
can make later rows go; then a timer clears it, and a user without rows leaves no state.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from prefforge.operators.dedup import Kept, decide

STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
#: Rows in lists: an entry holds many, since each entry is sent, packed and unpacked on its own.
_ROWS = "d array<long>, p array<long>, t array<string>"
#: Rows of an entry at most.
ENTRY_ROWS = 10_000


def _entries(rows: list[tuple[int, int, str]]) -> list[tuple[list, list, list]]:
    """(d, p, t) rows as entries of a state."""
    parts = (rows[i : i + ENTRY_ROWS] for i in range(0, len(rows), ENTRY_ROWS))
    return [tuple(map(list, zip(*part, strict=True))) for part in parts]


def _rows(entries: Iterator[tuple[list, list, list]]) -> list[tuple[int, int, str]]:
    return [r for e in entries for r in zip(*e, strict=True)]


class EarliestStay(StatefulProcessor):
    """State of a user: rows that wait for the watermark, and rows that stayed less than an interval ago."""

    def __init__(self, width: int, threshold: float):
        self.width, self.threshold = width, threshold

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", _ROWS)
        self.kept = handle.getListState("kept", _ROWS)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        latest = None
        for pdf in rows:
            d = pdf["d"].astype("int64").tolist()
            self.waiting.appendList(_entries(list(zip(d, pdf["p"].astype("int64").tolist(), pdf["t"].tolist(), strict=True))))
            latest = max(d) if latest is None else max(latest, *d)
        if latest is not None:
            self.handle.registerTimer(latest // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = max(expiredTimerInfo.getExpiryTimeInMs(), timerValues.getCurrentWatermarkInMs()) * 1000  # rows before it have come
        rows = sorted(_rows(self.waiting.get()))
        due, later = [r for r in rows if r[0] < now], [r for r in rows if r[0] >= now]
        before = _rows(self.kept.get())
        # by their times backwards, so that the earliest is visited first
        kept = Kept(self.threshold, self.width)
        for d, _, t in before:
            kept.add(-d, t)
        stay = decide([-d for d, _, _ in due], [t for _, _, t in due], self.threshold, self.width, kept)
        fresh = [r for r, s in zip(due, stay, strict=True) if s]
        recent = [r for r in before + fresh if r[0] > now - self.width]
        # each call is a question to the JVM and its answer, so a state that is as it was is left alone
        for state, left, had in ((self.waiting, later, rows), (self.kept, recent, before)):
            if left == had:
                continue
            if left:
                state.put(_entries(left))
            else:
                state.clear()
        if recent:
            self.handle.registerTimer((recent[-1][0] + self.width) // 1000 + 1)
        if fresh:
            texts = pd.Series([r[2] for r in fresh], dtype=object)
            yield pd.DataFrame({"u": pd.Series([key[0]] * len(fresh), dtype=object if isinstance(key[0], str) else None), "d": [r[0] for r in fresh], "p": [r[1] for r in fresh], "t": texts})

    def close(self) -> None:
        pass


def near_dup_stream(stream: DataFrame, user: str, date: str, text: str, pos: str, seconds: int = 3600, threshold: float = 0.6, late: str = "10 minutes") -> DataFrame:
    """(user, date, pos, text) of the rows that stay: of a user's rows less than `seconds` apart and more similar than
    `threshold`, the earliest (ties: smaller pos). Rows later than the watermark are dropped; rows without a user, a date or
    a text do not take part."""
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    col = lambda c: F.col(f"`{c}`")
    rows = stream.filter(col(user).isNotNull() & (col(text) != "")).select(col(user).alias("u"), col(date).alias("_time"), F.unix_micros(col(date)).alias("d"), col(pos).cast("long").alias("p"), col(text).alias("t"))
    kind = rows.schema["u"].dataType.simpleString()
    out = rows.withWatermark("_time", late).groupBy("u").transformWithStateInPandas(EarliestStay(seconds * 1_000_000, threshold), f"u {kind}, d long, p long, t string", "Append", "EventTime")
    return out.select(F.col("u").alias(user), F.timestamp_micros("d").alias(date), F.col("p").alias(pos), F.col("t").alias(text))
