"""Exact and near de-duplication of records."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from prefforge.functions.tables import shared_table

#: Rows of a session that a task visits at once.
BLOCK_ROWS = 4096


def exact_first(df: DataFrame, keys: list[str], order: str | list, last: bool = False) -> DataFrame:
    """The first (or last) row of each key by some columns, an aggregate that Spark forms in part before it shuffles, so that a
    key with many rows is no large task. Nulls come first. Ties of the order are broken arbitrarily, so it should be unique.

    The aggregate sorts by its keys; a hash in front of texts settles nearly all comparisons of different ones."""
    orders = [order] if isinstance(order, (str, Column)) else order
    orders = [F.col(o) if isinstance(o, str) else o for o in orders]
    rest = F.struct(*[F.col(f"`{c}`") for c in df.columns])
    pick = F.max_by if last else F.min_by
    texts = [F.col(f"`{k}`") for k in keys if df.schema[k].dataType == T.StringType()]
    hashed = [F.xxhash64(*texts).alias("_h")] if texts else []
    best = df.groupBy(*hashed, *[F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keys)]).agg(pick(rest, F.struct(*[o.alias(f"_o{i}") for i, o in enumerate(orders)])).alias("_row"))
    return best.select(*[F.col("_row")[c].alias(c) for c in df.columns])


def last_wins(df: DataFrame, keys: list[str], position: str) -> DataFrame:
    """The latest row of each key."""
    return exact_first(df, keys, position, last=True)


def _jaro(a: str, b: str) -> float:
    """Jaro similarity in linear time: a character of a takes the first free equal one of b within reach. What lies before
    the reach of one character lies before that of all later ones, so each character's places in b are gone through once."""
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0
    if a == b:
        return 1.0
    reach = max(max(n, m) // 2 - 1, 0)
    places: dict[str, list[int]] = {}
    for j in range(m - 1, -1, -1):
        places.setdefault(b[j], []).append(j)
    mine, taken = [], []
    for i, x in enumerate(a):
        free = places.get(x)
        if free:
            while free and free[-1] < i - reach:
                free.pop()
            if free and free[-1] <= i + reach:
                taken.append(free.pop())
                mine.append(x)
    k = len(mine)
    if not k:
        return 0.0
    taken.sort()
    moved = sum(x != b[j] for x, j in zip(mine, taken, strict=True)) // 2
    return (k / n + k / m + (k - moved) / k) / 3


@F.pandas_udf(T.DoubleType())
def jaro(a: pd.Series, b: pd.Series) -> pd.Series:
    """Jaro similarity; 0 if either text is empty."""
    return pd.Series(np.fromiter((np.nan if x is None or y is None else _jaro(x, y) for x, y in zip(a, b, strict=True)), float, len(a)))


class Profile:
    """A text as bounds of its Jaro similarity need it: how often characters of each of 64 classes occur, and the places of
    the first, second, ... occurrence of each character."""

    def __init__(self, text: str):
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        self.text, self.n = text, len(codes)
        self.counts = np.bincount(codes & 63, minlength=64)
        self.places = np.argsort(codes, kind="stable")
        line = codes[self.places]
        first = np.flatnonzero(np.diff(line, prepend=-1))
        self.keys = line << 32 | np.arange(self.n) - np.repeat(first, np.diff(np.append(first, self.n)))


def most_similar(counts: np.ndarray, lengths: np.ndarray, other: Profile) -> np.ndarray:
    """An upper bound of the Jaro similarity of each row of counts with another text: no more characters match than both have."""
    both = np.minimum(counts, other.counts).sum(axis=1)
    return np.where(both > 0, (both / lengths + both / other.n + 1) / 3, 0.0)


def least_similar(a: Profile, b: Profile) -> float:
    """A lower bound: equal occurrences of a character match where they are within reach, at worst all out of order. The
    similarity matches as many characters as can be, hence as many at least."""
    if a.n > b.n:
        a, b = b, a
    at = np.minimum(np.searchsorted(b.keys, a.keys), b.n - 1)
    reach = max(b.n // 2 - 1, 0)
    k = np.count_nonzero((b.keys[at] == a.keys) & (np.abs(b.places[at] - a.places) <= reach))
    return (k / a.n + k / b.n + 0.5) / 3 if k else 0.0


class Kept:
    """Texts that stay, latest first, each with its time. Bounds decide about most pairs; `exact` counts the others. A text
    is looked at when it is compared for the first time."""

    def __init__(self, threshold: float, width: int):
        self.threshold, self.width, self.exact, self.pairs = threshold, width, 0, 0
        self.texts: list[str] = []
        self.profiles: list[Profile | None] = []
        self.times: list[int] = []
        self.last: dict[str, int] = {}
        self._first = 0  # those before are too late for all that comes
        self._counts, self._lengths = np.zeros((0, 64), np.int64), np.zeros(0)

    def add(self, time: int, text: str, profile: Profile | None = None) -> None:
        self.texts.append(text)
        self.profiles.append(profile)
        self.times.append(time)
        self.last[text] = time

    def _seen(self, low: int) -> None:
        """Bounds of all texts from `low` on are known."""
        n = len(self.texts)
        if n > len(self._lengths):
            more = max(64, 2 * n) - len(self._lengths)
            self._counts = np.concatenate([self._counts, np.zeros((more, 64), np.int64)])
            self._lengths = np.concatenate([self._lengths, np.zeros(more)])
        for i in range(n - 1, low - 1, -1):
            if self._lengths[i]:
                break  # those before are known too, or too late
            if self.profiles[i] is None:
                self.profiles[i] = Profile(self.texts[i])
            self._counts[i], self._lengths[i] = self.profiles[i].counts, self.profiles[i].n

    def similar(self, time: int, text: str) -> tuple[bool, Profile | None]:
        """Whether a text that stays is less than `width` later than `time` and more similar than the threshold, and the
        profile if it was needed. Times never rise from call to call."""
        while self._first < len(self.times) and self.times[self._first] - time >= self.width:
            self._first += 1
        low, n = self._first, len(self.texts)
        if low == n:
            return False, None
        if self.threshold < 1 and text in self.last and self.last[text] - time < self.width:
            return True, None
        self._seen(low)
        profile = Profile(text)
        most = most_similar(self._counts[low:n], self._lengths[low:n], profile)
        self.pairs += n - low
        for i in np.argsort(-most, kind="stable").tolist():
            if most[i] <= self.threshold - 1e-9:
                break
            if least_similar(self.profiles[low + i], profile) > self.threshold + 1e-9:
                return True, profile
            self.exact += 1
            if _jaro(text, self.texts[low + i]) > self.threshold:
                return True, profile
        return False, profile


def decide(times: list[int], texts: list[str], threshold: float, width: int, kept: Kept | None = None) -> list[bool]:
    """Which of some texts stay, visited from the latest on."""
    kept = kept or Kept(threshold, width)
    stay = []
    for time, text in zip(times, texts, strict=True):
        gone, profile = kept.similar(time, text)
        stay.append(not gone)
        if not gone:
            kept.add(time, text, profile)
    return stay


def _in_blocks(rows: DataFrame, width: int, block_rows: int) -> DataFrame:
    """(u, d, p, t) with the session of each row and its block in the session, from the latest on. A session ends where a user
    pauses for `width`; rows of different sessions do not touch each other.

    A range sort puts the rows in order; what a range needs to know of those before it (the last row, the last beginning
    of a session) is one row of each range on the driver. So no user's rows have to meet in one task.
    """
    spark = rows.sparkSession
    ranged = rows.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), "u", "d", "p").sortWithinPartitions("u", "d", "p").withColumn("_id", F.monotonically_increasing_id())
    ranged = shared_table(ranged.withColumn("_p", F.shiftright("_id", 33)), "by-user-and-time")
    ends = ranged.groupBy("_p").agg(F.max(F.struct("_id", "u", "d")).alias("e"), F.count(F.lit(1)).alias("n")).orderBy("_p").collect()
    user = ranged.schema["u"].dataType
    before = [(r["_p"], last["u"] if last else None, last["d"] if last else None) for r, last in zip(ends, [None, *[r["e"] for r in ends]], strict=False)]
    bases = spark.createDataFrame(before, T.StructType([T.StructField("_p", T.LongType()), T.StructField("_u", user), T.StructField("_d", T.LongType())]))
    along = Window.partitionBy("_p").orderBy("_id")
    last_u, last_d = F.coalesce(F.lag("u").over(along), "_u"), F.coalesce(F.lag("d").over(along), "_d")
    begins = F.coalesce((last_u != F.col("u")) | (F.col("d") - last_d >= width), F.lit(True))
    marked = ranged.join(F.broadcast(bases), "_p").withColumn("_begin", F.when(begins, F.col("_id"))).drop("_u", "_d")
    carried, total, known = [], 0, None
    begun = {r["_p"]: r["b"] for r in marked.groupBy("_p").agg(F.max("_begin").alias("b")).collect()}
    for r in ends:
        carried.append((r["_p"], known, total))
        known, total = begun[r["_p"]] if begun[r["_p"]] is not None else known, total + r["n"]
    carried = spark.createDataFrame(carried, "_p long, _known long, _base long")
    so_far = F.last("_begin", ignorenulls=True).over(along.rowsBetween(Window.unboundedPreceding, 0))
    placed = marked.join(F.broadcast(carried), "_p").withColumn("session", F.coalesce(so_far, "_known")).withColumn("_at", F.col("_base") + F.col("_id").bitwiseAND((1 << 33) - 1))
    placed = shared_table(placed.select("session", "d", "p", "t", "_at"), "sessions")
    large = placed.groupBy("session").agg(F.max("_at").alias("_end"), F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > block_rows).select(F.col("session").alias("_s"), "_end")
    block = F.coalesce(F.floor((F.col("_end") - F.col("_at")) / block_rows), F.lit(0)).cast("long")
    return placed.join(large, F.col("session") == F.col("_s"), "left").select("session", block.alias("block"), "d", "p", "t")


def near_dup_greedy(df: DataFrame, user: str, date: str, text: str, pos: str, interval: str = "1 HOUR", threshold: float = 0.6, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Rows that stay when each user's rows are visited from the latest to the earliest (ties: larger pos first) and a row
    goes if a row kept before is less than `interval` later and more similar than `threshold`. pos is unique. Rows without a
    user, a date or a text, and empty texts, stay.

    Rows are decided in rounds. A round visits the next block of each session (see `_in_blocks`), each in one task, and what stays
    of it is compared with all later blocks in reach, each in a task of its own. Sessions of block_rows rows at most, which
    are nearly all, are done after the first round; a task never holds more than two blocks.
    """
    begin = "timestamp'2000-01-01 00:00:00'"
    width = df.sparkSession.range(1).select(F.expr(f"unix_micros({begin} + interval {interval}) - unix_micros({begin})")).first()[0]
    col = lambda c: F.col(f"`{c}`")
    rows = df.filter(col(user).isNotNull() & col(date).isNotNull() & (col(text) != "")).select(col(user).alias("u"), F.unix_micros(col(date).cast("timestamp")).alias("d"), col(pos).cast("long").alias("p"), col(text).alias("t"))
    # written once: the range sort looks at its input twice
    placed = _in_blocks(shared_table(rows, "rows-by-user"), width, block_rows)
    kind = "session long, block long, d long, p long, t string, stays boolean"

    def visit(frames: Iterator[pd.DataFrame], columns: list[str]) -> Iterator[pd.DataFrame]:
        """Rows of many sessions, one after the other, each from the latest on."""
        session, kept = None, None
        for pdf in frames:
            stays = []
            for s, d, t_ in zip(pdf["session"].tolist(), pdf["d"].tolist(), pdf["t"].tolist(), strict=True):
                if s != session:
                    session, kept = s, Kept(threshold, width)
                gone, profile = kept.similar(d, t_)
                stays.append(not gone)
                if not gone:
                    kept.add(d, t_, profile)
            yield pdf.assign(stays=stays)[columns]

    def against(key, kept_rows: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
        kept = Kept(threshold, width)
        for r in kept_rows.sort_values(["d", "p"], ascending=False).itertuples():
            kept.add(r.d, r.t)
        pdf = pdf.sort_values(["d", "p"], ascending=False)
        gone = [kept.similar(r.d, r.t)[0] for r in pdf.itertuples()]
        return pdf.loc[gone, ["p"]]

    most = placed.agg(F.max("block")).first()[0] or 0
    if most:
        placed = shared_table(placed, "blocks")
    gone = None
    for k in range(most + 1):
        todo = placed.filter(F.col("block") == k)
        if gone is not None:
            todo = todo.join(gone, "p", "left_anti")
        lined = todo.repartition("session").sortWithinPartitions("session", F.desc("d"), F.desc("p"))
        # texts go on only where later blocks are compared with them
        fields = kind if k < most else "p long, stays boolean"
        columns = [x.split()[0] for x in fields.split(", ")]
        decided = shared_table(lined.select("session", "block", "d", "p", "t").mapInPandas(partial(visit, columns=columns), fields), "decided")
        out = decided.filter("not stays").select("p")
        if k < most:
            later = placed.filter(F.col("block") > k)
            later = later if gone is None else later.join(gone, "p", "left_anti")
            tops = later.groupBy("session", "block").agg(F.max("d").alias("top"))
            near = decided.filter("stays").drop("block").join(tops, "session").filter(F.col("d") - F.col("top") < width).select(F.col("session").alias("s"), F.col("block").alias("b"), "d", "p", "t")
            # only blocks that kept rows reach are asked
            pushed = near.groupBy("s", "b").cogroup(later.groupBy("session", "block")).applyInPandas(against, "p long")
            out = out.unionByName(pushed)
        out = shared_table(out, "gone")
        gone = out if gone is None else gone.unionByName(out)
    return df.join(gone.select(F.col("p").alias("_gone")), col(pos) == F.col("_gone"), "left_anti")
