"""Runs of repeated word sequences in each document, by the runs theorem.

A run is a maximal stretch with a smallest period. In every run stands a Lyndon root, which is the longest Lyndon word at its
place under one of the two orders of words, and longest Lyndon words reach to the next smaller value of the inverse suffix
array (under the reversed order: to the next greater one). So each place has two candidate roots; one is extended to both
sides by the longest common extensions of the places at either of its ends, which are range minima over LCP arrays, of the
text and of its reverse. A run of at least SHORTEST words and LEAST periods has an extension of some words to the right of
its first root, so other candidates are not extended.

Documents are worked on together, many in one set of numpy arrays: each ends with a mark of its own that is smaller than its
words, and suffixes sort by document first, so that nothing reaches over a document's end. Suffix arrays come from
doubling, which sorts only what is not told apart yet; documents without a repeat of eight words are done after three
rounds and have no runs.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefforge.functions.tables import bounded_batches
from prefforge.llm.textops import whole

#: A run has at least so many words and periods.
SHORTEST = 24
LEAST = 3
#: Words of documents that are worked on together (longer documents: alone).
BATCH_WORDS = 1 << 18


class Suffixes:
    """Suffix array, inverse and LCP array of documents laid end to end. symbols: words as numbers from 1 on, with a 0 behind
    each document; doc: the number of the document of each place."""

    def __init__(self, symbols: np.ndarray, doc: np.ndarray):
        n = self.n = len(symbols)
        self.levels: list[np.ndarray] = []  # level k: places with the same first 2 ** k words, by the same number
        key = doc * (int(symbols.max(initial=0)) + 1) + symbols
        order = np.argsort(key, kind="stable")
        rank = np.empty(n, np.int64)
        rank[order], open_ = _numbered(key[order], np.zeros(n, np.int64), np.arange(n))
        # open_: places (in sorted order) that are not told apart from all others yet
        self.sa = order
        step = 1
        while True:
            self.levels.append(rank.astype(np.int32))
            if not len(open_):
                break
            own = order[open_]
            behind = np.minimum(own + step, n - 1)  # an open place has as many words behind it in its document, or its mark
            first, second = rank[own], rank[behind]
            by = np.argsort(first * n + second, kind="stable")
            first, second, own = first[by], second[by], own[by]
            order[open_] = own
            rank = rank.copy()
            rank[own], still = _numbered(second, first, open_)
            open_ = open_[still]
            step *= 2
        self.rank = rank
        self._lcp(order)

    def _lcp(self, order: np.ndarray) -> None:
        """lcp[r]: words that the suffixes of ranks r - 1 and r share."""
        self.lcp = np.zeros(self.n, np.int32)
        pairs = []  # pairs[k]: the ranks of those that share 2 ** k words
        at = np.arange(1, self.n)
        for level in self.levels:
            at = at[level[order[at - 1]] == level[order[at]]]
            if not len(at):
                break
            pairs.append(at)
        for k in range(len(pairs) - 1, -1, -1):
            at = pairs[k]  # these share less than 2 ** (k + 1) words beyond those that are counted
            a, b = order[at - 1] + self.lcp[at], order[at] + self.lcp[at]
            self.lcp[at[self.levels[k][a] == self.levels[k][b]]] += 1 << k

    def minima(self) -> None:
        """The sparse table of the LCP array: row k has the least of 2 ** k values from each place on."""
        self.table = [self.lcp]
        k = 1
        while 2 * k <= self.n:
            last = self.table[-1]
            self.table.append(np.minimum(last[: len(last) - k], last[k:]))
            k *= 2

    def extension(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Words that the suffixes of places a and b (a <> b) share: the least LCP between their ranks."""
        x, y = self.rank[a], self.rank[b]
        low, high = np.minimum(x, y) + 1, np.maximum(x, y) + 1
        k = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(a), np.int64)
        for level in np.unique(k):
            own = np.flatnonzero(k == level)
            row = self.table[level]
            out[own] = np.minimum(row[low[own]], row[high[own] - (1 << int(level))])
        return out


def _numbered(values: np.ndarray, groups: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rank of each of the sorted (group, value), which of them share theirs). A rank is the place of the first of its equals."""
    fresh = np.ones(len(values), bool)
    fresh[1:] = (values[1:] != values[:-1]) | (groups[1:] != groups[:-1])
    start = np.flatnonzero(fresh)
    count = np.diff(np.append(start, len(values)))
    return np.repeat(places[start], count), np.flatnonzero(np.repeat(count, count) > 1)


def next_smaller(values: np.ndarray, rounds: int = 8) -> np.ndarray:
    """For each place the next one whose value is smaller, or the length."""
    n = len(values)
    ends = np.append(values, np.iinfo(values.dtype).min)
    after = np.arange(1, n + 1)
    open_ = np.flatnonzero(ends[after] > values)
    for _ in range(rounds):  # all between a place and `after` are greater, so what is `after` that one's is the next to try
        after[open_] = after[after[open_]]
        open_ = open_[ends[after[open_]] > values[open_]]
        if not len(open_):
            return after
    # long ways are gone in powers of two, over the minima of what lies ahead
    table, k = [values], 1
    while 2 * k <= n:
        table.append(np.minimum(table[-1][:-k], table[-1][k:]))
        k *= 2
    at = after[open_]
    own = values[open_]
    for k in range(len(table) - 1, -1, -1):
        inside = at + (1 << k) <= n
        free = np.zeros(len(at), bool)
        free[inside] = table[k][at[inside]] > own[inside]
        at[free] += 1 << k
    after[open_] = at
    return after


def find_runs(documents: list[np.ndarray], shortest: int = SHORTEST, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, start, length, period) of every run, by document, start and period. documents: words as numbers from 1 on."""
    none = (np.zeros(0, np.int64),) * 4
    # the first root of a run shares so many words with what follows a period behind
    shared = min(shortest - 2 * p + 1 if least * p <= shortest else (least - 2) * p + 1 for p in range(1, shortest + 2))
    index = np.arange(len(documents))
    text = _laid(documents)
    if text is None:
        return none
    symbols, doc, first = text
    forward = Suffixes(symbols, doc)
    # only documents with a repeat of that many words go on
    with_repeat = np.unique(doc[forward.sa[forward.lcp >= shared]])
    if not len(with_repeat):
        return none
    if len(with_repeat) < len(documents):
        index = with_repeat
        symbols, doc, first = _laid([documents[i] for i in with_repeat])
        forward = Suffixes(symbols, doc)
    forward.minima()
    n = len(symbols)
    place = np.arange(n)
    end = first[1:][doc] - 1  # the place of the document's mark
    rank = forward.rank
    longest = np.maximum(forward.lcp, np.append(forward.lcp[1:], 0))[rank]  # the most that a place shares with any other
    found = []
    for behind in (next_smaller(rank), next_smaller(-rank)):
        period = behind - place
        own = np.flatnonzero((behind < end) & (longest >= np.maximum(shared, 1)))
        right = forward.extension(own, behind[own])
        good = right >= np.where(least * period[own] <= shortest, shortest - 2 * period[own] + 1, (least - 2) * period[own] + 1)
        found.append(np.stack([own[good], period[own[good]], right[good]]))
    at, period, right = np.concatenate(found, axis=1)
    if not len(at):
        return none
    # left: the same in the reversed documents, from the word before each end of the root
    has = np.unique(doc[at])
    back_symbols, back_doc, back_first = _laid([symbols[first[d] : first[d + 1] - 1][::-1] for d in has])
    backward = Suffixes(back_symbols, back_doc)
    backward.minima()
    of = np.searchsorted(has, doc[at])
    mirror = lambda x: back_first[of] + (end[at] - 1 - x)  # noqa: E731  the place of x in the reversed documents
    inner = at > first[doc[at]]
    left = np.zeros(len(at), np.int64)
    left[inner] = backward.extension(mirror(at - 1)[inner], mirror(at - 1 + period)[inner])
    start, length = at - left, left + period + right
    good = length >= np.maximum(shortest, least * period)
    rows = np.unique(np.stack([index[doc[at]], start - first[doc[at]], period, length])[:, good], axis=1)
    return rows[0], rows[1], rows[3], rows[2]


def _laid(documents: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """(symbols, document of each place, first place of each document and the length of all), with a 0 behind each document."""
    lengths = np.array([len(d) for d in documents], np.int64) + 1
    if not len(lengths):
        return None
    first = np.concatenate([[0], np.cumsum(lengths)])
    symbols = np.zeros(first[-1], np.int64)
    doc = np.repeat(np.arange(len(documents)), lengths)
    inside = np.ones(len(symbols), bool)
    inside[first[1:] - 1] = False
    symbols[inside] = np.concatenate(documents)
    return symbols, doc, first


def repeated(words: list[bytes], crc: int) -> list[bytes]:
    """The words, a part of which repeats for one in ten values of crc."""
    n, g = len(words), crc // 10
    if crc % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (1 + (n - a) // p))[: n - a]


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", repeats: bool = False, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """One row for each row of docs: id, runs (array of start, length, period, by start and period) and collapsed, the words
    that no run holds behind its first period, joined by single blanks.

    Words are what stands between white space. repeats: of one in ten ids a part of the words is repeated first (see
    `repeated`; a null id counts as the empty text). Null and empty texts have no words and no runs; rows are independent of
    each other, so repeated rows give repeated results; columns other than id and text are not carried. An empty table gives
    no rows.
    """
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), whole(F.col(f"`{text_col}`")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def run(batches):
        for batch in batches:
            for names, texts in _some(batch):
                words = [t.split() for t in texts]
                if repeats:
                    words = [repeated(w, zlib.crc32(b"" if i is None else str(i).encode())) for w, i in zip(words, names.to_pylist(), strict=True)]
                number: dict[bytes, int] = {}
                symbols = [np.array([number.setdefault(w, len(number) + 1) for w in ws], np.int64) for ws in words]
                doc, start, length, period = find_runs(symbols, shortest, least)
                cut = np.searchsorted(doc, np.arange(len(words) + 1))
                collapsed = []
                for i, ws in enumerate(words):
                    own = slice(cut[i], cut[i + 1])
                    if cut[i] < cut[i + 1]:
                        change = np.zeros(len(ws) + 1, np.int64)
                        np.add.at(change, start[own] + period[own], 1)
                        np.add.at(change, start[own] + length[own], -1)
                        kept = np.cumsum(change)[:-1] == 0
                        ws = [w for w, k in zip(ws, kept.tolist(), strict=True) if k]
                    collapsed.append(b" ".join(ws))
                found = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], fields=list(run_type))
                lists = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), found)
                yield pa.RecordBatch.from_arrays([names, lists, pa.array(collapsed, pa.binary()).cast(pa.string())], ["_id", "runs", "collapsed"])

    return rows.mapInArrow(run, f"_id {kind}, runs array<struct<start: long, length: long, period: long>>, collapsed string").withColumnRenamed("_id", id_col)


def _some(batch: pa.RecordBatch) -> Iterator[tuple[pa.Array, list[bytes]]]:
    """(ids, texts) of about BATCH_WORDS words (at five bytes a word) at a time."""
    texts = [x.as_py() for x in batch.column(1).cast(pa.binary())]
    at = size = 0
    for n, t in enumerate(texts):
        size += len(t)
        if size >= 5 * BATCH_WORDS or n == len(texts) - 1:
            yield batch.column(0)[at : n + 1], texts[at : n + 1]
            at, size = n + 1, 0


def run_digests(runs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """periodic_runs as digests: id, n_runs, the run of the greatest length / period (the first of these, the shortest period
    of these) with exponent_milli, runs_sha256 and collapsed_sha256."""
    # whole numbers decide: no two runs of a document of less than 10**9 words are taken for equal
    longer = lambda x, y: x["length"] * y["period"] > y["length"] * x["period"]
    best = F.aggregate("runs", F.get("runs", F.lit(0)), lambda acc, x: F.when(longer(x, acc), x).otherwise(acc))
    line = lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])
    lines = F.array_join(F.transform("runs", lambda r: F.concat(line(r), F.lit("\n"))), "")
    with_best = runs.withColumn("_best", best)
    return with_best.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), *[F.col(f"_best.{c}").alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * _best.length div _best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
