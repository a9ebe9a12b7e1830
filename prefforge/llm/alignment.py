"""Alignment of the tokens of two tokenizers, and how often pairs of tokens align in a corpus.

Both tokenizers cut the same bytes. The places where tokens of both end (intersect1d of the cumulative token lengths) cut a
text into groups; tokens are labelled with their groups by searchsorted, and the pairs of tokens whose bytes overlap are
made by repeating each token of one side as often as tokens of the other side lie in it. There are no more of them than
tokens.

A document counts once for each pair of ids that it holds linked. Counts are formed in two stages, by pair and salt and
then by pair, so that a pair that every document holds is no hot key. They return to the documents without moving the pairs
of most: the most frequent pairs (FREQUENT at most) are broadcast, and only the others of each document are joined by pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefforge.functions.tables import bounded_batches, shared_table
from prefforge.llm.textops import whole
from prefforge.llm.vocab import ByteLevel, Pieces, in_worker

#: Salts of a pair, pairs whose counts are broadcast, levels of counts for each power of two, and characters of texts that are
#: aligned together.
SALTS = 16
FREQUENT = 1 << 19
LEVELS = 4
ALIGN_CHARS = 1 << 18


class Aligner:
    """Two tokenizers and what their ids stand for. a sees a blank in front of the text, b puts one there by itself."""

    def __init__(self, a: ByteLevel, b: Pieces):
        self.a, self.b = a, b
        #: ids as text, with the sign behind them: within a group, at the end of the one side, at the end of the other
        self._text = [f"{i}{sign}" for side, end in ((a, "|"), (b, ";")) for i in range(len(side.token)) for sign in (",", end)]

    def tokens(self, texts: list[str]) -> list[tuple[np.ndarray, np.ndarray] | None]:
        """The ids of both for each text, or nothing where it is empty or either's bytes differ from those of a blank and it."""
        out: list[tuple[np.ndarray, np.ndarray] | None] = []
        for text, ids_b in zip(texts, self.b.encode(texts), strict=True):
            ids_a = self.a.encode(f" {text}", special=False) if text and ids_b is not None else None
            if ids_a is not None and not self.a.lossless and b"".join(map(self.a.token.__getitem__, ids_a.tolist())) != f" {text}".encode():
                ids_a = None
            out.append(None if ids_a is None else (ids_a, ids_b))
        return out

    def align(self, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(cuts, group of each token of a, of b, and the places of the linked tokens in a and in b), of one text or of
        several laid end to end: where texts end, tokens of both end."""
        ends_a, ends_b = np.cumsum(self.a.length[ids_a]), np.cumsum(self.b.length[ids_b])
        cuts = np.intersect1d(ends_a, ends_b, assume_unique=True)  # no token is empty
        starts_a = np.append(0, ends_a[:-1])
        first = np.searchsorted(ends_b, starts_a, side="right")  # the first of b that ends behind the start
        last = np.searchsorted(ends_b, ends_a)  # the first that reaches the end
        many = last - first + 1
        of_a = np.repeat(np.arange(len(ids_a)), many)
        of_b = np.arange(len(of_a)) + np.repeat(first - np.cumsum(many) + many, many)
        return cuts, np.searchsorted(cuts, ends_a), np.searchsorted(cuts, ends_b), of_a, of_b

    def written(self, ids_a: np.ndarray, ids_b: np.ndarray, group_a: np.ndarray, group_b: np.ndarray, texts: np.ndarray) -> list[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`; texts: the number of tokens of both of each."""
        if not len(ids_a):
            return []
        n_a, n_b = (np.bincount(g, minlength=int(group_a[-1]) + 1) for g in (group_a, group_b))
        before_a, before_b = np.cumsum(n_a) - n_a, np.cumsum(n_b) - n_b
        end_a, end_b = (np.append(g[1:] != g[:-1], True) for g in (group_a, group_b))
        out = np.empty(len(ids_a) + len(ids_b), np.int64)
        out[np.arange(len(ids_a)) + before_b[group_a]] = 2 * ids_a.astype(np.int64) + end_a
        out[np.arange(len(ids_b)) + (before_a + n_a)[group_b]] = 2 * (ids_b.astype(np.int64) + len(self.a.token)) + end_b
        signs = list(map(self._text.__getitem__, out.tolist()))
        ends = np.cumsum(texts).tolist()
        return ["".join(signs[s:e])[:-1] for s, e in zip([0, *ends], ends, strict=False)]


_ALIGNERS: dict[str, Aligner] = {}


def _aligner(raw_a: bytes, raw_b: bytes) -> Aligner:
    """Made once in each Python worker."""
    key = hashlib.sha256(hashlib.sha256(raw_a).digest() + hashlib.sha256(raw_b).digest()).hexdigest()
    if key not in _ALIGNERS:
        _ALIGNERS[key] = Aligner(in_worker(ByteLevel, raw_a), in_worker(Pieces, raw_b))
    return _ALIGNERS[key]


def aligned(docs: DataFrame, raw_a: bytes, raw_b: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: _row (a number of its own), id, n_a, n_b, n_groups, n_links, groups_sha256, and the distinct
    linked pairs (id of a << 32 | id of b, sorted) with how often each is linked. raw_a, raw_b: the tokenizers' files.

    A text that is null, empty, or whose tokens do not give its bytes back has no tokens, and '' as groups_sha256.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast((raw_a, raw_b))  # vocabulary files
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), whole(F.col(f"`{text_col}`")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()
    names = ["_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]

    def run(batches):
        aligner = _aligner(*shared.value)
        at = TaskContext.get().partitionId() << 40
        for batch in batches:
            for own, texts in _some(batch):
                found = aligner.tokens(texts)
                with_tokens = [x for x in found if x is not None]
                has = np.array([x is not None for x in found])
                ids_a, ids_b = (np.concatenate([x[k] for x in with_tokens]) if with_tokens else np.zeros(0, np.uint32) for k in (0, 1))
                n_a, n_b = (np.array([len(x[k]) for x in with_tokens], np.int64) for k in (0, 1))
                cuts, group_a, group_b, of_a, of_b = aligner.align(ids_a, ids_b)
                end_a = np.cumsum(n_a)
                n_groups = np.diff(group_a[end_a - 1] + 1, prepend=0)
                end_link = np.searchsorted(of_a, end_a)
                linked = ids_a[of_a].astype(np.int64) << 32 | ids_b[of_b].astype(np.int64)
                pairs, times = zip(*[np.unique(x, return_counts=True) for x in np.split(linked, end_link)[:-1]], strict=True) if with_tokens else ((), ())
                digests = np.full(len(texts), "", object)
                digests[has] = [hashlib.sha256(x.encode()).hexdigest() for x in aligner.written(ids_a, ids_b, group_a, group_b, n_a + n_b)]
                cols = [pa.array(np.arange(at, at + len(texts))), own]
                cols += [pa.array(_spread(has, x)) for x in (n_a, n_b, n_groups, np.diff(end_link, prepend=0))] + [pa.array(digests, pa.string())]
                ends = pa.array(np.cumsum(np.append(0, _spread(has, np.array([len(x) for x in pairs], np.int64)))).astype(np.int32))
                cols += [pa.ListArray.from_arrays(ends, pa.array(np.concatenate([np.zeros(0, kind_), *x]).astype(kind_))) for x, kind_ in ((pairs, np.int64), (times, np.int32))]
                at += len(texts)
                yield pa.RecordBatch.from_arrays(cols, names)

    return rows.mapInArrow(run, f"_row long, _id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>")


def _some(batch: pa.RecordBatch):
    """(ids, texts) of about ALIGN_CHARS characters at a time."""
    texts = batch.column(1).to_pylist()
    at = size = 0
    for n, t in enumerate(texts):
        size += len(t)
        if size >= ALIGN_CHARS or n == len(texts) - 1:
            yield batch.column(0)[at : n + 1], texts[at : n + 1]
            at, size = n + 1, 0


def _spread(has: np.ndarray, values: np.ndarray) -> np.ndarray:
    """The values where there are some, else 0."""
    out = np.zeros(len(has), np.int64)
    out[has] = values
    return out


def pair_counts(held: DataFrame, salts: int = SALTS) -> DataFrame:
    """aligned rows -> (pair, n, best): in how many documents each pair is linked, and whether no pair of its id of a is in more."""
    each = held.select(F.explode("pairs").alias("pair"), F.pmod("_row", F.lit(salts)).alias("salt"))
    counts = each.groupBy("pair", "salt").agg(F.count(F.lit(1)).alias("n")).groupBy("pair").agg(F.sum("n").alias("n"))
    counts = shared_table(counts, "pair-counts")
    most = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("most"))
    best = counts.join(most, F.shiftright("pair", 32) == F.col("a"))
    return shared_table(best.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "pair-counts")


def _frequent(counts: DataFrame, at_most: int) -> tuple[DataFrame, bool]:
    """(the most frequent pairs, at_most of them at most, whether these are all). The driver sees one number for each level of
    counts, of which there are LEVELS for each power of two."""
    level = F.floor(F.log2("n") * LEVELS).cast("int")
    sizes = sorted(((r["level"], r["count"]) for r in counts.groupBy(level.alias("level")).count().collect()), reverse=True)
    total, least = 0, None
    for at, n in sizes:
        if total + n > at_most:
            break
        total, least = total + n, at
    if least is None:
        return counts.limit(0), not sizes
    return counts.filter(level >= least), total == sum(n for _, n in sizes)


def align_tokens(docs: DataFrame, raw_a: bytes, raw_b: bytes, id_col: str = "doc_id", text_col: str = "text", frequent: int = FREQUENT) -> DataFrame:
    """One row for each row of docs: id, n_a, n_b, n_groups, n_links, n_best (links whose count is the greatest of their id of a,
    ties included), count_sum (over links) and groups_sha256. A pair's count is the number of rows that hold it linked.

    Texts without tokens (see `aligned`) have zeros. Rows that repeat an id are documents each. An empty table gives no rows.
    """
    held = shared_table(aligned(docs, raw_a, raw_b, id_col, text_col), "aligned")
    counts = pair_counts(held)
    known, all_known = _frequent(counts, frequent)
    known = known.select(F.col("pair").alias("_p"), "n", "best")
    links = held.select("_row", "times", F.posexplode("pairs").alias("_k", "pair")).select("_row", "pair", F.col("times")[F.col("_k")].cast("long").alias("times"))
    sums = [F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum")]
    found = links.join(F.broadcast(known), F.col("pair") == F.col("_p")).groupBy("_row").agg(*sums)
    if not all_known:
        rare = links.join(F.broadcast(known), F.col("pair") == F.col("_p"), "left_anti")
        rest = counts.join(F.broadcast(known), F.col("pair") == F.col("_p"), "left_anti").withColumnRenamed("pair", "_q")
        found = found.unionByName(rare.join(rest, F.col("pair") == F.col("_q")).groupBy("_row").agg(*sums))
        found = found.groupBy("_row").agg(F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    found = found.withColumnRenamed("_row", "_of")
    of_row = held.select("_row", "_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256").join(found, F.col("_row") == F.col("_of"), "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return of_row.select(F.col("_id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", zero("n_best"), zero("count_sum"), "groups_sha256")
