"""Exact top-k inner products by no-random-access aggregation.

Candidates are dealt to blocks. Each block is written once as its sorted lists: for every dimension, the order of the
candidates by their values. A query reads every list sequentially from its better end (large values where its component is
positive, small ones where it is negative), to depths that grow round by round. What it has read of a candidate gives bounds
of its score: an unread value is at least the list's last one, and at most the value at the depth reached. A query stops in
a block when no candidate but a few has an upper bound that reaches the k-th best lower bound, and the scores of those few
are resolved. Blocks are searched in groups of growing size; the k-th best score of the groups before is a floor from which a
query starts in the next ones, so that most of later blocks drops out early.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions.tables import shared_table

#: Candidates of a block; queries that a task holds, and that it searches at once.
BLOCK = 4_096
BATCH = 16_384
AT_ONCE = 128
#: Depths of the rounds, as shares of the lists, and the share of candidates that is few enough to resolve.
DEPTHS = (0.125, 0.25, 0.5, 0.75, 1.0)
FEW = 0.02


class SortedLists:
    """The lists of one block: values (dimensions, candidates), and each dimension's order of the candidates, ascending."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, order: np.ndarray):
        self.ids, self.values, self.order = ids, values.astype(float), order.astype(np.int64)
        self.line = np.arange(len(values))[:, None]

    def read(self, queries: np.ndarray, own: np.ndarray, k: int, floor: np.ndarray):
        """(row of queries, ids, scores) of the k best candidates of each query but its own id, best first; those with a
        score below the query's floor need not be found."""
        d, m = self.values.shape
        first, last = self.values[self.line[:, 0], self.order[:, 0]], self.values[self.line[:, 0], self.order[:, -1]]
        # what has been read from the large and from the small end of the lists, and which places that is
        read_up, read_down, seen_up, seen_down = (np.zeros((d, m)) for _ in range(4))
        up, down = np.maximum(queries, 0).astype(float), np.minimum(queries, 0).astype(float)
        active, before = np.arange(len(queries)), 0
        for share in DEPTHS:
            depth = max(1, int(np.ceil(share * m)))
            for places, read, seen in ((self.order[:, m - depth : m - before], read_up, seen_up), (self.order[:, before:depth], read_down, seen_down)):
                read[self.line, places] = self.values[self.line, places]
                seen[self.line, places] = 1
            before = depth
            p, n = up[active], down[active]
            known = p @ read_up + n @ read_down

            def bound(a: np.ndarray, b: np.ndarray, p=p, n=n, known=known) -> np.ndarray:
                """Scores if unread values are a (of lists read from the large end) and b (from the small end)."""
                x, y = p * a, n * b
                return known + (x.sum(axis=1) + y.sum(axis=1))[:, None] - x @ seen_up - y @ seen_down

            lower = bound(first, last)
            upper = bound(self.values[self.line[:, 0], self.order[:, m - depth]], self.values[self.line[:, 0], self.order[:, depth - 1]])
            mine = self.ids[None, :] == own[active][:, None]
            lower[mine] = upper[mine] = -np.inf
            if m > k:
                floor[active] = np.maximum(floor[active], np.partition(lower, m - k, axis=1)[:, m - k])
            open_ = (upper >= floor[active][:, None]) & ~mine
            done = (open_.sum(axis=1) <= max(2 * k, FEW * m)) | (depth == m)
            for i in np.flatnonzero(done):
                left = np.flatnonzero(open_[i])
                scores = (queries[active[i]] @ self.values[:, left]).astype(np.int64)
                top = np.lexsort((self.ids[left], -scores))[:k]
                yield active[i], self.ids[left][top], scores[top]
            active = active[~done]
            if not len(active):
                return


_LISTS = "block int, n int, width int, kind string, ids binary, data binary, sorted binary"


def _sort(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """A block as one row of lists."""
    pdf = pdf.sort_values("id", kind="stable")
    values = _matrix(pdf["v"]).T
    most = int(np.abs(values).max(initial=0))
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<i8"
    order = np.argsort(values, axis=1, kind="stable").astype("<u4")
    return pd.DataFrame({"block": [key[0]], "n": [len(pdf)], "width": [len(values)], "kind": [kind], "ids": [pdf["id"].to_numpy("<i8").tobytes()], "data": [values.astype(kind).tobytes()], "sorted": [order.tobytes()]})


def _lists(row) -> SortedLists:
    shape = (row.width, row.n)
    return SortedLists(np.frombuffer(row.ids, "<i8"), np.frombuffer(row.data, row.kind).reshape(shape), np.frombuffer(row.sorted, "<u4").reshape(shape))


def _search(k: int):
    def run(key, queries: pd.DataFrame, blocks: pd.DataFrame) -> pd.DataFrame:
        found = []
        for row in blocks.itertuples() if len(queries) else ():
            lists = _lists(row)
            width = len(lists.values)
            rows = queries["row"].to_numpy(np.int64)
            wanted, weights = queries["id"].to_numpy(np.int64), _wide(_matrix(queries["v"]), width)[:, :width]  # beyond it all values are 0
            floor = queries["floor"].astype(float).fillna(-np.inf).to_numpy().copy()
            for at in range(0, len(wanted), AT_ONCE):
                part = slice(at, at + AT_ONCE)
                for i, ids, scores in lists.read(weights[part], wanted[part], k, floor[part]):
                    if len(ids):
                        found.append(pd.DataFrame({"row": rows[at + i], "query_id": wanted[at + i], "vec_id": ids, "score": scores}))
        return pd.concat(found) if found else pd.DataFrame({"row": [], "query_id": [], "vec_id": [], "score": []}).astype("int64")

    return run


def _matrix(column: pd.Series) -> np.ndarray:
    width = max(map(len, column))
    return np.stack([_wide(np.asarray(v, np.int64)[None], width)[0] for v in column])


def _wide(x: np.ndarray, width: int) -> np.ndarray:
    return x if x.shape[1] >= width else np.pad(x, ((0, 0), (0, width - x.shape[1])))


def top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: str, k: int = 5, scale: int = 256, block_rows: int = BLOCK, batch_rows: int = BATCH) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best candidates by integer inner product, ties to the smaller id.

    Components x become floor(scale * x). Rows whose vector is null, or holds a null or a component that is not finite,
    take no part, nor do rows without an id. Of vectors of different lengths the shorter one counts as filled up with
    zeros. Each row whose id is a query's is a query of its own, also where several rows repeat an id; rows with its own id
    are no candidates, and each of several rows that repeat another id is one. Scores are exact: vectors so large that an
    inner product could pass 2**53 raise.
    """
    spark = vectors.sparkSession
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf")))) & (F.size(v) > 0)
    whole_numbers = F.transform(v, lambda x: F.floor(x * F.lit(float(scale))).cast("long"))
    empty = v.isNotNull() & (F.size(v) == 0)
    rows = vectors.filter((fine | empty) & F.col(f"`{id_col}`").isNotNull()).select(
        F.col(f"`{id_col}`").cast("long").alias("id"), F.when(empty, F.array(F.lit(0).cast("long"))).otherwise(whole_numbers).alias("v"),
        F.coalesce(F.array_max(F.transform(v, lambda x: F.abs(x * F.lit(float(scale))))), F.lit(0.0)).alias("most"), F.monotonically_increasing_id().alias("row"),
    )
    rows = shared_table(rows, "vectors")
    of_all = rows.agg(F.max("most").alias("most"), F.max(F.size("v")).alias("width")).first()
    if of_all["most"] is not None and of_all["width"] * (of_all["most"] + 1) ** 2 > 2**53:
        raise ValueError(f"components up to {of_all['most'] / scale:g} give inner products beyond 2**53, which would not be exact")
    rows = rows.drop("most")
    queries = rows.filter(is_query.format(id="id"))
    n, n_queries = rows.count(), queries.count()
    blocks, batches = max(1, -(-n // block_rows)), max(1, -(-n_queries // batch_rows))
    spread = lambda parts, salt: F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int")
    lists = shared_table(rows.withColumn("block", spread(blocks, 2)).groupBy("block").applyInPandas(_sort, _LISTS), "sorted-lists")
    order = Window.partitionBy("row").orderBy(F.desc("score"), "vec_id")
    best, first, many = spark.createDataFrame([], "row long, query_id long, vec_id long, score long, rank int"), 0, 1
    while first < blocks:
        last = min(blocks, first + many)
        # a query that has k candidates so far need not look for scores below the least of theirs
        floors = best.groupBy("row").agg(F.count(F.lit(1)).alias("c"), F.min("score").alias("s")).select(F.col("row").alias("q"), F.when(F.col("c") == k, F.col("s").cast("double")).alias("floor"))
        asked = queries.join(floors, F.col("row") == F.col("q"), "left").select("row", "id", "v", "floor", spread(batches, 1).alias("batch"), F.explode(F.sequence(F.lit(first), F.lit(last - 1))).alias("block"))
        given = lists.filter(F.col("block").between(first, last - 1)).withColumn("batch", F.explode(F.sequence(F.lit(0), F.lit(batches - 1))))
        found = asked.groupBy("batch", "block").cogroup(given.groupBy("batch", "block")).applyInPandas(_search(k), "row long, query_id long, vec_id long, score long")
        merged = found.unionByName(best.select("row", "query_id", "vec_id", "score"))
        best = shared_table(merged.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k), "best")
        first, many = last, 2 * many
    return best.select("query_id", "rank", "vec_id", "score")
