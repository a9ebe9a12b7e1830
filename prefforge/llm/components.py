"""Connected components of a table of links: by union-find where links are few, else by alternating large and small stars."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefforge.functions.tables import shared_table

#: Links (16 bytes each) that one task connects by itself; more go through rounds, with the same result.
LOCAL_LINKS = 1_000_000


def _united(batches):
    """The root, which is the least node, of each node of the links."""
    above: dict[int, int] = {}

    def root(x: int) -> int:
        top = x
        while (up := above.setdefault(top, top)) != top:
            top = up
        while (up := above[x]) != top:
            above[x], x = top, up
        return top

    for batch in batches:
        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                above[max(a, b)] = min(a, b)
    nodes = list(above)
    if nodes:
        yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array([root(x) for x in nodes], pa.int64())], ["node", "root"])


def connected_components(links: DataFrame, most_rounds: int = 60, local_links: int = LOCAL_LINKS) -> DataFrame:
    """(a, b) long links -> (node, root): each node that has a link to another one, and the least node it reaches.

    Each round is written to the shared folder, which cuts the lineage. Neighbours are never gathered: a round is a
    minimum for each node (partly formed before the shuffle) and a join of the links with it, whose hot nodes Spark's
    skew join splits. The number of rounds grows with the logarithm of the number of nodes; what is not finished after
    most_rounds raises.
    """
    edges = shared_table(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "links")
    if edges.count() <= local_links:
        return shared_table(edges.repartition(1).mapInArrow(_united, "node long, root long"), "roots")
    state = None
    for _ in range(most_rounds):
        # large star: all larger neighbours of a node go to its least neighbour (or itself)
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("k"), F.least("u", "m").alias("m"))
        large = both.join(least, both["u"] == least["k"]).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = shared_table(large, "large-star")
        # small star: all smaller neighbours of a node, and the node, go to the least of them
        least = large.groupBy("u").agg(F.min("v").alias("m")).withColumnRenamed("u", "k")
        near = large.join(least, large["u"] == least["k"])
        small = near.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select(F.col("k").alias("u"), F.col("m").alias("v")))
        edges = shared_table(small.distinct(), "small-star")
        now = edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if (now["n"], now["s"]) == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        state = (now["n"], now["s"])
    raise RuntimeError(f"components are not found after {most_rounds} rounds")
