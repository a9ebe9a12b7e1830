"""SimHash near-dedup over a distributed vantage-point tree.

Fingerprints are 64 bits, a majority vote of the hashes of a text's word shingles. Of two fingerprints within `reach` bits,
one of their two halves is within reach // 2 bits, so each half has a vantage-point tree of its own, laid over a bounded
sample. Every fingerprint goes down both trees by the Hamming distance of its half to the vantage points. Halves at distance
d differ by at most d in their distance to any vantage point (triangle bound), so what is that near to a boundary also
visits the shard beyond it, and no link is lost. Shards that the sample leaves too large are divided further, by vantage points
of their own. (One tree over all 64 bits has three times as wide boundaries: its visits
grow as the rows to the power 1.6.) A shard compares whole fingerprints through a vantage-point search of its own; only a
spanning forest leaves it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions.tables import bounded_batches, releasing, shared_table
from prefforge.llm.components import connected_components
from prefforge.llm.sampling import least_hashes
from prefforge.llm.textops import WORD, lower_ascii, named_columns, numbered_columns, whole

#: Fingerprints of the sample that the tree is laid over (a bound on what the driver sees, not on what is indexed),
#: fingerprints that a shard is to have at home and that one task compares, and the fewest sample fingerprints of a shard.
SAMPLE = 200_000
SHARD_ROWS = 4_000
LEAST_LEAF = 8
#: Shards of fewer nodes than this share of the sample on one side are not worth their boundary.
LEAST_SIDE = 0.15


def shingle_hashes(text: str, width: int, words=regex.compile(WORD.encode()).findall):
    """XXH64 of the shingles of one text whose A-Z are in lower case already, in arrays of up to 50,000; none without words.
    A text of fewer words than `width` is one shingle."""
    found = words(text.encode())
    if not found:
        return
    width = min(width, len(found))
    joined = b" ".join(found)
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    digest = xxhash.xxh64_intdigest
    n = len(found) - width + 1
    for at in range(0, n, 50_000):
        s, e = starts[at : min(n, at + 50_000)].tolist(), ends[at + width - 1 : min(n, at + 50_000) + width - 1].tolist()
        yield np.array([digest(joined[i:j], 42) for i, j in zip(s, e, strict=True)], np.uint64)


def fingerprint(text: str, width: int) -> int:
    """SimHash of one text whose A-Z are in lower case already."""
    return majority(shingle_hashes(text, width))


def majority(parts) -> int:
    """The fingerprint of shingle hashes that come in arrays: a bit is set if it is in over half of them."""
    votes, n = np.zeros(64, np.int64), 0
    for h in parts:
        n += len(h)
        # bits of up to 255 hashes at a time are summed as bytes
        bits = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        for b in range(0, len(bits), 255):
            votes += bits[b : b + 255].sum(axis=0, dtype=np.uint8)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3) -> DataFrame:
    """(id, fp long): fp holds the fingerprint's 64 bits. Null texts count as empty; texts without words get 0."""
    bounded_batches(docs.sparkSession)
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), lower_ascii(whole(F.col(f"`{text_col}`"))).alias("_text"))

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t.as_py(), width) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fp, np.uint64).view(np.int64))], ["_id", "fp"])

    return rows.mapInArrow(releasing(run), f"_id {rows.schema['_id'].dataType.simpleString()}, fp long").withColumnRenamed("_id", id_col)


def halves(points: np.ndarray) -> list[np.ndarray]:
    return [points & np.uint64(0xFFFFFFFF), points >> np.uint64(32)]


class VantageTree:
    """Nodes are (vantage point, radius, inside child, outside child); a negative child -s-1 is shard s."""

    def __init__(self, sample: np.ndarray, reach: int, leaf: int, seed: int = 42):
        self.reach = reach
        self.nodes: list[list[int]] = []
        self.shards = 0
        self._rng = np.random.default_rng(seed)
        self._leaf = leaf
        self.root = self._build(sample)

    def _build(self, points: np.ndarray) -> int:
        best = None
        if len(points) > self._leaf:
            for v in self._rng.choice(points, min(12, len(points)), replace=False):
                d = np.bitwise_count(points ^ v).astype(np.int64)
                inside = np.cumsum(np.bincount(d, minlength=65))
                for radius in range(64):
                    share = inside[radius] / len(points)
                    if LEAST_SIDE <= share <= 1 - LEAST_SIDE:
                        # those inside that also visit the outside: radius - reach < d <= radius
                        lap = (inside[radius] - (inside[radius - self.reach] if radius >= self.reach else 0)) / len(points)
                        cost = share**2 + (1 - share + lap) ** 2
                        if cost < 0.95 and (best is None or cost < best[0]):
                            best = (cost, v, radius, d)
        if best is None:
            self.shards += 1
            return -self.shards
        _, v, radius, d = best
        at = len(self.nodes)
        self.nodes.append([int(v), int(radius), 0, 0])
        self.nodes[at][2] = self._build(points[d <= radius])
        self.nodes[at][3] = self._build(points[d > radius - self.reach])
        return at

    def visits(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(index of the point, shard) of every shard that each point goes to; two points within reach of each other
        meet in at least one shard: those inside a boundary within reach of it go to both sides."""
        found, stack = [], [(self.root, np.arange(len(points)))]
        while stack:
            at, own = stack.pop()
            if at < 0:
                found.append((own, np.full(len(own), -at - 1)))
            elif len(own):
                v, radius, inside, outside = self.nodes[at]
                d = np.bitwise_count(points[own] ^ np.uint64(v)).astype(np.int64)
                stack += [(inside, own[d <= radius]), (outside, own[d > radius - self.reach])]
        return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def local_forest(points: np.ndarray, reach: int, block: int = 64) -> np.ndarray:
    """For each point the index of one point of its component, the same for all of it; links are distances up to reach.

    The points are sorted by their distance to one of them, the vantage point, and a block is compared only with those
    behind it that are at most reach farther from it.
    """
    d = np.bitwise_count(points ^ points[0]).astype(np.int64)
    order = np.argsort(d, kind="stable")
    p, d = points[order], d[order]
    root = np.arange(len(p))
    for at in range(0, len(p), block):
        own = p[at : at + block]
        end = np.searchsorted(d, d[at + len(own) - 1] + reach, side="right")
        near = np.bitwise_count(own[:, None] ^ p[None, at:end]) <= reach
        for i in np.flatnonzero(near.sum(axis=1) > 1):
            met = np.unique(root[at + np.flatnonzero(near[i])])
            if len(met) > 1:
                root[np.isin(root, met)] = met[0]
    out = np.empty_like(root)
    out[order] = order[root]
    return out


def deepened(visits: DataFrame, reach: int, shard_rows: int, most_levels: int = 40) -> DataFrame:
    """(fp, shard, side) with every shard of more than shard_rows fingerprints divided by a vantage point of its own, again and
    again, until it is small or no point divides it well (a dense neighbourhood).

    The sample's tree has a bounded number of shards, so that with more fingerprints they grow; a subtree goes on from there.
    A level takes the point of least hash of each large shard, counts the distances of its half to it (33 values at most), and
    sends each fingerprint inside or outside of the radius that divides best, and to both where it is within reach of it.
    """
    half = lambda x: F.when(F.col("side") == 0, F.col(x).bitwiseAND(0xFFFFFFFF)).otherwise(F.shiftrightunsigned(x, 32))
    done = None
    for level in range(most_levels):
        sizes = visits.groupBy("shard").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct(F.xxhash64("fp", F.lit(level)).alias("h"), "fp")).alias("v"))
        large = shared_table(sizes.filter(F.col("n") > shard_rows).select(F.col("shard").alias("s"), "n", F.col("v.fp").alias("v")), "large-shards")
        if large.isEmpty():
            break
        measured = shared_table(visits.join(large, F.col("shard") == F.col("s")).withColumn("d", F.bit_count(half("fp").bitwiseXOR(half("v")))).drop("s", "v"), "measured")
        small = visits.join(large, F.col("shard") == F.col("s"), "left_anti")
        counts = measured.groupBy("shard", "d").agg(F.count(F.lit(1)).alias("c"), F.first("n").alias("n"))
        up_to = Window.partitionBy("shard").orderBy("d").rangeBetween(Window.unboundedPreceding, 0)
        lap = Window.partitionBy("shard").orderBy("d").rangeBetween(1 - reach, 0)  # radius - reach < d <= radius
        share = counts.select("shard", F.col("d").alias("radius"), (F.sum("c").over(up_to) / F.col("n")).alias("p"), (F.sum("c").over(lap) / F.col("n")).alias("q"))
        share = share.filter(F.col("p").between(LEAST_SIDE, 1 - LEAST_SIDE)).withColumn("cost", F.col("p") * F.col("p") + (1 - F.col("p") + F.col("q")) * (1 - F.col("p") + F.col("q")))
        best = share.filter("cost < 0.95").groupBy("shard").agg(F.min(F.struct("cost", "radius")).alias("b")).select(F.col("shard").alias("s"), F.col("b.radius").alias("radius"))
        cut = measured.join(best, F.col("shard") == F.col("s"), "left")
        whole_ = cut.filter("radius is null").select("fp", "shard", "side")
        sides = F.array_compact(F.array(F.when(F.col("d") <= F.col("radius"), 0), F.when(F.col("d") > F.col("radius") - reach, 1)))
        parts = cut.filter("radius is not null").withColumn("part", F.explode(sides))
        parts = parts.select("fp", F.xxhash64("shard", "part", F.lit(level)).alias("shard"), "side")
        closed = shared_table(small.unionByName(whole_) if done is None else done.unionByName(small).unionByName(whole_), "closed-shards")
        done, visits = closed, shared_table(parts, "subtree")
    return visits if done is None else done.unionByName(visits)


def fingerprint_links(distinct: DataFrame, reach: int = 3, sample_rows: int = SAMPLE, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """(fp) distinct fingerprints -> (a, b): links that connect exactly the fingerprints that chains of distances up to
    reach connect. A spanning forest of each shard, never all pairs."""
    spark = distinct.sparkSession
    sample = np.array([r["fp"] for r in least_hashes(distinct.select("fp"), "fp", sample_rows, 7).toLocalIterator()], np.int64).view(np.uint64)
    if not len(sample):
        return spark.createDataFrame([], "a long, b long")
    # more fingerprints make a deeper tree: about shard_rows of them are at home in a shard
    leaf = max(LEAST_LEAF, int(shard_rows * len(sample) / distinct.count()))
    trees = spark.sparkContext.broadcast([VantageTree(half, reach // 2, leaf) for half in halves(sample)])

    def route(batches):
        for batch in batches:
            points = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            found = [tree.visits(half) for tree, half in zip(trees.value, halves(points.view(np.uint64)), strict=True)]
            own = np.concatenate([x for x, _ in found])
            shard = np.concatenate([2 * x + side for side, (_, x) in enumerate(found)])
            for at in range(0, len(own), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(points[own[at : at + 100_000]]), pa.array(shard[at : at + 100_000].astype(np.int64))], ["fp", "shard"])

    visits = shared_table(distinct.select("fp").mapInArrow(releasing(route), "fp long, shard long"), "visits")
    visits = deepened(visits.select("fp", "shard", F.pmod("shard", F.lit(2)).cast("int").alias("side")), reach // 2, shard_rows)
    # what no vantage point divides is cut into blocks, and every two blocks meet in a task of their own
    sizes = visits.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / F.lit(shard_rows)).cast("int").alias("blocks"))
    block = F.pmod(F.xxhash64("fp", F.lit(11)), F.col("blocks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    dealt = visits.join(sizes, "shard").withColumn("block", block).withColumn("other", other)
    dealt = dealt.select("shard", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y"), "fp")

    def forest(pdf: pd.DataFrame) -> pd.DataFrame:
        # hash order, so that the vantage point is any point
        points = np.unique(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        root = local_forest(points, reach)
        own = np.flatnonzero(root != np.arange(len(points)))
        return pd.DataFrame({"a": points[own].view(np.int64), "b": points[root[own]].view(np.int64)})

    return dealt.groupBy("shard", "x", "y").applyInPandas(forest, "a long, b long")


def as_hex(fp: Column) -> Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def _components(docs: DataFrame, id_col: str, text_col: str, width: int, reach: int) -> tuple[DataFrame, DataFrame]:
    """((id, fp) of each row, (_fp, component_id) of each fingerprint)."""
    prints = shared_table(fingerprints(docs, id_col, text_col, width), "fingerprints")
    own = shared_table(prints.groupBy("fp").agg(F.min(id_col).alias("_least")), "distinct-fingerprints")
    links = fingerprint_links(own.select("fp"), reach)
    roots = connected_components(links)
    named = own.join(roots, own["fp"] == roots["node"], "left").select("fp", "_least", F.coalesce("root", "fp").alias("_root"))
    least = named.groupBy("_root").agg(F.min("_least").alias("component_id"))
    return prints, named.join(least, "_root").select(F.col("fp").alias("_fp"), "component_id")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) of each row: the component is the smallest id that chains of links reach.

    Equal fingerprints link (also those of texts without words, which are 0). A null id takes part, but gives no
    component its name unless all ids of the component are null. An empty table gives no rows.
    """
    prints, named = _components(docs, id_col, text_col, width, reach)
    return prints.join(named, prints["fp"] == named["_fp"]).select(id_col, as_hex(F.col("fp")).alias("fingerprint"), "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, reach: int = 3) -> DataFrame:
    """docs without the rows whose component has a smaller id. Rows are told apart by id and fingerprint, so one that shares
    its id with a near copy stays if it is none itself; rows without an id stay."""
    plain, at = numbered_columns(docs)
    id_, text = at[id_col], at[text_col]
    prints, named = _components(plain.select(id_, text), id_, text, width, reach)
    gone = prints.join(named, prints["fp"] == named["_fp"]).filter(F.col(id_) != F.col("component_id")).select(F.col(id_).alias("_gone"), F.col("fp").alias("_fp")).distinct()
    mine = _with_fingerprints(plain, text, width)
    return named_columns(mine.join(gone, (F.col(id_) == F.col("_gone")) & (F.col("_print") == F.col("_fp")), "left_anti"), at)


def _with_fingerprints(rows: DataFrame, text: str, width: int) -> DataFrame:
    """rows with a column _print beside their own."""
    lowered = rows.withColumn("_lower", lower_ascii(whole(F.col(text))))
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema.fields)

    def run(batches):
        for batch in batches:
            fp = [fingerprint(t.as_py(), width) for t in batch.column("_lower")]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in rows_columns], pa.array(np.array(fp, np.uint64).view(np.int64))], [*rows_columns, "_print"])

    rows_columns = rows.columns
    return lowered.mapInArrow(run, f"{kinds}, _print long")
