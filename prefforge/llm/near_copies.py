"""Near copies by the similarity of whole texts, decided exactly.

Two texts link if the Jaccard similarity of their sets of five-word shingles is 0.8 at least. A SimHash of 64 bits shows the
closest pairs only: at a similarity of 0.8 two fingerprints lie some ten bits apart, where very many others do. Candidates
are therefore the links of the SimHash operator (5-word fingerprints within 3 bits) and the pairs that share a band: each
text has 32 bands of 4 least hashes, and two texts of a similarity of 0.8 share none of them once in 2 * 10**7 pairs, while
of texts that share a tenth of their shingles (a passage) 3 in 1,000 do. A candidate goes on if at least 80 of the 128 least
hashes agree, by a byte of each; of pairs of a similarity of 0.8, where 102 are expected, one in a million does not. Whole
sets decide about all that go on.

The texts of a band first meet a pivot. Those that this leaves in different components get finer bands, 80 of 8 least hashes,
which texts of a similarity of 0.8 all miss once in 2 * 10**6 pairs, while of texts of a similarity of 0.35, which are 38 in
100 in a band of the first kind, 2 in 100 share one. They meet the pivot of each finer band, and only those that are still
in different components are compared with each other, in blocks (see `_crowd_links`), so that there is no row for a pair. A
shingle that only one of them has is in no intersection, so texts are left out where their other shingles are too few for
0.8: this, which is exact, keeps texts with many changes of their own apart, however many have the same origin. Pairs with
pivots are dealt to cells of neighbouring texts, so that least hashes and sets move once for each cell and not once for each
pair.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefforge.functions.tables import bounded_batches, release_memory, releasing, shared_table
from prefforge.llm.components import connected_components
from prefforge.llm.simhash import fingerprint_links, majority, shingle_hashes
from prefforge.llm.textops import lower_ascii, named_columns, numbered_columns, whole

#: Words of a shingle; bands of a text, and least hashes of a band.
WIDTH = 5
BANDS = 32
ROWS = 4
#: The same of the finer bands, which only texts have that the first ones leave apart.
FINE_BANDS = 80
FINE_ROWS = 8
#: Of BANDS * ROWS least hashes, how many of a candidate must agree.
AGREE = 80
#: Bytes of a block of nodes, bytes that a node counts for at least, and bytes that one task compares.
BLOCK_BYTES = 4 << 20
LEAST_WEIGHT = 4 << 10
TASK_BYTES = 8 << 20
#: Bits of a filter of ids.
FILTER_BITS = 1 << 26
_RANDOM = np.random.default_rng(5)


def _mixers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """What n hash functions mix and multiply a hash with."""
    mix, odd = (_RANDOM.integers(1, 1 << 63, n, dtype=np.uint64)[:, None] for _ in range(2))
    return mix, odd | np.uint64(1)


_COARSE = _mixers(BANDS * ROWS)
_FINE = _mixers(FINE_BANDS * FINE_ROWS)


def shingle_set(text: str, width: int = WIDTH) -> np.ndarray:
    """The text's distinct shingles as sorted 64-bit hashes. A text without words has a shingle of its own, the empty one."""
    found = list(shingle_hashes(text, width)) or [np.zeros(1, np.uint64)]
    return np.unique(np.concatenate(found))


def least_hashes(hashes: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The least value of a set of hashes under each of the hash functions."""
    mix, odd = mixers
    block = max(1, (1 << 19) // len(mix))
    least = np.full(len(mix), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), block):
        mixed = hashes[None, at : at + block] ^ mix
        mixed *= odd
        least = np.minimum(least, mixed.min(axis=1))
    return least


def band_keys(least: np.ndarray, mixers: tuple[np.ndarray, np.ndarray], rows: int) -> np.ndarray:
    """A key of each band of so many least hashes. Bands of different places do not meet."""
    of_band = (least * mixers[1][::-1, 0]).reshape(-1, rows)
    keys = of_band[:, 0].copy()
    for k in range(1, rows):
        keys = (keys ^ keys >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9) + of_band[:, k]
    keys ^= np.arange(len(keys), dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def least_bytes(least: np.ndarray, mixers: tuple[np.ndarray, np.ndarray]) -> bytes:
    """A byte of each least hash."""
    return (least * mixers[1][:, 0] >> np.uint64(56)).astype(np.uint8).tobytes()


def _lists(parts: list[np.ndarray]) -> pa.Array:
    ends = pa.array(np.cumsum([0, *map(len, parts)]).astype(np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)))


def _sketches(texts: DataFrame) -> DataFrame:
    """(_node, _id, _text) -> (_node, _id, _n, _fp, _bands, _least): the size of each text's set, its fingerprint, its bands and
    the bytes of its least hashes."""

    def run(batches):
        for batch in batches:
            sizes, prints, keys, least = [], [], [], []
            for t in batch.column("_text"):
                found = list(shingle_hashes(t.as_py(), WIDTH))
                prints.append(majority(found))
                hashes = np.unique(np.concatenate(found)) if found else np.zeros(1, np.uint64)
                sizes.append(len(hashes))
                found = least_hashes(hashes, _COARSE)
                keys.append(band_keys(found, _COARSE, ROWS))
                least.append(least_bytes(found, _COARSE))
            yield pa.RecordBatch.from_arrays([batch.column("_node"), batch.column("_id"), pa.array(sizes, pa.int64()), pa.array(np.array(prints, np.uint64).view(np.int64)), _lists(keys), pa.array(least, pa.binary())], ["_node", "_id", "_n", "_fp", "_bands", "_least"])

    bounded_batches(texts.sparkSession)
    return texts.select("_node", "_id", "_text").mapInArrow(releasing(run), f"_node long, _id {texts.schema['_id'].dataType.simpleString()}, _n long, _fp long, _bands array<long>, _least binary")


def _sets(texts: DataFrame) -> DataFrame:
    """(_node, _text) -> (_node, _hashes)."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("_node"), _lists([shingle_set(t.as_py()).view(np.int64) for t in batch.column("_text")])], ["_node", "_hashes"])

    bounded_batches(texts.sparkSession)
    return texts.select("_node", "_text").mapInArrow(releasing(run), "_node long, _hashes array<long>")


def _finer(texts: DataFrame) -> DataFrame:
    """(_node, _text) -> (_node, _n, _bands, _hashes): the size of each text's set, the keys of its finer bands, and the set."""

    def run(batches):
        for batch in batches:
            sets = [shingle_set(t.as_py()) for t in batch.column("_text")]
            keys = [band_keys(least_hashes(s, _FINE), _FINE, FINE_ROWS) for s in sets]
            yield pa.RecordBatch.from_arrays([batch.column("_node"), pa.array([len(s) for s in sets], pa.int64()), _lists(keys), _lists([s.view(np.int64) for s in sets])], ["_node", "_n", "_bands", "_hashes"])

    bounded_batches(texts.sparkSession)
    return texts.select("_node", "_text").mapInArrow(releasing(run), "_node long, _n long, _bands array<long>, _hashes array<long>")


def _perhaps(rows: DataFrame, key, wanted: DataFrame) -> DataFrame:
    """rows with `_maybe`: false only where the hash of key is not among those of the one column of wanted. The filter has one
    bit a place and 8 MB at most (FILTER_BITS), which is broadcast; a full one costs speed, never rows."""
    place = lambda c: F.xxhash64(c).bitwiseAND(FILTER_BITS - 1)
    marks = wanted.select(place(F.col(f"`{wanted.columns[0]}`")).alias("p"))
    marks = marks.groupBy(F.shiftright("p", 15).alias("_bucket")).agg(F.bitmap_construct_agg(F.col("p").bitwiseAND(32767)).alias("_bits"))
    marks = F.broadcast(shared_table(marks, "filter"))
    at = rows.withColumn("_place", place(key))
    at = at.join(marks, F.shiftright("_place", 15) == F.col("_bucket"), "left")
    byte = "cast(conv(hex(substring(_bits, cast(((_place & 32767) div 8) + 1 as int), 1)), 16, 10) as int)"
    return at.withColumn("_maybe", F.coalesce(F.expr(f"getbit({byte}, cast(_place % 8 as int)) = 1"), F.lit(False))).drop("_place", "_bucket", "_bits")


def _once(rows: DataFrame, name: str) -> DataFrame:
    """One row of each node; nothing moves if there are no more."""
    if rows.count() == rows.select("_node").distinct().count():
        return rows
    return shared_table(rows.dropDuplicates(["_node"]), name)


def _judged(pairs: DataFrame, nodes: DataFrame, labels: DataFrame, judge) -> DataFrame:
    """The (a, b) of pairs that judge keeps. nodes are (_node, _root, _w, _what): one row of each node of a pair, with what it
    is judged by and that one's bytes. Nodes of a label are dealt to blocks, and pairs to cells of two blocks, so what a node
    is judged by moves once for each cell and not once for each pair."""
    spark = pairs.sparkSession
    weight = F.greatest(F.col("_w"), F.lit(LEAST_WEIGHT))
    named = nodes.select("_node", weight.alias("_w")).join(labels, F.col("_node") == F.col("_named"), "left").select("_node", "_w", F.coalesce("_label", "_node").alias("_label"))
    blocks = named.groupBy("_label").agg(F.ceil(F.sum("_w") / BLOCK_BYTES).alias("_blocks")).select(F.col("_label").alias("_l"), "_blocks")
    block = F.xxhash64("_label", F.pmod(F.xxhash64("_node", F.lit(7)), F.col("_blocks")))
    dealt = shared_table(named.join(blocks, F.col("_label") == F.col("_l")).select("_node", "_w", block.alias("_block")), "blocks")
    side = lambda x: dealt.select(F.col("_node").alias(f"_{x}"), F.col("_block").alias(f"b_{x}"), F.col("_w").alias(f"w_{x}"))
    cells = pairs.select("a", "b").join(side("a"), F.col("a") == F.col("_a")).join(side("b"), F.col("b") == F.col("_b"))
    cell = F.xxhash64(F.least("b_a", "b_b"), F.greatest("b_a", "b_b"))
    cells = shared_table(cells.select("a", "b", "w_a", "w_b", cell.alias("cell")), "cells")
    visits = cells.select("cell", F.explode(F.array(F.struct(F.col("a").alias("n"), F.col("w_a").alias("w")), F.struct(F.col("b").alias("n"), F.col("w_b").alias("w")))).alias("v"))
    visits = shared_table(visits.select("cell", "v.n", "v.w").distinct(), "visits")
    total = visits.agg(F.sum("w")).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    task = F.pmod("cell", F.lit(tasks)).alias("task")
    held = visits.select("n", task).distinct().join(nodes, F.col("n") == F.col("_node")).select("task", "_node", "_root", "_what")

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        order = np.argsort(node := left.column("_node").to_numpy())
        a, b = (order[np.searchsorted(node, right.column(c).to_numpy(), sorter=order)] for c in ("a", "b"))
        kept = judge(left.column("_what").combine_chunks(), left.column("_root").to_numpy(), a, b)
        found = right.select(["a", "b"]).filter(pa.array(kept, pa.bool_()))
        del left, right, order, node, a, b
        release_memory()
        return found

    return held.groupBy("task").cogroup(cells.select("a", "b", task).groupBy("task")).applyInArrow(run, "a long, b long")


def _similar(what: pa.Array, roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which pairs of whole sets have a similarity of 0.8 at least. Those that others connect already are not looked at."""
    ends, values = what.offsets.to_numpy(), what.values.to_numpy()
    above: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    kept = np.zeros(len(a), bool)
    named = roots.tolist()
    for n, (i, k) in enumerate(zip(a.tolist(), b.tolist(), strict=True)):
        x, y = root(named[i]), root(named[k])
        if x == y:
            continue
        both = np.concatenate([values[ends[i] : ends[i + 1]], values[ends[k] : ends[k + 1]]])
        both.sort()
        if 9 * np.count_nonzero(both[1:] == both[:-1]) >= 4 * len(both):
            kept[n] = True
            above[max(x, y)] = min(x, y)
    return kept


def _agree(what: pa.Array, roots: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Of which pairs at least AGREE least hashes agree."""
    least = np.frombuffer(b"".join(what.to_pylist()), np.uint8).reshape(-1, BANDS * ROWS)
    kept = [(least[a[at : at + 50_000]] == least[b[at : at + 50_000]]).sum(axis=1) >= AGREE for at in range(0, len(a), 50_000)]
    return np.concatenate(kept) if kept else np.zeros(0, bool)


def _ends(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("a", "b")).alias("_wanted")).distinct()


def _texts_of(wanted: DataFrame, texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """(_node, _text) of the nodes of wanted, a table of one column `_wanted`: a filter of ids keeps others in place."""
    ids = sketches.join(wanted, F.col("_node") == F.col("_wanted"), "left_semi").select("_id")
    return _perhaps(texts, F.col("_id"), ids).filter("_maybe").select("_node", "_text").join(wanted, F.col("_node") == F.col("_wanted"), "left_semi")


def _decided(pairs: DataFrame, texts: DataFrame, sketches: DataFrame, labels: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """Of the (a, b), links that connect all that the similar ones among them connect: least hashes decide first, then whole
    sets. What the roots connect counts as connected."""
    of = sketches.join(_ends(pairs), F.col("_node") == F.col("_wanted"), "left_semi")
    of = shared_table(of.select("_node", F.col("_node").alias("_root"), F.octet_length("_least").cast("long").alias("_w"), F.col("_least").alias("_what")), "least-hashes")
    pairs = shared_table(_judged(pairs, of, labels, _agree), "agreeing")
    ends = shared_table(_ends(pairs), "ends")
    sets = _once(shared_table(_sets(_texts_of(ends, texts, sketches)), "shingle-sets"), "shingle-sets")
    if roots is None:
        sets = sets.withColumn("_root", F.col("_node"))
    else:
        sets = sets.join(roots, F.col("_node") == F.col("node"), "left").withColumn("_root", F.coalesce("root", "_node"))
    return _judged(pairs, sets.select("_node", "_root", (8 * F.size("_hashes")).cast("long").alias("_w"), F.col("_hashes").alias("_what")), labels, _similar)


def _apart(keyed: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of the bands (key, _node, ...) whose texts are not all connected, with the `_root` of each node."""
    placed = keyed.join(roots, F.col("_node") == F.col("node"), "left").select(*keyed.columns, F.coalesce("root", "_node").alias("_root"))
    ends = placed.groupBy("key").agg(F.min("_root").alias("x"), F.max("_root").alias("y")).filter("x <> y").select(F.col("key").alias("k"))
    return shared_table(placed.join(ends, F.col("key") == F.col("k"), "left_semi"), "apart")


def similar_links(texts: DataFrame, sketches: DataFrame) -> DataFrame:
    """(_node, _text) and one sketch of each node -> (a, b): links that connect the nodes which chains of similar texts
    connect."""
    fits = (5 * F.least("_n", "_m") >= 4 * F.greatest("_n", "_m")) & (F.col("_node") != F.col("_other"))
    pair = (F.least("_node", "_other").alias("a"), F.greatest("_node", "_other").alias("b"))
    keyed = sketches.select("_node", "_n", F.explode("_bands").alias("key"))
    counts = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select(F.col("key").alias("k"))
    met = shared_table(keyed.join(counts, F.col("key") == F.col("k"), "left_semi"), "shared-bands")
    # bands of the same texts: one of them is enough
    groups = met.groupBy("key").agg(F.count(F.lit(1)).alias("c"), *[F.bit_xor(F.xxhash64("_node", F.lit(k))).alias(f"s{k}") for k in (1, 2)], F.min(F.struct("_node", "_n")).alias("p"))
    groups = groups.groupBy("c", "s1", "s2").agg(F.min("key").alias("k"), F.first("p").alias("p"))
    groups = shared_table(groups.select("k", F.col("p._node").alias("_other"), F.col("p._n").alias("_m")), "band-pivots")
    met = shared_table(met.join(groups.select("k"), F.col("key") == F.col("k"), "left_semi"), "shared-bands")
    tried = met.join(groups, F.col("key") == F.col("k")).filter(fits).select(*pair)
    # the links of the SimHash operator, and texts of equal fingerprints
    prints = shared_table(sketches.groupBy("_fp").agg(F.min("_node").alias("first")), "distinct-fingerprints")
    equal = sketches.join(prints.withColumnRenamed("_fp", "f"), F.col("_fp") == F.col("f")).select("_node", F.col("first").alias("_other"))
    close = fingerprint_links(prints.select(F.col("_fp").alias("fp")))
    end = lambda x, y: prints.select(F.col("_fp").alias(x), F.col("first").alias(y))
    close = close.join(end("a", "_node"), "a").join(end("b", "_other"), "b").select("_node", "_other")
    tried = tried.unionByName(equal.unionByName(close).filter("_node <> _other").select(*pair))
    tried = shared_table(tried.distinct(), "pivot-pairs")
    # texts of a neighbourhood have the same label, mostly: it decides only which of them meet in one task
    labels = shared_table(tried.groupBy(F.col("b").alias("_named")).agg(F.min("a").alias("_label")), "labels")
    links = shared_table(_decided(tried, texts, sketches, labels), "pivot-links")
    # what is not connected yet meets the pivots of finer bands, and what these leave apart is compared pair by pair
    roots = connected_components(links)
    apart = shared_table(_apart(met, roots).select(F.col("_node").alias("_wanted")).distinct(), "nodes-apart")
    finer = _once(shared_table(_finer(_texts_of(apart, texts, sketches)), "finer-bands"), "finer-bands")
    # `_e` shingles of a node are in another one of these nodes too
    alone = finer.select("_node", F.explode("_hashes").alias("h")).groupBy("h").agg(F.count(F.lit(1)).alias("c"), F.min("_node").alias("_owner"))
    alone = alone.filter("c = 1").groupBy("_owner").agg(F.count(F.lit(1)).alias("_alone"))
    shared = finer.select("_node", "_n", "_bands").join(alone, F.col("_node") == F.col("_owner"), "left").withColumn("_e", F.col("_n") - F.coalesce("_alone", F.lit(0)))
    keyed = shared.filter("5 * _e >= 4 * _n").select("_node", "_n", "_e", F.explode("_bands").alias("key"))
    met = _apart(keyed, roots)
    fits = (9 * F.least("_e", "_f") >= 4 * (F.col("_n") + F.col("_m"))) & (F.col("_root") != F.col("_beyond"))
    beyond = lambda x: [F.col(f"{x}{c}").alias(d) for c, d in (("_node", "_other"), ("_n", "_m"), ("_e", "_f"), ("_root", "_beyond"))]
    pivots = met.groupBy("key").agg(F.min(F.struct(F.xxhash64("_node", "key").alias("h"), "_node", "_n", "_e", "_root")).alias("p")).select(F.col("key").alias("k"), *beyond("p."))
    fresh = met.join(pivots, F.col("key") == F.col("k")).filter(fits).select(*pair).distinct()
    fresh = shared_table(fresh.join(tried, ["a", "b"], "left_anti"), "finer-pivot-pairs")
    links = shared_table(links.unionByName(_decided(fresh, texts, sketches, labels, roots)), "finer-pivot-links")
    roots = connected_components(links)
    return links.unionByName(_crowd_links(_apart(met.drop("_root"), roots), finer))


def _crowd_links(met: DataFrame, finer: DataFrame) -> DataFrame:
    """Links among the nodes of finer bands (key, _node, _root, ...) that are not all connected. Nodes that bands lead to from
    each other are a crowd, whose nodes are all compared, but never as pairs in rows: a crowd is dealt to blocks of bounded
    bytes, every two blocks meet in a task, and what leaves it is a forest of links between different components."""
    spark = met.sparkSession
    least = met.groupBy("key").agg(F.min("_node").alias("_to")).select(F.col("key").alias("k"), "_to")
    star = met.join(least, F.col("key") == F.col("k")).select(F.col("_node").alias("a"), F.col("_to").alias("b"))
    crowds = connected_components(star).select(F.col("node").alias("_c"), F.col("root").alias("_crowd"))
    nodes = met.select("_node", "_root").distinct().join(crowds, F.col("_node") == F.col("_c")).select(F.col("_node").alias("n"), "_root", "_crowd")
    nodes = shared_table(nodes.join(finer.select("_node", "_hashes"), F.col("n") == F.col("_node")).select("_node", "_root", "_crowd", "_hashes"), "crowds")
    weight = F.greatest(8 * F.size("_hashes"), F.lit(LEAST_WEIGHT))
    blocks = nodes.groupBy("_crowd").agg(F.ceil(F.sum(weight) / BLOCK_BYTES).cast("int").alias("_blocks")).select(F.col("_crowd").alias("_of"), "_blocks")
    block = F.pmod(F.xxhash64("_node", F.lit(13)), F.col("_blocks")).cast("int")
    dealt = nodes.join(blocks, F.col("_crowd") == F.col("_of")).withColumn("_own", block).withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    cell = F.xxhash64("_crowd", F.least("_own", "_other"), F.greatest("_own", "_other")).alias("cell")
    cells = dealt.select(cell, (F.col("_own") > F.col("_other")).alias("upper"), (F.col("_own") == F.col("_other")).alias("same"), "_node", "_root", "_hashes")
    total = nodes.agg(F.sum(weight)).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))

    def run(held: pa.Table) -> pa.Table:
        held = held.combine_chunks()
        cell_, node, root = (held.column(c).to_numpy() for c in ("cell", "_node", "_root"))
        upper, same = (held.column(c).to_numpy(zero_copy_only=False) for c in ("upper", "same"))
        lists = held.column("_hashes").combine_chunks()
        by = np.argsort(cell_, kind="stable")
        line = cell_[by]
        a, b = [], []
        for own in np.split(by, np.flatnonzero(line[1:] != line[:-1]) + 1):
            found = crowd_forest(node[own], root[own], upper[own], same[own], [lists[int(i)].values.to_numpy() for i in own])
            a += [x for x, _ in found]
            b += [y for _, y in found]
        del held, lists
        release_memory()
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    return cells.groupBy(F.pmod("cell", F.lit(tasks))).applyInArrow(run, "a long, b long")


def crowd_forest(node: np.ndarray, root: np.ndarray, upper: np.ndarray, same: np.ndarray, sets: list[np.ndarray], columns: int = 2048) -> list[tuple[int, int]]:
    """Links that connect all components which similar texts of a cell connect. Texts of a cell of one block (same) are compared
    with each other, those of two blocks (upper or not) with those of the other one. The numbers of shared shingles of all
    of them are products of matrices of which shingles each has, some columns at a time; shingles of one text are in no
    product."""
    size = np.array([len(x) for x in sets], np.int64)
    text = np.repeat(np.arange(len(sets)), size)
    _, shingle, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count > 1
    place = np.cumsum(shared) - 1
    inside = shared[shingle]
    text, shingle = text[inside], place[shingle[inside]]
    by = np.argsort(shingle, kind="stable")
    text, shingle = text[by], shingle[by]
    one = np.flatnonzero(same) if same.any() else np.flatnonzero(upper)
    other = one if same.any() else np.flatnonzero(~upper)
    both = np.zeros((len(one), len(other)), np.float32)
    for at in range(0, int(shared.sum()), columns):
        low, high = np.searchsorted(shingle, [at, at + columns])
        has = np.zeros((len(sets), columns), np.float32)
        has[text[low:high], shingle[low:high] - at] = 1
        both += has[one] @ has[other].T
    similar = 9 * both >= 4 * (size[one][:, None] + size[other][None, :])
    similar &= root[one][:, None] != root[other][None, :]
    above: dict[int, int] = {}

    def top(x: int) -> int:
        while (up := above.get(x, x)) != x:
            above[x] = above.get(up, up)
            x = up
        return x

    out = []
    for i, k in zip(*(x.tolist() for x in np.nonzero(similar)), strict=True):
        i, k = int(one[i]), int(other[k])
        x, y = top(int(root[i])), top(int(root[k]))
        if x != y:
            above[max(x, y)] = min(x, y)
            out.append((int(node[i]), int(node[k])))
    return out


def drop_similar(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the rows that chains of links lead to a smaller id: one document of each group stays (rows without an id
    do). Upper-case A-Z count as lower case, null texts as empty; texts without words are copies of each other, and texts
    of fewer than five words have one shingle. A text is known by its 64-bit hash, so rows that share an id are decided each
    by its own text."""
    plain, at = numbered_columns(docs)
    text = lower_ascii(whole(F.col(at[text_col])))
    texts = plain.select(F.xxhash64(text).alias("_node"), F.col(at[id_col]).alias("_id"), text.alias("_text"))
    sketches = shared_table(_sketches(texts), "sketches")
    roots = connected_components(similar_links(texts, _once(sketches, "sketches")))
    rooted = sketches.select("_node", "_id").join(roots, F.col("_node") == F.col("node"), "left").select("_node", "_id", F.coalesce("root", "_node").alias("_root"))
    rooted = shared_table(rooted, "rooted")
    least = rooted.groupBy("_root").agg(F.min("_id").alias("_least")).select(F.col("_root").alias("_r"), "_least")
    gone = rooted.join(least, F.col("_root") == F.col("_r")).filter("_id > _least").select("_node", "_id").distinct()
    # rows whose id cannot be among those that go pass straight through
    gone = shared_table(gone, "gone")
    tested = _perhaps(plain, F.col(at[id_col]), gone.select("_id"))
    asked = tested.filter("_maybe").join(gone, (F.col(at[id_col]) == F.col("_id")) & (F.xxhash64(text) == F.col("_node")), "left_anti")
    return named_columns(tested.filter("not _maybe").unionByName(asked), at)
