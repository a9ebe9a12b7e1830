"""Removal of repeated 100-byte strings by suffix arrays over aligned blocks.

A string of `length` bytes is removed wherever it starts later than somewhere else. To compare only what can be equal, every
string is dealt to its anchor: of its k-byte grams the one with the least hash, leftmost of equals. Equal strings have equal
anchors in equal places, so strings need comparing only within the class of an anchor, and only at the same offset from it.

Consecutive strings of a text with one anchor are a piece. Equal pieces of a class collapse to the earliest one (before
the shuffle within a batch, after it within the class): all others repeat it. Classes that are left with several
different pieces are compared by a suffix array: the pieces are cut into 8-byte blocks on a grid that hangs on the anchor, a
task's pieces are one sequence of block symbols, and linear grouping sorts its suffixes. Equal strings share the block
interval that the suffix array gives them, and the few bytes before its first and behind its last block.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefforge.functions.tables import bounded_batches, shared_buckets, shared_table
from prefforge.llm.suffix_order import suffix_order
from prefforge.llm.textops import whole

#: Bytes of a string, of an anchor's gram, and of a block.
LENGTH = 100
GRAM = 32
BLOCK = 8
#: Bytes of a text that are scanned together (parts overlap by a string), of text for each class bucket, and pieces of one
#: class from which its strings are dealt to finer classes.
PART = 4 << 20
BUCKET_BYTES = 24 << 20
HOT_PIECES = 2_000
#: Pieces that one suffix array holds.
TASK_PIECES = 6_000

_MIX = np.uint64(0xBF58476D1CE4E5B9)
_BASE = 0x9E3779B97F4A7C15
_VALUE = np.random.default_rng(100).integers(1, 1 << 63, 256, dtype=np.uint64)
_POWERS: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """base ** i modulo 2**64 for i below n."""
    have = _POWERS.get(base)
    if have is None or len(have) < n:
        size = max(1 << 16, 1 << (n - 1).bit_length())
        have = np.ones(size, np.uint64)
        k = 1
        while k < size:
            have[k : 2 * k] = have[:k] * np.uint64(pow(base, k, 1 << 64))
            k *= 2
        _POWERS[base] = have
    return have[:n]


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(31)) * _MIX
    return h ^ h >> np.uint64(29)


def pieces_of(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(class, piece, anchor, first, last) of each piece of one text: hashes of the anchor's gram and of the piece, where the
    anchor stands, and the starts of the piece's first and last string."""
    found = []
    for base in range(0, len(raw) - length + 1, PART):
        part = raw[base : base + PART + length - 1]
        n, wide = len(part), length - gram + 1
        along = np.zeros(n + 1, np.uint64)
        np.cumsum(_VALUE[part] * _powers(_BASE, n), out=along[1:])
        back = _powers(pow(_BASE, -1, 1 << 64), n)
        grams = _stir((along[gram:] - along[:-gram]) * back[: n - gram + 1])
        # hash and place in one number: the least is the least hash, leftmost of equals
        key = (grams >> np.uint64(23) << np.uint64(23)) | np.arange(len(grams), dtype=np.uint64)
        step = 1
        while 2 * step <= wide:
            key = np.minimum(key[:-step], key[step:])
            step *= 2
        if wide > step:
            key = np.minimum(key[: len(key) - (wide - step)], key[wide - step :])
        anchor = (key & np.uint64((1 << 23) - 1)).astype(np.int64)
        cut = np.flatnonzero(np.diff(anchor)) + 1
        first, last = np.concatenate([[0], cut]), np.concatenate([cut, [len(anchor)]]) - 1
        x = anchor[first]
        inside = _stir((along[last + length] - along[first]) * back[first] + (last - first).astype(np.uint64) * _VALUE[1] + (x - first).astype(np.uint64) * _VALUE[2])
        found.append((grams[x], inside, x + base, first + base, last + base))
    if not found:
        return tuple(np.empty(0, t) for t in (np.uint64, np.uint64, np.int64, np.int64, np.int64))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


#: One piece as it travels to its class: class, piece, anchor, text, and how far before the anchor its first and its last
#: string start.
_PIECE = np.dtype([("h", "<u8"), ("v", "<u8"), ("x", "<u4"), ("t", "<u4"), ("a", "u1"), ("c", "u1")])


def _by_piece(h: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places by class and piece, equal ones in the order in which they come; whether each is the first of its piece)."""
    by = np.argsort(h ^ v * _MIX, kind="stable")
    first = np.ones(len(by), bool)
    first[1:] = (h[by][1:] != h[by][:-1]) | (v[by][1:] != v[by][:-1])
    return by, first


def _split(values: np.ndarray) -> list[tuple[int, np.ndarray]]:
    """(value, places) of each value."""
    if not len(values):
        return []
    # small numbers are sorted by radix
    by = np.argsort(values.astype(np.uint16) if 0 <= values.min() and values.max() < 1 << 16 else values, kind="stable")
    line = values[by]
    at = np.flatnonzero(line[1:] != line[:-1]) + 1
    return list(zip(line[np.append(0, at)].tolist(), np.split(by, at), strict=True))


def _scan(buckets: int, length: int, gram: int):
    """Pieces of the texts of a batch by bucket of their class, and (without docs) runs that repeat within the batch."""

    def run(batches):
        for batch in batches:
            rows = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            ids = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64)
            parts, texts = [], batch.column(2).cast(pa.binary()).to_pylist()
            for i in np.lexsort([rows, ids]).tolist():  # so that of equal pieces the earliest comes first
                text = texts[i]
                if len(text) >= length:
                    h, v, x, first, last = pieces_of(np.frombuffer(text, np.uint8), length, gram)
                    piece = np.empty(len(h), _PIECE)
                    piece["h"], piece["v"], piece["x"], piece["t"], piece["a"], piece["c"] = h, v, x, i, x - first, x - last
                    parts.append(piece)
            if not parts:
                continue
            piece = np.concatenate(parts)
            del parts, texts
            by, first = _by_piece(piece["h"], piece["v"])
            out = [(int(rows[i]) % buckets, int(rows[i]), _runs(piece[by[~first]][g]), b"") for i, g in _split(piece["t"][by[~first]])]
            piece = piece[by[first]]
            for k, g in _split((piece["h"] >> np.uint64(8)) % np.uint64(buckets)):
                own = piece[g]
                used, where = np.unique(own["t"], return_inverse=True)
                own["t"] = where
                # column by column, which shortens when it is compressed
                blob = b"".join(np.ascontiguousarray(own[f]).tobytes() for f in _PIECE.names)
                out.append((int(k), -1, blob, np.stack([ids[used], rows[used]]).astype("<i8").tobytes()))
            for s in range(0, len(out), 500):
                columns = zip(*out[s : s + 500], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, (pa.int32(), pa.int64(), pa.binary(), pa.binary()), strict=True)], ["bucket", "row", "blob", "docs"])

    return run


def _runs(piece: np.ndarray) -> bytes:
    """Pairs of first and last start of the strings of some pieces."""
    x = piece["x"].astype(np.int64)
    return np.stack([x - piece["a"], x - piece["c"]], axis=1).astype("<i8").tobytes()


def _unpack(blob: bytes) -> np.ndarray:
    n = len(blob) // _PIECE.itemsize
    out, at = np.empty(n, _PIECE), 0
    for f in _PIECE.names:
        out[f] = np.frombuffer(blob, _PIECE[f], n, at)
        at += n * _PIECE[f].itemsize
    return out


_CLASSES = "row long, runs binary, class long, order long, x long, a int, c int, hot boolean"


def _classes(key, pdf: pd.DataFrame) -> pd.DataFrame:
    """Of a bucket: runs that repeat a whole piece, and the pieces of classes that are left with several of them."""
    local = pdf[pdf["row"] >= 0]
    found = [(int(r), b, None, None, None, None, None, None) for r, b in zip(local["row"], local["blob"], strict=True)]
    sent = pdf[pdf["row"] < 0]
    if len(sent):
        parts, docs, base = [], [], 0
        for blob, d in zip(sent["blob"], sent["docs"], strict=True):
            piece, own = _unpack(blob), np.frombuffer(d, "<i8").reshape(2, -1)
            piece["t"] += base
            base += own.shape[1]
            parts.append(piece)
            docs.append(own)
        piece, (ids, rows) = np.concatenate(parts), np.concatenate(docs, axis=1)
        del parts
        # a class that is met once has nothing to compare
        h = np.sort(piece["h"])
        met = np.unique(h[1:][h[1:] == h[:-1]])
        piece = piece[met[np.minimum(np.searchsorted(met, piece["h"]), len(met) - 1)] == piece["h"]] if len(met) else piece[:0]
        t = piece["t"]
        piece = piece[np.lexsort([piece["x"], rows[t], ids[t]])]
        t = piece["t"]
        by, first = _by_piece(piece["h"], piece["v"])
        again = piece[by[~first]]
        found += [(r, _runs(again[g]), None, None, None, None, None, None) for r, g in _split(rows[again["t"]])]
        left = piece[by[first]]
        _, where, count = np.unique(left["h"], return_inverse=True, return_counts=True)
        for p, n in zip(left[count[where] > 1], count[where][count[where] > 1].tolist(), strict=True):
            found.append((int(rows[p["t"]]), None, int(p["h"].astype(np.int64)), int(ids[p["t"]]), int(p["x"]), int(p["a"]), int(p["c"]), n > HOT_PIECES))
    names = ["row", "runs", "class", "order", "x", "a", "c", "hot"]
    out = pd.DataFrame(found, columns=names, dtype=object)
    for c in ("class", "order", "x", "a", "c"):
        out[c] = out[c].astype("Int64")
    return out.astype({"row": "int64", "hot": "boolean"})


_PIECES = "row long, runs binary, class long, order long, x long, a int, c int, bytes binary"


def _extract(length: int, gram: int):
    """The bytes of wanted pieces. A piece of a hot class is dealt to two finer ones: strings that start well before the
    anchor go by the bytes in front of it, all others by the bytes behind it; of equal ones of a batch the earliest."""
    half = (length - gram) // 2

    def run(batches):
        for batch in batches:
            out, hot = [], {}
            for row, order, text, want in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()).to_pylist(), batch.column(3).to_pylist(), strict=True):
                for w in want:
                    x, a, c = w["x"], w["a"], w["c"]
                    if not w["hot"]:
                        out.append((row, None, w["class"], order, x, a, c, text[x - a : x - c + length]))
                        continue
                    sides = [(a, max(c, half), text[max(0, x - half) : x + gram] + b"<"), (min(a, half - 1), c, text[x : x + length - half + 1] + b">")]
                    for a_, c_, near in sides:
                        if a_ >= c_:
                            finer = int.from_bytes(hashlib.blake2b(near, digest_size=8).digest(), "little", signed=True)
                            hot.setdefault((finer, a_, c_, text[x - a_ : x - c_ + length]), []).append((order, row, x))
            for (finer, a, c, t), places in hot.items():
                places.sort()
                order, row, x = places[0]
                out.append((row, None, finer, order, x, a, c, t))
                out += [(row, np.array([x - a, x - c], "<i8").tobytes(), None, None, None, None, None, None) for order, row, x in places[1:]]
            if out:
                kinds = (pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(zip(*out, strict=True), kinds, strict=True)], ["row", "runs", "class", "order", "x", "a", "c", "bytes"])

    return run


def _cells(width: int, length: int):
    """The strings of some pieces in cells of `width` neighbouring offsets from the anchor: each is a piece of a class of its own,
    that of the bytes which all strings of the cell have."""

    def run(batches):
        for batch in batches:
            out = []
            for row, order, x, a, c, raw in zip(*[batch.column(k).to_pylist() for k in ("row", "order", "x", "a", "c", "bytes")], strict=True):
                for cell in range(c // width, a // width + 1):
                    a_, c_ = min(a, (cell + 1) * width - 1), max(c, cell * width)
                    # all strings of the whole cell have these bytes; a piece that has not all of the cell has them as well
                    begin, end = a - (cell * width), a - ((cell + 1) * width - 1) + length
                    near = raw[max(begin, 0) : min(end, len(raw))]
                    finer = hashlib.blake2b(near, digest_size=8, salt=cell.to_bytes(4, "little"), person=width.to_bytes(4, "little")).digest()
                    out.append((row, int.from_bytes(finer, "little", signed=True), order, x, a_, c_, raw[a - a_ : a - c_ + length]))
            for at in range(0, len(out), 20_000):
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary())
                columns = zip(*out[at : at + 20_000], strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(columns, kinds, strict=True)], ["row", "class", "order", "x", "a", "c", "bytes"])

    return run


def _as_runs(batches):
    """(row, x, a, c) -> (row, runs)."""
    for batch in batches:
        x, a, c = (batch.column(k).to_numpy(zero_copy_only=False).astype("<i8") for k in ("x", "a", "c"))
        pairs = np.stack([x - a, x - c], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([p.tobytes() for p in pairs], pa.binary())], ["row", "runs"])


def redealt(pieces: DataFrame, length: int, most: int) -> tuple[DataFrame, DataFrame]:
    """(row, class, order, x, a, c, bytes) -> (such pieces, of which no class has more than `most`, (row, runs) of repeated ones).

    Classes of more pieces, as of a passage that many documents have in other surroundings each, are dealt to finer ones by
    ever longer context: cells of 32, 16, ... and at last one offset, whose strings share all but as many bytes. Equal
    pieces of a class collapse to the earliest at each step, and classes of one piece are done, so that the last step, in
    which a class is one string, leaves none.
    """
    spark = pieces.sparkSession
    names = ["row", "class", "order", "x", "a", "c", "bytes"]
    pieces, runs = pieces.select(*names), spark.createDataFrame([], "row long, runs binary")
    for width in (32, 16, 8, 4, 2, 1):
        large = shared_table(pieces.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("class"), "large-classes")
        if large.isEmpty():
            break
        hot = pieces.join(large, "class", "left_semi").select(*names)
        finer = shared_table(hot.mapInArrow(_cells(width, length), "row long, class long, order long, x long, a int, c int, bytes binary"), "finer-pieces")
        # of equal pieces the earliest goes on; those of a class with several different ones only
        first = finer.groupBy("class", "a", "c", "bytes").agg(F.min(F.struct("order", "row", "x")).alias("f"))
        first = shared_table(first, "first-pieces")
        same = first.select(F.col("class").alias("k"), F.col("a").alias("ka"), F.col("c").alias("kc"), F.col("bytes").alias("kb"), "f")
        again = finer.join(same, (F.col("class") == F.col("k")) & (F.col("a") == F.col("ka")) & (F.col("c") == F.col("kc")) & (F.col("bytes") == F.col("kb")))
        again = again.filter(F.struct("order", "row", "x") != F.col("f")).select("row", "x", "a", "c")
        runs = runs.unionByName(shared_table(again.mapInArrow(_as_runs, "row long, runs binary"), "finer-runs"))
        several = first.groupBy("class").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("class")
        left = first.join(several, "class", "left_semi").select(F.col("f.row").alias("row"), "class", F.col("f.order").alias("order"), F.col("f.x").alias("x"), "a", "c", "bytes")
        pieces = shared_table(pieces.join(large, "class", "left_anti").select(*names).unionByName(left), "redealt-pieces")
    return pieces, runs


def repeated_strings(a: np.ndarray, c: np.ndarray, parts: list[bytes], order: list[np.ndarray], x: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray]:
    """(piece, start) of each string of some pieces that an earlier one equals. order: arrays that order the pieces' texts,
    the least significant first; x: where the anchors stand; a, c: how far before them the first and last strings start."""
    # every piece in a line of its own, with the anchor at column `zero`
    zero = (int(a.max()) // BLOCK + 1) * BLOCK
    width = zero + (length // BLOCK + 1) * BLOCK
    lines = np.zeros((len(parts), width), np.uint8)
    for i, t in enumerate(parts):
        s = zero - int(a[i])
        lines[i, s : s + len(t)] = np.frombuffer(t, np.uint8)
    blocks = lines.view("<u8")
    mid = zero // BLOCK
    # whole blocks of each piece, and one place between pieces
    low, high = mid - a // BLOCK, mid + (length - c) // BLOCK
    count = high - low
    base = np.concatenate([[0], np.cumsum(count + 1)])[:-1]
    n = int((count + 1).sum())
    column = np.arange(n) - np.repeat(base, count + 1) + np.repeat(low, count + 1)
    line = np.repeat(np.arange(len(parts)), count + 1)
    between = column == np.repeat(high, count + 1)
    symbols = np.ones(n, np.int64)
    symbols[~between] = np.unique(blocks[line[~between], column[~between]], return_inverse=True)[1] + 2
    order_of = suffix_order(symbols)
    # no block interval reaches over the end of a piece
    alone = symbols.copy()
    alone[between] = -np.arange(1, between.sum() + 1)
    alone = np.concatenate([alone, -n - 1 - np.arange(length // BLOCK + 1)])
    span = a - c + 1
    piece = np.repeat(np.arange(len(parts)), span)
    o = np.repeat(a, span) - (np.arange(int(span.sum())) - np.repeat(np.cumsum(span) - span, span))
    begin, end = mid - o // BLOCK, mid + (length - o) // BLOCK
    at = base[piece] + begin - low[piece]
    interval = np.zeros(len(o), np.int64)
    for k in np.unique(end - begin):
        same = np.ones(len(order_of) - 1, bool)
        for j in range(int(k)):
            row = alone[order_of + j]
            same &= row[1:] == row[:-1]
        ids = np.empty(n, np.int64)
        ids[order_of] = np.cumsum(np.append(True, ~same))
        own = end - begin == k
        interval[own] = ids[at[own]]
    # the bytes before the first block and behind the last one
    before, behind = (o % BLOCK).astype(np.uint64), ((length - o) % BLOCK).astype(np.uint64)
    eight, one = np.uint64(8), np.uint64(1)
    left = np.where(before > 0, blocks[piece, begin - 1] >> (eight * (np.uint64(BLOCK) - np.maximum(before, one))), np.uint64(0))
    right = np.where(behind > 0, blocks[piece, np.minimum(end, width // BLOCK - 1)] & ((one << (eight * behind)) - one), np.uint64(0))
    start = x[piece] - o
    keys = [right, left, interval, o]
    by = np.lexsort([start, *[v[piece] for v in order], *keys])
    first = np.ones(len(by), bool)
    first[1:] = np.any([k[by][1:] != k[by][:-1] for k in keys], axis=0)
    again = by[~first]
    return piece[again], start[again]


def _compare(length: int):
    """Runs of repeated strings among the pieces of some classes."""

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf["row"].to_numpy(np.int64)
        piece, start = repeated_strings(pdf["a"].to_numpy(np.int64), pdf["c"].to_numpy(np.int64), list(pdf["bytes"]), [rows, pdf["order"].to_numpy(np.int64)], pdf["x"].to_numpy(np.int64), length)
        out = []
        for row, g in _split(rows[piece]):
            s = np.unique(start[g])
            cut = np.flatnonzero(np.diff(s) > 1) + 1
            lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(s)]]) - 1
            out.append((row, np.stack([s[lo], s[hi]], axis=1).astype("<i8").tobytes()))
        return pd.DataFrame(out, columns=["row", "runs"]).astype({"row": "int64"})

    return run


def removed_spans(runs: list[bytes] | None, n: int, length: int = LENGTH) -> list[tuple[int, int]]:
    """Maximal removed spans (start, end) of a text of n bytes from runs of repeated strings."""
    if not runs:
        return []
    pairs = np.frombuffer(b"".join(runs), "<i8").reshape(-1, 2)
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    start, end = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + length)
    new = np.append(True, start[1:] > end[:-1])
    return list(zip(start[new].tolist(), end[np.append(new[1:], True)].tolist(), strict=True))


def _apply(length: int):
    """Digests of what is left of each text."""

    def run(batches):
        for batch in batches:
            cols = [[], [], [], []]
            for text, runs in zip(batch.column(1).cast(pa.binary()).to_pylist(), batch.column(2).to_pylist(), strict=True):
                spans = removed_spans(runs, len(text), length)
                left, at = hashlib.sha256(), 0
                for s, e in spans:
                    left.update(text[at:s])
                    at = e
                left.update(text[at:])
                for c, value in zip(cols, (len(text), sum(e - s for s, e in spans), len(spans), left.hexdigest()), strict=True):
                    c.append(value)
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], ["_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return run


def suffix_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM) -> DataFrame:
    """id, n_bytes, n_removed, n_spans, kept_sha256 of each row of docs.

    Texts are ordered by id (rows without an id come last, rows with equal ids as they were numbered). A null text counts
    as empty; texts shorter than a string keep all bytes. Of repeated rows all but one lose what strings cover. An empty
    table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    last = (1 << 63) - 1
    # one copy of the texts, dealt by row number: both joins below find it in place
    numbered = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{id_col}`").cast("long"), F.lit(last)).alias("_order"), F.monotonically_increasing_id().alias("_row"), whole(F.col(f"`{text_col}`")).alias("_text"))
    texts = shared_buckets(numbered, "texts", "_row")
    n_bytes = texts.agg(F.sum(F.octet_length("_text"))).first()[0] or 0
    parts = texts.select("_row", "_order", "_text").mapInArrow(_scan(max(1, -(-n_bytes // BUCKET_BYTES)), length, gram), "bucket int, row long, blob binary, docs binary")
    classes = shared_table(parts.groupBy("bucket").applyInPandas(_classes, _CLASSES), "suffix-classes")
    want = classes.filter("class is not null").groupBy("row").agg(F.collect_list(F.struct("class", "x", "a", "c", "hot")).alias("want"))
    wanted = texts.join(want, texts["_row"] == want["row"]).select("_row", "_order", "_text", "want")
    pieces = shared_table(wanted.mapInArrow(_extract(length, gram), _PIECES), "suffix-pieces")
    compared, finer_runs = redealt(pieces.filter("class is not null"), length, TASK_PIECES)
    tasks = max(1, -(-compared.count() // TASK_PIECES))
    repeats = shared_table(compared.groupBy(F.pmod(F.xxhash64("class"), F.lit(tasks))).applyInPandas(_compare(length), "row long, runs binary"), "suffix-repeats")
    runs = classes.filter("runs is not null").select("row", "runs").unionByName(pieces.filter("runs is not null").select("row", "runs")).unionByName(repeats).unionByName(finer_runs)
    by_row = runs.groupBy("row").agg(F.collect_list("runs").alias("runs"))
    marked = texts.join(by_row, texts["_row"] == by_row["row"], "left").select("_id", "_text", "runs")
    kind = docs.schema[id_col].dataType.simpleString()
    return marked.mapInArrow(_apply(length), f"_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string").withColumnRenamed("_id", id_col)
