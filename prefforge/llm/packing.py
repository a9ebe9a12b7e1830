"""Hierarchical packing of documents' token ids into context windows of several sizes.

A document's ids (with an end id) first fill windows of the longest size by themselves. What is left of it is routed to the
tier of the shortest window that holds it. Tiers are packed from the longest to the shortest: each document opens a window,
and the gap behind it is filled from shorter tiers, always by the longest part that fits; where none fits, the longest one
of the shorter tiers is cut. So windows are full, and what the last window of a pool lacks is cut into windows of powers of
two: nothing is padded. The windows of a tier are dealt to step groups of an equal number of ids, in turn and back by their
attention cost (the squares of the parts' lengths), so that steps take about equally long.

A task packs its own rows in pools of a bounded number of ids: ids are made once and do not move, and no task waits for
others. A long document takes windows of its own, so that neither a source nor a length makes one task large.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefforge.functions.tables import bounded_batches
from prefforge.llm.textops import whole
from prefforge.llm.vocab import ByteLevel, in_worker

#: Window sizes of the tiers; ids of a pool, of a step group and of a batch of results; the id that ends a document.
TIERS = (256, 512, 1024, 2048)
POOL_IDS = 1 << 22
STEP_IDS = 64 * 2048
BATCH_IDS = 1 << 20
END_ID = 1

#: A part of a document: its number, where it starts in the document, and its length.
Part = tuple[int, int, int]


class _Waiting:
    """Parts by their length. Bit n of `lengths` is set if there is one of length n."""

    def __init__(self, most: int):
        self.parts: list[list[Part]] = [[] for _ in range(most + 1)]
        self.lengths = 0

    def put(self, part: Part) -> None:
        self.parts[part[2]].append(part)
        self.lengths |= 1 << part[2]

    def longest(self, most: int) -> int:
        """The greatest length up to `most`, or 0."""
        return (self.lengths & ((1 << most + 1) - 1)).bit_length() - 1 if self.lengths & ((1 << most + 1) - 1) else 0

    def take(self, length: int) -> Part:
        own = self.parts[length]
        part = own.pop()
        if not own:
            self.lengths ^= 1 << length
        return part


def pack_lengths(lengths: list[int], tiers: tuple[int, ...] = TIERS) -> Iterator[tuple[int, list[Part]]]:
    """(size, parts) of each window for documents of these lengths (1 at least). Every window is full."""
    most = tiers[-1]
    waiting = _Waiting(most)
    for doc, n in enumerate(lengths):
        start = 0
        while n - start > most:
            yield most, [(doc, start, most)]
            start += most
        waiting.put((doc, start, n - start))
    for below, tier in list(zip((0, *tiers), tiers, strict=False))[::-1]:
        while (n := waiting.longest(tier)) > below:
            window, gap = [waiting.take(n)], tier - n
            while gap and waiting.lengths:
                if n := waiting.longest(gap):
                    window.append(waiting.take(n))
                    gap -= n
                else:
                    doc, start, n = waiting.take(waiting.longest(below) or waiting.longest(tier))
                    window.append((doc, start, gap))
                    waiting.put((doc, start + gap, n - gap))
                    gap = 0
            if gap:
                yield from _powers(window, tier - gap)
            else:
                yield tier, window


def _powers(parts: list[Part], total: int) -> Iterator[tuple[int, list[Part]]]:
    """Windows of different powers of two that hold the parts."""
    parts = parts[::-1]
    for size in (1 << b for b in range(total.bit_length() - 1, -1, -1) if total >> b & 1):
        window, gap = [], size
        while gap:
            doc, start, n = parts.pop()
            window.append((doc, start, min(n, gap)))
            if n > gap:
                parts.append((doc, start + gap, n - gap))
            gap -= min(n, gap)
        yield size, window


def step_groups(windows: list[tuple[int, list[Part]]], step_ids: int = STEP_IDS) -> np.ndarray:
    """The group of each window: windows of one size, in turn and back by falling cost, to groups of at most step_ids."""
    size = np.array([s for s, _ in windows])
    cost = np.array([sum(n * n for _, _, n in parts) for _, parts in windows])
    group, made = np.zeros(len(windows), np.int64), 0
    for s in np.unique(size):
        own = np.flatnonzero(size == s)
        own = own[np.argsort(-cost[own], kind="stable")]
        groups = -(-len(own) * int(s) // step_ids)
        lap, at = np.divmod(np.arange(len(own)), groups)
        group[own] = made + np.where(lap % 2 == 0, at, groups - 1 - at)
        made += groups
    return group


def pack(docs: DataFrame, tokenizer: bytes, id_col: str = "doc_id", text_col: str = "text", pool_ids: int = POOL_IDS) -> DataFrame:
    """One row for each part: id, start, length, ids (binary, little-endian unsigned 32-bit), doc_tokens, sequence_id, offset,
    window_size and step_group. tokenizer: the bytes of a byte-level `tokenizers` file.

    Null and empty texts are the end id alone. Rows are documents each, also those that repeat an id. A document's parts are
    together all of its ids, once; a sequence's parts lie without gaps from 0 to window_size. Columns other than id and text
    are not carried. An empty table gives no rows. Results depend on how the table is split into tasks, and a task that is
    run again on its split gives the same.
    """
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(tokenizer)  # a vocabulary file
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), whole(F.col(f"`{text_col}`")).alias("_text"))
    kind = rows.schema["_id"].dataType.simpleString()

    def run(batches):
        model = in_worker(ByteLevel, shared.value)
        base = TaskContext.get().partitionId() << 32
        sequences = groups = 0
        for names, ids in _pools(batches, model, pool_ids):
            windows = list(pack_lengths([len(x) for x in ids]))
            group = step_groups(windows)
            yield from _batches(names, ids, windows, base + sequences, base + groups + group)
            sequences += len(windows)
            groups += int(group.max()) + 1

    fields = f"_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, window_size int, step_group long"
    return rows.mapInArrow(run, fields).withColumnRenamed("_id", id_col)


def _pools(batches, model: ByteLevel, pool_ids: int) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids of the documents, token ids of each) of about pool_ids token ids together."""
    names, found, size = [], [], 0
    end = np.array([END_ID], "<u4")
    for batch in batches:
        done = 0
        for n, text in enumerate(batch.column(1)):
            found.append(np.concatenate([model.encode(text.as_py(), special=True).astype("<u4"), end]))
            size += len(found[-1])
            if size >= pool_ids:
                names.append(batch.column(0)[done : n + 1])
                yield pa.concat_arrays(names), found
                names, found, size, done = [], [], 0, n + 1
        names.append(batch.column(0)[done:])
    if found:
        yield pa.concat_arrays(names), found


def _batches(names: pa.Array, ids: list[np.ndarray], windows: list[tuple[int, list[Part]]], first: int, group: np.ndarray) -> Iterator[pa.RecordBatch]:
    """The windows' parts as rows, about BATCH_IDS ids in a batch."""
    at, size = 0, np.cumsum([s for s, _ in windows])
    while at < len(windows):
        end = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + BATCH_IDS, side="right")))
        parts = [(doc, start, n, w, s) for w in range(at, end) for s in [windows[w][0]] for doc, start, n in windows[w][1]]
        doc, start, n, window, tier = (np.array(x, np.int64) for x in zip(*parts, strict=True))
        ends = np.cumsum(n)
        offset = ends - n - np.repeat((ends - n)[np.unique(window, return_index=True)[1]], np.unique(window, return_counts=True)[1])
        raw = pa.array([ids[d][s : s + k].tobytes() for d, s, k, _, _ in parts], pa.binary())
        total = np.array([len(x) for x in ids], np.int64)[doc]
        cols = [names.take(pa.array(doc)), pa.array(start), pa.array(n), raw, pa.array(total), pa.array(first + window), pa.array(offset), pa.array(tier.astype(np.int32)), pa.array(group[window])]
        yield pa.RecordBatch.from_arrays(cols, ["_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "window_size", "step_group"])
        at = end
