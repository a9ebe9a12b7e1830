"""Byte-level BPE encoding and decoding by merge replay over a corpus of words.

A task gathers the distinct words of its texts and replays the merges over all of them together: an inverted index leads
from each token pair to the places where it stands, merges are applied in rank order, and each application touches only
the two neighbours of the merged pair. Texts are then put together from their words.
"""

from __future__ import annotations

import base64
import hashlib
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefforge.functions.tables import bounded_batches, releasing
from prefforge.llm.textops import whole

#: Distinct words that a Python worker keeps encoded; beyond that it starts anew.
CACHE_WORDS = 120_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of lines `base64 rank`."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class MergeReplay:
    """Encodes many words at once. A pair of tokens a, b is known by the number a << 20 | b."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.text = {r: str(r) for r in self.token}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)])
        #: every pair of tokens that together are a token, and that token's rank
        self.pairs = {}
        for t, r in ranks.items():
            for cut in range(1, len(t)):
                a, b = ranks.get(t[:cut]), ranks.get(t[cut:])
                if a is not None and b is not None:
                    self.pairs[a << 20 | b] = r
        self.byte_pairs = np.full((256, 256), -1)
        for x in range(256):
            for y in range(256):
                self.byte_pairs[x, y] = ranks.get(bytes([x, y]), -1)

        self._keys = np.array(sorted(self.pairs))
        self._made = np.array([self.pairs[k] for k in self._keys.tolist()])

    def made_by(self, keys: np.ndarray) -> np.ndarray:
        """Rank of the token that each pair makes, or -1."""
        at = np.minimum(self._keys.searchsorted(keys), len(self._keys) - 1)
        return np.where(self._keys[at] == keys, self._made[at], -1)

    def encode(self, words: list[bytes]) -> list[list[int]]:
        """The ids of each word. A word that is a token is that token, as in tiktoken."""
        ranks = self.ranks
        out: list[list[int] | None] = [[r] if (r := ranks.get(w)) is not None else None for w in words]
        todo = [n for n, ids in enumerate(out) if ids is None]
        if not todo:
            return out
        # all words one after another, each with a place of -1 behind it
        lengths = np.fromiter((len(words[n]) for n in todo), np.int64, len(todo))
        raw = np.frombuffer(b"\0".join([words[n] for n in todo]) + b"\0", np.uint8)
        ends = np.cumsum(lengths + 1) - 1
        first = self.byte[raw]
        first[ends] = -1
        made = np.append(self.byte_pairs[raw[:-1], raw[1:]], -1)
        made[ends] = -1
        made[ends - 1] = -1
        # the index: by the rank that merging gives, the places of its pairs' left tokens, with the pairs
        tok = first
        after = np.arange(1, len(tok) + 1)
        before = np.arange(-1, len(tok) - 1)
        index: dict[int, list] = {}
        queue: list[int] = []

        def note(places: np.ndarray, keys: np.ndarray, made: np.ndarray) -> None:
            """Put pairs that are tokens into the index."""
            if len(made) == 1:
                groups = [(int(made[0]), places, keys)]
            else:
                order = made.argsort(kind="stable")
                made, places, keys = made[order], places[order], keys[order]
                cuts = [0, *(np.flatnonzero(made[1:] != made[:-1]) + 1).tolist(), len(made)]
                groups = [(int(made[x]), places[x:y], keys[x:y]) for x, y in zip(cuts[:-1], cuts[1:], strict=True)]
            for x, p, k in groups:
                if x in index:
                    index[x].append((p, k))
                else:
                    index[x] = [(p, k)]
                    heappush(queue, x)

        own = np.flatnonzero(made >= 0)
        if len(own):
            note(own, first[own] << 20 | first[own + 1], made[own])
        marked = np.zeros(len(tok) + 1, bool)
        odd: list[np.ndarray] = []  # places in words that a merge at a time has to encode
        while queue:
            r = heappop(queue)
            found = index.pop(r)
            if len(found) == 1:
                here, keys = found[0]
            else:
                here, keys = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
            there = after[here]
            fits = (tok[here] << 20 | tok[there]) == keys  # places merged meanwhile hold negative numbers
            if not fits.all():
                here, there = here[fits], there[fits]
            if not len(here):
                continue
            if len(found) > 1:
                here = np.unique(here)
                there = after[here]
            marked[here] = True
            if (lap := marked[there]).any():  # as in aaa: one token cannot be in two pairs
                odd.append(here[lap])
            behind = after[there]
            old = tok[behind]
            close = marked[behind]
            marked[here] = False
            tok[here], tok[there] = r, -2
            after[here], before[behind] = behind, here
            # between two merges that follow each other stands, for a moment, a pair that may come earlier still
            if close.any() and (self.made_by(r << 20 | old[close]) >= 0).any():
                x = self.made_by(r << 20 | old[close])
                odd.append(here[close][(x >= 0) & (x <= r)])
            front = before[here]
            b, a = tok[behind], np.where(front >= 0, tok[front], -1)
            right, left = b >= 0, (a >= 0) & (a != r)  # a pair of two merged tokens is seen from its left one
            places = np.concatenate([here[right], front[left]])
            keys = np.concatenate([r << 20 | b[right], a[left] << 20 | r])
            x = self.made_by(keys)
            if (early := (x >= 0) & (x <= r)).any():
                odd.append(places[early])
            if (later := x > r).any():
                note(places[later], keys[later], x[later])
        ids = tok[tok >= 0].tolist()
        last = np.cumsum(tok >= 0)[ends].tolist()
        at = 0
        for n, end in zip(todo, last, strict=True):
            out[n] = ids[at:end]
            at = end
        for n in np.unique(np.searchsorted(ends, np.concatenate(odd))).tolist() if odd else []:
            out[todo[n]] = self.encode_alone(words[todo[n]])
        return out

    def encode_alone(self, word: bytes) -> list[int]:
        """One word, one merge at a time: the lowest rank first, leftmost first. Pairs wait in a heap, and tokens know their
        neighbours, so n bytes take n log n steps."""
        ids = [int(self.byte[x]) for x in word]
        n = len(ids)
        pairs = self.pairs
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        waiting = [(r, i) for i in range(n - 1) if (r := pairs.get(ids[i] << 20 | ids[i + 1])) is not None]
        heapify(waiting)
        while waiting:
            r, i = heappop(waiting)
            j = after[i]
            # a pair whose tokens were merged meanwhile is no more
            if ids[i] < 0 or j >= n or pairs.get(ids[i] << 20 | ids[j]) != r:
                continue
            ids[i], ids[j] = r, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (x := pairs.get(r << 20 | ids[k])) is not None:
                    heappush(waiting, (x, i))
            if (k := before[i]) >= 0 and (x := pairs.get(ids[k] << 20 | r)) is not None:
                heappush(waiting, (x, k))
        return [x for x in ids if x >= 0]


_STATE: dict[str, tuple] = {}


def _state(key: str, raw: dict[bytes, int]):
    """The replay and the words known so far, kept by the Python worker from task to task."""
    if key not in _STATE:
        _STATE.clear()
        _STATE[key] = (MergeReplay(raw), Known())
    return _STATE[key]



class Known:
    """Words known so far: their ids as text, and the bytes that their ids decode to."""

    def __init__(self):
        self.ids: dict[str, str] = {}
        self.raw: dict[str, bytes] = {}

    def learn(self, replay: MergeReplay, words: set[str]) -> None:
        fresh = [w for w in words if w not in self.ids]
        token, text = replay.token, replay.text
        for w, ids in zip(fresh, replay.encode([w.encode() for w in fresh]), strict=True):
            self.ids[w] = " ".join([text[i] for i in ids])
            self.raw[w] = b"".join([token[i] for i in ids])


def encode_texts(docs: DataFrame, ranks: dict[bytes, int], pattern: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False, carry: list[str] | None = None) -> DataFrame:
    """id, n_tokens, ids_sha256 and decoded_sha256 of each row; keep_ids adds ids (array) and decoded (text).

    A null or empty text has no tokens and the digests of nothing; rows are independent of each other, so repeated rows
    give repeated results. An empty table gives no rows.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    shared = spark.sparkContext.broadcast(ranks)  # a vocabulary file: its size does not depend on the input
    name = hashlib.sha256(b"".join(b"%d %d " % (r, len(t)) + t for t, r in sorted(ranks.items()))).hexdigest()
    extra = carry or []
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), whole(F.col(f"`{text_col}`")).alias("_text"), *[F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(extra)])
    fields = [f"_id {rows.schema['_id'].dataType.simpleString()}", "n_tokens long", "ids_sha256 string", "decoded_sha256 string"]
    fields += ["ids array<int>", "decoded string"] if keep_ids else []
    fields += [f"_c{i} {rows.schema[f'_c{i}'].dataType.simpleString()}" for i in range(len(extra))]

    def run(batches):
        replay, known = _state(name, shared.value)
        split = regex.compile(pattern).findall
        for batch in batches:
            n_tokens, ids_sha, decoded_sha, all_ids, decoded = [], [], [], [], []
            texts = batch.column(1).to_pylist()
            # words of some texts at a time, so that what is held stays small
            for chunk in _chunks(texts):
                words = [split(t) for t in chunk]
                if len(known.ids) > CACHE_WORDS:
                    known.ids.clear()
                    known.raw.clear()
                known.learn(replay, set().union(*words))
                for ws in words:
                    text = " ".join(map(known.ids.__getitem__, ws))
                    raw = b"".join(map(known.raw.__getitem__, ws))
                    n_tokens.append(text.count(" ") + 1 if text else 0)
                    ids_sha.append(hashlib.sha256(text.encode()).hexdigest())
                    decoded_sha.append(hashlib.sha256(raw).hexdigest())
                    if keep_ids:
                        all_ids.append([int(x) for x in text.split()])
                        decoded.append(raw.decode())
            cols = [batch.column(0), pa.array(n_tokens, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(decoded_sha, pa.string())]
            if keep_ids:
                cols += [pa.array(all_ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
            names = [x.split(" ", 1)[0] for x in fields]
            yield pa.RecordBatch.from_arrays([*cols, *batch.columns[2:]], names)

    out = rows.mapInArrow(releasing(run), ", ".join(fields))
    renamed = [F.col("_id").alias(id_col)] + [F.col(c) for c in out.columns if c != "_id" and not c.startswith("_c")]
    return out.select(*renamed, *[F.col(f"_c{i}").alias(c) for i, c in enumerate(extra)])


def _chunks(texts: list[str], most: int = 1 << 20):
    """Lists of texts of about `most` characters together."""
    part, size = [], 0
    for t in texts:
        part.append(t)
        size += len(t)
        if size >= most:
            yield part
            part, size = [], 0
    if part:
        yield part
