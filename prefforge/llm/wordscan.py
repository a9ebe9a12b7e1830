"""Words of many texts at once, as numpy arrays over their UTF-8 bytes."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

#: Bytes that are scanned together. Longer texts are cut at white space into parts of about that size.
PIECE = 1 << 18
_SPACE = re.compile(rb"[ \n\t\r]")
#: What stands before a word, and the word: of words between white space, and of words of letters.
NEXT_WORD = re.compile(rb"[ \n\t\r]*[^ \n\t\r]+")
NEXT_LETTERS = re.compile(rb"[^0-9A-Za-z\x80-\xff]*[0-9A-Za-z\x80-\xff]+")
_RANDOM = np.random.default_rng(20240501).integers(1, 1 << 63, 128, dtype=np.uint64) | np.uint64(1)


def as_bytes(column: pa.Array) -> list[bytes]:
    """The texts of an Arrow string column; null as empty."""
    return [x or b"" for x in column.cast(pa.binary()).to_pylist()]


def pieces(texts: list[bytes], most: int = PIECE, back: int = 1, ahead: int = 2, next_word: re.Pattern = NEXT_WORD):
    """(index of the text of each part, parts, own): lists of about `most` bytes. own (from, to) is what a part has for
    itself: these ranges together are all of every text, once. Around it a part of a longer text also holds the `back` words
    before (between white space) and the `ahead` words behind (which next_word finds), so that n-grams over a cut are seen whole
    by the part in which they begin."""
    index, parts, own, size = [], [], [], 0
    for i, t in enumerate(texts):
        at = 0
        while True:
            end = low = high = len(t)
            if end - at > 2 * most:
                found = _SPACE.search(t, at + most)
                end = high = found.start() if found else len(t)
                for _ in range(ahead):
                    found = next_word.match(t, high)
                    high = found.end() if found else len(t)
            low = at
            for _ in range(back if at else 0):
                while low > 0 and t[low - 1] in b" \n\t\r":
                    low -= 1
                while low > 0 and t[low - 1] not in b" \n\t\r":
                    low -= 1
            index.append(i)
            parts.append(t[low:high])
            own.append((at - low, end - low))
            size += high - low
            if size >= most:
                yield np.array(index), parts, np.array(own)
                index, parts, own, size = [], [], [], 0
            at = end
            if at >= len(t):
                break
    if index:
        yield np.array(index), parts, np.array(own)


def _stir(h: np.ndarray) -> np.ndarray:
    h = (h ^ h >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


class Words:
    """Words of texts: maximal runs of bytes that `kind` maps to a value above 0; that value enters the hash."""

    def __init__(self, texts: list[bytes], kind: np.ndarray):
        raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        self.raw = raw
        self.text_ends = np.cumsum(lengths)
        value = kind[raw]
        inside = value > 0
        edge = np.flatnonzero(np.diff(inside.view(np.int8), prepend=0, append=0))
        self.starts, self.ends = edge[::2], edge[1::2]
        n = len(self.starts)
        #: the words of text i are first[i] up to first[i + 1]
        self.first = np.concatenate([[0], np.searchsorted(self.starts, self.text_ends)])
        if n:
            at = np.zeros(len(raw), np.int64)
            at[self.starts] = np.diff(self.starts, prepend=0)
            place = np.arange(len(raw)) - np.cumsum(at)
            mixed = value.astype(np.uint64) * _RANDOM[place & 127] * inside
            self._mixed = mixed
            h = np.add.reduceat(mixed, self.starts) + (self.ends - self.starts).astype(np.uint64) * _RANDOM[127]
            self.hashes = _stir(h)
        else:
            self.hashes = np.empty(0, np.uint64)

    def of_parts(self, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first, last): the words of part i that begin within its own range are first[i] up to last[i]."""
        begin = np.concatenate([[0], self.text_ends[:-1]])
        return np.searchsorted(self.starts, begin + own[:, 0]), np.searchsorted(self.starts, begin + own[:, 1])

    def prefixes(self, k: int) -> np.ndarray:
        """Hashes of the words' first k bytes (of shorter words: all)."""
        h = np.full(len(self.starts), k, np.uint64)
        for at in range(k):
            i = np.minimum(self.starts + at, len(self.raw) - 1)
            h += np.where(self.starts + at < self.ends, self._mixed[i], np.uint64(0))
        return _stir(h)


def by_space() -> np.ndarray:
    """Words are what stands between white space."""
    kind = np.arange(256, dtype=np.uint8)
    kind[[9, 10, 11, 12, 13, 32, 0]] = 0
    return kind


def by_letters() -> np.ndarray:
    """Words are runs of letters, digits and bytes beyond ASCII, A-Z in lower case."""
    kind = np.zeros(256, np.uint8)
    for b in range(256):
        c = chr(b)
        if b >= 128 or c.isdigit() or "a" <= c <= "z":
            kind[b] = b
        elif "A" <= c <= "Z":
            kind[b] = b + 32
    return kind
