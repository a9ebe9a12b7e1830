"""Public tokenizers in Python workers: their files are read by the driver and broadcast, as they have a fixed size."""

from __future__ import annotations

import hashlib
import json

import numpy as np
import tiktoken
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

#: How a byte-level vocabulary writes bytes as characters: printable ones as themselves, the others from U+0100 on.
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(0x100 + n): b for n, b in enumerate(x for x in range(256) if x not in set(_PRINTED))}
#: The words of the byte-level vocabulary's pre-tokenizer (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_KNOWN: dict[tuple[str, str], object] = {}


def read_file(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def in_worker(kind: type, raw: bytes):
    """The tokenizer of a file's bytes, made once in each Python worker."""
    key = (kind.__name__, hashlib.sha256(raw).hexdigest())
    if key not in _KNOWN:
        _KNOWN[key] = kind(raw)
    return _KNOWN[key]


class ByteLevel:
    """A byte-level BPE from a `tokenizers` file. Where the file's merges are in the order of their ids, tiktoken gives the same
    ids at four times the speed; texts that its pattern engine gives up on (some 100,000 blanks in a row), and other files,
    go through `tokenizers`."""

    def __init__(self, raw: bytes):
        told = json.loads(raw)
        vocab, merges, added = told["model"]["vocab"], told["model"]["merges"], {x["content"]: x["id"] for x in told["added_tokens"]}
        #: bytes of each id
        self.token = [b""] * (1 + max([*vocab.values(), *added.values()]))
        for t, i in vocab.items():
            self.token[i] = bytes(BYTE_OF[c] for c in t)
        for t, i in added.items():
            self.token[i] = t.encode()
        self.length = np.array([len(t) for t in self.token])
        self._slow = {special: Tokenizer.from_str(raw.decode()) for special in (True, False)}
        self._slow[False].encode_special_tokens = True
        self._special = {True: set(added), False: set()}
        ordered = all(vocab["".join(m.split(" ") if isinstance(m, str) else m)] == 256 + n for n, m in enumerate(merges))
        plain = told.get("normalizer") is None and told["pre_tokenizer"] == {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
        #: what is encoded are the text's bytes, whatever it is
        self.lossless = plain
        self._fast = None
        if ordered and plain and len(vocab) == 256 + len(merges):
            self._fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks={self.token[i]: i for i in vocab.values()}, special_tokens=added)

    def encode(self, text: str, special: bool) -> np.ndarray:
        """The text's ids; special: strings of special tokens in it are these tokens, else ordinary text."""
        if self._fast is not None:
            try:
                return self._fast.encode_to_numpy(text, allowed_special=self._special[special], disallowed_special=())
            except ValueError:
                pass
        return np.array(self._slow[special].encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """A sentencepiece model whose pieces stand for bytes: U+2581 is a blank, <0xHH> a byte. It puts a blank in front of a text."""

    def __init__(self, raw: bytes):
        self._model = SentencePieceProcessor(model_proto=raw)
        self.token = []
        for i in range(self._model.get_piece_size()):
            piece = self._model.id_to_piece(i)
            self.token.append(bytes([int(piece[3:5], 16)]) if self._model.is_byte(i) else piece.replace("\u2581", " ").encode())
        self.length = np.array([len(t) for t in self.token])

    def encode(self, texts: list[str]) -> list[np.ndarray | None]:
        """Each text's ids; None if their bytes are not those of a blank and the text."""
        out: list[np.ndarray | None] = []
        token = self.token.__getitem__
        for text, ids in zip(texts, self._model.encode(texts, num_threads=1) if texts else [], strict=True):
            out.append(np.array(ids, np.uint32) if b"".join(map(token, ids)) == f" {text}".encode() else None)
        return out
