"""Alignment of tokens against loops over bytes."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from prefforge.llm.alignment import align_tokens
from prefforge.llm.queries_alignment import op13_token_alignment
from prefforge.llm.vocab import BYTE_OF, read_file
from tests.llm.data import documents, frame
from tests.oracle import SMALL

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def loop(rows: list[tuple]) -> list[dict]:
    one = Tokenizer.from_file(A)
    one.encode_special_tokens = True
    two = SentencePieceProcessor(model_file=B)

    def spans(pieces: list[bytes]) -> list[tuple[int, int]]:
        at, out = 0, []
        for p in pieces:
            out.append((at, at + len(p)))
            at += len(p)
        return out

    made = []
    for doc_id, text in rows:
        row = {"doc_id": doc_id, "n_a": 0, "n_b": 0, "n_groups": 0, "n_links": 0, "links": [], "groups_sha256": ""}
        made.append(row)
        if not text:
            continue
        a, b = one.encode(f" {text}", add_special_tokens=False).ids, two.encode(text)
        raw_a = [bytes(BYTE_OF[c] for c in one.id_to_token(i)) for i in a]
        raw_b = [bytes([int(p[3:5], 16)]) if two.is_byte(i) else p.replace("▁", " ").encode() for i in b for p in [two.id_to_piece(i)]]
        if b"".join(raw_a) != f" {text}".encode() or b"".join(raw_b) != f" {text}".encode():
            continue
        of_a, of_b = spans(raw_a), spans(raw_b)
        cuts = sorted({e for _, e in of_a} & {e for _, e in of_b})
        row |= {"n_a": len(a), "n_b": len(b), "n_groups": len(cuts)}
        groups, low = [], 0
        for cut in cuts:
            groups.append(",".join(str(i) for i, (_, e) in zip(a, of_a, strict=True) if low < e <= cut) + "|" + ",".join(str(i) for i, (_, e) in zip(b, of_b, strict=True) if low < e <= cut))
            low = cut
        row["groups_sha256"] = hashlib.sha256(";".join(groups).encode()).hexdigest()
        row["links"] = [(i, k) for i, (s, e) in zip(a, of_a, strict=True) for k, (t, f) in zip(b, of_b, strict=True) if s < f and t < e]
        row["n_links"] = len(row["links"])
    counts = Counter(pair for row in made for pair in set(row["links"]))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    for row in made:
        links = row.pop("links")
        row |= {"n_best": sum(counts[x] == most[x[0]] for x in links), "count_sum": sum(counts[x] for x in links)}
    return made


def same(got, want):
    text = lambda rows: sorted(str(sorted(r.items())) for r in rows)
    assert text(r.asDict() for r in got) == text(want)


ODD = [
    (None, "no id", None, None, 1), (4, "again and again", "en", "a", 5), (4, "again and again", "en", "a", 5), (9, "<|endoftext|> <s> </s> <0x41>", "en", "a", 5), (10, "a  b   c\t\n\r\x0b ", "en", "a", 5),
    (11, "漢字​ é😀 ﬁ ▁x \x00", "en", "a", 5), (12, " leading", "en", "a", 5), (13, "▁▁", "en", "a", 5), (14, " " * 700, "en", "a", 5), (15, "don't 12345 " * 40, "en", "a", 5),
]


@pytest.mark.parametrize("frequent", [0, 40, 1 << 19])
def test_rows(spark, frequent):
    rows = [r if r[1] is None or len(r[1]) < 3000 else (*r[:1], r[1][:3000], *r[2:]) for r in documents(5, 40)] + ODD
    want = loop([(r[0], r[1]) for r in rows])
    assert sum(r["n_links"] == 0 for r in want) >= 2 and sum(r["n_best"] < r["n_links"] for r in want) >= 3
    same(align_tokens(frame(spark, rows), read_file(A), read_file(B), frequent=frequent).collect(), want)
    assert align_tokens(frame(spark, []), read_file(A), read_file(B), frequent=frequent).collect() == []


def test_query(spark, tmp_path):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").filter("length(text) < 2000").select("doc_id", "text")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    same(op13_token_alignment(spark, str(tmp_path)).collect(), loop([tuple(r) for r in docs.collect()]))
