"""Packing against `tokenizers` and the rules of packing."""

from __future__ import annotations

import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from prefforge.llm.packing import STEP_IDS, TIERS, pack, pack_lengths, step_groups
from prefforge.llm.queries_packing import op11_packing
from prefforge.llm.vocab import ByteLevel, read_file
from tests.llm.data import documents, frame
from tests.oracle import SMALL

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.mark.parametrize("seed", range(30))
def test_windows_are_full_and_hold_every_id_once(seed):
    rng = random.Random(seed)
    top = rng.choice([3, 200, 1000, 2048, 9000])
    lengths = [rng.randint(1, top) for _ in range(rng.choice([0, 1, 2, 50, 400]))]
    found = list(pack_lengths(lengths))
    of = defaultdict(list)
    for size, parts in found:
        assert sum(n for _, _, n in parts) == size <= TIERS[-1] and size & (size - 1) == 0
        for doc, start, n in parts:
            assert n > 0
            of[doc].append((start, n))
    for doc, n in enumerate(lengths):
        at = 0
        for start, k in sorted(of[doc]):
            assert start == at
            at += k
        assert at == n
    # only the last window of all is broken up into sizes that are no tiers, or smaller than its tier
    assert sum(size not in TIERS for size, _ in found) <= 8


def test_documents_that_fit_stay_whole():
    found = list(pack_lengths([1500, 500, 48, 900, 124, 256]))
    assert [p for _, p in found] == [[(0, 0, 1500), (1, 0, 500), (2, 0, 48)], [(3, 0, 900), (4, 0, 124)], [(5, 0, 256)]]


def test_step_groups_are_balanced():
    rng = random.Random(5)
    windows = list(pack_lengths([min(rng.randint(1, 3000) for _ in range(3)) for _ in range(6000)]))
    group = step_groups(windows)
    ids, cost, sizes = defaultdict(int), defaultdict(int), defaultdict(set)
    for g, (size, parts) in zip(group.tolist(), windows, strict=True):
        ids[g] += size
        cost[g] += sum(n * n for _, _, n in parts)
        sizes[g].add(size)
    assert all(len(s) == 1 for s in sizes.values()) and max(ids.values()) <= STEP_IDS
    assert {s for (s,) in sizes.values()} >= {1024, 2048}
    for size in (1024, 2048):
        own = [g for g in ids if sizes[g] == {size}]
        assert max(ids[g] for g in own) - min(ids[g] for g in own) <= size
        spread = [cost[g] / ids[g] for g in own]
        assert max(spread) <= 1.1 * min(spread)


def _check(rows, texts: list[tuple], column: str = "doc_id"):
    """rows of the query against the ids that `tokenizers` gives each text; ids may repeat."""
    tokenizer = Tokenizer.from_file(FILE)
    expected = sorted((str(i), tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1])) for i, t in texts)
    by_doc = defaultdict(list)
    by_sequence = defaultdict(list)
    for r in rows:
        by_doc[str(r[column]), r["doc_tokens"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
    for parts in by_sequence.values():
        at = 0
        for r in sorted(parts, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at == parts[0]["window_size"] <= 2048 and at & (at - 1) == 0
    assert sum(r["length"] for r in rows) == sum(len(ids) for _, ids in expected)
    for (doc, total), parts in by_doc.items():
        own = [ids for i, ids in expected if i == doc and len(ids) == total]
        raw = [np.array(ids, "<u4") for ids in own]
        assert sum(r["length"] for r in parts) == total * len(own)
        for r in parts:
            assert r["ids_crc32"] in [zlib.crc32(x[r["start"] : r["start"] + r["length"]].tobytes()) for x in raw]
        if len(own) == 1:
            assert [r["start"] for r in sorted(parts, key=lambda r: r["start"])] == np.cumsum([0, *[r["length"] for r in sorted(parts, key=lambda r: r["start"])][:-1]]).tolist()


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    _check(op11_packing(spark, SMALL).collect(), [tuple(r) for r in docs])


def test_odd_rows(spark):
    from pyspark.sql import functions as F

    odd = [(None, "no id", None, None, 1), (4, "again", "en", "a", 5), (4, "again", "en", "a", 5), (9, "<|endoftext|> <|endoftext", "en", "a", 5), (10, " " * 300_000, "en", "a", 5), (11, "漢字​ é" * 9000, "en", "a", 5)]
    rows = documents(3) + odd
    parts = pack(frame(spark, rows), read_file(FILE), pool_ids=6000).withColumn("ids_crc32", F.crc32("ids"))
    assert "_row" not in parts.columns
    _check(parts.collect(), [(r[0], r[1]) for r in rows])
    again = pack(frame(spark, rows), read_file(FILE), pool_ids=6000)
    assert sorted(map(str, again.collect())) == sorted(map(str, parts.drop("ids_crc32").collect()))
    assert pack(frame(spark, []), read_file(FILE)).collect() == []


def test_ids_are_those_of_tokenizers():
    model, other = ByteLevel(read_file(FILE)), Tokenizer.from_file(FILE)
    rng = random.Random(11)
    plain = Tokenizer.from_file(FILE)
    plain.encode_special_tokens = True
    signs = [*"ab 'sT\n\t\r\x0b 　.,!1٣9é漢😀́\x00\x85", "<|endoftext|>", "'re", "  ", "don't"]
    for _ in range(3000):
        text = "".join(rng.choice(signs) for _ in range(rng.randint(0, 30)))
        assert model.encode(text, special=True).tolist() == other.encode(text, add_special_tokens=False).ids
        assert model.encode(text, special=False).tolist() == plain.encode(text, add_special_tokens=False).ids
