"""The pipeline's near-dedup stage against all pairs of whole texts."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest

import corpus_pipeline
from prefforge.llm import near_copies as near_copies_module
from prefforge.llm.near_copies import crowd_forest
from tests.llm.data import documents, frame, words
from tests.llm.test_dedup import UPPER


def plain_set(text: str | None) -> frozenset:
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    return frozenset(tuple(found[i : i + 5]) for i in range(max(1, len(found) - 4)))


def plain_groups(texts: list) -> list[int]:
    sets = [plain_set(t) for t in texts]
    root = list(range(len(sets)))
    for i, a in enumerate(sets):
        for k, b in enumerate(sets[:i]):
            if root[i] != root[k] and 5 * len(a & b) >= 4 * len(a | b):
                old, new = max(root[i], root[k]), min(root[i], root[k])
                root = [new if r == old else r for r in root]
    return root


def near_copies(seed: int) -> list[tuple]:
    """Copies of texts of all lengths with ever more changed words, around a similarity of 0.8, chains of copies of copies,
    and a passage that all long texts share."""
    rng = random.Random(seed)
    passage, texts = words(rng, 40), []
    for n in (1, 3, 5, 6, 8, 9, 10, 14, 25, 60, 200, 600):
        for _ in range(3):
            own = words(rng, n, 10**6) + (passage if n >= 25 else [])
            texts.append(" ".join(own))
            for changed in (0, 1, 1, 2, 4, 8, n // 30):
                copy = own.copy()
                for at in rng.sample(range(len(own)), min(len(own), changed)):
                    copy[at] = f"c{rng.randint(0, 10**6)}"
                texts.append(" ".join(copy))
                texts.append(" ".join(copy[: len(copy) - changed]))
                own = copy if rng.random() < 0.3 else own
    rng.shuffle(texts)
    return [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]


def test_near_stage(spark):
    for rows in (near_copies(1), near_copies(2), documents(4)):
        root = plain_groups([r[1] for r in rows])
        assert {r["doc_id"] for r in corpus_pipeline.near(spark, frame(spark, rows), "").collect()} == {rows[k][0] for k in set(root)}


def test_near_stage_of_longer_distances(spark):
    """Pairs of similarity 0.8 whose fingerprints are more than 3 bits apart: one of each goes, and nothing else."""
    rows = []
    for i in range(30):
        own = [f"w{i}x{k}" for k in range(12 + i)]
        rows += [(2 * i, " ".join(own), "en", "a", 0), (2 * i + 1, " ".join([*own, "more"]), "en", "a", 0)]
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, frame(spark, rows), "").collect()} == {2 * i for i in range(30)}


@pytest.mark.parametrize("columns", [1, 7, 2048])
def test_forest_of_a_cell(columns):
    """Links of a cell connect what similar sets connect, within one block and between two."""
    rng = np.random.default_rng(columns)
    for trial in range(60):
        n = int(rng.integers(2, 25))
        base = rng.integers(0, 10**6, 60)
        sets = [np.unique(np.concatenate([rng.permutation(base)[: int(rng.integers(48, 61))], rng.integers(10**6, 10**6 + 50, int(rng.integers(0, 6)))])) for _ in range(n)]
        node = np.arange(100, 100 + n)
        root = node.copy()
        if n > 4:
            root[3] = root[1]
        same = np.full(n, trial % 2 == 0)
        upper = np.zeros(n, bool) if same[0] else rng.random(n) < 0.5
        got = crowd_forest(node, root, upper, same, sets, columns)
        pairs = [(i, k) for i in range(n) for k in range(i) if (same[0] or upper[i] != upper[k]) and 5 * len(np.intersect1d(sets[i], sets[k])) >= 4 * len(np.union1d(sets[i], sets[k]))]

        def components(links):
            top = {int(r): int(r) for r in root}
            for x, y in links:
                old, new = top[int(root[x])], top[int(root[y])]
                top = {k: new if v == old else v for k, v in top.items()}
            return [[a for a in top if top[a] == top[b]] for b in top]

        assert components([(a - 100, b - 100) for a, b in got]) == components(pairs) and len(got) < n


@pytest.mark.parametrize("block_bytes", [1 << 14, 4 << 20])
def test_near_stage_of_a_crowd(spark, monkeypatch, block_bytes):
    """Copies of one text with two or three changes of their own: most pairs lie under 0.8, some copies of copies over it."""
    monkeypatch.setattr(near_copies_module, "BLOCK_BYTES", block_bytes)
    rng = random.Random(5)
    origin, texts = words(rng, 120, 10**6), []
    for _ in range(60):
        own = origin.copy()
        for at in rng.sample(range(120), rng.choice((2, 3, 3, 4))):
            own[at] = f"c{rng.randint(0, 10**6)}"
        texts.append(" ".join(own))
        if rng.random() < 0.3:
            own[rng.randrange(120)] = f"c{rng.randint(0, 10**6)}"
            texts.append(" ".join(own))
    root = plain_groups(texts)
    assert 10 < len(set(root)) < len(texts)
    rows = [(i, t, "en", "a", len(t)) for i, t in enumerate(texts)]
    assert {r["doc_id"] for r in corpus_pipeline.near(spark, frame(spark, rows), "").collect()} == set(root)
