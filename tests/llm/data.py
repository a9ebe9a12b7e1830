"""Small tables with nulls, empty and long texts, ties, repeated rows and columns whose names clash with inner ones."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _id long, _row string, kept string, h long, fp string, size long, row long, `class` string, rank int, _text string, d0 string"
EXTRA = (7, "x", "y", 1, "z", 5, 9, "k", 3, "w", "v")


def words(rng: random.Random, n: int, size: int = 400) -> list[str]:
    return [f"w{rng.randint(0, size)}" for _ in range(n)]


def documents(seed: int = 1, n: int = 60) -> list[tuple]:
    """(doc_id, text, lang, source, n_chars): exact and near copies, shared passages, blank and null texts."""
    rng = random.Random(seed)
    passage = " ".join(words(rng, 60))
    texts: list[str | None] = [None, "", " \n\t", "one", "Two words", "é" * 150, "ab" * 400, "x" * 99, "y" * 100, "y" * 100]
    long = " ".join(words(rng, 4000, 50_000))
    texts += [long, long + " end", long[5000:], "a b " * 900]
    while len(texts) < n:
        kind = rng.randint(0, 4)
        own = words(rng, rng.randint(5, 200))
        if kind == 1 and len(texts) > 20:
            own = (texts[rng.randint(14, len(texts) - 1)] or "").split()
            if own:
                own[rng.randint(0, len(own) - 1)] = "changed"
        elif kind == 2:
            at = rng.randint(0, len(own))
            own = [*own[:at], passage, *own[at:]]
        elif kind == 3:
            own = (texts[rng.randint(14, len(texts) - 1)] if len(texts) > 14 else "q").upper().split(" ")
        texts.append(" ".join(own) if rng.random() < 0.7 else "\n".join(own))
    sources = ["b", "a", None, "c", "a"]
    return [(i * 3 + 1, t, "en", sources[i % 5], None if t is None else len(t)) for i, t in enumerate(texts)]


def frame(spark, rows):
    return spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)
