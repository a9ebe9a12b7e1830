"""Runs of repeated words against a loop over all starts and periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from prefforge.llm.periodic import find_runs, next_smaller, periodic_runs, run_digests
from prefforge.llm.queries_periodic import op12_periodic_runs
from tests.llm.data import documents, frame
from tests.oracle import SMALL


def loop_runs(w: list, shortest: int = 24, least: int = 3) -> list[tuple[int, int, int]]:
    """(start, length, period): for each period the stretches in which words that far apart are equal."""
    out, n = [], len(w)
    for p in range(1, n // least + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and w[j] == w[j + p]:
                j += 1
            s, length = i, j + p - i
            if j > i and length >= max(shortest, least * p):
                seg = w[s : s + length]
                if not any(seg[q:] == seg[:-q] for q in range(1, p)):
                    out.append((s, length, p))
            i = max(j, i + 1)
    return sorted(out, key=lambda r: (r[0], r[2]))


def expected(doc_id, text) -> dict:
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n, h = len(words), zlib.crc32(b"" if doc_id is None else str(doc_id).encode())
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = loop_runs(words)
    dropped = {k for s, length, p in runs for k in range(s + p, s + length)}
    best = None
    for s, length, p in runs:
        if best is None or length * best[2] > best[1] * p:
            best = (s, length, p)
    s, length, p = best or (None, None, None)
    return {
        "doc_id": doc_id, "n_runs": len(runs), "start": s, "length": length, "period": p, "exponent_milli": None if best is None else 1000 * length // p,
        "runs_sha256": hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
        "collapsed_sha256": hashlib.sha256(" ".join(w for k, w in enumerate(words) if k not in dropped).encode()).hexdigest(),
    }


@pytest.mark.parametrize("seed", range(6))
def test_runs_of_many_documents_at_once(seed):
    rng = random.Random(seed)
    for _ in range(60):
        texts = []
        for _ in range(rng.randint(0, 6)):
            kinds, n = rng.randint(1, 4), rng.randint(0, 90)
            w = [rng.randint(1, kinds) for _ in range(n)]
            if rng.random() < 0.6 and n > 10:
                a, p = rng.randint(0, n - 1), rng.randint(1, 12)
                w = w[:a] + (w[a : a + p] * n)[: n - a]
                w += [rng.randint(1, kinds) for _ in range(rng.randint(0, 10))] + w[-9:] * rng.randint(0, 5)
            texts.append(w)
        for shortest, least in ((24, 3), (6, 2), (2, 2), (30, 4)):
            got = list(zip(*[x.tolist() for x in find_runs([np.array(t, np.int64) for t in texts], shortest, least)], strict=True))
            assert got == [(i, *r) for i, t in enumerate(texts) for r in loop_runs(t, shortest, least)]


def test_next_smaller_goes_long_ways():
    for n in (1, 2, 5000):
        values = np.array([0, *range(n, 1, -1)])[:n] if n > 1 else np.array([3])
        for v in (values, -values, np.random.default_rng(n).permutation(n)):
            loop = [next((j for j in range(i + 1, n) if v[j] < v[i]), n) for i in range(min(n, 300))]
            assert next_smaller(v)[: len(loop)].tolist() == loop


def test_query(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()
    want = {r["doc_id"]: expected(*r) for r in docs}
    got = [r.asDict() for r in op12_periodic_runs(spark, SMALL).collect()]
    assert len(got) == len(docs) and all(want[r["doc_id"]] == r for r in got)
    assert sum(r["n_runs"] > 0 for r in got) > 5


def test_odd_rows(spark):
    rng = random.Random(2)
    long = " ".join(f"w{rng.randint(0, 3)}" for _ in range(2000))
    odd = [(None, "a b c", None, None, 1), (None, None, None, None, 1), (18, long, "en", "a", 5), (18, long, "en", "a", 5), (5, "x " * 5000, "en", "a", 5), (6, "x y\tx\x0by x " * 40, "en", "a", 5), (7, "a b " * 60_000, "en", "a", 5)]
    odd[-1] = (7, "a b c " * 400 + "d " * 23, "en", "a", 5)
    rows = [*documents(4), *odd]
    got = run_digests(periodic_runs(frame(spark, rows), repeats=True)).collect()
    want = [expected(r[0], r[1]) for r in rows]
    assert sorted(str(sorted(r.asDict().items())) for r in got) == sorted(str(sorted(r.items())) for r in want)
    assert run_digests(periodic_runs(frame(spark, []))).collect() == []


def test_the_operator_returns_runs_and_texts(spark):
    df = spark.createDataFrame([(1, "start " + "a b c " * 10 + "end")], "doc_id long, text string")
    row = periodic_runs(df).first()
    assert [tuple(r) for r in row["runs"]] == [(1, 30, 3)] and row["collapsed"] == "start a b c end"
