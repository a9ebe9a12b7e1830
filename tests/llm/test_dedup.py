"""Exact, near, line and substring dedup against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from prefforge.llm import suffix_dedup as suffix_dedup_module
from prefforge.llm.catalog import queries
from prefforge.llm.exact_dedup import drop_exact_copies, exact_dedup
from prefforge.llm.line_dedup import _places, dedup_lines, remove_lines
from prefforge.llm.queries_exact_dedup import SQL as EXACT_SQL
from prefforge.llm.queries_line_dedup import SQL as LINE_SQL
from prefforge.llm.components import connected_components
from prefforge.llm.near_copies import drop_similar
from prefforge.llm.simhash import VantageTree, drop_near_copies, fingerprint, fingerprint_links, halves, local_forest, near_duplicates
from prefforge.llm.suffix_dedup import suffix_dedup
from prefforge.llm.suffix_order import suffix_order
from tests.llm.data import documents, frame
from tests.oracle import SMALL, connect, same

UPPER = {c: c + 32 for c in range(65, 91)}


def components(prints: list[int], reach: int = 3) -> list[int]:
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i in range(len(prints)):
        for k in range(i):
            if (prints[i] ^ prints[k]).bit_count() <= reach:
                a, b = find(i), find(k)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(prints))]


def plain_fingerprint(text: str | None, width: int = 3) -> int:
    found = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(UPPER))
    if not found:
        return 0
    shingles = [" ".join(found[i : i + width]) for i in range(max(1, len(found) - width + 1))]
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


@pytest.mark.parametrize("key", sorted({**EXACT_SQL, **LINE_SQL}))
def test_sql(spark, key):
    same(queries()[key](spark, SMALL), connect(), {**EXACT_SQL, **LINE_SQL}[key])


def test_exact(spark):
    rows = documents(3) + [(4000, "Two WORDS", "en", "a", 9), (4000, "two words", "en", "a", 9), (None, "two words", "en", "a", 9), (None, "alone", "en", "a", 5)]
    got = exact_dedup(frame(spark, rows)).collect()
    groups: dict[str, list] = {}
    for r in rows:
        groups.setdefault((r[1] or "").translate(UPPER), []).append(r[0])
    assert len(got) == len(rows)
    for text, ids in groups.items():
        sha = hashlib.sha256(text.encode()).hexdigest()
        own = [g for g in got if g["text_sha256"] == sha]
        best = max((i for i in ids if i is not None), default=None)
        assert sorted(g["doc_id"] or -1 for g in own) == sorted(i or -1 for i in ids)
        assert {(g["keep_id"], g["group_size"]) for g in own} == {(best, len(ids))}
        assert sum(g["kept"] for g in own) == 1 and all(g["doc_id"] == best for g in own if g["kept"])
    left = drop_exact_copies(frame(spark, rows))
    assert left.count() == len(groups) and left.columns == frame(spark, rows).columns
    # a filter that is far too small costs speed only
    tiny = exact_dedup(frame(spark, rows), max_bits=1 << 16).filter("kept").count()
    assert tiny == len(groups)
    assert exact_dedup(frame(spark, [])).count() == 0


def test_near(spark):
    rows = documents(4) + [(5000, None, "en", "a", None), (5000, None, "en", "a", None)]
    got = {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in near_duplicates(frame(spark, rows)).collect()}
    prints = [plain_fingerprint(r[1]) for r in rows]
    root = components(prints)
    wanted = {(r[0], f"{prints[i]:016x}", min(rows[k][0] for k in range(len(rows)) if root[k] == root[i])) for i, r in enumerate(rows)}
    assert got == wanted
    left = drop_near_copies(frame(spark, rows))
    assert {r["doc_id"] for r in left.collect()} == {c for _, _, c in wanted}
    assert near_duplicates(frame(spark, [])).count() == 0


def test_rows_that_share_an_id(spark):
    rows = [(3, "a b c d", "en", "a", 0), (5, "a b c d", "en", "a", 0), (5, "something else altogether", "en", "a", 0), (None, "a b c d", "en", "a", 0)]
    wanted = sorted(((3, "a b c d"), (5, "something else altogether"), (-1, "a b c d")))
    for drop in (drop_near_copies, drop_similar):
        left = drop(frame(spark, rows))
        assert sorted((-1 if r["doc_id"] is None else r["doc_id"], r["text"]) for r in left.collect()) == wanted
        assert left.columns == frame(spark, rows).columns


def test_components_agree(spark):
    rng = random.Random(8)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(250)] + [(i, i + 1) for i in range(1000, 1090)]
    df = spark.createDataFrame(links, "a long, b long")
    few, many = ({(r["node"], r["root"]) for r in connected_components(df, local_links=n).collect()} for n in (10**6, 0))
    assert few == many and (1090, 1000) in few
    with pytest.raises(RuntimeError, match="not found"):
        connected_components(df, most_rounds=1, local_links=0)


def test_shards_are_divided(spark):
    """Small shards only, and the same links as of all pairs."""
    points = _clustered(5, 3000)
    df = spark.createDataFrame([(int(x),) for x in points.view(np.int64)], "fp long")
    links = fingerprint_links(df, sample_rows=200, shard_rows=150)
    got = {r["node"]: r["root"] for r in connected_components(links).collect()}
    wanted = components([int(x) for x in points])
    of: dict = {}
    for x, k in zip(points.view(np.int64).tolist(), wanted, strict=True):
        of.setdefault(k, []).append(x)
    assert all(len({got.get(x, x) for x in own}) == 1 for own in of.values())
    assert len({got.get(x, x) for own in of.values() for x in own}) == len(of)


def test_fingerprint_of_long_text():
    text = " ".join(f"w{i % 997}" for i in range(1000))
    assert fingerprint(text, 3) == plain_fingerprint(text)
    assert fingerprint("a b c", 5) == plain_fingerprint("a b c", 5)


def _clustered(seed, n):
    rng = np.random.default_rng(seed)
    centres = rng.integers(0, 1 << 63, 40, dtype=np.uint64) * np.uint64(2)
    points = centres[rng.integers(0, 40, n)]
    for _ in range(5):
        flip = rng.random(n) < 0.6
        points = np.where(flip, points ^ (np.uint64(1) << rng.integers(0, 64, n).astype(np.uint64)), points)
    return np.unique(points)


@pytest.mark.parametrize("shard_rows", [20, 100_000])
def test_links_of_clusters(spark, shard_rows):
    """Chains, boundaries and shards that are cut into blocks lose no link."""
    points = _clustered(1, 900)
    df = spark.createDataFrame([(int(p),) for p in points.view(np.int64)], "fp long")
    root = components([int(p) for p in points])
    sizes: dict[int, set] = {}
    for i, r in enumerate(root):
        sizes.setdefault(r, set()).add(int(points.view(np.int64)[i]))
    wanted = {(x, min(s)) for s in sizes.values() if len(s) > 1 for x in s}
    found = connected_components(fingerprint_links(df, 3, sample_rows=300, shard_rows=shard_rows))
    assert {(r["node"], r["root"]) for r in found.collect()} == wanted


def test_tree_meets_all_near_pairs():
    points = _clustered(2, 1500)
    for half in halves(points):
        tree = VantageTree(half[:400], 1, 20)
        own, shard = tree.visits(half)
        visits = [set(shard[own == i].tolist()) for i in range(len(half))]
        assert tree.shards > 5 and all(visits)
        for i in range(0, len(half), 7):
            for k in np.flatnonzero(np.bitwise_count(half ^ half[i]) <= 1):
                assert visits[i] & visits[k]


def test_local_forest():
    points = _clustered(3, 500)
    root = local_forest(points, 3)
    wanted = components([int(p) for p in points])
    assert len(set(root)) == len(set(wanted)) and len(set(zip(root.tolist(), wanted, strict=True))) == len(set(wanted))


def test_components_of_chains(spark):
    rng = random.Random(5)
    edges = [(i, i + 1) for i in range(1, 200)] + [(1000, 1000 + i) for i in range(1, 50)] + [(7000, 7000)]
    rng.shuffle(edges)
    found = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**dict.fromkeys(range(1, 201), 1), **dict.fromkeys(range(1000, 1050), 1000)}


def plain_lines(rows, run=3, words=20):
    """Lines to delete, by place in rows, which are in order."""
    seen, gone = set(), {}
    for i, (_, text, *_rest) in enumerate(rows):
        lines = (text or "").split("\n")
        count = [len(re.findall(r"[^\x20\x09-\x0D]+", x)) for x in lines]
        for k in range(len(lines)):
            m = next((m for m in range(1, run) if k + m <= len(lines) and sum(count[k : k + m]) >= words), run)
            gram = tuple(lines[k : k + m])
            if len(gram) < m:
                continue
            if gram in seen:
                gone.setdefault(i, set()).update(range(k, k + m))
            seen.add(gram)
    return gone


def test_lines(spark):
    rng = random.Random(6)
    texts = ["\n".join(rng.choice("abcde") for _ in range(rng.randint(0, 30))) for _ in range(40)] + [None, "", "\n\n\n\n", "p\nq\nr\ns", "x\np\nq\nr\ns\ny"]
    long = [" ".join(f"{c}{k}" for k in range(n)) for c, n in (("s", 20), ("t", 19), ("u", 12), ("v", 8))]
    texts += ["\n".join(rng.choice([*long, "a", "b"]) for _ in range(rng.randint(1, 8))) for _ in range(40)] + [f"new\n{long[0]}", f"{long[2]}\n{long[3]}", long[1]]
    rows = [(i, x, "en", "a", 0) for i, x in enumerate(texts)]
    # a repeated id, and rows without one, which come last
    rows += [(7, "only\nhere\nnow", "en", "a", 0), (None, "only\nhere\nnow", "en", "a", 0)]
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    gone = plain_lines(rows)
    got = sorted(dedup_lines(frame(spark, rows).coalesce(1)).collect(), key=lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["n_lines"]))
    mine = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0, len((rows[i][1] or "").split("\n"))))
    for r, i in zip(got, mine, strict=True):
        removed = {k for part in r["removed"].split(",") if part for k in range(int(part.split("-")[0]), int(part.split("-")[1]) + 1)}
        assert r["doc_id"] == rows[i][0] and removed == gone.get(i, set()) and r["n_removed"] == len(removed) and r["n_lines"] == len((rows[i][1] or "").split("\n"))
    wanted = sorted("\n".join(x for k, x in enumerate((r[1] or "").split("\n")) if k not in gone.get(i, ())) for i, r in enumerate(rows))
    left = remove_lines(frame(spark, rows).coalesce(1))
    assert sorted(r["text"] or "" for r in left.collect()) == wanted and left.columns == frame(spark, rows).columns
    assert left.filter("text is null").count() == 1
    assert dedup_lines(frame(spark, [])).count() == 0 and remove_lines(frame(spark, [])).count() == 0


def test_lines_of_repeated_ids(spark):
    """Which of several rows with one id loses its lines does not depend on how they are dealt out."""
    rows = [(7, f"A\nB\nC\n{x}", "en", "a", 0) for x in "pqrst"] + [(8, "A\nB\nC", "en", "a", 0)] * 3 + [(None, "B\nC\nD", "en", "a", 0), (None, "A\nB\nC\nD", "en", "a", 0)]
    results = {tuple(sorted((str(r["text"]), r["doc_id"] or -1) for r in remove_lines(frame(spark, rows).repartition(n)).collect())) for n in (1, 2, 5, 9)}
    assert len(results) == 1
    digests = {tuple(sorted(map(str, dedup_lines(frame(spark, rows).repartition(n)).collect()))) for n in (1, 2, 5, 9)}
    assert len(digests) == 1


def test_window_minima_thin_out_lines(spark):
    """Of short lines about every second one is a window minimum, and only these are sent on; each window has its minimum there."""
    rng = random.Random(3)
    texts = ["\n".join(f"line {rng.randint(0, 10**6)}" for _ in range(200)) for _ in range(10)] + ["a", "a\nb", ""]
    df = spark.createDataFrame([(x.split("\n"),) for x in texts], "x array<string>")
    df = df.select(F.transform("x", lambda v: F.xxhash64(v)).alias("h"), F.transform("x", lambda v: F.size(F.split(v, " "))).alias("c"))
    got = df.select(F.size("h").alias("n"), _places(F.col("h"), F.col("c"), 3, 20).alias("p"), "h").collect()
    assert 0.4 < sum(len(r["p"]) for r in got) / sum(r["n"] for r in got) < 0.6
    for r in got:
        hashes = r["h"]
        windows = sorted((p["at"] - k, p[f"m{k}"]) for p in r["p"] for k in range(3) if p[f"m{k}"] is not None)
        assert windows == [(i, 3) for i in range(len(hashes) - 2)]
        for p in r["p"]:
            assert p["print"] == hashes[p["at"]] and all(min(hashes[p["at"] - k : p["at"] - k + 3]) == p["print"] for k in range(3) if p[f"m{k}"] is not None)


def plain_strings(rows, length):
    """Results by place in rows, which are in order."""
    seen, out = set(), []
    for _, text, *_rest in rows:
        raw = (text or "").encode()
        covered = bytearray(len(raw))
        for s in range(len(raw) - length + 1):
            if raw[s : s + length] in seen:
                covered[s : s + length] = b"\1" * length
            seen.add(raw[s : s + length])
        left = bytes(b for b, c in zip(raw, covered, strict=True) if not c)
        spans = sum(c and (i == 0 or not covered[i - 1]) for i, c in enumerate(covered))
        out.append((len(raw), sum(covered), spans, hashlib.sha256(left).hexdigest()))
    return out


def test_strings(spark):
    rows = documents(7, 90) + [(9000, "y" * 101, "en", "a", 101), (None, "y" * 300, "en", "a", 300)]
    got = suffix_dedup(frame(spark, rows)).collect()
    assert sorted((r["doc_id"] or 10**9, *r[1:5]) for r in got) == sorted((r[0] or 10**9, *x) for r, x in zip(rows, plain_strings(rows, 100), strict=True))
    twice = [(1, "z" + "q" * 120, "en", "a", 1)] * 2
    assert sorted(tuple(r[1:5]) for r in suffix_dedup(frame(spark, twice)).collect()) == sorted(plain_strings(twice, 100))
    assert suffix_dedup(frame(spark, [])).count() == 0


def test_strings_of_hot_classes(spark, monkeypatch):
    """Classes that are dealt to finer ones give the same."""
    monkeypatch.setattr("prefforge.llm.suffix_dedup.HOT_PIECES", 1)
    monkeypatch.setattr("prefforge.llm.suffix_dedup.TASK_PIECES", 50)
    rng = random.Random(8)
    shared = "".join(rng.choice("abcdefgh") for _ in range(260))
    rows = []
    for i in range(50):
        a, b = sorted(rng.sample(range(260), 2))
        own = "".join(rng.choice("abcdefgh") for _ in range(60))
        rows.append((i, own[:30] + shared[a:b] + own[30:], "en", "a", 0))
    got = suffix_dedup(frame(spark, rows)).orderBy("doc_id").collect()
    assert [tuple(r[1:5]) for r in got] == plain_strings(rows, 100)


def test_a_passage_in_many_surroundings(spark, monkeypatch):
    """A passage one byte short of a string, in other surroundings each, and one that is long enough: no class stays large."""
    rng = random.Random(9)
    short, long = ("".join(rng.choice("abcdefgh") for _ in range(n)) for n in (99, 130))
    own = lambda: "".join(rng.choice("abcdefgh") for _ in range(40))
    rows = [(i, own() + (short if i % 5 else long) + own(), "en", "a", 0) for i in range(900)]
    rows += [(1000 + i, rows[i][1], "en", "a", 0) for i in range(20)] + [(2000 + i, rows[7][1][:90] + own(), "en", "a", 0) for i in range(40)]
    largest, mine = [], suffix_dedup_module.redealt

    def watched(pieces, length, most):
        left, runs = mine(pieces, length, 100)
        for x in (pieces, left):
            largest.append(max([r["count"] for r in x.groupBy("class").count().collect()], default=0))
        return left, runs

    monkeypatch.setattr(suffix_dedup_module, "redealt", watched)
    got = suffix_dedup(frame(spark, rows)).orderBy("doc_id").collect()
    assert [tuple(r[1:5]) for r in got] == plain_strings(rows, 100)
    assert largest[0] > 500 and largest[1] <= 100


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 4), max_size=60))
def test_suffix_order(symbols):
    assert suffix_order(np.array(symbols, int)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_suffix_order_of_repeats():
    for symbols in ([1] * 50, [2, 1] * 30, [1, 2, 3] * 20, [3, 2, 1] * 20, list(range(1, 60))):
        assert suffix_order(np.array(symbols)).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])


def test_queries_run_on_whole_tables(spark):
    n = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for key in ("op1_suffix_dedup", "op2_simhash_near_dedup"):
        assert queries()[key](spark, SMALL).select(F.countDistinct("doc_id")).first()[0] == n
