"""Quality, toxicity, mixing, top-k, BPE and personal data: brute force, round trips and held-out accuracy."""

from __future__ import annotations

import hashlib
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from prefforge.llm.bpe import MergeReplay, encode_texts, read_ranks
from prefforge.llm.catalog import queries
from prefforge.llm.mixing import mix, source_targets, take_mix
from prefforge.llm.pii import find_pii
from prefforge.llm import quality, toxicity
from prefforge.llm.quality import BUCKETS, features, keep_good, kth_largest, level_of, resample
from prefforge.llm.queries_mixing import SQL as MIX_SQL
from prefforge.llm.queries_topk import SQL
from prefforge.llm.sampling import least_hashes
from prefforge.llm.toxicity import FILTERS, LANGUAGE_WORDS, WIDTHS, ConvNet, fit, rows_of, score_toxicity, train_on
from prefforge.llm.topk import top_k
from prefforge.llm.wordscan import NEXT_LETTERS, Words, by_letters, by_space, pieces
from tests.llm.data import documents, frame
from tests.oracle import SMALL, connect, same

MEDIUM = "/root/testdata/sf0.01"


def held(i):
    return zlib.crc32(str(i).encode()) % 5 == 0


# mixing
def plain_targets(sizes: dict, weights=(3, 1, 2)):
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    total = 1.5 * sum(sizes.values())
    target, open_ = {}, set(names)
    while True:
        left = total - sum(target.values())
        share = {s: left * w[s] / sum(w[x] for x in open_) for s in open_}
        above = [s for s in open_ if share[s] > 2 * sizes[s]]
        if not above:
            return target | share
        for s in above:
            target[s] = 2.0 * sizes[s]
            open_.remove(s)


@pytest.mark.parametrize("sizes", [{"a": 30, "b": 10}, {"a": 30, "b": 10, "c": 20}, {"a": 6, "b": 2, "c": 4, "d": 6, "e": 2}, *[dict(zip("abcdefg", map(int, np.random.default_rng(n).integers(0, 30, 7)), strict=True)) for n in range(4)]])
def test_targets_with_ties(spark, sizes):
    df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
    got = {r["source"]: r["target"] for r in source_targets(df).collect()}
    assert got == pytest.approx(plain_targets(sizes))


def test_mix_sql(spark):
    same(queries()["op4_mix_sources"](spark, SMALL), connect(), MIX_SQL["op4_mix_sources"])


def test_mix_of_repeated_rows(spark):
    """Rows without an id, and rows that repeat one, with equal and with different texts."""
    rows = [(None, "a b c", "en", "s", 0)] * 50 + [(4, "a b c d e", "en", "s", 0)] * 30 + [(None, f"w{i} x", "en", "t", 0) for i in range(40)]
    got = mix(frame(spark, rows)).collect()
    assert len(got) == len(rows) and all(0 <= g["taken"] <= 2 * g["size"] for g in got)
    for s in ("s", "t"):
        own = [g for g in got if g["source"] == s]
        assert abs(sum(g["taken"] for g in own) - own[0]["target"]) <= len(own) / 2 + 1
    mixed = take_mix(frame(spark, rows)).collect()
    assert abs(sum(len(r["text"].split()) for r in mixed) - sum(g["taken"] for g in got)) <= 50


@pytest.mark.parametrize("parts", [1, 2, 5, 9])
def test_mix_of_repeated_rows_at_the_cut(spark, parts):
    """Nine rows that repeat id and text, at the cut: the mix takes its budget to the word, however they are dealt out."""
    rows = [(1, "a b c d e", "en", "s", 0)] * 9 + [(2, "w " * 36, "en", "t", 0)]
    got = mix(frame(spark, rows).repartition(parts)).collect()
    own = sorted(g["taken"] for g in got if g["source"] == "s")
    target = next(g["target"] for g in got if g["source"] == "s")
    assert sum(own) == int(target + 0.5) and own[-1] - own[0] <= 1
    mixed = [r["text"] for r in take_mix(frame(spark, rows).repartition(parts)).collect() if r["source"] == "s"]
    assert sum(len(t.split()) for t in mixed) == sum(own)


def test_mix(spark):
    rows = documents(11, 120) + [(900, "a b c", "en", "empty?", 5), (901, None, "en", "nothing", None)]
    got = mix(frame(spark, rows)).collect()
    sizes: dict = {}
    for r in rows:
        sizes[r[3]] = sizes.get(r[3], 0) + len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or ""))
    wanted = plain_targets(sizes)
    assert len(got) == len(rows)
    for s, size in sizes.items():
        own = [g for g in got if g["source"] == s]
        assert {g["source_size"] for g in own} == {size}
        assert own[0]["target"] == pytest.approx(wanted[s])
        assert sum(g["taken"] for g in own) == int(own[0]["target"] + 0.5)
        assert all(0 <= g["taken"] <= 2 * g["size"] for g in own)
        assert sum(g["taken"] % g["size"] > 0 for g in own if g["size"]) <= 1
    key = lambda df: sorted((g["doc_id"], g["taken"]) for g in df.collect())
    assert key(mix(frame(spark, rows))) == key(mix(frame(spark, rows).repartition(7)))
    mixed = take_mix(frame(spark, rows))
    assert mixed.columns == frame(spark, rows).columns
    n_words = {s: 0 for s in sizes}
    for r in mixed.collect():
        n_words[r["source"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
    assert n_words == {s: int(wanted[s] + 0.5) for s in sizes}
    assert mix(frame(spark, [])).count() == 0 and take_mix(frame(spark, [])).count() == 0


# quality
def test_quality_held_out(spark):
    got = {r["doc_id"]: r["kept"] for r in queries()["op10_quality_resampling"](spark, MEDIUM).collect()}
    labels = [(r["doc_id"], r["quality"]) for r in spark.read.parquet(f"{MEDIUM}/labels.parquet").collect() if held(r["doc_id"])]
    good = [got[i] for i, y in labels if y == 1]
    bad = [got[i] for i, y in labels if y == 0]
    assert np.mean(good) >= 0.95 and np.mean(bad) <= 0.2
    assert len(got) == spark.read.parquet(f"{MEDIUM}/documents.parquet").count()


def test_quality_edges(spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = documents(12)
    assert resample(frame(spark, rows), none).filter("kept").count() == len(rows)
    left = keep_good(frame(spark, rows), spark.createDataFrame([(1, 1), (4, 0), (None, 1), (7, None)], "doc_id long, quality int"))
    assert left.columns == frame(spark, rows).columns
    assert resample(frame(spark, []), none).count() == 0
    assert level_of([(5.0, 1), (-3.0, 0), (-1.0, 1)]) == pytest.approx(-2.0)


def test_kth_largest(spark):
    values = [float(x % 97) ** 1.5 for x in range(5000)]
    df = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 60, 2500, 5000):
        value, above = kth_largest(df, k, bins=7, few=20)
        assert value == sorted(values, reverse=True)[k - 1] and above == sum(v > value for v in values)
    assert kth_largest(df, 0) is None


def test_least_hashes(spark):
    df = spark.range(5000).toDF("i")
    small = {r["i"] for r in least_hashes(df, "i", 200, 1).collect()}
    assert len(small) == 200 and small < {r["i"] for r in least_hashes(df, "i", 400, 1).collect()}
    assert small == {r["i"] for r in least_hashes(df.repartition(7), "i", 200, 1).collect()}
    assert least_hashes(df, "i", 9000, 1).count() == 5000 and least_hashes(df.filter("i < 0"), "i", 5, 1).count() == 0


# toxicity
def test_toxicity_held_out(spark):
    folder = "/root/testdata/sf0.1"
    got = {r["doc_id"]: r for r in queries()["op7_toxicity"](spark, folder).collect()}
    labels = {r["doc_id"]: r["toxic"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r["held_out"] == held(i) for i, r in got.items())
    own = [(got[i]["predicted"], y) for i, y in labels.items() if held(i)]
    assert np.mean([p == y for p, y in own]) >= 0.95
    assert np.mean([p for p, y in own if y == 0]) <= 0.02 and np.mean([p for p, y in own if y == 1]) >= 0.7


def plain_score(net: ConvNet, text: bytes) -> float:
    """The forward pass word by word and filter by filter."""
    w = Words([text], by_letters())
    rows = rows_of(w)
    words = [sum(net.embedding[r] for r in own) for own in rows]
    response = []
    for k, filters, bias in zip(WIDTHS, net.filters, net.bias, strict=True):
        for f in range(FILTERS):
            windows = [sum(float(words[a + o] @ filters[o][:, f]) for o in range(k)) for a in range(len(words) - k + 1)]
            response.append(max(max(windows) + float(bias[f]), 0.0) if windows else 0.0)
    counts = [sum(x.lower() in known.split() for x in re.findall("[A-Za-z0-9\x80-\xff]+", text.decode("latin-1"))) for known in LANGUAGE_WORDS.values()]
    lang = counts.index(max(counts)) if max(counts) else len(LANGUAGE_WORDS)
    return 1 / (1 + np.exp(-(np.dot(response, net.out) + float(net.out_bias) - net.shift[lang])))


def test_forward_pass_against_a_loop(spark):
    """With fixed arrays; also where a window of three words lies over the cut of a very long text."""
    net, rng = ConvNet(3), np.random.default_rng(3)
    net.embedding[:] = rng.normal(0, 1, net.embedding.shape)
    for x in [*net.filters, *net.bias]:
        x[:] = rng.normal(0, 0.3, x.shape)
    net.out[:], net.shift[:] = rng.normal(0, 0.05, len(net.out)), [0.1, -0.2, 0.3, 0.0, -0.1]
    texts = ["", "one", "one two", "the cat is on the mat", "der Hund und die Katze", "Le chat, et la souris. " * 30]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["score"] for r in score_toxicity(frame(spark, rows), net).collect()}
    assert got == pytest.approx({i: plain_score(net, t.encode()) for i, t, *_ in rows}, abs=1e-5)
    long = [" ".join(f"w{x}" for x in rng.integers(0, 10**6, 400)).encode() for _ in range(3)]
    long += [" ".join(rng.choice(["--", "* * *", "bad", "evil-thing", "...", "é"], 900).tolist()).encode() for _ in range(3)]
    for t in long:
        whole_text, parts = Words([t], by_letters()), [p for _, ps, _ in pieces([t], 100, back=0, ahead=2, next_word=NEXT_LETTERS) for p in ps]
        w = Words(parts, by_letters())
        assert np.allclose(net.pooled(rows_of(whole_text), whole_text.first)[0], net.pooled(rows_of(w), w.first).max(axis=0), atol=1e-5) and len(parts) > 9


def test_training_rows(spark):
    """Long texts are trained on, and of rows that repeat an id only one."""
    rows = [(i, ("vile " if i % 2 else "nice ") * (90_000 if i < 4 else 9), "en", "a", 0) for i in range(40)] + [(5, f"nice copy {k}", "en", "a", 0) for k in range(200)]
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, toxic int")
    seen = {}
    mine = fit
    try:
        toxicity.fit = lambda texts, y, seed=42: seen.update(texts=texts) or mine(texts, y, seed)
        train_on(frame(spark, rows), labels, "doc_id", "text", held_out=False)
        assert len(seen["texts"]) == 40 and sum(len(t) > 400_000 for t in seen["texts"]) == 4
        train_on(frame(spark, rows), labels, "doc_id", "text", train_bytes=500, held_out=False)
        assert 0 < sum(map(len, seen["texts"])) <= 500
    finally:
        toxicity.fit = mine


def test_toxicity_edges(spark):
    net = fit([b"good day", b"nice words here"] * 30 + [b"a vile word", b"so vile"] * 30, np.array([0, 0] * 30 + [1, 1] * 30))
    rows = [(1, None, "en", "a", None), (2, "", "en", "a", 0), (3, "such a VILE thing", "en", "a", 0), (4, "nice", "en", "a", 0), (None, "vile", "en", "a", 0), (6, "nice " * 300_000 + "vile", "en", "a", 0)]
    got = {r["doc_id"]: r for r in score_toxicity(frame(spark, rows), net).collect()}
    assert [got[i]["predicted"] for i in (1, 2, 3, 4, None, 6)] == [0, 0, 1, 0, 1, 1]
    assert got[1]["score"] == got[2]["score"] and got[None]["held_out"] is False
    none = train_on(frame(spark, rows), spark.createDataFrame([], "doc_id long, toxic int"), "doc_id", "text")
    assert score_toxicity(frame(spark, []), none).count() == 0
    assert {r["predicted"] for r in score_toxicity(frame(spark, rows), none).collect()} == {0}


def test_words():
    texts = ["Ein Wort, ein WORT", "", "a" * 5000, "x y " * 1000]
    for kind, pattern in ((by_space(), rb"[^ ]+"), (by_letters(), rb"[A-Za-z]+")):
        w = Words([t.encode() for t in texts], kind)
        assert np.diff(w.first).tolist() == [len(re.findall(pattern, t.encode())) for t in texts]
    w = Words([texts[0].encode()], by_letters())
    assert w.hashes[0] == w.hashes[2] and w.hashes[1] == w.hashes[3] and w.prefixes(3)[0] != w.prefixes(3)[1]
    parts = [(i, p[a:b]) for index, ps, own in pieces([t.encode() for t in texts], 600) for i, p, (a, b) in zip(index, ps, own, strict=True)]
    assert all(b"".join(p for i, p in parts if i == k) == t.encode() for k, t in enumerate(texts))


def plain_features(text: bytes) -> list[int]:
    """The n-gram buckets of one text, one after another."""
    mask = (1 << 32) - 1
    out = [(int.from_bytes(text[i : i + 4], "little") * 0x9E3779B1 & mask) >> 16 for i in range(len(text) - 3)]
    found = re.findall(rb"[^\x00\x09-\x0D\x20]+", text)
    shapes = []
    for k, w in enumerate(found):
        kind = lambda c: 1 if chr(c) in ".,;:?" else 2 if chr(c) in "!%$#&*|=<>{}[]~^_\\/+" else 0
        upper = sum(65 <= c <= 90 for c in w)
        same = k > 0 and w == found[k - 1]
        shapes.append(same | (65 <= w[0] <= 90) << 1 | (upper > 1) << 2 | kind(w[-1]) << 3 | kind(w[0]) << 5 | min(len(w) // 4, 3) << 7)
    for a, b, c in zip(shapes, shapes[1:], shapes[2:], strict=False):
        out.append((((a + b * 521 + c * 521 * 521) & mask) * 0x85EBCA6B & mask) >> 16 | BUCKETS)
    return out


def test_features_of_long_texts():
    """Each n-gram once, also those over the cuts, whatever stands beside a text."""
    rng = np.random.default_rng(6)
    texts = [" ".join(rng.choice(["a", "Bb", "b", "long,", "WORD!", "x\ny", "="], n).tolist()).encode() for n in (0, 1, 2, 3, 30, 400, 4000)] + [b"", b"b b b"]
    got = [[] for _ in texts]
    for index, parts, own in pieces(texts, 300):
        g, gb, s, sb = features(parts, own)
        for k, i in enumerate(index):
            got[i] += g[gb[2 * k] : gb[2 * k + 1]].tolist() + s[sb[2 * k] : sb[2 * k + 1]].tolist()
    for t, f in zip(texts, got, strict=True):
        assert sorted(f) == sorted(plain_features(t))


def test_resampling_of_repeated_and_missing_ids(spark):
    """One weight of each labelled id reaches the driver, and rows without an id have noise of their own."""
    rng = np.random.default_rng(8)
    text = lambda good: " ".join(rng.choice(["good", "fine", "and", "the"] if good else ["!!", "##", "BUY", "the"], 40).tolist())
    rows = [(i % 20, text(i % 20 % 3), "en", "a", 0) for i in range(600)] + [(None, text(True), "en", "a", 0) for _ in range(60)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0)) for i in range(20)], "doc_id long, quality int")
    seen, mine = [], quality.level_of
    try:
        quality.level_of = lambda pairs: seen.append(len(pairs)) or mine(pairs)
        got = resample(frame(spark, rows), labels, held_out=False).collect()
    finally:
        quality.level_of = mine
    assert seen == [20] and len(got) == len(rows)
    noise = {round(r["gumbel_key"] - r["log_weight"], 6) for r in got if r["doc_id"] is None}
    assert len(noise) == 60


def test_resampling_against_loops(spark):
    """Counts, weights, noise, level and the kept rows, as plain loops give them."""
    rng = np.random.default_rng(7)
    texts = [" ".join(rng.choice(["good", "fine", "and", "the"], 40).tolist()) if i % 3 else " ".join(rng.choice(["!!", "##", "BUY", "the"], 40).tolist()) for i in range(80)] + ["", None]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)]
    labels = [(i, int(i % 3 > 0)) for i in range(0, 80, 2)]
    got = {r["doc_id"]: r for r in resample(frame(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")).collect()}
    sample = {i: y for i, y in labels if not held(i)}
    grams = {i: plain_features((t or "").encode()) for i, t, *_ in rows}
    raw, target = np.zeros(2 * BUCKETS), np.zeros(2 * BUCKETS)
    for i, f in grams.items():
        for b in f:
            raw[b] += 1
            target[b] += sample.get(i) == 1
    ratio = np.zeros(2 * BUCKETS)
    for kind in (slice(0, BUCKETS), slice(BUCKETS, None)):
        ratio[kind] = np.log((target[kind] + 20) / (raw[kind] * target[kind].sum() / raw[kind].sum() + 20))
    weight = {i: sum(ratio[b] for b in f) * 500 / (len(f) + 500) for i, f in grams.items()}
    for i, r in got.items():
        assert r["n_grams"] == len(grams[i]) and r["log_weight"] == pytest.approx(weight[i], abs=1e-5)
    level = level_of([(got[i]["log_weight"], y) for i, y in sample.items()])
    k = sum(r["log_weight"] >= level for r in got.values())
    cut = sorted((r["gumbel_key"] for r in got.values()), reverse=True)[k - 1]
    assert {i for i, r in got.items() if r["kept"]} == {i for i, r in got.items() if r["gumbel_key"] >= cut} and 0 < k < len(rows)


# top-k
def test_topk_sql(spark):
    same(queries()["op8_topk_search"](spark, SMALL), connect(), SQL["op8_topk_search"])


@pytest.mark.parametrize("blocks", [(64, 8), (100_000, 1000)])
def test_topk(spark, blocks):
    """Of one block and of many, whose later ones begin with a floor."""
    rng = np.random.default_rng(3)
    x = np.round(rng.normal(0, 1, (900, 6)), 1)
    rows = [(int(i), [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (1050, [float("nan")] * 6), (1100, [float("inf")] * 6), (None, [9.0] * 6), (1150, []), (1200, [2.0, 1.0])]
    df = spark.createDataFrame([(i, v, 3, 4) for i, v in rows], "vec_id long, e array<double>, id int, rank int")
    got = {(r["query_id"], r["rank"]): (r["vec_id"], r["score"]) for r in top_k(df, "vec_id", "e", "{id} % 50 = 0", block_rows=blocks[0], batch_rows=blocks[1]).collect()}
    fine = {i: np.floor(np.pad(np.array(v), (0, 6 - len(v))) * 256).astype(int) for i, v in rows if v is not None and i is not None and all(c is not None and np.isfinite(c) for c in v)}
    wanted = {}
    for q in fine:
        if q % 50 == 0:
            best = sorted((-int(fine[q] @ v), i) for i, v in fine.items() if i != q)[:5]
            wanted |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == wanted
    assert top_k(df.filter("vec_id < 0"), "vec_id", "e", "{id} % 50 = 0").count() == 0


def test_topk_of_repeated_ids_and_large_components(spark):
    rows = [(0, [1.0, 2.0]), (0, [-1.0, 0.5]), (1, [3.0, 1.0]), (1, [0.0, 4.0]), (7, [2.0, -3.0])]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>")
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in top_k(df, "vec_id", "e", "{id} % 50 = 0", k=2, block_rows=2).collect())
    fixed = [(i, np.array(v) * 256) for i, v in rows]
    want = []
    for q in fixed[:2]:
        best = sorted((-int(q[1] @ v), i) for i, v in fixed if i != 0)[:2]
        want += [(0, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert got == sorted(want)
    with pytest.raises(ValueError, match="2\\*\\*53"):
        top_k(spark.createDataFrame([(0, [1e20]), (1, [-1e20])], "vec_id long, e array<double>"), "vec_id", "e", "{id} % 50 = 0")


# byte-level BPE
RANKS = read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken"))
TIKTOKEN = tiktoken.Encoding("test", pat_str=public_tokenizers.PATTERN, mergeable_ranks=RANKS, special_tokens={})


def test_bpe(spark):
    rows = documents(13) + [(7001, "<|endoftext|> aaaaaaa  \U0001f600‍ x  \n\n y", "en", "a", 0), (7002, "1234567 don't we'LL " * 50, "en", "a", 0), (7002, "a" * 3000, "en", "a", 0)]
    got = encode_texts(frame(spark, rows), RANKS, public_tokenizers.PATTERN, keep_ids=True, carry=["kept"]).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(r[0] for r in rows)
    wanted = {(r[0], r[1] or "") for r in rows}
    for r in got:
        assert (r["doc_id"], r["decoded"]) in wanted
        ids = TIKTOKEN.encode_ordinary(r["decoded"])
        assert list(r["ids"]) == ids and r["n_tokens"] == len(ids) and r["kept"] == "y"
        assert r["ids_sha256"] == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(r["decoded"].encode()).hexdigest()
    assert encode_texts(frame(spark, []), RANKS, public_tokenizers.PATTERN).count() == 0


def test_bpe_of_odd_vocabularies():
    """Also where a merge makes a pair of an earlier rank."""
    rng = np.random.default_rng(4)
    for _ in range(30):
        ranks = {bytes([b]): b for b in range(256)}
        known = list(b"abc")
        tokens = [bytes([b]) for b in known]
        while len(tokens) < 40:
            t = tokens[rng.integers(len(tokens))] + tokens[rng.integers(len(tokens))]
            if t not in ranks:
                tokens.append(t)
                ranks[t] = 256 + int(rng.integers(1 << 16)) * 64 + len(tokens)
        replay = MergeReplay(ranks)
        words = list({bytes(rng.choice(known, rng.integers(1, 25)).tolist()) for _ in range(200)})
        for w, ids in zip(words, replay.encode(words), strict=True):
            assert ids == ([ranks[w]] if w in ranks else replay.encode_alone(w))


def test_bpe_of_very_long_words(spark):
    """A million letters of one kind take seconds, and vocabularies that differ only in ranks are told apart."""
    for word in ("a" * 1_000_000, "=" * 100_000, "ab" * 50_000):
        began = time.time()
        assert MergeReplay(RANKS).encode([word.encode()])[0] == TIKTOKEN.encode_ordinary(word)
        assert time.time() - began < 60
    small = {bytes([b]): b for b in range(256)}
    for ranks in (small | {b"ab": 256, b"bc": 257}, small | {b"ab": 257, b"bc": 256}):
        got = encode_texts(frame(spark, [(1, "abc", "en", "a", 3)]).repartition(1), ranks, ".+", keep_ids=True).first()
        assert list(got["ids"]) == ([256, 99] if ranks[b"ab"] == 256 else [97, 256])


# personal data
def luhn(digits: str) -> bool:
    each = [int(c) for c in reversed(digits)]
    return (sum(each[::2]) + sum(2 * d - 9 * (d > 4) for d in each[1::2])) % 10 == 0


def only_digits(m: str) -> str:
    return re.sub("[^0-9]", "", m)


FORMS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(p) <= 255 for p in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 14 <= len(only_digits(m)) <= 19 and luhn(only_digits(m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 10 <= len(only_digits(m)) <= 15),
]


def plain_pii(text: str | None):
    found = sorted((m.start(), k, m.end()) for k, (_, form, ok) in enumerate(FORMS) for m in re.finditer(form, text or "") if ok(m.group()))
    return [sum(k == i for _, k, _ in found) for i in range(4)], ",".join(f"{FORMS[k][0]}:{s}:{e}" for s, k, e in found)


def check_base(rows, got):
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, text, *_ in rows:
        counts, spans = plain_pii(text)
        for r in by[i]:
            assert [r["n_email"], r["n_ip"], r["n_card"], r["n_phone"]] == counts, text
            assert r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
            assert set(filter(None, spans.split(","))) <= set(r["spans"].split(","))


def test_pii_forms(spark):
    rng = np.random.default_rng(5)
    texts = ["", None, "x" * 5000 + "@", "9" * 30_000, "1 " * 20_000, "a." * 5000 + "@b.c", "a@b.c_d@e.f a@b@c.d é1.2.3.4.5.6.7.8 256.1.1.1 0001.2.3.255", "4111 1111 1111 1111, 4111-1111-1111-1112 +4111111111111111", "+1 (017) 555-7713. ++49 30 123456789 +1 2"]
    alphabet = list("a1 9.@+-()é4\n")
    texts += ["".join(rng.choice(alphabet, rng.integers(1, 60))) for _ in range(1500)]
    texts += [f"{rng.integers(10**13, 10**17)} {rng.integers(0, 300)}.{rng.integers(0, 300)}.1.2 u{i}@h-{i}.org" for i in range(200)]
    rows = [(i, t, "en", "a", 0) for i, t in enumerate(texts)] + [(3, texts[3], "en", "a", 0)]
    got = find_pii(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    check_base(rows, got)
    assert find_pii(frame(spark, [])).count() == 0


def test_pii_contexts(spark):
    """Identifiers that no form knows are found behind words that announce seeds, and nowhere else."""
    rows = [(i, f"the sea is blue\nreach me at mailto: user{i}@mail{i % 7}.example.com and the day is long 12345", "en", "a", 0) for i in range(40)]
    rows += [(100, "then mailto: user@localhost now", "en", "a", 0), (101, "the 12345 user@localhost-two at 99", "en", "a", 0), (102, "mailto: nothing here", "en", "a", 0)]
    got = {r["doc_id"]: r for r in find_pii(frame(spark, rows)).collect()}
    check_base(rows, got.values())
    assert got[100]["spans"] == "email:13:27" and got[100]["n_added"] == 1
    assert got[101]["n_added"] == 0 and got[102]["n_added"] == 0 and all(got[i]["n_added"] == 0 for i in range(40))


def test_pii_patterns(spark):
    """Long announcing words, two words in front, a word behind, secrets, and punctuation that does not belong to a token."""
    long = "announcing" * 12
    rows = [(i, f"some text {long} user{i}@mail.example.com and more text to read here number {i}x", "en", "a", 0) for i in range(20)]
    rows += [(100, f"then {long} someone@intranet, and", "en", "a", 0)]
    rows += [(200 + i, f"the call went from 10.0.{i}.7 via the old line, via nothing at all, from nobody, via air via sea from me from us", "en", "a", 0) for i in range(20)]
    rows += [(300, "the call went from (host-77). Then", "en", "a", 0), (301, "it came from host-78 again", "en", "a", 0)]
    rows += [(400 + i, f"write to me+{i}@mail.example.org privately please", "en", "a", 0) for i in range(20)]
    rows += [(500, "we met 7up@home privately here", "en", "a", 0)]
    rows += [(600, 'set token = "0123456789abcdef0123"### now', "en", "a", 0), (601, "token 0123456789abcdef0123", "en", "a", 0)]
    got = {r["doc_id"]: r for r in find_pii(frame(spark, rows)).collect()}
    check_base(rows, got.values())
    cut = lambda i: [(s.split(":")[0], rows[[r[0] for r in rows].index(i)][1][int(s.split(":")[1]) : int(s.split(":")[2])]) for s in got[i]["spans"].split(",") if s]
    assert cut(100) == [("email", "someone@intranet")]
    assert cut(300) == [("ip", "host-77")] and cut(301) == []
    assert cut(500) == [("email", "7up@home")]
    assert cut(600) == [("secret", "0123456789abcdef0123")] and cut(601) == []
    assert all(got[i]["n_found"] == len(cut(i)) for i in got)


def test_pii_of_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    check_base([(r["doc_id"], r["text"]) for r in docs.collect()], queries()["op3_pii"](spark, SMALL).collect())


def test_native_plans(spark):
    """The operators that are to be native run no Python."""
    for key in ("op3_pii", "op4_mix_sources", "op5_line_dedup"):
        plan = queries()[key](spark, SMALL)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
    assert spark.range(1).select(F.lit(1)).count() == 1
