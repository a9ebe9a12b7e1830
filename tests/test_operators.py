"""Semantics on small literal frames: ties, nulls, empty texts, missing separators, half-even rounding."""

from __future__ import annotations

import json
import os
import random
import re

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from prefforge.functions import constants as k
from prefforge.functions import numeric as n
from prefforge.functions import text as t
from prefforge.functions.generation import register_candidates
from prefforge.functions.constants import ALLOWED_FAILURE_MODES, CORE_FIELDS, OBJECTIVE_FIELDS, STRICT_GUARDRAILS
from prefforge.functions.tables import clean_shared, number_rows, prefix_sums, shared_buckets, shared_folder, shared_table
from prefforge.operators import cleaning, evaluate, judge, labelling, pairs, reward, scorer, tasks, training
from prefforge.operators.dedup import Kept, Profile, _in_blocks, _jaro, decide, exact_first, least_similar, most_similar, near_dup_greedy
from prefforge.plans.fixtures import view
from prefforge.sources import files
from prefforge.sources.onefile import write_one_file
from prefforge.streaming.near_dup import EarliestStay, near_dup_stream


def one(spark, column, value, kind="string"):
    return spark.createDataFrame([(value,)], f"x {kind}").select(column(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("function", "given", "wanted"),
    [
        (t.first_token, "  Dreamt in", "Dreamt"),
        (t.first_token, " \n", ""),
        (t.username, "x for @bob... y", "bob"),
        (t.username, "x for @bob", "bob"),
        (t.prompt_body, "a /dream prompt:cat!", "cat"),
        (t.prompt_body, "nothing", ""),
        (t.strip_arguments, "a cat steps:50 seed:7\nb", "a cat\nb"),
        (t.drop_prefix, "PROMPT: x", ": x"),
        (t.trailing_seed, "a seed", "a "),
        (t.trailing_seed, "seed a seed", "seed a seed"),
        (t.remove_characters, "(a)[b]{c}|d", "abcd"),
        (t.glue_digits, "1 9 5 5 s, 4 k", "1955s, 4k"),
        (t.space_comma, "a , b", "a, b"),
        (t.strip_characters, " :'a.b\", ", "a.b"),
        (t.as_prompt, "a</s>b", "a</s>"),
        (t.completion, "a</s>b<|endoftext|>", "b"),
        (t.completion, "a", ""),
        (lambda x: t.truncate(x, 3, "…"), "abcd", "abc…"),
        (t.strip_emoji, "a😀☀️b", "ab"),
    ],
)
def test_text(spark, function, given, wanted):
    assert one(spark, function, given) == wanted


def test_phrases_and_ngrams(spark):
    assert one(spark, lambda x: t.phrase_hits(x, ["unreal engine", "unreal engine 5", "hd"]), "Unreal Engine 5 HD shadhd") == 4
    assert one(spark, t.repeated_ngrams, "a b c a b c a b c") == 4
    assert one(spark, t.repeated_ngrams, "a b") == 0
    assert one(spark, lambda x: t.copy_ratio(F.lit("a cat</s>"), x), "cat cat dog") == pytest.approx(2 / 3)
    assert one(spark, lambda x: t.copy_ratio(F.lit("a cat"), x), "") == 0.0
    assert one(spark, t.token_count, "ein Übel, été_1") == 3
    assert one(spark, lambda x: t.round_half_even(x), 0.0625, "double") == 0.062


def test_character_classes(spark):
    plain = set(" .,\"-'!–/;&?")
    superscripts = set("²³¹⁰⁴⁵⁶⁷⁸⁹₀₁₂₃₄₅₆₇₈₉")
    rng = random.Random(1)
    alphabet = list("ab9 .,\"-'!–/;&?+*_#|:=@\n\téñ漢²₃٣(")
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 6))) for _ in range(800)]
    digit = lambda c: c.isdecimal() or c in superscripts
    df = spark.createDataFrame([(x,) for x in texts], "x string")
    got = df.select("x", t.all_non_ascii(F.col("x")), t.all_not_alpha(F.col("x")), t.suspicious(F.col("x")), t.has_non_ascii(F.col("x"))).collect()
    for x, a, b, c, d in got:
        assert a == (not any(ord(k) < 128 and k not in plain and not k.isdigit() for k in x))
        assert b == (not any(k.isalpha() for k in x))
        assert c == any(k not in plain and k not in "+*_#|" and not digit(k) and not k.isalpha() for k in x)
        assert d == any(ord(k) >= 128 and k not in plain and not digit(k) for k in x)


def test_json_numbers(spark):
    for text, wanted in (('{"k": 8.7}', 8), ('{"k": "8"}', 8), ('{"k": true}', 1), ('{"k": "8/10"}', None), ('{"k": 11}', None), ("{bad", None), ('{"k": null}', None)):
        assert one(spark, lambda x: n.int_1_to_10(x, "$.k"), text) == wanted


def test_modes(spark):
    given = [" Magic-Words", "none", "strange", "magic words", None]
    assert one(spark, lambda x: n.normalise_modes(x, ALLOWED_FAILURE_MODES), given, "array<string>") == ["magic_words"]
    assert one(spark, n.normalise_modes, given, "array<string>") == ["magic_words", "strange"]
    assert one(spark, n.normalise_modes, ["none"], "array<string>") == ["none"]
    assert one(spark, n.default_modes, None, "array<string>") == ["none"]


def test_numbers(spark):
    assert one(spark, lambda x: n.win_probability(x, x), 0.0, "double") == 0.0
    assert one(spark, n.perplexity, 1000.0, "double") == float("inf")
    assert one(spark, n.dpo_loss, -800.0, "double") == 800.0
    assert one(spark, lambda x: n.mask_prompt_labels(x, 0), [5, 6, 0, 7, 0], "array<int>") == [-100, -100, -100, 7, 0]
    assert one(spark, lambda x: n.mask_prompt_labels(x, 0), [0, 7], "array<int>") == [0, 7]
    assert one(spark, lambda x: n.dpo_encode(x, F.array(F.lit(8), F.lit(9)), 3)[1], [1, 2, 3], "array<int>") == [-100, 8, 9]
    assert one(spark, n.reward_logit, [1.0, 3.0], "array<double>") == 2.0
    assert n.block_size(None, 2048) == 1024
    assert n.block_size(4096, 2048) == 2048


def test_judge_replies(spark):
    texts = ["", None, '```json\n{"score": 7, "reason": "r"}\n```', 'x {"score": 3} {"score": 99}', "score = 4 \"reason\": \"why\"", "score: 12", '{"overall": {"score": 5}}']
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    flat = [tuple(r["r"]) for r in df.orderBy("i").select(judge.parse_flat(F.col("x")).alias("r")).collect()]
    assert flat == [(None, "empty_response"), (None, "empty_response"), (7, "r"), (3, ""), (4, "why"), (None, "parse_failed: score: 12"), (5, "")]
    nested = [(r["r"]["overall"], r["r"]["fidelity"], r["r"]["failure_modes"]) for r in df.select(judge.parse_nested("x").alias("r"), "i").orderBy("i").collect()]
    assert nested[6] == (5, None, [])
    deep = spark.createDataFrame([('{"overall": 6, "fidelity": "7", "failure_modes": "Too Generic", "x": {"overall": 2}}',)], "x string")
    assert deep.select(judge.parse_nested("x").alias("r")).first()["r"]["overall"] == 2


def loop_nested(text):
    """A reply taken apart by Python's JSON reader, which is tried at every brace."""
    def whole(value):
        try:
            got = int(value)
        except (TypeError, ValueError, OverflowError):
            return None
        return got if 1 <= got <= 10 else None

    if not text:
        return [None] * 9 + [[], "empty_response"]
    text = text.strip()
    clean = re.sub(k.FENCE_END, "", re.sub(k.FENCE_BEGIN, "", text))
    for at in reversed([i for i, c in enumerate(clean) if c == "{"]):
        try:
            found = json.JSONDecoder().raw_decode(clean, at)[0]
        except ValueError:
            continue
        overall = whole(found.get("overall"))
        overall = whole(found.get("score")) if overall is None else overall
        if overall is not None:
            modes = found.get("failure_modes")
            modes = [modes] if isinstance(modes, str) else modes if isinstance(modes, list) else []
            modes = [re.sub("[ -]", "_", m.strip().lower()) for m in modes if isinstance(m, str)]
            modes = list(dict.fromkeys(m for m in modes if m in k.ALLOWED_FAILURE_MODES))
            return [overall, *[whole(found.get(f)) for f in k.OBJECTIVE_FIELDS], [m for m in modes if m != "none"] if len(modes) > 1 else modes, str(found.get("reason", ""))]
    prose = re.search(k.OVERALL_IN_PROSE, clean)
    if prose and whole(prose[1]) is not None:
        why = re.search(k.REASON_IN_PROSE, clean)
        return [whole(prose[1]), *[None] * 8, [], why[1] if why else ""]
    return [None] * 9 + [[], f"parse_failed: {text[:150]}"]


def test_nested_replies_against_a_loop(spark):
    """Objects within objects, in strings, cut off and broken ones, and all kinds of values."""
    rng = random.Random(12)
    values = [lambda: str(rng.randint(-2, 12)), lambda: f'"{rng.randint(0, 11)}"', lambda: f"{rng.randint(0, 11)}.7", lambda: rng.choice(["true", "null", "1e1", "NaN", "-Infinity", '" 7 "', '"7.5"', '"x"', "[3]", "{}", '"{"', '"}"', '"a\\\\"', '"\\"{"'])]
    keys = ["overall", "score", *k.OBJECTIVE_FIELDS[:3], "x"]

    def made(depth=0):
        pairs = [f'"{rng.choice(keys)}": {made(depth + 1) if depth < 3 and rng.random() < 0.2 else rng.choice(values)()}' for _ in range(rng.randint(0, 4))]
        if rng.random() < 0.5:
            pairs.append('"failure_modes": ' + rng.choice(['"Too Generic"', '["none", "magic-words", 5, null, ["none"]]', '["none"]', "[]", "7", "null", '"other"']))
        if rng.random() < 0.6:
            pairs.append('"reason": ' + rng.choice(['"why {not}"', '"say \\"hi\\" {"', "12", "null", "true", '"é — ok"', '"{\\"score\\": 3}"', "\'a\'"]))
        rng.shuffle(pairs)
        return "{" + rng.choice([", ", ",", ",\n "]).join(pairs) + "}"

    texts = ["", None, "   ", "{", "}{", '{"overall": 3', "overall: 7", "overall = 17"]
    for _ in range(1500):
        parts = [rng.choice(["", "Sure! ", "```json\n", 'he said "', "{", "}", "overall: 4 ", '"reason": "p"', "\u2003"]), made(), rng.choice(["", "\n```", " then ", '" {', "}"]), made() if rng.random() < 0.4 else "", rng.choice(["", " ", "}", " }]"])]
        text = "".join(parts)
        texts.append(text[: rng.randint(1, len(text))] if rng.random() < 0.15 else text)
    df = spark.createDataFrame(list(enumerate(texts)), "i int, x string")
    parsed = df.select("i", judge.parse_nested("x").alias("r"))
    assert "Python" not in parsed._jdf.queryExecution().executedPlan().toString()
    got = {r["i"]: list(r["r"]) for r in parsed.collect()}
    wrong = [(t, got[i], loop_nested(t)) for i, t in enumerate(texts) if got[i] != loop_nested(t)]
    assert not wrong, (len(wrong), wrong[:3])
    assert sum(r[0] is not None for r in got.values()) > 500


def test_upsert_and_cache(spark):
    log = spark.createDataFrame([(0, 1, 1, 4, None), (1, 1, 1, None, 9), (2, None, 2, 5, None), (3, 2, 1, 77, None)], "line_no int, prompt_id int, candidate_id int, score int, overall int")
    got = {(r["prompt_id"], r["candidate_id"]): r["overall"] for r in judge.upsert_scores(log).collect()}
    assert got == {(1, 1): 9, (2, 1): None}
    assert judge.upsert_scores(log, missing_ids="minus_one").count() == 3
    cache = spark.createDataFrame([(i, "p", ["a"] * (2 + (i == 3))) for i in range(5)], "prompt_id int, prompt string, candidates array<string>")
    assert judge.validate_cache(cache.filter("prompt_id <> 3"), 2).count() == 4
    with pytest.raises(ValueError, match="1 prompts"):
        judge.validate_cache(cache, 2)


def _scored(spark, seed, prompts=60):
    rng = random.Random(seed)
    rows = []
    for pid in range(prompts):
        for c in range(rng.randint(1, 8)):
            overall = rng.choice([None, *range(1, 11)])
            rows.append((pid, c, f"t{c}", overall, *[rng.choice([None, 5, 6, 7, 8, 9]) for _ in OBJECTIVE_FIELDS], rng.choice([["none"], ["magic_words"], []])))
    return rows, spark.createDataFrame(rows, "prompt_id int, candidate_id int, expansion string, overall int, " + ", ".join(f"{f} int" for f in OBJECTIVE_FIELDS) + ", failure_modes array<string>")


def test_greedy_against_a_loop(spark):
    rows, df = _scored(spark, 5)
    field = {f: 4 + i for i, f in enumerate(OBJECTIVE_FIELDS)}
    wanted, skips = [], {}
    for pid in range(60):
        own = sorted((r for r in rows if r[0] == pid), key=lambda r: (-(r[3] or -1), r[1]))
        if len(own) < 2:
            continue
        taken, used = [], set()
        for a, c in enumerate(own):
            if len(taken) == 4:
                break
            if c[3] is None:
                continue
            low = next((f for f, m in STRICT_GUARDRAILS.items() if c[field[f]] is not None and c[field[f]] < m), None)
            why = f"chosen_{low}_below_{STRICT_GUARDRAILS[low]}" if low else "chosen_hard_failure_magic_words" if c[-1] == ["magic_words"] else None
            if why:
                skips[why] = skips.get(why, 0) + 1
                continue
            for b in range(len(own) - 1, a, -1):
                r = own[b]
                if r[1] in used or r[3] is None:
                    continue
                lost = next((f for f in CORE_FIELDS if None not in (c[field[f]], r[field[f]]) and c[field[f]] < r[field[f]]), None)
                why = "gap_too_small" if c[3] - r[3] < 2 else f"chosen_loses_{lost}" if lost else None
                if why:
                    skips[why] = skips.get(why, 0) + 1
                    continue
                taken.append((pid, len(taken), c[1], r[1]))
                used.add(r[1])
                break
        wanted += taken
    got = [tuple(r) for r in pairs.greedy_multi(df).select("prompt_id", "slot", "chosen_id", "rejected_id").orderBy("prompt_id", "slot").collect()]
    assert got == wanted
    assert {r["reason"]: r["n"] for r in pairs.greedy_skips(df).collect()} == skips


def test_best_worst_ties(spark):
    df = spark.createDataFrame([(1, c, f"t{c}", s) for c, s in enumerate([5, 9, 9, 2, 2])] + [(2, 0, "x", 1)], "prompt_id int, candidate_id int, expansion string, overall int")
    assert [(r["chosen_id"], r["rejected_id"]) for r in pairs.best_worst(df).collect()] == [(1, 3)]
    assert [(r["chosen_id"], r["rejected_id"]) for r in pairs.best_worst(df, last_of_tied_worst=True).collect()] == [(1, 4)]
    assert {r["reason"]: r["n"] for r in pairs.best_worst_skips(df).collect()} == {"no_scores": 1}


def loop_near(rows, width=3600, threshold=0.6):
    """pos of the rows (pos, user, second, text) that stay, one after the other."""
    kept = []
    for r in sorted((r for r in rows if None not in r[1:]), key=lambda r: (r[2], r[0]), reverse=True):
        if not any(k[1] == r[1] and 0 <= k[2] - r[2] < width and _jaro(r[3], k[3]) > threshold for k in kept):
            kept.append(r)
    return {k[0] for k in kept} | {r[0] for r in rows if None in r[1:]}


def near_frame(spark, rows):
    return spark.createDataFrame(rows, "pos long, username string, s long, content string").withColumn("date", F.timestamp_seconds(F.col("s") + 1_700_000_000))


@pytest.mark.parametrize("block_rows", [20, 4096])
def test_near_duplicates_against_a_loop(spark, block_rows):
    """Users with pauses and without, in blocks of every size; repeated and missing values."""
    rng = random.Random(2)
    words = ["a red cat", "a red cap", "blue dog", "a red catt", "the sea", "", "qwertz", "zzz", "é漢", "xylophone of brass", None]
    rows = [(i, f"u{rng.randint(0, 5)}", rng.randint(0, 20_000), rng.choice(words)) for i in range(300)]
    rows += [(1000 + i, "busy", 10 * i, "".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 9)))) for i in range(120)]
    rows += [(2000, None, 5, "a red cat"), (2001, "u1", None, "a red cat"), (2002, "u1", 9, None)]
    got = {r["pos"] for r in near_dup_greedy(near_frame(spark, rows), "username", "date", "content", "pos", block_rows=block_rows).collect()}
    assert got == loop_near(rows)
    assert near_dup_greedy(near_frame(spark, []), "username", "date", "content", "pos").count() == 0


def test_a_user_with_many_rows_in_an_hour(spark):
    """No task visits more than a block: the rows of one user and hour are dealt to blocks."""
    rng = random.Random(4)
    rows = [(i, "one", rng.randint(0, 3599), f"{rng.choice(['cat', 'DOG', '1234', '....'])} {rng.randint(0, 300)}") for i in range(1200)]
    got = {r["pos"] for r in near_dup_greedy(near_frame(spark, rows), "username", "date", "content", "pos", block_rows=400).collect()}
    assert got == loop_near(rows)
    blocks = _in_blocks(near_frame(spark, rows).select(F.col("username").alias("u"), F.unix_micros("date").alias("d"), F.col("pos").alias("p"), F.col("content").alias("t")), 3_600_000_000, 400)
    assert sorted(r["count"] for r in blocks.groupBy("session", "block").count().collect()) == [400] * 3


def test_bounds_decide_about_most_pairs():
    """The bounds hold, and few pairs of ordinary texts need the similarity itself."""
    rng = random.Random(6)
    common = "the of and to in is that was for with are this be by a red cat sat on mat under blue sky".split()
    texts = [" ".join(rng.choice(common) for _ in range(rng.randint(1, 60))) for _ in range(60)] + [f"{rng.random()}" for _ in range(20)] + ["漢字" * 9, "abc", "cab", "z"]
    profiles = [Profile(t) for t in texts]
    counts, lengths = np.array([p.counts for p in profiles]), np.array([float(p.n) for p in profiles])
    for p in profiles:
        most = most_similar(counts, lengths, p)
        for q, m in zip(profiles, most, strict=True):
            assert least_similar(p, q) - 1e-9 <= _jaro(p.text, q.text) <= m + 1e-9
    exact = pairs = 0
    for width in (1, 5, 40):
        kept = Kept(0.6, width)
        stay = decide(list(range(len(texts), 0, -1)), texts, 0.6, width, kept)
        exact, pairs = exact + kept.exact, pairs + kept.pairs
        assert [t for t, s in zip(range(len(texts)), stay, strict=True) if s] == sorted(loop_near([(i, "u", len(texts) - i, t) for i, t in enumerate(texts)], width))
    assert pairs > 50 and exact <= pairs / 4


@pytest.mark.parametrize("batches", [1, 3])
def test_near_duplicates_of_a_stream(spark, tmp_path, batches):
    """The earliest of similar rows stays however rows come in batches, and users leave no state an hour after."""
    rng = random.Random(5)
    words = ["a red cat", "a red cap", "blue dog", "a red catt", "the sea", "qwertz", "zzz", "é漢", "xylophone of brass"]
    rows = sorted(((i, f"u{rng.randint(0, 4)}", rng.randint(0, 20_000), rng.choice(words)) for i in range(200)), key=lambda r: r[2])
    end = [(9000, "end", 40_000, "end"), (9001, None, 39_000, "x"), (9002, "u1", 39_000, "")]
    cuts = [rows[k * len(rows) // batches : (k + 1) * len(rows) // batches] for k in range(batches)]
    schema = near_frame(spark, rows).drop("s").schema
    for part in (*cuts, end):  # one file after the other
        near_frame(spark, part).drop("s").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    out = near_dup_stream(source, "username", "date", "content", "pos")
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    kept = []
    for r in sorted(rows, key=lambda r: (r[2], r[0])):
        if not any(x[1] == r[1] and r[2] - x[2] < 3600 and _jaro(r[3], x[3]) > 0.6 for x in kept):
            kept.append(r)
    got = {r["pos"] for r in spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()}
    assert got == {x[0] for x in kept} and 20 < len(got) < 190
    for name in ("kept", "waiting"):
        left = spark.read.format("statestore").option("path", f"{tmp_path}/state").option("stateVarName", name).load().select("key.u").distinct().collect()
        assert {r["u"] for r in left} <= {"end"}


class Listed(list):
    """A list state that counts what it is told."""

    calls = 0

    def appendList(self, entries):
        self.calls, self[:] = self.calls + len(entries), [*self, *entries]

    def put(self, entries):
        self.calls, self[:] = self.calls + len(entries), entries

    def get(self):
        return iter(list(self))

    def clear(self):
        self.calls, self[:] = self.calls + 1, []


def test_stream_states_hold_many_rows_in_an_entry():
    class Handle:
        def getListState(self, name, schema):
            return Listed()

        def registerTimer(self, ms):
            self.at = ms

        getCurrentWatermarkInMs = getExpiryTimeInMs = lambda self: self.at

    stay, handle = EarliestStay(3_600_000_000, 0.6), Handle()
    stay.init(handle)
    n = 25_000
    pdf = pd.DataFrame({"d": [i * 7_200_000_000 for i in range(n)], "p": range(n), "t": ["same"] * n})
    list(stay.handleInputRows(("u",), iter([pdf]), None))
    assert len(stay.waiting) == stay.waiting.calls == 3
    out = pd.concat(stay.handleExpiredTimer(("u",), handle, handle))
    assert out["p"].tolist() == list(range(n)) and out["d"].tolist() == pdf["d"].tolist()
    assert not stay.waiting and stay.waiting.calls == 4 and [len(e[0]) for e in stay.kept] == [1] and stay.kept.calls == 1
    list(stay.handleExpiredTimer(("u",), handle, handle))
    assert not stay.kept and stay.waiting.calls == 4


def test_candidates_in_sql(spark):
    register_candidates(spark, lambda prompts, k: [[f"{p} {i}" for i in range(k)] for p in prompts])
    df = spark.createDataFrame([(1, "a", 0.5), (1, "a", 0.7), (1, "b", 0.1), (2, "a", 0.2)], "k int, x string, other double")
    got = spark.sql("SELECT * FROM candidates(TABLE(SELECT * FROM {df}), 2, 'x', 'k')", df=df)
    assert got.columns == ["k", "x", "other", "candidate_id", "expansion"]
    rows = [(r["k"], r["candidate_id"], r["expansion"]) for r in got.collect()]
    assert sorted(r[:2] for r in rows) == [(1, 0), (1, 1), (1, 2), (1, 3), (2, 0), (2, 1)]
    assert {r[2] for r in rows if r[0] == 1} == {"a 0", "a 1", "b 0", "b 1"}
    for call, message in (("candidates(TABLE(SELECT * FROM {df}), 2, 'y', 'k')", "y is not one of"), ("candidates(TABLE(SELECT * FROM {df}), 0, 'x', 'k')", "k must be 1"), ("candidates(1, 2, 'x', 'k')", "take a table first")):
        with pytest.raises(Exception, match=message):
            spark.sql(f"SELECT * FROM {call}", df=df).collect()


def slow_jaro(a: str, b: str) -> float:
    """The definition, place by place."""
    if not a or not b:
        return 0.0
    reach, used, mine = max(max(len(a), len(b)) // 2 - 1, 0), [False] * len(b), []
    if a == b:
        return 1.0
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == x:
                used[j] = True
                mine.append(x)
                break
    if not mine:
        return 0.0
    other, k = [b[j] for j in range(len(b)) if used[j]], len(mine)
    return (k / len(a) + k / len(b) + (k - sum(x != y for x, y in zip(mine, other, strict=True)) // 2) / k) / 3


def test_jaro_is_linear_and_right():
    rng = random.Random(9)
    for _ in range(3000):
        a, b = ("".join(rng.choice("abcé"[: rng.randint(1, 4)]) for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert _jaro(a, b) == pytest.approx(slow_jaro(a, b), abs=1e-12), (a, b)
    long = "abcdefghij" * 30_000
    assert _jaro(long, long[:-1]) > 0.99 and 0 < _jaro(long, long[1:]) < 1


def test_jaro():
    assert _jaro("MARTHA", "MARHTA") == pytest.approx(0.9444, abs=1e-4)
    assert _jaro("", "a") == 0.0


def test_checkpoints(spark):
    rows = [(c, p, s, f"{c}{p}{s}", v) for c, base in (("a", -0.5), ("b", 0.0), ("c", 0.95)) for p in range(3) for s, v in ((0, base), (1, base + 0.1 * p))]
    df = spark.createDataFrame(rows, "checkpoint string, prompt_idx int, sample_idx int, gen string, rm_score double")
    summary = evaluate.rm_summary(df)
    flags = {r["flag"]: r["raised"] for r in evaluate.hacking_flags(summary.withColumn("ord", F.col("checkpoint"))).collect()}
    assert flags["ceiling_saturated"] and flags["accelerating_reward"] and not flags["no_strong_flags"]
    assert evaluate.hacking_flags(summary.filter("checkpoint <> 'a'").withColumn("ord", F.col("checkpoint"))).count() == 0
    wide = evaluate.wide_checkpoints(df, ["a", "b", "c"])
    assert wide.columns == ["prompt_idx", "sample_idx", "a__rm_score", "b__rm_score", "c__rm_score"] and wide.count() == 6


def test_printed_reward_scores(spark):
    good = spark.createDataFrame([(x,) for x in (3.0, 2.0, -2.0)], "score double")
    bad = spark.createDataFrame([(x,) for x in (-3.0, -2.0)], "score double")
    got = evaluate.theta_win_rate(good, bad).first()
    assert (got["wins"], got["pairs"]) == (5, 6)


def test_bradley_terry(spark):
    wins = [("d", "a", "b")] * 3 + [("d", "b", "a")] + [("d", "b", "c")] * 2 + [("d", "c", "b")] * 2
    got = {r["prompt"]: r["score"] for r in reward.bradley_terry(spark.createDataFrame(wins, "descr string, winner string, loser string"), 2000).collect()}
    assert sum(got.values()) == pytest.approx(1)
    assert got["a"] / got["b"] == pytest.approx(3, rel=1e-3) and got["b"] == pytest.approx(got["c"], rel=1e-3)


@pytest.mark.parametrize(("iterations", "tolerance"), [(5, 0.0), (40, 0.02)])
def test_large_descriptions_step_together(spark, iterations, tolerance):
    """Strengths of descriptions that no task fits alone are those of the fit, also where some come to rest earlier."""
    rng = random.Random(iterations)
    wins = [(d, *rng.sample([f"{d}{i}" for i in range(m)], 2)) for d, m, k in (("x", 3, 20), ("y", 30, 300), ("z", 2, 5)) for _ in range(k)] + [("x", "x0", "x0"), (None, "a", "b"), ("x", None, "x1")]
    df = spark.createDataFrame(wins, "descr string, winner string, loser string")
    of = lambda rows: {(r["descr"], r["prompt"]): r["score"] for r in rows.collect()}
    local = of(reward.bradley_terry(df, iterations, tolerance))
    for least in (0, 5):  # all of them, and all but the smallest
        assert of(reward.bradley_terry(df, iterations, tolerance, local_pairs=least)) == pytest.approx(local, abs=1e-9)
    assert {d for d, _ in local} == {"x", "y", "z"}


def test_tasks_are_dealt_by_number(spark):
    images = [(f"d{i % 2}", f"p{i}", f"{i}_{j}", i * 4 + j) for i in range(60) for j in range(4)]
    df = spark.createDataFrame(images, "descr string, prompt string, image_name string, img_idx long")
    draw = lambda d, m, task, salt: F.xxhash64(d, task, F.lit(salt))
    whole = sorted(map(str, tasks.sample_comparisons(df, draw).collect()))
    most, tasks.TASKS_AT_ONCE = tasks.TASKS_AT_ONCE, 7
    try:
        assert sorted(map(str, tasks.sample_comparisons(df, draw).collect())) == whole
    finally:
        tasks.TASKS_AT_ONCE = most
    assert len(whole) == 2 * tasks.expected_comparisons(30)


def test_tasks_are_made_in_many_partitions(spark):
    """The few rows that tasks are exploded from stay apart, and images that come along are those that are joined later."""
    images = [("d", f"p{i}", f"{i}_{j}", i * 4 + j) for i in range(300) for j in range(3 if i == 7 else 5)] + [(None, "p", f"n{i}", 9000 + i) for i in range(8)]
    df = spark.createDataFrame(images, "descr string, prompt string, image_name string, img_idx long")
    draw = lambda d, m, task, salt: F.xxhash64(d, task, F.lit(salt))
    most, tasks.TASKS_AT_ONCE = tasks.TASKS_AT_ONCE, 50
    try:
        sampled, wide = tasks.sample_comparisons(df, draw), tasks.sampled_wide_tasks(df, draw, "http://x")
        plan = sampled._jdf.queryExecution().optimizedPlan().toString()
        assert re.search(r"RepartitionByExpression \[descr#\d+, _part#\d+L\], 4\b", plan)
        assert sorted(map(str, wide.collect())) == sorted(map(str, tasks.wide_tasks(sampled, df, "http://x").collect()))
    finally:
        tasks.TASKS_AT_ONCE = most
    assert 0 < sampled.count() < tasks.expected_comparisons(300) and wide.columns[:3] == ["descr", "task", "INPUT:left_0"]


def test_sampler_counts(spark):
    images = [(f"d{m}", f"d{m}p{i}", f"{m}_{i}_{j}", (m * 100 + i) * 4 + j) for m in (1, 2, 5) for i in range(m) for j in range(3 if (m, i) == (5, 4) else 4)]
    df = spark.createDataFrame(images, "descr string, prompt string, image_name string, img_idx long")
    draw = lambda d, m, task, salt: F.xxhash64(d, task, F.lit(salt))
    got = tasks.sample_comparisons(df, draw).collect()
    by = {d: [r for r in got if r["descr"] == d] for d in ("d1", "d2", "d5")}
    assert len(by["d1"]) == 0 and len(by["d2"]) == tasks.expected_comparisons(2)
    assert 0 < len(by["d5"]) < tasks.expected_comparisons(5)
    assert all(r["left"] != r["right"] and "d5p4" not in (r["left"], r["right"]) for r in got)
    assert tasks.wide_tasks(tasks.sample_comparisons(df, draw), df).count() == len(got)


def test_training_logs(spark):
    steps = spark.createDataFrame([(i, v) for i, v in enumerate([9.0, 1.0, 2.0, 2.0, 3.0])], "step int, mean_reward double")
    got = [r["is_best"] for r in training.running_best(steps, after=1).orderBy("step").collect()]
    assert got == [False, True, True, False, True]
    many = [(i, (i * 37) % 101 / 10) for i in range(300)]
    rows = training.running_best(spark.createDataFrame(many, "step int, mean_reward double"), after=20).orderBy("step").collect()
    best = [max([v for j, v in many if 20 <= j < i], default=None) for i, _ in many]
    assert [r["best_before"] for r in rows] == best
    log = spark.createDataFrame([(i, i % 9) for i in range(200)], "line_no long, tokens long")
    assert [r["running"] for r in labelling.running_tokens(log).orderBy("line_no").collect()] == [sum(j % 9 for j in range(i + 1)) for i in range(200)]
    short = spark.createDataFrame([(0, [1, 2]), (1, [3]), (2, [4, 5, 6, 7, 8])], "at int, t array<int>")
    packed = training.pack_blocks(short, "t", "at", 4, 2).orderBy("batch", "block").collect()
    assert [list(r["input_ids"]) for r in packed] == [[1, 2, 3], [4, 5, 6, 7]]


def test_log_lines(spark):
    ok = spark.createDataFrame([(0, "header"), (1, "t: a | b | 3 | 3"), (2, "t: a | c: d | 4 | 7")], "line_no int, value string")
    log = labelling.parse_log(ok)
    assert [(r["prompt"], r["description"]) for r in labelling.replay(log).collect()] == [("a", "c: d")]
    assert labelling.total_tokens(log).first()["tokens"] == 7
    with pytest.raises(Exception, match="bad log line"):
        labelling.parse_log(spark.createDataFrame([(1, "t: a | b")], "line_no int, value string")).collect()


def test_files(spark, tmp_path):
    df = spark.createDataFrame([(0, 'a "b"\nc, d'), (1, None)], "i int, x string")
    files.write_csv(df, f"{tmp_path}/c")
    assert {r["x"] for r in files.read_csv(spark, f"{tmp_path}/c", schema="i int, x string").collect()} == {'a "b"\nc, d', None}
    odd = spark.createDataFrame([(i, x) for i, x in enumerate([" a ", "", None, 'x"\t"y', "l\r\nm", "\\", "end\\"] * 9)], "i int, x string")
    for index in (None, "i"):
        files.write_tsv(odd.repartition(3), f"{tmp_path}/t{index}", index)
        got = {r["i"]: r["x"] for r in files.read_tsv(spark, f"{tmp_path}/t{index}", "i int, x string").collect()}
        assert got == {r["i"]: r["x"] or None for r in odd.collect()}  # the format knows no empty texts beside missing ones
    assert files.read_scores(spark, f"{tmp_path}/none").count() == 0
    (tmp_path / "l.txt").write_text("a\n\nb\n")
    assert [r["value"] for r in files.read_lines(spark, f"{tmp_path}/l.txt").orderBy("line_no").collect()] == ["a", "", "b"]
    (tmp_path / "s.jsonl").write_text('{"i": 1}\n\n{"i": 2}\n')
    assert [(r["row_no"], r["i"]) for r in files.read_jsonl_strict(spark, f"{tmp_path}/s.jsonl", "i int").orderBy("row_no").collect()] == [(0, 1), (1, 2)]
    (tmp_path / "bad.jsonl").write_text('{"i": 1}\n{oops\n')
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|[Mm]alformed"):
        files.read_jsonl_strict(spark, f"{tmp_path}/bad.jsonl", "i int").collect()
    with pytest.raises(ValueError, match="is not one of"):
        files.read_text(spark, "x.parquet")


def test_files_with_empty_texts(spark, tmp_path):
    """Empty and missing texts, NUL characters and texts like the mark of missing values come back as they were."""
    texts = ["", None, "\\N", "\\\\N", "\\N\n", "N", "\\", '"\\N"', "\0", "a\0\nb", '"\0"\t,\0', " ", "\r\n"] * 3
    odd = spark.createDataFrame([(i, x, x if i % 2 else "y") for i, x in enumerate(texts)], "i int, x string, `y.z` string")
    for index in (None, "i"):
        files.write_tsv(odd.repartition(3), f"{tmp_path}/{index}", index, empty_texts=True)
        got = files.read_tsv(spark, f"{tmp_path}/{index}", "i int, x string, `y.z` string", empty_texts=True)
        assert sorted(got.collect()) == sorted(odd.collect())
    files.write_csv(odd, f"{tmp_path}/plain")
    got = {r["i"]: r["x"] for r in files.read_csv(spark, f"{tmp_path}/plain", schema="i int, x string, z string").collect()}
    assert got == {i: x or None for i, x in enumerate(texts)}


def test_errors_of_the_judge(spark):
    """How often each class of error is tried, how long it waits, and the reason of the row."""
    def failing(*answers):
        """A judge that raises the answers in turn (the last one again and again), and what it was asked and waited."""
        calls, waits = [], []

        def judge_(text):
            calls.append(text)
            answer = answers[min(len(calls), len(answers)) - 1]
            if isinstance(answer, Exception):
                raise answer
            return answer

        return (*scorer.ask(judge_, "x", 4, waits.append), len(calls), waits)

    limited, refused, broken = scorer.RateLimited("429"), scorer.Refused(400, "bad request"), scorer.Refused(503, "busy")
    assert failing(limited) == (None, "max_retries_exceeded", 4, [1, 2, 4, 8])
    assert failing(scorer.NoConnection(), limited, "fine") == ("fine", None, 3, [1, 2])
    assert failing(broken) == (None, "api_error_503: busy", 4, [1, 2, 4])
    assert failing(broken, "fine") == ("fine", None, 2, [1])
    assert failing(refused) == (None, "api_error_400: bad request", 1, [])
    assert failing(limited, refused) == (None, "api_error_400: bad request", 2, [1])
    assert failing(KeyError("choices")) == (None, "error: KeyError: 'choices'", 1, [])


def test_scorers(spark):
    def flaky(text):
        if text == "bad":
            raise OSError("down")
        return text.upper()

    df = spark.createDataFrame([("a",), ("bad",)], "x string")
    got = {r["x"]: (r["reply"], r["error"]) for r in scorer.with_replies(df, "x", flaky).collect()}
    assert got == {"a": ("A", None), "bad": (None, "error: OSError: down")}
    for concurrency in (1, 3, 50):  # calls of all tasks together
        asked = scorer.with_replies(spark.range(40).select(F.col("id").cast("string").alias("x")), "x", lambda x: x, concurrency=concurrency)
        assert asked.rdd.getNumPartitions() * (concurrency // asked.rdd.getNumPartitions()) <= concurrency and asked.count() == 40
    assert all(-1 <= r["rm_score"] < 1 for r in scorer.with_scores(df, "x").collect())


def test_one_file(spark, tmp_path):
    """The file is the texts in order, whatever the partitions; after a failed task it is as it was, and no part is left."""
    rows = [(i, f"text {i} é\n" if i % 3 else None) for i in random.Random(1).sample(range(500), 500)]
    df = spark.createDataFrame(rows, "k int, x string").repartition(7)
    path = f"{tmp_path}/out/report.md"
    write_one_file(df, "k", "x", path)
    wanted = "".join(x or "" for _, x in sorted(rows))
    assert open(path, encoding="utf-8").read() == wanted and os.listdir(f"{tmp_path}/out") == ["report.md"]
    with pytest.raises(Exception, match="the writer fails"):
        write_one_file(df.withColumn("x", F.when(F.col("k") == 400, F.raise_error(F.lit("the writer fails")).cast("string")).otherwise(F.col("x"))), "k", "x", path)
    assert open(path, encoding="utf-8").read() == wanted and os.listdir(f"{tmp_path}/out") == ["report.md"]
    write_one_file(df.filter("k < 0"), "k", "x", f"file://{path}")
    assert open(path).read() == ""


def test_pretty_json(spark):
    df = spark.createDataFrame([(1, 'a "b"\n', None, (3, None, [1, 2]))], "k long, a string, b double, s struct<x: int, y: string, z: array<int>>")
    block = files.audit_json_blocks(df, "k").first()["block"]
    assert block == json.dumps({"a": 'a "b"\n', "b": None, "s": {"x": 3, "y": None, "z": [1, 2]}}, indent=2).replace("[\n      1,\n      2\n    ]", "[1,2]") + "\n\n"


def test_reports_write_no_texts_that_they_do_not_need(spark):
    """The sorted report of flags keeps ids, and what Markdown is ordered by has no texts."""
    df = spark.createDataFrame([(1, "p</s>", "a b", "8K Hd"), (2, "q</s>", None, "")], "doc_id long, prompt string, sft string, dpo string")
    out = evaluate.layer3(df, ["doc_id"])
    assert not {"prompt", "sft", "dpo"} & set(spark.read.parquet(out.inputFiles()[0].rsplit("/", 1)[0]).columns)
    wide = {r["doc_id"]: r for r in evaluate.layer3(df).collect()}
    assert all(r[c] == wide[r["doc_id"]][c] for r in out.collect() for c in out.columns) and wide[1]["dpo_magic_word_hits"] == 2


def test_successive_halving(spark):
    rng = random.Random(3)
    rows = [(f"r{i}", s, rng.choice([0.5, 1.0, rng.random()])) for i in range(60) for s in range(5, rng.choice([10, 30, 70, 200, 600]), 5)]
    want, alive, rung = [], {r for r, _, _ in rows}, 20
    for k in range(5):
        here = sorted((max((s, x) for r, s, x in rows if r == run and s <= rung)[1], run) for run in alive if max(s for r, s, _ in rows if r == run) >= rung)
        keep = {run for _, run in here[: -(-len(here) // 3)]}
        want += [(run, k, rung, x, run not in keep) for x, run in here]
        alive, rung = keep, rung * 3
        if rung > max(s for _, s, _ in rows):
            break
    got = training.hyperband_stop(spark.createDataFrame(rows, "run string, step int, loss double")).collect()
    assert sorted(map(tuple, got)) == sorted(want) and {r["rung"] for r in got} == {0, 1, 2, 3}
    assert training.hyperband_stop(spark.createDataFrame([("a", 3, 1.0)], "run string, step int, loss double")).collect() == []


def test_numbered_rows(spark):
    df, total = number_rows(spark.createDataFrame([(x,) for x in random.Random(3).sample(range(1000), 200)], "k int"), "k")
    got = [r["at"] for r in df.orderBy("k").collect()]
    assert total == 200 and got == list(range(200))


def test_prefix_sums(spark):
    rows = [(k, k % 7) for k in random.Random(4).sample(range(500), 120)]
    got = {r["k"]: r["before"] for r in prefix_sums(spark.createDataFrame(rows, "k int, v int"), "k", "v").collect()}
    assert got == {k: sum(v for other, v in rows if other < k) for k, _ in rows}


def test_first_of_key(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3)], "k string, i int")
    assert {(r["k"], r["i"]) for r in exact_first(df, ["k"], "i").collect()} == {("a", 1), (None, 3)}


def test_steps_are_made_once_and_in_many_tasks(spark):
    """No step of the cleaning is computed again by the filters behind it, and few events' bytes do not mean few tasks."""
    messages = view(spark, "/root/testdata/sf0.001", "messages")
    cleaned = cleaning.filter_characters(cleaning.cut_arguments(cleaning.extract(messages)))
    plan = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("^prompt") == 1 and plan.count("naughty dreams that had to be popped  ") == 1 and plan.count("cfg _ scale, 1") == 1
    assert re.search(r"RepartitionByExpression \[event_id#\d+L\], 4\b", plan)


@pytest.mark.parametrize("text", ["", "a", "x\n", "a seed", "seed seed", "tail seed", "é漢\U0001f600", "\U0001f600", "a \U0001f600☀ b", "a(b)[c]{d}|e", "k:v", "w k:v\nx", "², –", "a²b", "a^b", "é^", "plain text, it's 4-5!", "a\\b"])
def test_guards_change_nothing(spark, text):
    """Patterns with a cheaper question in front give what they gave alone."""
    wanted = {
        "last": F.regexp_replace("x", r"(?s).\z", ""), "arguments": F.regexp_replace("x", k.ARGUMENTS, ""), "seed": F.regexp_replace("x", r"(?s)\A((?:(?!seed).)*+)seed\z", "$1"),
        "emoji": F.regexp_replace("x", t.EMOJI, ""), "brackets": F.translate("x", k.BRACKETS, ""), "odd": F.col("x").rlike(rf"[^\p{{L}}{t.DIGITS}{t.PLAIN}+*_#|]"), "beyond": F.col("x").rlike(rf"[^\x00-\x7F–{t.DIGITS}]"),
    }
    x = F.col("x")
    got = {"last": t.without_last(x), "arguments": t.strip_arguments(x), "seed": t.trailing_seed(x), "emoji": t.strip_emoji(x), "brackets": t.remove_characters(x), "odd": t.suspicious(x), "beyond": t.has_non_ascii(x)}
    df = spark.createDataFrame([(text,), (None,)], "x string")
    assert df.select(*[c.alias(n) for n, c in got.items()]).collect() == df.select(*[wanted[n].alias(n) for n in got]).collect()


def test_clean_pipeline_drops(spark):
    rows = [(i, c, "2024-01-01 00:00:00") for i, c in enumerate([None, " ", "Dreaming in 1s for @u... /dream prompt:x!", "Dreamt in 1s for @u... /dream prompt:A fine cat , 4 k steps:5!", "Dreamt for @v... /dream prompt:http here!"])]
    df = spark.createDataFrame(rows, "pos int, content string, d string").withColumn("date", F.to_timestamp("d"))
    assert [(r["pos"], r["content"]) for r in cleaning.clean_messages(df).collect()] == [(3, "A fine cat, 4k")]


def test_bucketed_tables_need_no_shared_warehouse(spark):
    tens = shared_buckets(spark.range(10), "ten", "id")
    assert sorted(r["id"] for r in tens.collect()) == list(range(10))
    assert {os.path.dirname(f.removeprefix("file://").removeprefix("file:")).rsplit("/", 1)[0] for f in tens.inputFiles()} == {shared_folder(spark).removeprefix("file://").removeprefix("file:") + "/tables"}


def test_texts_are_cut_and_judged_without_copies(spark):
    given = ["", "--", "a", "a--b", "a---b", "a--b--c", "----", "é--ü--", None]
    df = spark.createDataFrame([(x,) for x in given], "x string").select("x", t.after(F.col("x"), "--").alias("after"), t.occurs_once(F.col("x"), "--").alias("once"))
    assert [r["after"] for r in df.collect()] == [None if x is None else (x.split("--") + [""])[1] for x in given]
    assert [r["once"] for r in df.collect()] == [None if x is None else x.count("--") == 1 for x in given]
    assert "split" not in df._jdf.queryExecution().optimizedPlan().toString()
    rng, odd = random.Random(7), [*"aZ9 .,\"-'!–/;&?+*_#|", *"éß漢٣²³¹⁰⁹₀₉", *"\n\t<>@\U0001f600€"]
    texts = ["".join(rng.choices(odd[:30], k=rng.randrange(40))) + rng.choice([*odd, ""]) for _ in range(300)]
    fine = re.compile("[\\w .,\"'!–/;&?+*#|²³¹⁰⁹₀₉-]*")
    found = spark.createDataFrame([(x,) for x in texts], "x string").select(t.suspicious(F.col("x")).alias("s")).collect()
    assert [r["s"] for r in found] == [fine.fullmatch(x) is None for x in texts]


def test_first_rows_are_grouped_by_hashes_first(spark):
    df = spark.createDataFrame([("a", 2), ("a", 1), (None, 3), ("b", 4)], "k string, i int")
    firsts = exact_first(df, ["k"], "i")
    assert {(r["k"], r["i"]) for r in firsts.collect()} == {("a", 1), (None, 3), ("b", 4)}
    assert "Aggregate [xxhash64(k" in firsts._jdf.queryExecution().analyzed().toString()


def test_messages_are_made_in_many_tasks(spark):
    plan = view(spark, "/root/testdata/sf0.001", "messages")._jdf.queryExecution().analyzed().toString()
    assert "RepartitionByExpression [conv_id" in plan and "RepartitionByExpression [event_id" in plan


def test_shared_tables_go(spark):
    df = shared_table(spark.range(3).toDF("i"), "three")
    assert df.count() == 3
    assert clean_shared(spark) >= 1 and clean_shared(spark) == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND|FAILED_READ_FILE|does not exist"):
        spark.read.parquet(df.inputFiles()[0]).count()
