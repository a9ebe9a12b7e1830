"""Published example values: printed scores, score pairs and the rows above the reward ceiling."""

from __future__ import annotations

import pytest

from prefforge.operators import evaluate, pairs

# Printed reward scores of ten good and ten bad answers, recorded score pairs, and rewards above 0.9.
GOOD = [-1.375, 0.387, -0.088, 0.165, 0.955, 0.738, 3.501, -2.229, 3.428, 2.229]
BAD = [-3.047, -2.791, -2.475, -2.433, -3.408, -1.761, -2.709, -2.726, -2.366, -3.817]
SCORE_PAIRS = [(4, 1), (8, 2), (3, 1), (3, 1), (4, 1), (4, 2), (6, 1), (9, 1), (4, 1), (3, 1), (4, 1)]
GAPS = [3, 6, 2, 2, 3, 2, 5, 8, 3, 2, 3]
ABOVE = [1.108, 1.005, 0.933, 0.925, 0.907]


@pytest.fixture
def labelled(spark):
    return spark.createDataFrame([("good", x) for x in GOOD] + [("bad", x) for x in BAD], "label string, score double")


def test_good_and_bad(labelled):
    got = {r["label"]: r for r in evaluate.good_bad(labelled).collect()}
    assert [round(got["good"][k], 3) for k in ("mean", "min", "max")] == [0.771, -2.229, 3.501]
    assert [round(got["bad"][k], 3) for k in ("mean", "min", "max")] == [-2.753, -3.817, -1.761]


def test_separation(labelled):
    got = evaluate.rm_separation(labelled).first()
    assert (round(got["gap"], 3), got["wins"], got["pairs"], got["passed"]) == (3.524, 99, 100, True)


def test_score_pairs(spark):
    rows = [(i, c, "", s) for i, pair in enumerate(SCORE_PAIRS) for c, s in enumerate(pair)]
    df = spark.createDataFrame(rows, "prompt_id int, candidate_id int, expansion string, overall int")
    got = pairs.best_worst(df).orderBy("prompt_id").collect()
    assert [r["score_gap"] for r in got] == GAPS and all(r["score_gap"] >= 2 for r in got)


def test_ceiling(spark):
    df = spark.createDataFrame([(x,) for x in [0.9, *reversed(ABOVE), 0.2]], "ppo__rm_score double")
    assert [r[0] for r in evaluate.top_reward(df, "ppo__rm_score").collect()] == ABOVE
