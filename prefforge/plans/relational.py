"""Queries of joins, aggregations, windows, sorts, sets and the pair builders."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions import text as t
from prefforge.functions.constants import LOOSE_GUARDRAILS, OBJECTIVE_FIELDS, STRICT_GUARDRAILS
from prefforge.functions.tables import number_rows
from prefforge.operators import evaluate as ev
from prefforge.operators import judge as j
from prefforge.operators import labelling as lab
from prefforge.operators import pairs as p
from prefforge.operators import reward as rw
from prefforge.operators import training as tr
from prefforge.operators.dedup import exact_first, last_wins
from prefforge.plans.registry import register
from prefforge.plans.scalars import _CORE, _guard_sql
from prefforge.sources.files import skip_rows, split_percent, union_all, zip_rows

C = F.col


def judged(get) -> DataFrame:
    return get("judged").withColumn("failure_modes", F.split("failure_modes_csv", ","))


# joins
register(
    "join_url_prompt",
    lambda get: rw.join_prompts(get("annotations"), get("img_map")).select("task", "left_prompt", "right_prompt"),
    "SELECT task, l.prompt AS left_prompt, r.prompt AS right_prompt FROM {annotations} a JOIN {img_map} l ON l.image_name = left_0 JOIN {img_map} r ON r.image_name = right_0",
)
register(
    "join_scores_to_candidates",
    lambda get: get("judged").select("prompt_id", "candidate_id", "expansion").join(j.upsert_scores(get("score_log")).select("prompt_id", "candidate_id", "overall"), ["prompt_id", "candidate_id"]).select("prompt_id", "candidate_id", "overall"),
    "SELECT prompt_id, candidate_id, overall FROM (SELECT *, coalesce(l.overall, score) AS o, row_number() OVER (PARTITION BY prompt_id, candidate_id ORDER BY line_no DESC) AS n FROM {score_log} l) WHERE n = 1".replace("overall FROM (SELECT *,", "o AS overall FROM (SELECT *,"),
)


def _pairs(get, ordered: bool):
    s = p.ranked(get("judged")).filter("overall is not null").select("prompt_id", "candidate_id", "overall", "rank")
    r = s.select("prompt_id", C("candidate_id").alias("other"), C("overall").alias("other_score"), C("rank").alias("other_rank"))
    both = s.join(r, "prompt_id")
    return both.filter("candidate_id <> other and overall - other_score >= 1" if ordered else "other_rank > rank").select("prompt_id", "candidate_id", "other")


_RANKED = "(SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY overall DESC NULLS LAST, candidate_id) - 1 AS rank, count(*) OVER (PARTITION BY prompt_id) AS n_scored FROM {judged})"
register("join_pairs_ordered", lambda get: _pairs(get, True), "SELECT a.prompt_id, a.candidate_id, b.candidate_id AS other FROM {judged} a JOIN {judged} b ON a.prompt_id = b.prompt_id AND a.candidate_id <> b.candidate_id AND a.overall - b.overall >= 1")
register("join_pairs_ranked", lambda get: _pairs(get, False), f"SELECT a.prompt_id, a.candidate_id, b.candidate_id AS other FROM {_RANKED} a JOIN {_RANKED} b ON a.prompt_id = b.prompt_id AND b.rank > a.rank WHERE a.overall IS NOT NULL AND b.overall IS NOT NULL")
_PROB = "case when a.score + b.score < 1e-9 then 0.0 else a.score / nullif(a.score + b.score, 0) end"
_PAIRS = f"SELECT a.descr, concat(a.descr, '</s>', a.prompt) AS left, concat(b.descr, '</s>', b.prompt) AS right, {_PROB} AS y FROM {{bt_scores}} a JOIN {{bt_scores}} b ON a.descr = b.descr AND a.prompt < b.prompt"
for _key in ("join_pairs_unordered", "rm_pair_expansion", "rm_pairs"):
    register(_key, lambda get: rw.all_pairs(get("bt_scores")).withColumn("y", F.round("y", 6)), f'SELECT descr, "left", "right", round(y, 6) AS y FROM ({_PAIRS.replace("AS left", chr(65) + "S " + chr(34) + "left" + chr(34)).replace("AS right", "AS " + chr(34) + "right" + chr(34))})')
_QPAIRS = _PAIRS.replace("AS left", 'AS "left"').replace("AS right", 'AS "right"')
for _key in ("orient_pairs", "rm_oriented"):
    register(_key, lambda get: rw.oriented(rw.all_pairs(get("bt_scores"))), f'SELECT case when y >= 0.5 then "left" else "right" end AS chosen, case when y >= 0.5 then "right" else "left" end AS rejected FROM ({_QPAIRS})')
_GB = "SELECT count(*) FILTER (WHERE g.score > b.score) AS wins, count(*) AS pairs, round(avg(case when g.score > b.score then 1.0 else 0.0 end), 6) AS win_rate FROM {rm_labels} g JOIN {rm_labels} b ON g.label = 'good' AND b.label = 'bad'"
register("join_theta_winrate", lambda get: ev.theta_win_rate(get("rm_labels").filter("label = 'good'"), get("rm_labels").filter("label = 'bad'")).withColumn("win_rate", F.round("win_rate", 6)), _GB)


def _time_range(get):
    m = get("messages").filter("content is not null").select("pos", "user_id", "date").withColumn("hour", F.floor(F.unix_timestamp(C("date").cast("timestamp")) / 3600))
    later = m.select("user_id", C("pos").alias("later"), C("date").alias("d2"), F.explode(F.array(C("hour"), C("hour") - 1)).alias("hour"))
    return m.join(later, ["user_id", "hour"]).filter("pos <> later and d2 >= date and d2 - date < interval 1 hour").select("pos", "later")


register("join_time_range", _time_range, "SELECT a.pos, b.pos AS later FROM {messages} a JOIN {messages} b ON a.user_id = b.user_id AND a.pos <> b.pos AND b.date >= a.date AND b.date - a.date < INTERVAL 1 HOUR WHERE a.content IS NOT NULL AND b.content IS NOT NULL")
_TODO = "SELECT prompt_id, candidate_id FROM {judged} j WHERE NOT EXISTS (SELECT 1 FROM {score_log} l WHERE l.prompt_id = j.prompt_id AND l.candidate_id = j.candidate_id)"
for _key in ("join_anti_done", "scores_resume_todo"):
    register(_key, lambda get: j.todo(get("judged").select("prompt_id", "candidate_id"), get("score_log")), _TODO)
_LOGGED = "cast(substr(prompt, 8) as bigint) % 3 = 0"
for _key in ("join_anti_labelled", "label_todo"):
    register(_key, lambda get: lab.to_label(get("label_log").select("prompt").distinct(), get("label_log").filter(_LOGGED)), f"SELECT DISTINCT prompt FROM {{label_log}} WHERE prompt NOT IN (SELECT prompt FROM {{label_log}} WHERE {_LOGGED})")
_VAL = "substr(descr, 2) IN ('3', '5', '11')"
register("join_anti_val_desc", lambda get: rw.without_leaks(get("bt_scores"), get("bt_scores").filter(_VAL), "descr").select("descr", "prompt"), f"SELECT descr, prompt FROM {{bt_scores}} WHERE NOT ({_VAL})")
register("join_semi_train_desc", lambda get: get("bt_wins").join(get("bt_scores").filter(_VAL), "descr", "left_semi"), f"SELECT descr, winner, loser FROM {{bt_wins}} WHERE {_VAL}")
register("join_zip_positional", lambda get: zip_rows(get("label_log").select(C("line_no").alias("i"), "prompt"), get("documents").select(C("doc_id").alias("i"), "lang"), "i"), "SELECT line_no AS i, prompt, lang FROM {label_log} JOIN {documents} ON doc_id = line_no")
_CKPT = ("base", "mid", "final")
_WIDE = "SELECT prompt_idx, sample_idx, " + ", ".join(f"max(case when checkpoint = '{c}' then rm_score end) AS {c}__rm_score" for c in _CKPT) + " FROM {checkpoint_scores} GROUP BY prompt_idx, sample_idx"
for _key in ("join_checkpoints_wide", "ckpt_wide"):
    register(_key, lambda get: ev.wide_checkpoints(get("checkpoint_scores"), list(_CKPT)), _WIDE)


def _base_vs(get):
    s = get("checkpoint_scores")
    return ev.paired(s.filter("checkpoint = 'base'"), s.filter("checkpoint = 'final'"), ["prompt_idx", "sample_idx"])


_PAIRED = "SELECT a.prompt_idx, a.sample_idx, a.rm_score AS base, b.rm_score AS other FROM {checkpoint_scores} a JOIN {checkpoint_scores} b ON a.prompt_idx = b.prompt_idx AND a.sample_idx = b.sample_idx AND a.checkpoint = 'base' AND b.checkpoint = 'final'"
register("join_base_vs_ppo", _base_vs, _PAIRED)
_rounded = lambda df, *cols: df.withColumns({c: F.round(c, 6) for c in cols})
register("win_rate", lambda get: _rounded(ev.paired_stats(_base_vs(get)), "delta", "win_rate"), f"SELECT round(avg(other) - avg(base), 6) AS delta, sum(cast(other > base as integer)) AS wins, round(avg(cast(other > base as integer)), 6) AS win_rate FROM ({_PAIRED})")


def _as_of(get):
    """Each order's latest earlier order of the same customer, by one window."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    return get("orders").select("o_orderkey", F.lag("o_orderkey").over(w).alias("before"))


register("join_as_of", _as_of, "SELECT o_orderkey, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS before FROM {orders}")

# aggregations
register("agg_count", lambda get: get("messages").agg(F.count(F.lit(1)).alias("n"), F.count_if(C("content").contains("sex")).alias("n_sex"), F.count("content").alias("n_content")), "SELECT count(*) AS n, count(*) FILTER (WHERE contains(content, 'sex')) AS n_sex, count(content) AS n_content FROM {messages}")
register("agg_value_counts", lambda get: get("messages").filter("content is not null").groupBy(t.count_of(C("content"), "/dream prompt:").alias("parts")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "parts"), "SELECT len(string_split(content, '/dream prompt:')) - 1 AS parts, count(*) AS n FROM {messages} WHERE content IS NOT NULL GROUP BY 1")


def _best_worst_sql(worst: str, gap: str = "", extra: str = "") -> str:
    return f"""
WITH s AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY overall DESC, candidate_id) AS b, row_number() OVER (PARTITION BY prompt_id ORDER BY overall, candidate_id {worst}) AS w, count(*) OVER (PARTITION BY prompt_id) AS n FROM {{judged}} WHERE overall IS NOT NULL)
SELECT c.prompt_id, c.candidate_id AS chosen_id, r.candidate_id AS rejected_id, c.expansion AS chosen, r.expansion AS rejected, c.overall AS chosen_score, r.overall AS rejected_score, c.overall - r.overall AS score_gap
FROM s c JOIN s r ON c.prompt_id = r.prompt_id AND c.b = 1 AND r.w = 1 WHERE c.n >= 2 {gap} {extra}"""


for _key in ("agg_best_worst", "pairs_best_worst", "pair_best_worst"):
    register(_key, lambda get: p.best_worst(get("judged")), _best_worst_sql("", "AND c.overall - r.overall >= 2"))
for _key in ("agg_best_worst_stable", "pairs_best_worst_stable"):
    register(_key, lambda get: p.best_worst(get("judged"), min_gap=None, last_of_tied_worst=True, different=True), _best_worst_sql("DESC", "", "AND c.expansion <> r.expansion"))
_HIST = "WITH c AS (SELECT v AS value, count(overall) AS n FROM range(1, 11) t(v) LEFT JOIN {judged} ON overall = v GROUP BY v) SELECT value, n, repeat('█', cast(floor(n * 40 / (SELECT max(n) FROM c)) as integer)) AS bar FROM c"
for _key in ("agg_histogram_1_10", "judge_histogram"):
    register(_key, lambda get: j.histogram(get("judged")), _HIST)
_DIST = "SELECT count(*) AS n, round(avg(overall), 6) AS mean, avg(overall) > 8.5 AS over_rating, avg(overall) < 3 AS under_rating, avg(case when overall <= 3 then 1.0 else 0 end) > 0.7 OR avg(case when overall >= 8 then 1.0 else 0 end) > 0.7 AS one_sided FROM {judged} WHERE overall IS NOT NULL"
for _key in ("agg_dist_warnings", "judge_dist_warnings"):
    register(_key, lambda get: j.distribution_warnings(get("judged")), _DIST)
_MEANS = " UNION ALL ".join(f"SELECT '{f}' AS objective, round(avg({f}), 6) AS mean, count({f}) AS n FROM {{judged}} WHERE overall IS NOT NULL" for f in OBJECTIVE_FIELDS)
for _key in ("agg_objective_means", "judge_objective_means"):
    register(_key, lambda get: j.objective_means(get("judged")), _MEANS)
for _key in ("agg_failure_modes", "judge_failure_modes"):
    register(_key, lambda get: j.failure_modes(judged(get)), "SELECT mode, count(*) AS n FROM (SELECT unnest(string_split(failure_modes_csv, ',')) AS mode FROM {judged} WHERE overall IS NOT NULL) GROUP BY mode")
register("judge_overall_audit", lambda get: _audit(get), "SELECT doc_id, overall AS declared, round(0.25 * fidelity + 0.2 * visual_specificity + 0.15 * style_fit + 0.15 * composition_lighting + 0.15 * non_genericness + 0.1 * coherence, 6) AS weighted FROM {judged} WHERE fidelity > 4 AND anti_magic_word_score > 4 AND failure_modes_csv = 'none'")


def _audit(get):
    from prefforge.functions.numeric import weighted_overall

    rows = judged(get).filter("fidelity > 4 and anti_magic_word_score > 4 and failure_modes_csv = 'none'")
    return rows.select("doc_id", C("overall").alias("declared"), F.round(weighted_overall(), 6).alias("weighted"))


def _priority_skips(get):
    """Reasons of the loose builder: of candidates by the guardrails, of ordered pairs by gap and core."""
    s = p.scored_enough(judged(get))
    guard = p.guardrail_failure(LOOSE_GUARDRAILS)
    by_candidate = s.select(guard.alias("reason")).filter("reason is not null")
    rows = s.withColumn("guard", guard).select("prompt_id", "guard", F.struct("candidate_id", "overall", *[C(f) for f in OBJECTIVE_FIELDS]).alias("c"))
    both = rows.filter("guard is null").join(rows.select("prompt_id", C("c").alias("r")), "prompt_id").filter("c.candidate_id <> r.candidate_id")
    by_pair = both.select(F.when(C("c.overall") - C("r.overall") < 1, "pair_gap_lt_1").otherwise(p.core_failure(C("c"), C("r"))).alias("reason")).filter("reason is not null")
    few = get("judged").groupBy("prompt_id").agg(F.count("overall").alias("n")).filter("n < 2").select(F.lit("prompt_lt_2_scored_candidates").alias("reason"))
    return by_candidate.unionByName(by_pair).unionByName(few).groupBy("reason").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "reason").limit(20)


_SKIPS = f"""
WITH s AS (SELECT * FROM (SELECT *, count(overall) OVER (PARTITION BY prompt_id) AS k, {_guard_sql(LOOSE_GUARDRAILS)} AS guard FROM {{judged}}) WHERE overall IS NOT NULL AND k >= 2),
r AS (SELECT guard AS reason FROM s WHERE guard IS NOT NULL
  UNION ALL SELECT case when c.overall - r.overall < 1 then 'pair_gap_lt_1' else {_CORE} end FROM s c JOIN s r ON c.prompt_id = r.prompt_id AND c.candidate_id <> r.candidate_id WHERE c.guard IS NULL
  UNION ALL SELECT 'prompt_lt_2_scored_candidates' FROM {{judged}} GROUP BY prompt_id HAVING count(overall) < 2)
SELECT reason, count(*) AS n FROM r WHERE reason IS NOT NULL GROUP BY reason ORDER BY n DESC, reason LIMIT 20"""
for _key in ("agg_skip_reasons", "pair_skip_reasons", "srt_counter"):
    register(_key, _priority_skips, _SKIPS)

# greedy matching as recursion over the eligible edges of each prompt in their order
_EDGES = f"""k AS (SELECT * FROM {_RANKED} WHERE n_scored >= 2),
e AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY a, b DESC) AS i FROM (
  SELECT c.prompt_id, c.rank AS a, r.rank AS b, c.n_scored, c.candidate_id AS chosen_id, r.candidate_id AS rejected_id, c.expansion AS chosen, r.expansion AS rejected, c.overall AS chosen_score, r.overall AS rejected_score, c.overall - r.overall AS score_gap
  FROM (SELECT *, {_guard_sql(STRICT_GUARDRAILS)} AS guard FROM k) c JOIN k r ON c.prompt_id = r.prompt_id AND r.rank > c.rank
  WHERE guard IS NULL AND c.overall IS NOT NULL AND r.overall IS NOT NULL AND c.overall - r.overall >= 2 AND {_CORE} IS NULL)),
f AS (SELECT prompt_id, cast(0 as bigint) AS i, cast([] as bigint[]) AS ta, cast([] as bigint[]) AS tb, false AS took FROM (SELECT DISTINCT prompt_id FROM e)
  UNION ALL SELECT e.prompt_id, e.i, case when ok then list_append(ta, e.a) else ta end, case when ok then list_append(tb, e.b) else tb end, ok
  FROM (SELECT f.prompt_id, f.i + 1 AS j, ta, tb FROM f) f JOIN (SELECT * FROM e) e ON e.prompt_id = f.prompt_id AND e.i = f.j, LATERAL (SELECT len(ta) < 4 AND NOT list_contains(ta, e.a) AND NOT list_contains(tb, e.b) AS ok))"""
_GREEDY = f"""WITH RECURSIVE {_EDGES}
SELECT e.prompt_id, row_number() OVER (PARTITION BY e.prompt_id ORDER BY e.i) - 1 AS slot, chosen_id, rejected_id, chosen, rejected, chosen_score, rejected_score, score_gap, a AS chosen_rank, b AS rejected_rank,
  case when a = 0 and b = n_scored - 1 then 'best_vs_worst' when score_gap >= 4 then 'high_gap' when score_gap >= 2 then 'medium_gap' else 'low_gap' end AS pair_quality
FROM f JOIN e ON f.prompt_id = e.prompt_id AND f.i = e.i WHERE took"""
for _key in ("pair_greedy_multi", "pairs_greedy_multi"):
    register(_key, lambda get: p.greedy_multi(judged(get)), _GREEDY)
_TARGET = 100
for _key in ("pair_round_robin", "pairs_round_robin", "win_slot_round_robin", "lim_target_pairs"):
    register(_key, lambda get: p.round_robin(p.greedy_multi(judged(get)), _TARGET).select("prompt_id", "slot", "chosen_id", "rejected_id"), f"{_GREEDY.replace('SELECT e.prompt_id, row', 'SELECT prompt_id, slot, chosen_id, rejected_id FROM (SELECT e.prompt_id, row')}) ORDER BY slot, prompt_id LIMIT {_TARGET}")
# pairs that the matching looked at in vain: of candidates before the fourth pair, with those not rejected yet, from the worst on
_LOOKED = f"""WITH RECURSIVE {_EDGES}, t AS (SELECT e.prompt_id, e.a, e.b FROM f JOIN e ON f.prompt_id = e.prompt_id AND f.i = e.i WHERE took),
u AS (SELECT prompt_id, count(*) AS n_pairs, max(a) AS last FROM t GROUP BY prompt_id), h AS (SELECT k.*, {_guard_sql(STRICT_GUARDRAILS)} AS guard, n_pairs, last FROM k LEFT JOIN u ON u.prompt_id = k.prompt_id WHERE overall IS NOT NULL),
s AS (SELECT * FROM h WHERE coalesce(n_pairs, 0) < 4 OR rank <= last),
q AS (SELECT guard AS reason FROM s WHERE guard IS NOT NULL UNION ALL SELECT case when c.overall - r.overall < 2 then 'gap_too_small' else {_CORE} end FROM s c JOIN h r ON r.prompt_id = c.prompt_id AND r.rank > c.rank WHERE c.guard IS NULL
  AND NOT EXISTS (SELECT 1 FROM t WHERE t.prompt_id = c.prompt_id AND t.a = c.rank AND t.b >= r.rank) AND NOT EXISTS (SELECT 1 FROM t WHERE t.prompt_id = c.prompt_id AND t.b = r.rank AND t.a < c.rank))
SELECT reason, count(*) AS n FROM q WHERE reason IS NOT NULL GROUP BY reason"""
register("greedy_skip_reasons", lambda get: p.greedy_skips(judged(get)), _LOOKED)
register("agg_pair_quality", lambda get: p.greedy_multi(judged(get)).groupBy("pair_quality").agg(F.count(F.lit(1)).alias("n")), f"{_GREEDY.replace('SELECT e.prompt_id, row', 'SELECT pair_quality, count(*) AS n FROM (SELECT e.prompt_id, row')}) GROUP BY pair_quality")
_PRIO_ALL = f"""
WITH s AS (SELECT * FROM (SELECT *, count(overall) OVER (PARTITION BY prompt_id) AS k FROM {{judged}}) WHERE overall IS NOT NULL AND k >= 2),
x AS (SELECT c.prompt_id, c.candidate_id AS chosen_id, r.candidate_id AS rejected_id, c.expansion AS chosen, r.expansion AS rejected, c.overall AS chosen_score, r.overall AS rejected_score, c.overall - r.overall AS score_gap,
  cast(3 * (c.overall - r.overall) + case when r.failure_modes_csv in ('magic_words', 'off_topic') then 2 else 0 end + case when r.failure_modes_csv in ('too_generic', 'restatement,too_verbose') then 1 else 0 end as double) + c.overall / 10 + c.anti_magic_word_score / 10 AS priority
  FROM (SELECT *, {_guard_sql(LOOSE_GUARDRAILS)} AS guard FROM s) c JOIN s r ON c.prompt_id = r.prompt_id AND c.candidate_id <> r.candidate_id WHERE guard IS NULL AND c.overall - r.overall >= 1 AND {_CORE} IS NULL),
y AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY priority DESC, chosen_id, rejected_id) AS place FROM x)
"""
_PRIO = _PRIO_ALL + "SELECT prompt_id, chosen_id, rejected_id, chosen, rejected, chosen_score, rejected_score, score_gap, round(priority, 6) AS priority, place FROM y WHERE place <= 4"
for _key in ("pair_priority_multi", "pairs_priority_multi", "win_topn_per_prompt"):
    register(_key, lambda get: _rounded(p.priority_multi(judged(get), target=None), "priority"), _PRIO)
register("lim_global_priority", lambda get: _rounded(p.priority_multi(judged(get), target=60), "priority").select("prompt_id", "chosen_id", "rejected_id", "priority"), f"{_PRIO_ALL} SELECT prompt_id, chosen_id, rejected_id, round(priority, 6) AS priority FROM y WHERE place <= 4 ORDER BY priority DESC, prompt_id, place LIMIT 60".replace("ORDER BY priority DESC, prompt_id, place LIMIT", "ORDER BY y.priority DESC, prompt_id, place LIMIT"))
register("agg_pair_summary", lambda get: p.pair_summary(judged(get), p.priority_multi(judged(get), target=None)), _PRIO_ALL + "SELECT count(*) AS valid_prompts, cast(sum(n) as bigint) AS pairs, count(*) FILTER (WHERE n > 0) AS prompts_with_pairs, round(sum(n) / count(*), 6) AS mean_pairs FROM (SELECT v.prompt_id, count(y.prompt_id) AS n FROM (SELECT DISTINCT prompt_id FROM s) v LEFT JOIN (SELECT * FROM y WHERE place <= 4) y ON y.prompt_id = v.prompt_id GROUP BY v.prompt_id)")
register("agg_cands_per_prompt", lambda get: get("judged").groupBy("prompt_id").agg(F.collect_list("expansion").alias("c")).groupBy(F.size("c").alias("n_candidates")).agg(F.count(F.lit(1)).alias("n")), "SELECT n_candidates, count(*) AS n FROM (SELECT count(*) AS n_candidates FROM {judged} GROUP BY prompt_id) GROUP BY n_candidates")
register("agg_missing_objectives", lambda get: j.missing_objectives(get("judged")), "SELECT count(*) FILTER (WHERE fidelity IS NULL) AS n_missing, count(*) AS n FROM {judged}")
for _key in ("agg_token_total", "label_cost"):
    register(_key, lambda get: lab.total_tokens(get("label_log")), "SELECT cast(sum(tokens) as bigint) AS tokens, round_even(sum(tokens) / 1000 * 0.02, 2) AS cost FROM {label_log}")
_SUMMARY_COLS = ["rm_mean", "rm_std_overall", "rm_std_across_prompts", "rm_min", "rm_max", "frac_above_0_5", "frac_at_ceiling_0_9"]
_SUMMARY = """SELECT a.checkpoint, rm_mean, rm_std_overall, rm_std_across_prompts, rm_min, rm_max, frac_above_0_5, frac_at_ceiling_0_9 FROM
(SELECT checkpoint, avg(rm_score) AS rm_mean, stddev_pop(rm_score) AS rm_std_overall, min(rm_score) AS rm_min, max(rm_score) AS rm_max, avg(case when rm_score > 0.5 then 1.0 else 0.0 end) AS frac_above_0_5, avg(case when rm_score > 0.9 then 1.0 else 0.0 end) AS frac_at_ceiling_0_9 FROM {checkpoint_scores} GROUP BY checkpoint) a
JOIN (SELECT checkpoint, stddev_pop(m) AS rm_std_across_prompts FROM (SELECT checkpoint, prompt_idx, avg(rm_score) AS m FROM {checkpoint_scores} GROUP BY checkpoint, prompt_idx) GROUP BY checkpoint) b ON a.checkpoint = b.checkpoint"""
for _key in ("agg_rm_summary", "rm_summary", "checkpoint_compare"):
    register(_key, lambda get: _rounded(ev.rm_summary(get("checkpoint_scores")), *_SUMMARY_COLS), "SELECT checkpoint, " + ", ".join(f"round({c}, 6) AS {c}" for c in _SUMMARY_COLS) + f" FROM ({_SUMMARY})")
_ORD = "case checkpoint when 'base' then 0 when 'mid' then 1 else 2 end"
_FLAGS = f"""WITH z AS (SELECT *, {_ORD} AS ord FROM ({_SUMMARY})),
q AS (SELECT max(case when ord = 2 then rm_mean end) AS m2, max(case when ord = 1 then rm_mean end) AS m1, max(case when ord = 0 then rm_mean end) AS m0, max(case when ord = 2 then rm_std_overall end) AS s2, max(case when ord = 0 then rm_std_overall end) AS s0, max(case when ord = 2 then frac_at_ceiling_0_9 end) AS c2, max(case when ord = 0 then frac_at_ceiling_0_9 end) AS c0 FROM z)
SELECT 'accelerating_reward' AS flag, m2 - m1 > 1.5 * (m1 - m0) AND m2 - m1 > 0.1 AS raised FROM q UNION ALL SELECT 'std_collapsed', s2 < 0.5 * s0 FROM q UNION ALL SELECT 'ceiling_saturated', c2 > 0.3 AND c0 < 0.05 FROM q UNION ALL SELECT 'no_strong_flags', s2 >= 0.5 * s0 AND c2 <= 0.3 FROM q"""
for _key in ("hacking_flags", "win_lag_acceleration", "win_first_last_compare"):
    register(_key, lambda get: ev.hacking_flags(ev.rm_summary(get("checkpoint_scores")).withColumn("ord", F.expr(_ORD))), _FLAGS)
register("agg_reward_stats", lambda get: _rounded(ev.reward_stats(get("checkpoint_scores")), "mean", "min", "max", "std", "frac_positive"), "SELECT round(avg(rm_score), 6) AS mean, round(min(rm_score), 6) AS min, round(max(rm_score), 6) AS max, round(stddev_pop(rm_score), 6) AS std, round(avg(case when rm_score > 0 then 1.0 else 0.0 end), 6) AS frac_positive, count(*) AS n FROM {checkpoint_scores}")
for _key in ("agg_good_bad", "good_bad_separation"):
    register(_key, lambda get: _rounded(ev.good_bad(get("rm_labels")), "mean"), "SELECT label, count(*) AS n, round(avg(score), 6) AS mean, min(score) AS min, max(score) AS max FROM {rm_labels} GROUP BY label")
register("rm_separation", lambda get: _rounded(ev.rm_separation(get("rm_labels")), "gap", "win_rate"), f"SELECT round(gap, 6) AS gap, wins, pairs, win_rate, gap > 0 AND win_rate > 0.9 AS passed FROM (SELECT avg(case when label = 'good' then score end) - avg(case when label = 'bad' then score end) AS gap FROM {{rm_labels}}), ({_GB})")
_DEG = r"""WITH w AS (SELECT doc_id, unnest(regexp_extract_all(dpo, '[\p{{L}}\p{{N}}_]+')) AS token FROM {review}), c AS (SELECT doc_id, token, count(*) AS n FROM w GROUP BY doc_id, token), s AS (SELECT doc_id, sum(n) AS n_tokens, max(n) AS top FROM c GROUP BY doc_id)
SELECT r.doc_id, cast(coalesce(n_tokens, 0) as bigint) AS n_tokens, round(coalesce(top / n_tokens, 0), 6) AS top_share, coalesce(n_tokens > 5 AND top / n_tokens > 0.6, false) AS degenerate FROM {review} r LEFT JOIN s ON s.doc_id = r.doc_id"""
register("agg_degenerate", lambda get: _rounded(ev.degenerate(get("review"), "doc_id", "dpo"), "top_share"), _DEG)


def _bt_sql(rounds: int) -> str:
    """The minorise-maximise steps, one after another."""
    out = """WITH c AS (SELECT descr, winner, loser, count(*) AS n FROM {bt_wins} GROUP BY descr, winner, loser),
i AS (SELECT descr, winner AS prompt FROM c UNION SELECT descr, loser FROM c),
w AS (SELECT i.descr, i.prompt, coalesce(sum(c.n), 0) AS wins FROM i LEFT JOIN c ON c.descr = i.descr AND c.winner = i.prompt GROUP BY i.descr, i.prompt),
b AS (SELECT descr, winner AS p, loser AS o, n FROM c UNION ALL SELECT descr, loser, winner, n FROM c),
p0 AS (SELECT descr, prompt, 1.0 / count(*) OVER (PARTITION BY descr) AS s FROM i)"""
    for k in range(1, rounds + 1):
        out += f""",
r{k} AS MATERIALIZED (SELECT w.descr, w.prompt, any_value(w.wins) / sum(b.n / (x.s + y.s)) AS s FROM w JOIN b ON b.descr = w.descr AND b.p = w.prompt JOIN p{k - 1} x ON x.descr = w.descr AND x.prompt = w.prompt JOIN p{k - 1} y ON y.descr = b.descr AND y.prompt = b.o GROUP BY w.descr, w.prompt),
p{k} AS MATERIALIZED (SELECT descr, prompt, s / sum(s) OVER (PARTITION BY descr) AS s FROM r{k})"""
    return out + f" SELECT descr, prompt, round(s, 6) AS score FROM p{rounds}"


for _key in ("agg_bradley_terry", "rm_bt_scores"):
    register(_key, lambda get: _rounded(rw.bradley_terry(get("bt_wins"), iterations=10), "score"), _bt_sql(10))
register("agg_vocab", lambda get: rw.vocabulary(get("img_map")), r"SELECT DISTINCT unnest(string_split(prompt, ' ')) AS word FROM {img_map}")
register("agg_groupby_desc", lambda get: get("img_map").filter("descr is not null").groupBy("descr").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("prompt").alias("n_prompts")).orderBy("descr"), "SELECT descr, count(*) AS n, count(DISTINCT prompt) AS n_prompts FROM {img_map} GROUP BY descr")


def _checks(get):
    kl = get("token_logps").select((F.abs("chosen_logp") % 3).alias("kl"))
    return ev.sanity_checks(get("review"), _base_vs(get), kl, "doc_id", "dpo").select("check_name", "status")


_CHECKS = f"""WITH d AS ({_DEG.replace("WITH w AS", "SELECT * FROM (WITH w AS")})), z AS ({_PAIRED}), t AS (SELECT avg(abs(chosen_logp) % 3) AS kl FROM {{token_logps}}), s AS (SELECT avg(other) AS mean, stddev_pop(other) AS std, avg(other) - avg(base) AS delta, avg(cast(other > base as integer)) AS wr, avg(cast(other > 0 as integer)) AS fp FROM z),
v AS (SELECT sum(cast(trim(dpo) = '' as integer)) AS empty FROM {{review}}), g AS (SELECT sum(cast(degenerate as integer)) AS bad FROM d)
SELECT check_name, case when ok is null then 'warn' when ok then 'pass' else 'fail' end AS status FROM (
SELECT 'empty_outputs' AS check_name, empty = 0 AS ok FROM v UNION ALL SELECT 'repetition_check', bad = 0 FROM g UNION ALL SELECT 'reward_mean', mean > 0 FROM s UNION ALL SELECT 'reward_diversity', case when std >= 0.01 then true end FROM s
UNION ALL SELECT 'reward_improvement', delta > 0 FROM s UNION ALL SELECT 'win_rate', wr >= 0.5 FROM s UNION ALL SELECT 'kl_divergence', case when kl between 0.1 and 20 then true end FROM t UNION ALL SELECT 'val_frac_positive', fp >= 0.5 FROM s)"""
register("sanity_checks", _checks, _CHECKS)
register("agg_check_status", lambda get: ev.overall_status(_checks(get)), f"SELECT cast(count(*) FILTER (WHERE status = 'pass') as bigint) AS n_pass, count(*) FILTER (WHERE status = 'warn') AS n_warn, count(*) FILTER (WHERE status = 'fail') AS n_fail, case when count(*) FILTER (WHERE status = 'fail') > 0 then 'fail' when count(*) FILTER (WHERE status = 'warn') > 0 then 'warn' else 'pass' end AS overall, cast(count(*) FILTER (WHERE status = 'fail') > 0 as integer) AS exit_code FROM (SELECT * FROM ({_CHECKS}))")
for _key in ("agg_group_advantage", "group_advantage"):
    register(_key, lambda get: _rounded(tr.group_advantage(get("checkpoint_scores").filter("checkpoint = 'mid'").select("prompt_idx", "sample_idx", "rm_score"), "prompt_idx", "rm_score"), "advantage"), "SELECT prompt_idx, sample_idx, rm_score, round((rm_score - avg(rm_score) OVER w) / (coalesce(stddev_samp(rm_score) OVER w, 0) + 1e-4), 6) AS advantage FROM {checkpoint_scores} WHERE checkpoint = 'mid' WINDOW w AS (PARTITION BY prompt_idx)")
for _key in ("agg_step_reward", "step_reward"):
    register(_key, lambda get: _rounded(tr.step_reward(get("checkpoint_scores"), "prompt_idx", "rm_score"), "mean_reward"), "SELECT prompt_idx, round(avg(rm_score), 6) AS mean_reward FROM {checkpoint_scores} GROUP BY prompt_idx")
register("agg_sweep_best", lambda get: tr.sweep_best(get("runs")), "SELECT run, loss FROM {runs} ORDER BY loss, run LIMIT 1")
for _key in ("agg_dpo_accuracy", "dpo_loss"):
    register(_key, lambda get: _rounded(tr.dpo_metrics(get("token_logps")), "loss", "accuracy", "margin"), "SELECT round(avg(ln(1 + exp(-z))), 6) AS loss, round(avg(cast(z > 0 as integer)), 6) AS accuracy, round(avg(z), 6) AS margin FROM (SELECT 0.1 * ((chosen_logp - rejected_logp) - (ref_chosen_logp - ref_rejected_logp)) AS z FROM {token_logps})")

# windows
register("win_rank_candidates", lambda get: p.ranked(get("judged")).select("doc_id", "rank", "n_scored"), f"SELECT doc_id, rank, n_scored FROM {_RANKED}")
register("win_pair_quality", lambda get: p.greedy_multi(judged(get)).select("prompt_id", "slot", "pair_quality"), _GREEDY.replace("SELECT e.prompt_id, row", "SELECT prompt_id, slot, pair_quality FROM (SELECT e.prompt_id, row") + ")")
_LAST = "SELECT prompt, description FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY line_no DESC) AS n FROM {label_log}) WHERE n = 1"
for _key in ("win_last_wins", "label_replay"):
    register(_key, lambda get: lab.replay(get("label_log")).select("prompt", "description"), _LAST)
register("win_running_total", lambda get: lab.running_tokens(get("label_log").withColumn("p", C("line_no") % 50), partition="p").select("line_no", "running"), "SELECT line_no, cast(sum(tokens) OVER (PARTITION BY line_no % 50 ORDER BY line_no) as bigint) AS running FROM {label_log}")
_BEST = "SELECT step, best_before, step >= 20 AND (best_before IS NULL OR mean_reward > best_before) AS is_best FROM (SELECT *, max(case when step >= 20 then mean_reward end) OVER (PARTITION BY event_type ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best_before FROM {train_steps})"
for _key in ("win_running_best", "running_best"):
    register(_key, lambda get: tr.running_best(get("train_steps"), partition="event_type").select("step", "best_before", "is_best"), _BEST)
for _key in ("win_keep_last_n", "keep_last_n"):
    register(_key, lambda get: tr.keep_last(get("train_steps")).select("step"), "SELECT step FROM {train_steps} WHERE step % 500 = 0 AND step > 0 ORDER BY step DESC LIMIT 3")


def _numbered(get):
    return number_rows(get("img_map").select("image_name"), "image_name")[0]


register("win_row_index", _numbered, "SELECT image_name, row_number() OVER (ORDER BY image_name) - 1 AS at FROM {img_map}")
register("win_group_size", lambda get: get("img_map").select("img_idx", F.count(F.lit(1)).over(Window.partitionBy("descr", "prompt")).alias("n")), "SELECT img_idx, count(*) OVER (PARTITION BY descr, prompt) AS n FROM {img_map}")
def _rung(i: int) -> str:
    """SQL of rung i: the runs that are alive and get there, with the loss of their last step up to it, and whether they stop."""
    at, before = 20 * 3**i, "SELECT run FROM {run_steps}" if i == 0 else f"SELECT run FROM r{i - 1} WHERE NOT stopped"
    loss = f"(SELECT run, arg_max(loss, step) AS loss FROM {{run_steps}} WHERE step <= {at} GROUP BY run)"
    ranked = f"SELECT l.run, l.loss, row_number() OVER (ORDER BY l.loss, l.run) AS n, count(*) OVER () AS c FROM {loss} l JOIN (SELECT run FROM {{run_steps}} GROUP BY run HAVING max(step) >= {at}) g ON g.run = l.run WHERE l.run IN ({before})"
    return f"r{i} AS MATERIALIZED (SELECT run, {i} AS rung, cast({at} as bigint) AS at_step, round(loss, 6) AS loss, n > ceil(c / 3) AS stopped FROM ({ranked}))"


register("win_hyperband_stop", lambda get: _rounded(tr.hyperband_stop(get("run_steps")), "loss"), "WITH " + ", ".join(map(_rung, range(4))) + " " + " UNION ALL ".join(f"SELECT * FROM r{i}" for i in range(4)))
_KEY = "(img_idx * 7919 + 17) % 1009"
register("win_group_random", lambda get: rw.one_of_group(get("img_map").withColumn("k", F.expr(_KEY)), "descr", F.struct("k", "img_idx")).select("descr", "prompt"), f"SELECT descr, prompt FROM (SELECT *, row_number() OVER (PARTITION BY descr ORDER BY {_KEY}, img_idx) AS n FROM {{img_map}}) WHERE n = 1")

# sorts, limits, samples
register("srt_user_date_desc", lambda get: get("messages").select("pos", F.row_number().over(Window.partitionBy("user_id").orderBy(F.desc("date"), F.desc("pos"))).alias("place")), "SELECT pos, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, pos DESC) AS place FROM {messages}")
register("srt_date", lambda get: number_rows(get("messages").select("pos", F.struct("date", "pos").alias("o")), "o")[0].select("pos", C("at").alias("place")), "SELECT pos, row_number() OVER (ORDER BY date, pos) - 1 AS place FROM {messages}")
register("lim_n", lambda get: get("label_log").orderBy("line_no").limit(50).select("line_no"), "SELECT line_no FROM {label_log} ORDER BY line_no LIMIT 50")
register("lim_max_samples", lambda get: get("sft_text").orderBy("id").limit(100).select("id"), "SELECT id FROM {sft_text} ORDER BY id LIMIT 100")
register("src_limit_prompts", lambda get: get("judged").orderBy("doc_id").limit(100).select("doc_id"), "SELECT doc_id FROM {judged} ORDER BY doc_id LIMIT 100")
register("off_offset", lambda get: skip_rows(get("label_log"), "line_no", 1000, F.struct(F.expr("(line_no * 7919 + 17) % 100003"), "line_no"), 50).select("line_no"), "SELECT line_no FROM {label_log} WHERE line_no >= 1000 ORDER BY (line_no * 7919 + 17) % 100003, line_no LIMIT 50")
register("smp_shuffle", lambda get: exact_first(get("judged").withColumn("k", F.expr("(doc_id * 7919 + 17) % 1009")), ["prompt_id"], F.struct("k", "doc_id")).select("prompt_id", "doc_id"), "SELECT prompt_id, doc_id FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY (doc_id * 7919 + 17) % 1009, doc_id) AS n FROM {judged}) WHERE n = 1")


def _replaced(get):
    rows, n = number_rows(get("documents").select("doc_id"), "doc_id")
    draws = get("events").select("event_id", ((C("event_id") * 7919 + 17) % 1009).alias("draw"))
    return tr.with_replacement(rows, "at", n, draws).select("event_id", "doc_id")


register("smp_with_replacement", _replaced, "SELECT event_id, d.doc_id FROM {events} JOIN (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS place, count(*) OVER () AS n FROM {documents}) d ON place = ((event_id * 7919 + 17) % 1009) % n")
for _key in ("smp_holdout_group", "rm_split"):
    register(_key, lambda get: get("bt_scores").select("descr", "prompt", (F.expr("(cast(substr(descr, 2) as bigint) * 7919 + 17) % 1009 % 10") < 2).alias("held_out")), "SELECT descr, prompt, (cast(substr(descr, 2) as bigint) * 7919 + 17) % 1009 % 10 < 2 AS held_out FROM {bt_scores}")


def _holdout(get):
    rows = get("sft_text").select("id", F.expr("(id * 7919 + 17) % 100003").alias("k"))
    return rw.sample_rows(rows, F.struct("k", "id"), rw.eval_size(rows.count())).select("id")


for _key in ("smp_holdout_row", "holdout"):
    register(_key, _holdout, "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY (id * 7919 + 17) % 100003, id) AS i, count(*) OVER () AS n FROM {sft_text}) WHERE i <= least(200, cast(floor(n / 10) as bigint))")
register("smp_display", lambda get: get("messages").orderBy("pos").limit(3).select("pos"), "SELECT pos FROM {messages} ORDER BY pos LIMIT 3")
for _key in ("flt_top_reward", "top_reward", "layer3_check"):
    register(_key, lambda get: ev.top_reward(get("checkpoint_scores").filter("checkpoint = 'final'"), "rm_score").select("prompt", "sample_idx", "rm_score"), "SELECT prompt, sample_idx, rm_score FROM {checkpoint_scores} WHERE checkpoint = 'final' AND rm_score > 0.9")


def _split(get):
    rows, n = number_rows(get("sft_text").select("id"), "id")
    return split_percent(rows, "at", n)[1].select("id")


for _key in ("src_split_percent", "split_percent"):
    register(_key, _split, "SELECT id FROM (SELECT id, row_number() OVER (ORDER BY id) - 1 AS place, count(*) OVER () AS n FROM {sft_text}) WHERE place < round_even(n * 5 / 100, 0)")

# sets and de-duplication
register("set_concat", lambda get: union_all([get("rm_labels").select("doc_id"), get("judged").select("doc_id")]), "SELECT doc_id FROM {rm_labels} UNION ALL SELECT doc_id FROM {judged}")
register("set_union_distinct", lambda get: get("bt_wins").select(C("winner").alias("p")).union(get("bt_wins").select("loser")).distinct(), "SELECT winner AS p FROM {bt_wins} UNION SELECT loser FROM {bt_wins}")
register("set_list_append", lambda get: j.upsert_scores(get("score_log")).select("prompt_id", "candidate_id").unionByName(j.todo(get("judged").select("prompt_id", "candidate_id"), get("score_log"))), "SELECT prompt_id, candidate_id FROM {judged}")
register("set_intersect", lambda get: judged(get).select("doc_id", F.array_join(F.array_intersect("failure_modes", F.array(F.lit("off_topic"), F.lit("too_verbose"))), ",").alias("value")), "SELECT doc_id, case when failure_modes_csv = 'off_topic' then 'off_topic' when contains(failure_modes_csv, 'too_verbose') then 'too_verbose' else '' end AS value FROM {judged}")
register("set_diff", lambda get: get("judged").select("prompt_id", "candidate_id").exceptAll(get("score_log").select("prompt_id", "candidate_id")), "SELECT prompt_id, candidate_id FROM {judged} EXCEPT ALL SELECT prompt_id, candidate_id FROM {score_log}")
_FIRST = "SELECT pos FROM (SELECT pos, row_number() OVER (PARTITION BY content ORDER BY pos) AS n FROM {messages} WHERE content IS NOT NULL) WHERE n = 1"
for _key in ("dedup_exact_first", "dedup_exact"):
    register(_key, lambda get: exact_first(get("messages").filter("content is not null"), ["content"], "pos").select("pos"), _FIRST)
register("dedup_ordered", lambda get: exact_first(get("documents").withColumn("s", F.trim("text")), ["s"], "doc_id").select("doc_id"), "SELECT min(doc_id) AS doc_id FROM {documents} GROUP BY trim(text, ' ')")
register("dedup_unique", lambda get: exact_first(get("img_map"), ["descr", "prompt"], "img_idx").select("descr", "prompt", "img_idx"), "SELECT descr, prompt, min(img_idx) AS img_idx FROM {img_map} GROUP BY descr, prompt")
register("scores_upsert", lambda get: j.upsert_scores(get("score_log")).select("prompt_id", "candidate_id", "score", "overall", "fidelity"), "SELECT prompt_id, candidate_id, coalesce(score, overall) AS score, coalesce(overall, score) AS overall, fidelity FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, candidate_id ORDER BY line_no DESC) AS n FROM {score_log}) WHERE n = 1")
register("upsert_scores", lambda get: last_wins(get("score_log"), ["prompt_id", "candidate_id"], "line_no").select("prompt_id", "candidate_id", "line_no"), "SELECT prompt_id, candidate_id, max(line_no) AS line_no FROM {score_log} GROUP BY prompt_id, candidate_id")
