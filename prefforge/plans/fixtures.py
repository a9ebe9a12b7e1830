"""Deterministic views of the driver's tables in the shape of preference data.

A view is SQL that Spark and DuckDB both run: integer arithmetic, no hashes, no random numbers. {name} stands for a table
or another view.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from prefforge.functions.constants import OBJECTIVE_FIELDS
from prefforge.functions.tables import table

#: Multiplier, modulus and offset of each objective.
_ARITHMETIC = {"fidelity": (3, 4, 1), "visual_specificity": (5, 4, 1), "style_fit": (7, 3, 1), "composition_lighting": (11, 5, 2), "non_genericness": (13, 3, 1), "coherence": (17, 4, 1), "brevity_control": (19, 5, 2), "anti_magic_word_score": (23, 3, 0)}
_OV = "(1 + (doc_id * doc_id + 3 * cast(floor(doc_id / 8) as bigint)) % 10)"


def _objective(name: str) -> str:
    a, b, c = _ARITHMETIC[name]
    value = f"greatest(1, least(10, {_OV} + (doc_id * {a}) % {b} - {c}))"
    return f"case when doc_id % 41 = 7 then null else {value} end as {name}" if name == "fidelity" else f"{value} as {name}"


_LETTERS = "case (doc_id % 9) when 0 then 'magic_words' when 1 then 'too_generic' when 2 then 'restatement,too_verbose' when 3 then 'off_topic' else 'none' end"
VIEWS = {
    "judged": f"""
SELECT doc_id, cast(floor(doc_id / 8) as bigint) AS prompt_id, doc_id % 8 AS candidate_id,
  concat('concept ', cast(cast(floor(doc_id / 8) as bigint) as string), '</s>') AS prompt, text AS expansion,
  case when doc_id % 37 = 5 then null else {_OV} end AS overall, {", ".join(map(_objective, OBJECTIVE_FIELDS))},
  {_LETTERS} AS failure_modes_csv, concat('because ', cast(doc_id % 5 as string)) AS reason
FROM {{documents}}""",
    "messages": """
SELECT event_id AS pos, ts AS date, user_id, case when event_id % 31 = 0 then null else concat(
  case when event_id % 13 = 0 then 'Dreaming' else 'Dreamt' end, ' in ', cast(event_id % 90 as string), 's for @user', cast(user_id as string), '... ',
  case when event_id % 29 = 0 then 'There were naughty dreams that had to be popped ' else '' end,
  case when event_id % 37 = 0 then '/dream prompt:twice ' else '' end, '/dream prompt:', replace(text, chr(10), ' '),
  case (event_id % 11) when 0 then ' negative_prompt: blurry' when 1 then ' steps:50 seed:7' when 2 then ' --ar 16 9' when 3 then ' 4 k , 3 d' when 4 then ' {{portrait}} (art)' when 5 then ' see http' when 8 then ' seed' when 9 then ' cfg _ scale 7' else '' end, '!') end AS content
FROM (SELECT event_id, ts, user_id, conv, cast(floor(event_id / 256) as bigint) % turns AS place
  FROM (SELECT event_id, ts, user_id, (case when event_id % 3 = 0 then event_id else user_id end) % n_convs AS conv FROM {events} CROSS JOIN (SELECT max(conv_id) + 1 AS n_convs FROM {conversations}) s) e
  JOIN (SELECT conv_id, count(*) AS turns FROM {conversations} GROUP BY conv_id) t ON t.conv_id = e.conv) m
JOIN {conversations} c ON c.conv_id = m.conv AND c.turn = m.place""",
    "checkpoint_scores": """
SELECT checkpoint, ord, cast(floor(doc_id / 3) as bigint) AS prompt_idx, doc_id % 3 AS sample_idx, concat('concept ', cast(cast(floor(doc_id / 3) as bigint) as string)) AS prompt,
  text AS gen, cast((doc_id * 37 + ord * 53) % 200 - 100 + ord * 20 as double) / 100 AS rm_score
FROM {documents} CROSS JOIN (VALUES ('base', 0), ('mid', 1), ('final', 2)) AS c(checkpoint, ord)""",
    "sft_text": """
SELECT u.conv_id * 1000 + u.turn AS id, u.conv_id, concat(u.text, '</s>', a.text) AS text, u.text AS prompt, a.text AS completion
FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
    "score_log": """
SELECT doc_id AS line_no, prompt_id, candidate_id, prompt, expansion, cast(1 as bigint) AS score, cast(null as bigint) AS overall, fidelity FROM {judged} WHERE doc_id % 10 = 0
UNION ALL SELECT 1000000000 + doc_id, prompt_id, candidate_id, prompt, expansion, cast(null as bigint), overall, fidelity FROM {judged} WHERE doc_id % 3 <> 1""",
    "judge_replies": f"""
SELECT doc_id, case (doc_id % 6)
  when 0 then concat('{{{{"score": ', cast({_OV} as string), ', "reason": "fine ', cast(doc_id as string), '"}}}}')
  when 1 then concat('Here it is: ```json ', '{{{{"score": "', cast({_OV} as string), '", "reason": "fenced"}}}}', ' ```')
  when 2 then concat('{{{{"score": 3, "reason": "first"}}}} then {{{{"score": ', cast({_OV} as string), ', "reason": "second"}}}}')
  when 3 then concat('{{{{"score": ', cast({_OV} as string), ', "reason": "valid"}}}} but {{{{"score": 99, "reason": "out"}}}}')
  when 4 then concat('I think score: ', cast({_OV} as string), ' and "reason": "prose"')
  else 'no idea at all' end AS reply
FROM {{documents}}""",
    "img_map": """
SELECT (p_partkey - 1) * 4 + j AS img_idx, p_type AS descr, concat(p_name, ' ', cast(p_partkey as string)) AS prompt, concat(cast(p_partkey as string), '_', cast(j as string)) AS image_name, j AS img_id_in_prompt
FROM {part} CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(j) WHERE NOT (p_partkey % 23 = 0 AND j = 3)""",
    "annotations": """
SELECT a.p_partkey AS task, a.p_type AS descr, concat(cast(a.p_partkey as string), '_0') AS left_0, concat(cast(b.p_partkey as string), '_0') AS right_0,
  case when a.p_partkey % 3 < 2 then 'left' else 'right' end AS result, a.p_partkey % 7 AS worker_id, case when a.p_partkey % 19 = 0 then 'left' else null end AS golden
FROM {part} a JOIN {part} b ON b.p_partkey = a.p_partkey + 1""",
    "bt_wins": """
SELECT concat('d', cast(p_partkey % 17 as string)) AS descr, concat('p', cast((p_partkey * 7) % 5 as string)) AS winner, concat('p', cast(((p_partkey * 7) % 5 + 1 + p_partkey % 4) % 5 as string)) AS loser
FROM {part} WHERE p_partkey % 2 = 1 OR p_partkey % 3 = 0""",
    "bt_scores": """
SELECT DISTINCT concat('d', cast(p_partkey % 17 as string)) AS descr, concat('p', cast((p_partkey * 7) % 5 as string)) AS prompt, cast((p_partkey * 7) % 5 + p_partkey % 17 as double) / 40 AS score FROM {part}""",
    "train_steps": "SELECT event_id AS step, value AS mean_reward, event_type FROM {events}",
    "rm_labels": "SELECT l.doc_id, case when quality = 1 then 'good' else 'bad' end AS label, cast((l.doc_id * 13) % 100 + quality * 40 as double) / 10 AS score FROM {labels} l JOIN {documents} d ON d.doc_id = l.doc_id",
    "label_log": "SELECT o_orderkey AS line_no, concat('prompt ', cast(o_orderkey % 5000 as string)) AS prompt, case when o_orderkey % 7 = 0 then '_no_object' else o_orderpriority end AS description, o_custkey % 100 AS tokens FROM {orders}",
    "token_logps": "SELECT doc_id, cast(0 - (doc_id * 7) % 50 - 1 as double) / 10 AS chosen_logp, cast(0 - (doc_id * 13) % 60 - 1 as double) / 10 AS rejected_logp, cast(0 - (doc_id * 3) % 40 - 1 as double) / 10 AS ref_chosen_logp, cast(0 - (doc_id * 11) % 45 - 1 as double) / 10 AS ref_rejected_logp FROM {documents}",
    "runs": "SELECT concat('run', cast(s_suppkey as string)) AS run, s_suppkey % 4 AS rung, cast((s_suppkey * 37) % 101 as double) / 20 AS loss FROM {supplier}",
    "run_steps": "SELECT concat('run', cast(s_suppkey as string)) AS run, t.step, cast((s_suppkey * 37 + t.step * 13) % 101 as double) / 20 + 100.0 / t.step AS loss FROM {supplier} CROSS JOIN (VALUES (5), (20), (40), (60), (150), (180), (240), (540)) AS t(step) WHERE t.step <= 5 + (s_suppkey * 53) % 700",
    "review": "SELECT doc_id, concat(source, ' ', split_part(text, '.', 1), '</s>') AS prompt, text AS sft, concat('a ', lang, ' picture of ', text, case when doc_id % 4 = 0 then ' 8k Artstation by greg rutkowski HD' else '' end) AS dpo FROM {documents}",
}
_NAMES = re.compile(r"(?<!\{)\{(\w+)\}(?!\})")


def _plain(sql: str) -> str:
    return sql.replace("{{", "{").replace("}}", "}")


#: Tables of short rows from which a view makes long ones: the keys by which they are dealt out first. Read by bytes they are a few
#: tasks, and all that is done with the long rows would be done in these; so it would be behind a join whose partitions are put
#: together by bytes, which those of a table that is dealt to a number are not.
_DEALT = {("messages", "events"): ["event_id"], ("messages", "conversations"): ["conv_id", "turn"]}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a table of the driver."""
    if name not in VIEWS:
        return table(spark, sf_dir, name)
    parts = {n: view(spark, sf_dir, n) for n in _NAMES.findall(VIEWS[name])}
    for n in parts:
        if (name, n) in _DEALT:
            tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
            parts[n] = parts[n].repartition(tasks, *_DEALT[name, n])
    return spark.sql(VIEWS[name], **parts)


def oracle(sql: str) -> str:
    """DuckDB SQL with the views that it names as {name} in front."""
    parts: dict[str, str] = {}

    def add(text: str) -> str:
        for n in _NAMES.findall(text):
            if n in VIEWS and n not in parts:
                body = add(VIEWS[n])
                parts[n] = body
        return _plain(_NAMES.sub(r"\1", text))

    body = add(sql.strip())
    views = ", ".join(f"{n} AS ({b})" for n, b in parts.items())
    if not views:
        return body
    return re.sub(r"^WITH (RECURSIVE )?", lambda m: f"WITH {m[1] or ''}{views}, ", body) if body.startswith("WITH ") else f"WITH {views} {body}"
