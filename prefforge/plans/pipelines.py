"""Queries of sources and sinks, judge parsing, cleaning, tasks, training data, reports and streams."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from prefforge.functions import numeric as n
from prefforge.functions import text as t
from prefforge.functions.constants import ARTIST_WORDS, MAGIC_WORDS
from prefforge.functions.generation import register_candidates
from prefforge.functions.tables import number_rows, shared_folder
from prefforge.operators import cleaning as cl
from prefforge.operators import evaluate as ev
from prefforge.operators import judge as j
from prefforge.operators import labelling as lab
from prefforge.operators import reward as rw
from prefforge.operators import scorer as sc
from prefforge.operators import tasks as tk
from prefforge.operators import training as tr
from prefforge.operators.dedup import near_dup_greedy
from prefforge.plans.registry import QUERIES, SQL, register, scalar
from prefforge.plans.relational import _rounded
from prefforge.plans.scalars import _GLUE, _T, _WORDS, _enc, _grams, _hits, _ids, _ratio, one_byte
from prefforge.sources import files as fs
from prefforge.sources.onefile import write_one_file
from prefforge.streaming.near_dup import near_dup_stream
from prefforge.streaming.score_log import current_scores, read_score_stream, upsert_stream, windowed_means

C = F.col


def _path(df, name: str) -> str:
    return f"{shared_folder(df.sparkSession)}/files/{name}-{uuid.uuid4().hex}"


# sources and sinks: what is written is read back
_DOC = "doc_id long, text string, lang string"
_DOC_SQL = "SELECT doc_id, text, lang FROM {documents}"


def _docs(get):
    return get("documents").select("doc_id", "text", "lang")


def _csv(get, sep=",", index=None):
    df = _docs(get)
    path = _path(df, "csv")
    fs.write_csv(df, path, sep, index, empty_texts=True)
    return fs.read_csv(df.sparkSession, path, sep, _DOC, empty_texts=True)


register("src_csv", lambda get: _csv(get), _DOC_SQL)
register("snk_csv", lambda get: _csv(get), _DOC_SQL)
register("src_tsv", lambda get: _csv(get, "\t"), _DOC_SQL)
register("snk_tsv", lambda get: _csv(get, "\t", "doc_id"), _DOC_SQL)


def _channels(get):
    df = get("label_log").select(C("line_no").alias("Pos"), C("prompt").alias("Content"))
    path = _path(df, "channels")
    for k in range(3):
        fs.write_csv(df.filter(C("Pos") % 3 == k), f"{path}/export-{k}.csv")
    return fs.read_channels(df.sparkSession, path, "Pos long, Content string")


register("src_csv_multi", _channels, "SELECT line_no AS pos, prompt AS content, concat('dreambot-', cast(line_no % 3 + 1 as string)) AS channel FROM {label_log}")


def _jsonl(get):
    df = _docs(get)
    path = _path(df, "jsonl")
    fs.write_jsonl(df.orderBy("doc_id"), path)
    return fs.read_jsonl_strict(df.sparkSession, path, _DOC)


register("src_jsonl_strict", lambda get: _jsonl(get), "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS row_no, doc_id, text, lang FROM {documents}")
register("snk_jsonl", lambda get: _jsonl(get).drop("row_no"), _DOC_SQL)


def _tolerant(get):
    df = get("score_log").select("prompt_id", "candidate_id", "prompt", "expansion", "score", "overall", "fidelity")
    path = _path(df, "scores")
    fs.append_jsonl(df, path)
    df.sparkSession.createDataFrame([("{broken",), ("",), ("[1]",)], "value string").write.mode("append").text(path)
    got = fs.read_scores(df.sparkSession, path)
    return got.select("prompt_id", "candidate_id", F.coalesce("overall", "score").alias("overall"), C("fidelity").cast("long").alias("fidelity"))


_TOLERANT = "SELECT prompt_id, candidate_id, coalesce(overall, score) AS overall, fidelity FROM {score_log}"
register("src_jsonl_tolerant", _tolerant, _TOLERANT)
register("snk_append_log", _tolerant, _TOLERANT)


def _log(get):
    rows = get("label_log").withColumn("line_no", C("line_no") + 1)  # line 0 is the header
    line = F.concat(F.lit("2022-10-01 10:00:00,000: "), "prompt", F.lit(" | "), "description", F.lit(" | "), C("tokens").cast("string"), F.lit(" | 0"))
    lines = rows.select("line_no", line.alias("value")).unionByName(rows.sparkSession.createDataFrame([(0, "time: log begins")], "line_no long, value string"))
    return lab.replay(lab.parse_log(lines)).select("prompt", "description", "tokens")


register("src_log_replay", _log, "SELECT prompt, description, tokens FROM (SELECT *, row_number() OVER (PARTITION BY prompt ORDER BY line_no DESC) AS n FROM {label_log}) WHERE n = 1")


def _text(get):
    df = get("label_log").select(C("prompt").alias("value")).distinct()
    path = _path(df, "text")
    df.write.text(path)
    return fs.read_text(df.sparkSession, path, "txt")


register("src_text", _text, "SELECT DISTINCT prompt AS text FROM {label_log}")


def _cache(get):
    df = get("judged").filter("candidate_id = 0").select("prompt_id", "prompt")
    path = _path(df, "cache")
    kind = "prompt_id long, prompt string, candidates array<string>"
    n_rows = df.count()
    for _ in range(2):  # the second time the cache is there
        got = fs.cached_candidates(df.sparkSession, path, kind, n_rows, lambda: sc.with_candidates(df.orderBy("prompt_id"), "prompt", 3))
    return got.select("prompt_id", F.array_join("candidates", "|").alias("c"))


_VARIANTS = "SELECT prompt_id, concat(p, ' variant 0|', p, ' variant 1|', p, ' variant 2') AS c FROM (SELECT prompt_id, split_part(prompt, '</s>', 1) AS p FROM {judged} WHERE candidate_id = 0)"
#: The number that the stubs make of a text: 32 bits of its MD5.
_STUB = "cast(concat('0x', substr(md5(coalesce(expansion, '')), 1, 8)) as bigint)"
register("src_cache_reuse", _cache, _VARIANTS)
register("src_model_generate", lambda get: sc.with_candidates(get("judged").filter("candidate_id = 0").select("prompt_id", "prompt"), "prompt", 3).select("prompt_id", F.array_join("candidates", "|").alias("c")), _VARIANTS)
register("src_model_score", lambda get: sc.with_scores(get("judged").select("doc_id", "expansion"), "expansion").select("doc_id", "rm_score"), f"SELECT doc_id, {_STUB} % 2000 / 1000 - 1 AS rm_score FROM {{judged}}")
register("src_llm_judge", lambda get: sc.with_replies(get("judged").select("doc_id", "expansion"), "expansion").select("doc_id", "reply", "error"), f"""SELECT doc_id, concat('{{{{"score": ', {_STUB} % 10 + 1, ', "reason": "stub"}}}}') AS reply, cast(null as string) AS error FROM {{judged}}""")
register("snk_text_concat", lambda get: fs.concat_text(get("bt_scores").withColumn("k", F.concat("descr", F.lit(" "), "prompt")), "prompt", "k", 20), "SELECT block, string_agg(prompt, '' ORDER BY k) AS text FROM (SELECT prompt, concat(descr, ' ', prompt) AS k, cast(floor((row_number() OVER (ORDER BY concat(descr, ' ', prompt)) - 1) / 20) as bigint) AS block FROM {bt_scores}) GROUP BY block")


def _pairs_table(get):
    return get("judged").filter("candidate_id = 0 and overall is not null").select((C("prompt_id")).alias("i"), "prompt", C("expansion").alias("chosen"), C("overall").alias("chosen_score"), C("reason").alias("rejected"), C("fidelity").alias("rejected_score"))


register("snk_audit_json", lambda get: fs.audit_json(_pairs_table(get), "i", 50).select("i", F.get_json_object("json", "$.prompt").alias("prompt"), F.get_json_object("json", "$.chosen_score").cast("long").alias("chosen_score")), "SELECT prompt_id AS i, prompt, overall AS chosen_score FROM {judged} WHERE candidate_id = 0 AND overall IS NOT NULL ORDER BY prompt_id LIMIT 50")
register(
    "snk_audit_md",
    lambda get: fs.audit_markdown(_pairs_table(get).filter("rejected_score is not null"), "i", 100),
    "SELECT prompt_id AS i, concat('## Pair ', cast(prompt_id + 1 as string), chr(10), chr(10), '**Prompt**: `', prompt, '`', chr(10), chr(10), '**Chosen** (', cast(overall as string), '): ', expansion, chr(10), chr(10), '**Rejected** (', cast(fidelity as string), '): ', reason, chr(10), chr(10)) AS block FROM {judged} WHERE candidate_id = 0 AND overall IS NOT NULL AND fidelity IS NOT NULL ORDER BY prompt_id LIMIT 100",
)

# files: what is written is read back line by line
def _file(get, blocks, ends="\n"):
    path = _path(blocks, "one") + ".txt"
    write_one_file(blocks, "place", "block", path)
    return fs.read_lines(blocks.sparkSession, path, ends)


def _lines_of(blocks: str, head: str = "") -> str:
    """SQL of the lines of blocks (place, block), each of which ends with a line break."""
    cut = "string_split(left(block, length(block) - 1), chr(10))"
    return f"{head} SELECT cast(row_number() OVER (ORDER BY place, k) - 1 AS bigint) AS line_no, line AS value FROM (SELECT place, unnest({cut}) AS line, unnest(range(len({cut}))) AS k FROM ({blocks}))"


def _scored_pairs(get):
    rows = get("judged").filter("candidate_id = 0 and overall is not null")
    side = lambda *names: F.struct(*[C(c) for c in names])
    return rows.select(C("prompt_id").alias("i"), "prompt", C("expansion").alias("chosen"), C("overall").alias("chosen_score"), side("fidelity", "style_fit").alias("chosen_scores"), C("reason").alias("rejected"), C("coherence").alias("rejected_score"), side("coherence", "brevity_control").alias("rejected_scores"))


def _sql_scores(names: list[str], gap: str) -> str:
    return "concat('{{', chr(10), " + ", ',', chr(10), ".join(f"""'{gap}  "{c}": ', coalesce(cast({c} as string), 'null')""" for c in names) + f", chr(10), '{gap}}}}}')"


_JUDGED_PAIRS = "FROM {judged} WHERE candidate_id = 0 AND overall IS NOT NULL ORDER BY prompt_id LIMIT"
_JSON_BLOCKS = f"""SELECT prompt_id AS place, concat('{{{{', chr(10), '  "prompt": ', to_json(prompt), ',', chr(10), '  "chosen": ', to_json(expansion), ',', chr(10), '  "chosen_score": ', cast(overall as string), ',', chr(10), '  "chosen_scores": ', {_sql_scores(["fidelity", "style_fit"], "  ")},
  ',', chr(10), '  "rejected": ', to_json(reason), ',', chr(10), '  "rejected_score": ', cast(coherence as string), ',', chr(10), '  "rejected_scores": ', {_sql_scores(["coherence", "brevity_control"], "  ")}, chr(10), '}}}}', chr(10), chr(10)) AS block {_JUDGED_PAIRS} 50"""
_MD_BLOCKS = f"""SELECT cast(-1 as bigint) AS place, concat('# DPO Pair Audit Sample', chr(10), chr(10), 'Showing first ', cast(count(*) as string), ' pairs. Manually inspect these before training.', chr(10), chr(10)) AS block FROM (SELECT 1 {_JUDGED_PAIRS} 100)
UNION ALL SELECT row_number() OVER (ORDER BY prompt_id) - 1, concat('## Pair ', cast(row_number() OVER (ORDER BY prompt_id) as string), chr(10), chr(10), '**Prompt**: `', prompt, '`', chr(10), chr(10), '**Chosen** (', cast(overall as string), '): ', expansion, chr(10), chr(10), '**Rejected** (', cast(coherence as string), '): ', reason, chr(10), chr(10),
  '**Chosen scores**:', chr(10), chr(10), '```json', chr(10), {_sql_scores(["fidelity", "style_fit"], "")}, chr(10), '```', chr(10), chr(10), '**Rejected scores**:', chr(10), chr(10), '```json', chr(10), {_sql_scores(["coherence", "brevity_control"], "")}, chr(10), '```', chr(10), chr(10)) FROM (SELECT * {_JUDGED_PAIRS} 100)"""
register("file_audit_json", lambda get: _file(get, fs.audit_json_blocks(_scored_pairs(get), "i", 50)), _lines_of(_JSON_BLOCKS))
register("file_audit_md", lambda get: _file(get, fs.audit_markdown_blocks(_scored_pairs(get), "i", 100)), _lines_of(_MD_BLOCKS))
register(
    "file_text_concat", lambda get: _file(get, lab.sft_strings(get("label_log")).select(C("line_no").alias("place"), C("text").alias("block")), "<endoftext>"),
    "SELECT row_number() OVER (ORDER BY line_no) - 1 AS line_no, concat('[BOS]', description, ' = ', prompt) AS value FROM {label_log} WHERE description <> '_no_object'",
)

# judge replies
_FLAT = """SELECT doc_id, case (doc_id % 6) when 5 then null else ov end AS score, case (doc_id % 6) when 0 then concat('fine ', cast(doc_id as string)) when 1 then 'fenced' when 2 then 'second' when 3 then 'valid' when 4 then 'prose' else 'parse_failed: no idea at all' end AS reason
FROM (SELECT doc_id, 1 + (doc_id * doc_id + 3 * cast(floor(doc_id / 8) as bigint)) % 10 AS ov FROM {documents})"""
for _key in ("json_extract_last", "judge_parse_replies"):
    register(_key, lambda get: get("judge_replies").select("doc_id", j.parse_flat(C("reply")).alias("r")).select("doc_id", "r.score", "r.reason"), _FLAT)
register("json_extract_nested", lambda get: get("judge_replies").select("doc_id", j.parse_nested("reply").alias("r")).select("doc_id", C("r.overall").alias("score"), "r.reason"), _FLAT)


def _candidates(get):
    rows = get("judged").groupBy("prompt_id").agg(F.first("prompt").alias("prompt"), F.transform(F.array_sort(F.collect_list(F.struct("candidate_id", "expansion"))), lambda x: x["expansion"]).alias("candidates"))
    return rows


register("arr_posexplode", lambda get: j.explode_candidates(_candidates(get)), "SELECT prompt_id, prompt, candidate_id, expansion FROM {judged}")
register("arr_explode_set", lambda get: get("img_map").groupBy("descr").agg(F.collect_set("prompt").alias("s")).select("descr", F.explode(F.array_distinct("s")).alias("prompt")), "SELECT DISTINCT descr, prompt FROM {img_map}")


def _wrong(get):
    rows = _candidates(get).withColumn("candidates", F.when(C("prompt_id") % 10 == 3, F.slice("candidates", 1, 5)).otherwise(C("candidates")))
    return j.wrong_sizes(rows, 8)


_WRONG = "SELECT prompt_id, cast(case when prompt_id % 10 = 3 then least(5, count(*)) else count(*) end as bigint) AS n_candidates FROM {judged} GROUP BY prompt_id HAVING case when prompt_id % 10 = 3 then least(5, count(*)) else count(*) end <> 8"
for _key in ("validate_candidate_cache", "cache_validation"):
    register(_key, _wrong, _WRONG)


def _resume(get):
    judge = lambda todo: sc.with_scores(todo.select("prompt_id", "candidate_id", "prompt", "expansion"), "expansion").drop("rm_score")
    return j.resume_scoring(_candidates(get), get("score_log"), judge).select("prompt_id", "candidate_id", "overall")


register("resume_scoring", _resume, "SELECT j.prompt_id, j.candidate_id, l.o AS overall FROM {judged} j LEFT JOIN (SELECT prompt_id, candidate_id, coalesce(overall, score) AS o, row_number() OVER (PARTITION BY prompt_id, candidate_id ORDER BY line_no DESC) AS n FROM {score_log}) l ON l.prompt_id = j.prompt_id AND l.candidate_id = j.candidate_id AND n = 1")

# cleaning
_SELECT = """SELECT pos, split_part(split_part(content, 'for @', 2), '... ', 1) AS username, content AS raw, split_part(content, '/dream prompt:', 2) AS body FROM {messages}
WHERE content IS NOT NULL AND string_split(content, ' ')[1] = 'Dreamt' AND NOT contains(content, 'There were naughty dreams that had to be popped') AND NOT contains(content, 'sex') AND len(string_split(content, '/dream prompt:')) = 2 AND len(string_split(content, 'for @')) = 2"""
_EXTRACT = f"SELECT pos, username, split_part(regexp_replace(split_part(left(body, greatest(length(body) - 1, 0)), 'negative_prompt:', 1), ' [^ ]*:.*', '', 'g'), concat(chr(10), '**WARNING:**'), 1) AS content FROM ({_SELECT})"
register("clean_filters", lambda get: cl.one_author(cl.one_prompt(cl.not_nsfw(cl.completed(get("messages"))))).select("pos"), f"SELECT pos FROM ({_SELECT})")
register("clean_bodies", lambda get: cl.extract(get("messages")).select("pos", "username", "content"), _EXTRACT)
_CUT = """SELECT pos, split_part(c, '--', 1) AS content FROM (SELECT pos, split_part(case when ends_with(b, 'seed') and len(string_split(b, 'seed')) = 2 then split_part(b, 'seed', 1) else b end, 'cfg _ scale', 1) AS c
FROM (SELECT pos, split_part(split_part(split_part(case when starts_with(lower(content), 'prompt') then substr(content, 7) else content end, 'negative prompt', 1), 'negative _ prompt', 1), 'negative_prompt', 1) AS b FROM (<rows>))) WHERE NOT (contains(c, '--') AND length(split_part(c, '--', 2)) > 20)"""
register("clean_cut", lambda get: cl.cut_arguments(cl.extract(get("messages"))).select("pos", "content"), _CUT.replace("<rows>", _EXTRACT))
_PLAIN = " .,\"\\-''!–/;&?"
_DIGITS = "\\p{{Nd}}²³¹⁰⁴-⁹₀-₉"
_CHARS = f"SELECT pos, translate(content, '()[]{{{{}}}}|', '') AS content FROM (<rows>) WHERE regexp_matches(regexp_replace(content, '[ .,\"\\-''!/;&?0-9]', '', 'g'), '[\\x00-\\x7F]') AND regexp_matches(content, '\\p{{{{L}}}}') AND NOT contains(content, 'http')"
_CHARS = f"SELECT pos, content FROM ({_CHARS}) WHERE NOT regexp_matches(content, '[^\\p{{{{L}}}}{_DIGITS}{_PLAIN}+*_#|]')".replace("{{{{", "{{").replace("}}}}", "}}")
register("clean_characters", lambda get: cl.filter_characters(cl.cut_arguments(cl.extract(get("messages")))).select("pos", "content"), _CHARS.replace("<rows>", _CUT.replace("<rows>", _EXTRACT)))


def _near(get):
    rows = get("messages").filter("content is not null").select("pos", C("user_id").alias("username"), "date", t.after(C("content"), "/dream prompt:").alias("content"))
    return near_dup_greedy(rows, "username", "date", "content", "pos").select("pos")


#: Of rows m(pos, user_id, date, body): those that near-duplicates leave, as kept(pos).
_NEAR = """m AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY date DESC, pos DESC) AS i FROM (<rows>)),
c AS MATERIALIZED (SELECT a.pos, list(b.pos) AS against FROM m a JOIN m b ON a.user_id = b.user_id AND b.i < a.i AND b.date - a.date < INTERVAL 1 HOUR AND jaro_similarity(a.body, b.body) > 0.6 GROUP BY a.pos),
x AS MATERIALIZED (SELECT m.user_id, m.pos, against, row_number() OVER (PARTITION BY m.user_id ORDER BY m.i) AS k FROM c JOIN m ON m.pos = c.pos),
f AS (SELECT user_id, cast(0 as bigint) AS k, cast([] as bigint[]) AS gone FROM (SELECT DISTINCT user_id FROM x)
  UNION ALL SELECT x.user_id, x.k, case when len(list_filter(x.against, lambda p: NOT list_contains(gone, p))) > 0 then list_append(gone, x.pos) else gone end FROM f JOIN x ON x.user_id = f.user_id AND x.k = f.k + 1),
g AS (SELECT unnest(gone) AS pos FROM (SELECT gone, row_number() OVER (PARTITION BY user_id ORDER BY k DESC) AS r FROM f) WHERE r = 1),
kept AS MATERIALIZED (SELECT pos FROM m WHERE pos NOT IN (SELECT pos FROM g))"""
_NEAR_ROWS = f"SELECT pos, user_id, date, {one_byte('content')} AS body FROM (SELECT pos, user_id, date, split_part(content, '/dream prompt:', 2) AS content FROM {{messages}} WHERE content IS NOT NULL)"
for _key in ("near_dup_greedy", "near_dup", "dedup_near_time"):
    register(_key, _near, f"WITH RECURSIVE {_NEAR.replace('<rows>', _NEAR_ROWS)} SELECT pos FROM kept")
_FIRSTS = "SELECT pos, username, content FROM (SELECT *, row_number() OVER (PARTITION BY content ORDER BY pos) AS n FROM (<rows>)) WHERE n = 1"
_EVEN = f"SELECT pos, regexp_replace(regexp_replace(content, '\\s,', ',', 'g'), '\\s+', ' ', 'g') AS content FROM (SELECT pos, {_GLUE} AS content FROM (<rows>))"
_TIDY = f"SELECT pos, trim(content, ': =''.,\"') AS content FROM ({_EVEN}) WHERE NOT regexp_matches(content, '[^\\x00-\\x7F–{_DIGITS}]')"
_TIDY = f"SELECT * FROM ({_TIDY}) WHERE NOT contains(content, 'dreamt in') AND NOT starts_with(content, 'dreaming for') AND length(content) > 2"
_STEPS = _TIDY.replace("<rows>", _CHARS.replace("<rows>", _CUT.replace("<rows>", "SELECT d.pos, d.content FROM d JOIN kept ON kept.pos = d.pos")))
_CLEAN_ROWS = f"SELECT d.pos, d.username AS user_id, o.date, {one_byte('d.content')} AS body FROM d JOIN {{messages}} o ON o.pos = d.pos"
_CLEAN = f"WITH RECURSIVE d AS MATERIALIZED ({_FIRSTS.replace('<rows>', _EXTRACT)}), {_NEAR.replace('<rows>', _CLEAN_ROWS)} {_FIRSTS.replace('<rows>', 'SELECT y.pos, d.username, y.content FROM (' + _STEPS + ') y JOIN d ON d.pos = y.pos')}"
register("clean_final", lambda get: cl.clean_messages(get("messages")).select("pos", "username", "content"), _CLEAN)

# comparison tasks

register("arr_replicate4", lambda get: tk.image_map(get("part").select((C("p_partkey") - 1).alias("i"), C("p_name").alias("prompt")), "i", name=F.concat_ws("_", C("i") + 1, "img_id_in_prompt")).select("img_idx", "prompt", "img_id_in_prompt", "image_name"), "SELECT (p_partkey - 1) * 4 + j AS img_idx, p_name AS prompt, j AS img_id_in_prompt, concat(cast(p_partkey as string), '_', cast(j as string)) AS image_name FROM {part} CROSS JOIN (VALUES (0), (1), (2), (3)) AS t(j)")
register("image_map", lambda get: get("img_map"), "SELECT * FROM {img_map}")
register("flt_min_images", lambda get: get("img_map").groupBy("descr", "prompt").agg(F.count(F.lit(1)).alias("n")).filter("n >= 4"), "SELECT descr, prompt, count(*) AS n FROM {img_map} GROUP BY descr, prompt HAVING count(*) >= 4")
_draw = lambda descr, m, task, salt: (task * 7919 + m * 31 + salt * 104729 + 17) % 1009
_DRAW = lambda salt: f"((task * 7919 + n * 31 + {salt} * 104729 + 17) % 1009)"


def _sampled(get):
    return tk.sample_comparisons(get("img_map"), _draw)


_SAMPLED = f"""WITH q AS (SELECT descr, prompt, min(img_idx) AS f, count(*) AS c FROM {{img_map}} GROUP BY descr, prompt), z AS (SELECT *, row_number() OVER (PARTITION BY descr ORDER BY f) - 1 AS i, count(*) OVER (PARTITION BY descr) AS n FROM q),
g AS (SELECT DISTINCT descr, n FROM z WHERE n > 1), k AS (SELECT descr, n, unnest(range(0, cast(floor(3 * n * log2(n)) as bigint))) AS task FROM g),
s AS (SELECT descr, n, task, case when task < n - 1 then task + {_DRAW(0)} % 2 else {_DRAW(1)} % n end AS a FROM k),
e AS (SELECT *, case when task < n - 1 then task + 1 - {_DRAW(0)} % 2 else (a + 1 + {_DRAW(2)} % (n - 1)) % n end AS b FROM s),
o AS (SELECT e.descr, task, l.prompt AS "left", r.prompt AS "right" FROM e JOIN z l ON l.descr = e.descr AND l.i = a AND l.c >= 4 JOIN z r ON r.descr = e.descr AND r.i = b AND r.c >= 4)"""
register("comparison_task_sampler", _sampled, _SAMPLED + ' SELECT descr, task, "left", "right" FROM o')
register(
    "task_wide",
    lambda get: tk.sampled_wide_tasks(get("img_map"), _draw).select("descr", "task", C("`INPUT:left_0`").alias("l0"), C("`INPUT:left_3`").alias("l3"), C("`INPUT:right_0`").alias("r0"), C("`INPUT:right_3`").alias("r3")),
    _SAMPLED + ', w AS (SELECT descr, prompt, image_name, row_number() OVER (PARTITION BY descr, prompt ORDER BY img_idx) - 1 AS k FROM {img_map}) SELECT o.descr, task, a.image_name AS l0, b.image_name AS l3, c.image_name AS r0, d.image_name AS r3 FROM o JOIN w a ON a.descr = o.descr AND a.prompt = o."left" AND a.k = 0 JOIN w b ON b.descr = o.descr AND b.prompt = o."left" AND b.k = 3 JOIN w c ON c.descr = o.descr AND c.prompt = o."right" AND c.k = 0 JOIN w d ON d.descr = o.descr AND d.prompt = o."right" AND d.k = 3',
)
register("flt_correct_classifier", lambda get: sc.with_scores(get("judged").select("doc_id", "prompt_id", "candidate_id", "expansion"), "expansion").filter("rm_score > 0 and candidate_id < 10").groupBy("prompt_id").agg(F.min("candidate_id").alias("candidate_id")), f"SELECT prompt_id, min(candidate_id) AS candidate_id FROM {{judged}} WHERE {_STUB} % 2000 > 1000 GROUP BY prompt_id")

# reward-model data
_first_prompt = "SELECT descr, prompt, k FROM (SELECT descr, prompt, (img_idx * 7919 + 17) % 1009 * 100000 + img_idx % 100000 AS k, row_number() OVER (PARTITION BY descr ORDER BY (img_idx * 7919 + 17) % 1009 * 100000 + img_idx % 100000) AS n FROM {img_map} WHERE img_id_in_prompt = 0) WHERE n = 1"


def _prompts(get):
    return get("img_map").filter("img_id_in_prompt = 0").withColumn("k", F.expr("(img_idx * 7919 + 17) % 1009 * 100000 + img_idx % 100000"))


register(
    "aux_negatives",
    lambda get: rw.mismatched(_prompts(get), C("k")),
    f"""WITH o AS (SELECT *, row_number() OVER (ORDER BY k % 1073741824, descr) - 1 AS place, count(*) OVER () AS n FROM ({_first_prompt}))
SELECT a.descr, concat(a.descr, '</s>', a.prompt) AS "left", concat(a.descr, '</s>', b.prompt) AS "right", 1.0 AS y FROM o a JOIN o b ON b.place = (a.place + 1) % a.n""",
)
register(
    "aux_doubled",
    lambda get: rw.doubled(_prompts(get), C("k"), C("k")),
    f"""WITH o AS ({_first_prompt}), r AS (SELECT descr, prompt, row_number() OVER (PARTITION BY descr ORDER BY (img_idx * 7919 + 17) % 1009 * 100000 + img_idx % 100000) AS n FROM {{img_map}} WHERE img_id_in_prompt = 0)
SELECT o.descr, concat(o.descr, '</s>', o.prompt) AS "left", concat(o.descr, '</s>', coalesce(r.prompt, o.prompt), ' ', o.prompt) AS "right", 1.0 AS y FROM o LEFT JOIN r ON r.descr = o.descr AND r.n = 2""",
)
register(
    "aux_word_salad",
    lambda get: rw.word_salad(_prompts(get), C("k"), lambda s, i: s * 7919 + i * 104729),
    f"""WITH o AS (SELECT *, k % 1073741824 AS s FROM ({_first_prompt})), v AS (SELECT word, row_number() OVER (ORDER BY word) - 1 AS place, count(*) OVER () AS n FROM (SELECT DISTINCT unnest(string_split(prompt, ' ')) AS word FROM {{img_map}} WHERE img_id_in_prompt = 0)),
d AS (SELECT descr, s, i FROM o, range(0, 10) t(i) WHERE i < s % 10), w AS (SELECT d.descr, string_agg(word, ' ' ORDER BY i) AS salad FROM d JOIN v ON v.place = (d.s * 7919 + i * 104729) % v.n GROUP BY d.descr)
SELECT o.descr, concat(o.descr, '</s>', prompt) AS "left", concat(o.descr, '</s>', coalesce(salad, '')) AS "right", 1.0 AS y FROM o LEFT JOIN w ON w.descr = o.descr""",
)


def _rm_join(get):
    return rw.comparisons(rw.join_prompts(rw.not_golden(get("annotations")), get("img_map")))


_RM_JOIN = "SELECT a.descr, case when result = 'left' then l.prompt else r.prompt end AS winner, case when result = 'left' then r.prompt else l.prompt end AS loser FROM {annotations} a JOIN {img_map} l ON l.image_name = left_0 JOIN {img_map} r ON r.image_name = right_0 WHERE golden IS NULL"
register("rm_join", _rm_join, _RM_JOIN)


def _scored_labels(get):
    scores = rw.bradley_terry(_rm_join(get), iterations=1)
    return _rounded(scores, "score").select("descr", "prompt", "score")


register(
    "scored_label_pipeline",
    _scored_labels,
    f"""WITH c AS ({_RM_JOIN}), i AS (SELECT descr, winner AS prompt FROM c UNION SELECT descr, loser FROM c), b AS (SELECT descr, winner AS p, 1.0 AS won FROM c UNION ALL SELECT descr, loser, 0.0 FROM c),
s AS (SELECT descr, p AS prompt, sum(won) / count(*) AS r FROM b GROUP BY descr, p) SELECT descr, prompt, round(r / sum(r) OVER (PARTITION BY descr), 6) AS score FROM s""",
)

# reports
def _flags(c: str) -> str:
    grams = _grams(c)
    return f"len({c}_words) AS {c}_tokens, {_hits(c, MAGIC_WORDS)} AS {c}_magic_word_hits, {_hits(c, ARTIST_WORDS)} AS {c}_artist_hits, len({grams}) - len(list_distinct({grams})) AS {c}_repeated_3grams, round_even({_ratio(c)}, 3) AS {c}_prompt_copy_ratio"


def _risk(s):
    return f"2.0 * {s}_magic_word_hits + 2.5 * {s}_artist_hits + {s}_repeated_3grams + greatest(0, {s}_tokens - 70) / 10 + greatest(0, {s}_prompt_copy_ratio - 0.45) * 4"


_FLAGGED = f"SELECT doc_id, prompt, sft, dpo, {_flags('sft')}, {_flags('dpo')} FROM {_WORDS}"
_REVIEWED = f"SELECT *, {_risk('sft')} AS sft_risk, {_risk('dpo')} AS dpo_risk FROM ({_FLAGGED})"
_TEXT_FLAGS = [f"{s}_{k}" for s in ("sft", "dpo") for k in ("tokens", "magic_word_hits", "artist_hits")]
register("text_flags", lambda get: ev.layer3(get("review"), ["doc_id"]).select("doc_id", *_TEXT_FLAGS), f"SELECT doc_id, {', '.join(_TEXT_FLAGS)} FROM ({_FLAGGED})")
for _key in ("layer3_report", "srt_layer3"):
    register(_key, lambda get: _rounded(ev.layer3(get("review"), ["doc_id"]), "sft_risk", "dpo_risk").select("doc_id", "sft_risk", "dpo_risk", "sft_repeated_3grams", "dpo_repeated_3grams", "sft_prompt_copy_ratio", "dpo_prompt_copy_ratio"), f"SELECT doc_id, round(sft_risk, 6) AS sft_risk, round(dpo_risk, 6) AS dpo_risk, sft_repeated_3grams, dpo_repeated_3grams, sft_prompt_copy_ratio, dpo_prompt_copy_ratio FROM ({_REVIEWED})")
_AVG = lambda digits: " UNION ALL ".join(f"SELECT '{k}' AS metric, round(avg(sft_{k}), {digits}) AS sft, round(avg(dpo_{k}), {digits}) AS dpo, {i} AS i FROM r" for i, k in enumerate(ev.FLAGS))
for _key in ("agg_layer3_avg", "layer3_averages"):
    register(_key, lambda get: ev.layer3_averages(ev.reviewed(get("review"), [])).select("metric", F.round("sft", 4).alias("sft"), F.round("dpo", 4).alias("dpo")), f"WITH r AS MATERIALIZED ({_REVIEWED}) SELECT metric, sft, dpo FROM ({_AVG(4)})")


def _markdown(get):
    # places come from rows without their texts, which are then joined once
    rows = _rounded(ev.reviewed(get("review").withColumn("_row", F.monotonically_increasing_id())), "sft_risk", "dpo_risk")
    order = F.struct(C("sft_risk") - C("dpo_risk"), -C("dpo_risk"), "doc_id", "_row").alias("_order")
    places, _ = number_rows(rows.select("_row", order), "_order")
    numbered = rows.join(places.select("_row", "at"), "_row")
    averages = ev.layer3_averages(rows).select("metric", F.round("sft", 6).alias("sft"), F.round("dpo", 6).alias("dpo"))
    return fs.layer3_markdown(numbered.withColumn("i", C("at").cast("int")).drop("at", "_row"), averages, "i")


_JSON = lambda s: ", ',', chr(10), ".join(f"""'    "{k}": ', cast({s}_{k} as string)""" for k in ev.FLAGS)
_HEAD = "concat(" + ", chr(10), ".join(f"'{x}'" for x in fs.REVIEW_HEAD.split("\n")) + ")"
_EXAMPLE = f"""concat('## Example ', cast(place + 1 as string), chr(10), chr(10), '**Prompt**: `', prompt, '`', chr(10), chr(10), '**SFT output**', chr(10), chr(10), '> ', sft, chr(10), chr(10), '**DPO output**', chr(10), chr(10), '> ', dpo, chr(10), chr(10), '**Flags**', chr(10), chr(10), '```json', chr(10),
  '{{{{', chr(10), '  "sft": {{{{', chr(10), {_JSON('sft')}, chr(10), '  }}}},', chr(10), '  "dpo": {{{{', chr(10), {_JSON('dpo')}, chr(10), '  }}}}', chr(10), '}}}}', chr(10), '```', chr(10), chr(10))"""
_REPORT = f"""WITH r AS MATERIALIZED ({_REVIEWED}), o AS (SELECT *, cast(row_number() OVER (ORDER BY round(sft_risk, 6) - round(dpo_risk, 6), -round(dpo_risk, 6), doc_id) - 1 as bigint) AS place FROM r)
SELECT cast(-1000 as bigint) AS place, {_HEAD} AS block UNION ALL SELECT cast(i - 100 as bigint), concat(printf('| %s | %.3f | %.3f |', metric, sft, dpo), chr(10), case when i = {len(ev.FLAGS) - 1} then chr(10) else '' end) FROM ({_AVG(6)}) UNION ALL SELECT place, {_EXAMPLE} FROM o"""
register("snk_layer3_md", _markdown, _REPORT)
_REPORT_HEAD, _REPORT_ROWS = _REPORT.split("\nSELECT cast(-1000", 1)
register("file_layer3_md", lambda get: _file(get, _markdown(get)), _lines_of("SELECT cast(-1000" + _REPORT_ROWS, _REPORT_HEAD))

# packing
def _packed(get):
    rows, _ = number_rows(get("sft_text").select("id", _ids("text").alias("tokens")), "id")
    return tr.pack_blocks(rows, "tokens", "at", 32, 50).select("batch", "block", F.array_join("input_ids", " ").alias("ids"))


_PACKED = """WITH r AS (SELECT cast(floor((row_number() OVER (ORDER BY id) - 1) / 50) as bigint) AS batch, id, list_transform(string_split(text, ' '), lambda w: length(w)) AS t FROM {sft_text}), f AS (SELECT batch, flatten(list(t ORDER BY id)) AS ids FROM r GROUP BY batch),
b AS (SELECT batch, ids, unnest(range(0, greatest(1, cast(floor(len(ids) / 32) as bigint)))) AS block FROM f) SELECT batch, block, array_to_string(case when len(ids) >= 32 then list_slice(ids, block * 32 + 1, block * 32 + 32) else ids end, ' ') AS ids FROM b"""
for _key in ("arr_pack_blocks", "pack_blocks"):
    register(_key, _packed, _PACKED)
register("pad_batches", lambda get: tr.pad_batches(get("sft_text").select("id", _enc()[0].alias("input_ids"), _enc()[1].alias("labels")), C("id") % 8).select("id", F.size("input_ids").alias("n"), F.aggregate("attention_mask", F.lit(0), lambda a, x: a + x).alias("n_real")), "SELECT id, max(l) OVER (PARTITION BY id % 8) AS n, l AS n_real FROM (SELECT id, least(64, len(string_split(prompt, ' ')) + len(string_split(completion, ' '))) AS l FROM {sft_text})")
register("flt_every_n", lambda get: tr.every_nth(get("train_steps").select("step", "event_type"), "step", "event_type", 7), "SELECT step, case when step % 7 = 0 then event_type else '' end AS event_type FROM {train_steps}")
register("sft_strings", lambda get: lab.sft_strings(get("label_log")).select("line_no", "text"), "SELECT line_no, concat('[BOS]', description, ' = ', prompt, '<endoftext>') AS text FROM {label_log} WHERE description <> '_no_object'")
scalar("perplexity", "runs", "run", lambda: F.round(n.perplexity(C("loss")), 6), "round(exp(loss), 6)")
register("shared_tails", lambda get: ev.shared_tails(get("review"), "dpo", 3), f"SELECT tail, count(*) AS n FROM (SELECT array_to_string(list_slice({_T}, greatest(1, len({_T}) - 2), len({_T})), ' ') AS tail FROM {{review}}) GROUP BY tail HAVING count(*) >= 2")

register("snk_checkpoint_meta", lambda get: tr.checkpoint_rows(get("train_steps").select("step", "mean_reward")), "SELECT printf('step-%06d', step) AS name, step, best_reward FROM (SELECT step, max(case when step >= 20 then mean_reward end) OVER (ORDER BY step) AS best_reward FROM {train_steps}) WHERE step % 500 = 0 AND step > 0 ORDER BY step DESC LIMIT 3")
_LINES = "SELECT l_returnflag, l_linestatus, count(*) AS n, cast(sum(l_quantity) as bigint) AS quantity, count(DISTINCT l_suppkey) AS n_suppliers FROM {lineitem} GROUP BY "
register("agg_distinct_sets", lambda get: get("lineitem").cube("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.countDistinct("l_suppkey").alias("n_suppliers")), _LINES + "CUBE (l_returnflag, l_linestatus)")
register("agg_rollup", lambda get: get("lineitem").rollup("l_returnflag", "l_linestatus").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").cast("long").alias("quantity"), F.countDistinct("l_suppkey").alias("n_suppliers")), _LINES + "ROLLUP (l_returnflag, l_linestatus)")
for _key, _same in (("mask_labels", "arr_mask_labels"), ("dpo_encode", "arr_dpo_encode"), ("token_accuracy", "num_token_acc"), ("kl", "num_kl")):
    QUERIES[_key], SQL[_key] = QUERIES[_same], SQL[_same]

# streams (extensions)
def _stream(get):
    log = get("score_log").select("line_no", "prompt_id", "candidate_id", "prompt", "expansion", "score", "overall", "fidelity")
    spark, folder = log.sparkSession, _path(log, "stream-in")
    for k in (0, 1):  # old records arrive first
        fs.append_jsonl(log.filter((C("line_no") >= 1000000000) == F.lit(bool(k))).drop("line_no"), folder)
    out = _path(log, "stream-out")
    upsert_stream(read_score_stream(spark, folder), out, out + "-checkpoint").awaitTermination()
    return current_scores(spark, out).select("prompt_id", "candidate_id", C("overall").cast("long").alias("overall"))


register("stream_score_upsert", _stream, "SELECT prompt_id, candidate_id, coalesce(overall, score) AS overall FROM (SELECT *, row_number() OVER (PARTITION BY prompt_id, candidate_id ORDER BY line_no DESC) AS n FROM {score_log}) WHERE n = 1")


def _stream_near(get):
    """The messages as a stream, with a row of another user behind all others, which moves the watermark past them."""
    rows = get("messages").filter("content is not null").select("pos", C("user_id").cast("long").alias("user"), C("date").cast("timestamp").alias("date"), t.after(C("content"), "/dream prompt:").alias("content"))
    end = rows.agg(F.lit(-1).cast("long").alias("pos"), F.lit(-1).cast("long").alias("user"), (F.max("date") + F.expr("interval 3 days")).alias("date"), F.lit("end").alias("content"))
    spark, folder = rows.sparkSession, _path(rows, "messages-in")
    rows.unionByName(end).write.parquet(folder)
    out = _path(rows, "messages-out")
    stream = near_dup_stream(spark.readStream.schema(rows.schema).parquet(folder), "user", "date", "content", "pos")
    query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out).filter("pos >= 0").select("pos")


_FIRST_STAY = _NEAR.replace("ORDER BY date DESC, pos DESC", "ORDER BY date, pos").replace("b.date - a.date", "a.date - b.date")
register("stream_near_dup", _stream_near, f"WITH RECURSIVE {_FIRST_STAY.replace('<rows>', _NEAR_ROWS)} SELECT pos FROM kept WHERE pos IN (SELECT pos FROM m WHERE body <> '')")


def _generated(get):
    rows = get("judged").filter("candidate_id < 2").select("prompt_id", "prompt")
    spark = rows.sparkSession
    register_candidates(spark, sc.stub_generate)
    return spark.sql("SELECT prompt_id, prompt, candidate_id, expansion FROM candidates(TABLE(SELECT prompt_id, prompt FROM {rows}), 3, 'prompt', 'prompt_id')", rows=rows)


register("udtf_candidates", _generated, "SELECT prompt_id, prompt, cast(i as integer) AS candidate_id, concat(split_part(prompt, '</s>', 1), ' variant ', cast(i as string)) AS expansion FROM (SELECT DISTINCT prompt_id, prompt FROM {judged} WHERE candidate_id < 2) CROSS JOIN range(0, 3) t(i)")


def _stream_means(get):
    events = get("events").select(C("ts").cast("timestamp").alias("ts"), "value")
    spark, folder = events.sparkSession, _path(events, "events-in")
    events.coalesce(2).write.parquet(folder)
    out = _path(events, "events-out")
    stream = windowed_means(spark.readStream.schema(events.schema).parquet(folder), "ts", "value", "1 day", "60 days")
    # all that is there is one batch, whose updated windows are the result
    query = stream.writeStream.outputMode("update").foreachBatch(lambda df, k: df.write.mode("overwrite").parquet(f"{out}/{k}") if not df.isEmpty() else None).option("checkpointLocation", out + "-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return _rounded(spark.read.option("recursiveFileLookup", True).schema(stream.schema).parquet(out), "mean").select(F.date_format("start", "yyyy-MM-dd").alias("day"), "mean", "n")


register("stream_windowed_means", _stream_means, "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, round(avg(value), 6) AS mean, count(*) AS n FROM {events} GROUP BY 1")
