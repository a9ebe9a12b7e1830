"""Queries of the scalar functions and filters."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefforge.functions import numeric as n
from prefforge.functions import text as t
from prefforge.functions.constants import ALLOWED_FAILURE_MODES, ARTIST_WORDS, HARD_FAILURE_MODES, LOOSE_GUARDRAILS, MAGIC_WORDS, NSFW_WARNING, STRICT_GUARDRAILS
from prefforge.operators import pairs as p
from prefforge.operators.dedup import jaro
from prefforge.plans.registry import keep, register, scalar

C = F.col
content = lambda: C("content")
HAVE = "content is not null"
BODY = "split_part(content, '/dream prompt:', 2)"
PLAIN = r" .,\"\-'!–/;&?"
DIGITS = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"


def _count(x: str, part: str) -> str:
    return f"cast((length({x}) - length(replace({x}, '{part}', ''))) / {len(part)} as integer)"


def _hits(x: str, phrases: list[str]) -> str:
    return " + ".join(_count(f"lower({x})", w) for w in phrases)


# strings
register("str_lower_cols", lambda get: t.lower_columns(get("region").toDF("R_RegionKey", "R_Name")), "SELECT r_regionkey, r_name FROM {region}")
scalar("str_first_token", "messages", "pos", lambda: t.first_token(content()), r"regexp_extract(content, '^\s*(\S*)', 1)", HAVE)
scalar("str_contains", "messages", "pos", lambda: content().contains("sex"), "contains(content, 'sex')", HAVE)
scalar("str_split_count", "messages", "pos", lambda: t.count_of(content(), "/dream prompt:"), _count("content", "/dream prompt:"), HAVE)
scalar("str_username", "messages", "pos", lambda: t.username(content()), "split_part(split_part(content, 'for @', 2), '... ', 1)", HAVE)
scalar("str_prompt_body", "messages", "pos", lambda: t.prompt_body(content()), f"left({BODY}, greatest(length({BODY}) - 1, 0))", HAVE)
scalar("str_cut_at", "messages", "pos", lambda: t.before(t.before(t.prompt_body(content()), "negative_prompt:"), "--"), f"split_part(split_part(left({BODY}, greatest(length({BODY}) - 1, 0)), 'negative_prompt:', 1), '--', 1)", HAVE)
scalar("str_strip_args", "messages", "pos", lambda: t.strip_arguments(content()), "regexp_replace(content, ' [^ ]*:.*', '', 'g')", HAVE)
scalar("str_drop_prefix", "label_log", "line_no", lambda: t.drop_prefix(C("prompt")), "case when starts_with(lower(prompt), 'prompt') then substr(prompt, 7) else prompt end")
scalar("str_trailing_seed", "messages", "pos", lambda: t.trailing_seed(t.prompt_body(content())), f"case when ends_with(left({BODY}, greatest(length({BODY}) - 1, 0)), 'seed') and {_count(BODY, 'seed')} = 1 then split_part({BODY}, 'seed', 1) else left({BODY}, greatest(length({BODY}) - 1, 0)) end", HAVE)
scalar("str_emoji_strip", "messages", "pos", lambda: t.strip_emoji(F.concat(F.lit("\U0001f600 ☀ "), content(), F.lit("❤️"))), "concat('  ', content)", HAVE)
scalar("str_remove_chars", "messages", "pos", lambda: t.remove_characters(content()), "translate(content, '()[]{{}}|', '')", HAVE)
# DuckDB has no look-behind, so each character is looked at with its neighbours
_GLUE = r"""array_to_string(list_transform(range(1, length(content) + 1), lambda i: case when regexp_matches(substr(content, i, 1), '\s') and i > 1 and regexp_matches(substr(content, i - 1, 1), '[0-9]')
  and (regexp_matches(substr(content, i + 1, 1), '[0-9]') or (substr(content, i + 1, 1) in ('K', 'k', 'd', 'D', 's') and (i + 1 = length(content) or not regexp_matches(substr(content, i + 2, 1), '[\p{{L}}\p{{N}}_]')))) then '' else substr(content, i, 1) end), '')"""
_GLUE = f"case when regexp_matches(content, '[0-9]\\s') then {_GLUE} else content end"
scalar("str_glue_digits", "messages", "pos", lambda: t.glue_digits(content()), _GLUE, HAVE)
scalar("str_space_comma", "messages", "pos", lambda: t.space_comma(content()), r"regexp_replace(content, '\s,', ',', 'g')", HAVE)
scalar("str_squeeze_ws", "documents", "doc_id", lambda: t.squeeze_space(C("text")), r"regexp_replace(text, '\s+', ' ', 'g')")
scalar("str_strip_charset", "messages", "pos", lambda: t.strip_characters(content()), "trim(content, ': =''.,\"')", HAVE)
scalar("str_sep_split", "sft_text", "id", lambda: t.as_prompt(C("text")), "concat(split_part(text, '</s>', 1), '</s>')")
scalar("str_sep_second", "sft_text", "id", lambda: t.completion(C("text")), "replace(split_part(text, '</s>', 2), '<|endoftext|>', '')")
keep("str_sep_exactly_two", "sft_text", "id", lambda: t.has_two_parts(C("text")), "len(string_split(text, '</s>')) = 2")
scalar("str_special_tokens", "sft_text", "id", lambda: t.without_special_tokens(F.concat("text", F.lit("<|endoftext|>"))), "replace(text, '</s>', '')")
scalar("str_sft_template", "label_log", "line_no", lambda: t.sft_template(C("description"), C("prompt")), "concat('[BOS]', description, ' = ', prompt, '<endoftext>')")
scalar("str_rm_text", "img_map", "img_idx", lambda: t.reward_text(C("descr"), C("prompt")), "concat(descr, '</s>', prompt)")
scalar("str_fewshot", "label_log", "line_no", lambda: t.fill_template('Prompt:{}\nAnswer as {{"a": 1}}:', _=C("prompt")), "concat('Prompt:', prompt, chr(10), 'Answer as {{\"a\": 1}}:')")
scalar("str_url", "img_map", "img_idx", lambda: {"slash": t.url("https://example.com/i", C("image_name")), "plain": t.url("https://example.com/i/", C("image_name"), slash=False)}, "concat('https://example.com/i/', image_name) AS slash, concat('https://example.com/i/', image_name) AS plain")
scalar("str_truncate", "documents", "doc_id", lambda: t.truncate(C("text"), 35, "…"), "case when length(text) > 35 then concat(left(text, 35), '…') else text end")
scalar("str_phrase_hits", "review", "doc_id", lambda: {"magic": t.phrase_hits(C("dpo"), MAGIC_WORDS), "artists": t.phrase_hits(C("dpo"), ARTIST_WORDS)}, f"{_hits('dpo', MAGIC_WORDS)} AS magic, {_hits('dpo', ARTIST_WORDS)} AS artists")
TOKENS = r"regexp_extract_all(lower({x}), '[\p{{L}}\p{{N}}_]+')"
scalar("str_token_len", "documents", "doc_id", lambda: t.token_count(C("text")), "len(" + TOKENS.replace("{x}", "text") + ")")
_T = TOKENS.replace("{x}", "dpo")
# lists of words are columns of their own, as a lambda computes what it refers to for each of its elements
_WORDS = f"(SELECT *, {TOKENS.replace('{x}', 'sft')} AS sft_words, {_T} AS dpo_words, {TOKENS.replace('{x}', chr(39).join(['replace(prompt, ', '</s>', ', ', '', ')']))} AS known FROM {{review}})"


def _grams(c: str) -> str:
    return f"list_transform(list_zip({c}_words, {c}_words[2:], {c}_words[3:], true), lambda g: concat_ws(' ', g[1], g[2], g[3]))"


def _ratio(c: str) -> str:
    return f"case when len({c}_words) > 0 then len(list_filter({c}_words, lambda x: list_contains(known, x))) / len({c}_words) else 0 end"


register("str_repeat_ngrams", lambda get: get("review").select("doc_id", t.repeated_ngrams(C("dpo"), 3).alias("value")), f"SELECT doc_id, len(g) - len(list_distinct(g)) AS value FROM (SELECT doc_id, {_grams('dpo')} AS g FROM {_WORDS})")
register("str_copy_ratio", lambda get: get("review").select("doc_id", F.round(t.copy_ratio(C("prompt"), C("dpo")), 6).alias("value")), f"SELECT doc_id, round({_ratio('dpo')}, 6) AS value FROM {_WORDS}")
scalar("str_round3", "documents", "doc_id", lambda: t.round_half_even((C("doc_id") % 1000).cast("double") / 16), "round_even(cast(doc_id % 1000 as double) / 16, 3)")
_MIXED = "concat(case (doc_id % 6) when 0 then '' when 1 then '12 3!' when 2 then 'é–à' when 3 then 'a: b' else '' end, case when doc_id % 2 = 0 then text else '' end)"
scalar(
    "str_char_classes", "documents", "doc_id",
    lambda: {k: f(F.expr(_MIXED)) for k, f in (("non_ascii", t.all_non_ascii), ("not_alpha", t.all_not_alpha), ("odd", t.suspicious), ("some_non_ascii", t.has_non_ascii))},
    f"NOT regexp_matches(regexp_replace({_MIXED}, '[ .,\"\\-''!/;&?0-9]', '', 'g'), '[\\x00-\\x7F]') AS non_ascii, NOT regexp_matches({_MIXED}, '\\p{{{{L}}}}') AS not_alpha, regexp_matches({_MIXED}, '[^\\p{{{{L}}}}\\p{{{{Nd}}}}²³¹⁰⁴-⁹₀-₉ .,\"\\-''!–/;&?+*_#|]') AS odd, regexp_matches({_MIXED}, '[^\\x00-\\x7F–\\p{{{{Nd}}}}²³¹⁰⁴-⁹₀-₉]') AS some_non_ascii".replace("{{{{", "{{").replace("}}}}", "}}"),
)
#: The letters beyond ASCII of the test tables. DuckDB compares bytes, so its texts get one byte for each.
BEYOND_ASCII = "ÁÄÇÈÉÊÍÑÓÖÚÜßáäçèéêíñóöúü"


def one_byte(x: str) -> str:
    """SQL of a text with one byte for each character, on which byte-wise similarity is that of characters."""
    spare = [k for k in range(1, 32) if k not in (9, 10, 13)]
    return f"translate({x}, '{BEYOND_ASCII}', concat({', '.join(f'chr({k})' for k in spare[: len(BEYOND_ASCII)])}))"


register("str_jaro", lambda get: get("review").select("doc_id", F.round(jaro("sft", "dpo"), 6).alias("value")), f"SELECT doc_id, round(jaro_similarity({one_byte('sft')}, {one_byte('dpo')}), 6) AS value FROM {{review}}")
scalar("str_tail_fingerprint", "review", "doc_id", lambda: t.tail_tokens(C("dpo"), 5), f"array_to_string(list_slice({_T}, greatest(1, len({_T}) - 4), len({_T})), ' ')")
scalar("str_name_path", "label_log", "line_no", lambda: dict(zip(("name", "path"), t.name_and_path(F.concat("prompt", F.lit(":/a:b/"), "description")), strict=True)), "prompt AS name, concat('/a:b/', description) AS path")
scalar("str_display_ckpt", "train_steps", "step", lambda: t.checkpoint_name(C("step")), "printf('step-%06d', step)")

# numbers, dates, arrays, nulls
register("num_score_gap", lambda get: get("judged").groupBy("prompt_id").agg((F.max("overall") - F.min("overall")).alias("gap")), "SELECT prompt_id, max(overall) - min(overall) AS gap FROM {judged} GROUP BY prompt_id")
scalar("num_bt_prob", "token_logps", "doc_id", lambda: F.round(n.win_probability(F.exp("chosen_logp") * (C("doc_id") % 3), F.exp("rejected_logp") * (C("doc_id") % 2)), 6), "round(case when exp(chosen_logp) * (doc_id % 3) + exp(rejected_logp) * (doc_id % 2) < 1e-9 then 0.0 else exp(chosen_logp) * (doc_id % 3) / nullif(exp(chosen_logp) * (doc_id % 3) + exp(rejected_logp) * (doc_id % 2), 0) end, 6)")
_PRIORITY = "3.0 * gap + case when list_has_any(m, ['magic_words', 'irrelevant_artist', 'off_topic', 'contradiction', 'incoherent']) then 2.0 else 0.0 end + case when list_has_any(m, ['too_generic', 'restatement', 'too_verbose']) then 1.0 else 0.0 end + s / 10.0 + (case when a is null or a = 0 then 5 else a end) / 10.0"
register(
    "num_priority",
    lambda get: get("judged").filter("overall is not null").select("doc_id", F.round(n.pair_priority(C("overall") - 3, F.split("failure_modes_csv", ","), C("overall"), C("anti_magic_word_score") % 10), 6).alias("value")),
    f"SELECT doc_id, round({_PRIORITY.replace('gap', '(s - 3)')}, 6) AS value FROM (SELECT doc_id, overall AS s, anti_magic_word_score % 10 AS a, string_split(failure_modes_csv, ',') AS m FROM {{judged}} WHERE overall IS NOT NULL)",
)
_WEIGHTED = "0.25 * fidelity + 0.2 * visual_specificity + 0.15 * style_fit + 0.15 * composition_lighting + 0.15 * non_genericness + 0.1 * coherence"
_CAPPED = f"case when fidelity is null then null else least({_WEIGHTED}, case when fidelity <= 4 then 5 else 10 end, case when anti_magic_word_score <= 4 then 5 else 10 end, case when contains(failure_modes_csv, 'restatement') then 6 else 10 end, case when contains(failure_modes_csv, 'off_topic') then 4 else 10 end) end"
register(
    "num_weighted_overall",
    lambda get: get("judged").withColumn("failure_modes", F.split("failure_modes_csv", ",")).select("doc_id", F.round(n.weighted_overall(), 6).alias("value")),
    f"SELECT doc_id, round(cast({_CAPPED} as double), 6) AS value FROM {{judged}}",
)
scalar("num_heuristic_risk", "token_logps", "doc_id", lambda: F.round(n.heuristic_risk(C("doc_id") % 4, C("doc_id") % 3, C("doc_id") % 7, C("doc_id") % 200, (C("doc_id") % 10) / 10), 6), "round(2.0 * (doc_id % 4) + 2.5 * (doc_id % 3) + doc_id % 7 + greatest(0, doc_id % 200 - 70) / 10 + greatest(0, (doc_id % 10) / 10 - 0.45) * 4, 6)")
scalar("num_cost", "label_log", "line_no", lambda: n.cost(C("tokens") * 37), "round_even(tokens * 37 / 1000 * 0.02, 2)")
scalar("num_perplexity", "runs", "run", lambda: F.round(n.perplexity(C("loss")), 6), "round(exp(loss), 6)")
_LOGIT = "(0.1 * ((chosen_logp - rejected_logp) - (ref_chosen_logp - ref_rejected_logp)))"
_logit = lambda: n.dpo_logit(*[C(c) for c in ("chosen_logp", "rejected_logp", "ref_chosen_logp", "ref_rejected_logp")])
scalar("num_logsigmoid_dpo", "token_logps", "doc_id", lambda: {"loss": F.round(n.dpo_loss(_logit()), 6), "correct": _logit() > 0}, f"round(ln(1 + exp(-{_LOGIT})), 6) AS loss, {_LOGIT} > 0 AS correct")
_arr = lambda step, mod: F.transform(F.sequence(F.lit(0), (C("doc_id") % 9).cast("int") + 1), lambda i: (C("doc_id") * step + i) % mod)
_sql_arr = lambda step, mod: f"list_transform(range(0, doc_id % 9 + 2), lambda i: (doc_id * {step} + i) % {mod})"
scalar("num_token_acc", "token_logps", "doc_id", lambda: F.round(n.token_accuracy(_arr(3, 4), _arr(5, 4)), 6), f"round(list_sum(list_transform(range(1, doc_id % 9 + 2), lambda i: case when {_sql_arr(3, 4)}[i] = {_sql_arr(5, 4)}[i + 1] then 1 else 0 end)) / (doc_id % 9 + 1), 6)")
scalar("num_seq_logp", "token_logps", "doc_id", lambda: F.round(n.sequence_logp(F.transform(_arr(3, 7), lambda x: -x / 10), F.transform(_arr(5, 4), lambda y: F.when(y == 0, -100).otherwise(y))), 6), f"round(list_sum(list_transform(range(1, doc_id % 9 + 2), lambda i: case when {_sql_arr(5, 4)}[i + 1] = 0 then 0 else -{_sql_arr(3, 7)}[i] / 10 end)), 6)")
scalar("num_kl", "token_logps", "doc_id", lambda: F.round(n.token_kl(F.transform(_arr(3, 7), lambda x: -(x + 1) / 5), F.transform(_arr(5, 6), lambda x: -(x + 1) / 5)), 6), f"round(list_sum(list_transform(range(1, doc_id % 9 + 3), lambda i: exp(-({_sql_arr(3, 7)}[i] + 1) / 5) * (-({_sql_arr(3, 7)}[i] + 1) / 5 + ({_sql_arr(5, 6)}[i] + 1) / 5))), 6)")
scalar("num_rm_logit", "token_logps", "doc_id", lambda: n.reward_logit(F.slice(F.array("chosen_logp", "rejected_logp", "ref_chosen_logp"), F.lit(1), (C("doc_id") % 3).cast("int") + 1)), "case (doc_id % 3) when 0 then chosen_logp when 1 then rejected_logp - chosen_logp else greatest(chosen_logp, rejected_logp, ref_chosen_logp) end")
_JSON = "case (doc_id % 8) when 0 then '{{\"v\": 8.7}}' when 1 then '{{\"v\": \"8\"}}' when 2 then '{{\"v\": true}}' when 3 then '{{\"v\": \"8/10\"}}' when 4 then '{{\"v\": 11}}' when 5 then '{{\"w\": 3}}' when 6 then '{{\"v\": null}}' else concat('{{\"v\": ', cast(doc_id % 13 as string), '}}') end"
scalar("num_int_cast", "documents", "doc_id", lambda: n.int_1_to_10(F.expr(_JSON.replace("{{", "{").replace("}}", "}")), "$.v"), "case (doc_id % 8) when 0 then 8 when 1 then 8 when 2 then 1 when 7 then case when doc_id % 13 between 1 and 10 then doc_id % 13 end end")
scalar("num_block_size", "runs", "run", lambda: F.lit(n.block_size(None, 2048) + n.block_size(512, 400)), "1424")
scalar("date_parse", "messages", "pos", lambda: F.date_format(F.to_timestamp(F.date_format("date", "yyyy-MM-dd HH:mm:ss")), "yyyy-MM-dd HH:mm"), "strftime(date, '%Y-%m-%d %H:%M')")
scalar("date_within", "messages", "pos", lambda: n.within(F.col("date"), F.lit("2024-01-15 00:00:00").cast("timestamp_ntz")), "date - TIMESTAMP '2024-01-15 00:00:00' < INTERVAL 1 HOUR")
scalar("json_reason_regex", "judge_replies", "doc_id", lambda: F.regexp_extract("reply", r'"?reason"?\s*[:=]\s*"([^"]*)"', 1), "regexp_extract(reply, '\"?reason\"?\\s*[:=]\\s*\"([^\"]*)\"', 1)")
register(
    "json_payload",
    lambda get: get("judged").withColumn("failure_modes", F.split("failure_modes_csv", ",")).select("doc_id", n.score_payload().alias("s")).select("doc_id", C("s.overall").alias("overall"), C("s.fidelity").alias("fidelity"), F.array_join("s.failure_modes", ",").alias("modes"), C("s.reason").alias("reason")),
    "SELECT doc_id, overall, fidelity, failure_modes_csv AS modes, reason FROM {judged}",
)
_RAW = "case (doc_id % 5) when 0 then ' Magic Words ,none' when 1 then 'none' when 2 then 'off-topic,off topic,strange' when 3 then '' else 'too_generic,none,RESTATEMENT' end"
_CLEAN = "case (doc_id % 5) when 0 then 'magic_words' when 1 then 'none' when 2 then 'off_topic{x}' when 3 then '' else 'too_generic,restatement' end"
scalar("arr_norm_modes", "documents", "doc_id", lambda: {"strict": F.array_join(n.normalise_modes(F.split(F.expr(_RAW), ","), ALLOWED_FAILURE_MODES), ","), "loose": F.array_join(n.normalise_modes(F.split(F.expr(_RAW), ",")), ",")}, f"{_CLEAN.replace('{x}', '')} AS strict, {_CLEAN.replace('{x}', ',strange')} AS loose")
scalar("arr_default_modes", "judged", "doc_id", lambda: F.array_join(n.default_modes(F.when(C("doc_id") % 4 > 0, F.split("failure_modes_csv", ",")).otherwise(F.array().cast("array<string>"))), ","), "case when doc_id % 4 > 0 then failure_modes_csv else 'none' end")
scalar("arr_intersect_modes", "judged", "doc_id", lambda: n.hard_modes(F.split(F.concat_ws(",", "failure_modes_csv", F.lit("incoherent,contradiction")), ",")), "case when failure_modes_csv in ('magic_words', 'off_topic') then concat('contradiction+incoherent+', failure_modes_csv) else 'contradiction+incoherent' end")
scalar("arr_words", "documents", "doc_id", lambda: F.array_join(t.words(C("text")), " "), r"trim(regexp_replace(text, '\s+', ' ', 'g'))")
_ids = lambda col: F.transform(F.split(col, " "), lambda w: F.length(w))
scalar("arr_mask_labels", "sft_text", "id", lambda: F.array_join(n.mask_prompt_labels(F.concat(_ids("prompt"), F.array(F.lit(0)), _ids("completion")), 0), " "), "concat(repeat('-100 ', len(string_split(prompt, ' '))), '-100 ', array_to_string(list_transform(string_split(completion, ' '), lambda w: length(w)), ' '))")
_enc = lambda: n.dpo_encode(_ids("prompt"), _ids("completion"), 64)
_IDS = "list_concat(list_transform(string_split(prompt, ' '), lambda w: length(w)), list_transform(string_split(completion, ' '), lambda w: length(w)))"
_LAB = "list_concat(list_transform(string_split(prompt, ' '), lambda w: -100), list_transform(string_split(completion, ' '), lambda w: length(w)))"
_cut = lambda x: f"array_to_string(list_slice({x}, greatest(1, len({x}) - 63), len({x})), ' ')"
scalar("arr_dpo_encode", "sft_text", "id", lambda: {"ids": F.array_join(_enc()[0], " "), "labels": F.array_join(_enc()[1], " ")}, f"{_cut(_IDS)} AS ids, {_cut(_LAB)} AS labels")
scalar("arr_pad", "sft_text", "id", lambda: F.array_join(n.pad(F.slice(_ids("prompt"), F.lit(1), F.lit(5)), F.lit(8), -1), " "), "array_to_string(list_resize(list_slice(list_transform(string_split(prompt, ' '), lambda w: length(w)), 1, 5), 8, -1), ' ')")
scalar("null_coalesce_scores", "score_log", "line_no", lambda: {"score": F.coalesce("score", "overall"), "overall": F.coalesce("overall", "score")}, "coalesce(score, overall) AS score, coalesce(overall, score) AS overall")
keep("null_passes", "judged", "doc_id", lambda: n.at_least(C("fidelity"), 6), "coalesce(fidelity >= 6, true)")
keep("null_drop", "messages", "pos", lambda: content().isNotNull(), "content IS NOT NULL")

# filters
keep("flt_completed", "messages", "pos", lambda: t.first_token(content()) == "Dreamt", "string_split(content, ' ')[1] = 'Dreamt'")
keep("flt_nsfw", "messages", "pos", lambda: ~(content().contains(NSFW_WARNING) | content().contains("sex")), f"NOT (contains(content, '{NSFW_WARNING}') OR contains(content, 'sex'))")
keep("flt_one_prompt", "messages", "pos", lambda: t.occurs_once(content(), "/dream prompt:"), "len(string_split(content, '/dream prompt:')) = 2")
keep("flt_one_author", "messages", "pos", lambda: t.occurs_once(content(), "for @"), "len(string_split(content, 'for @')) = 2")
keep("flt_mid_args", "messages", "pos", lambda: ~(content().contains("--") & (F.length(t.after(content(), "--")) > 8)), "NOT (contains(content, '--') AND length(split_part(content, '--', 2)) > 8)")
keep("flt_http", "messages", "pos", lambda: ~content().contains("http"), "NOT contains(content, 'http')")
for _name, _f, _sql in (
    ("all_non_ascii", t.all_non_ascii, f"regexp_matches(regexp_replace({_MIXED}, '[ .,\"\\-''!/;&?0-9]', '', 'g'), '[\\x00-\\x7F]')"),
    ("all_not_alpha", t.all_not_alpha, f"regexp_matches({_MIXED}, '\\p{{{{L}}}}')"),
    ("suspicious", t.suspicious, f"NOT regexp_matches({_MIXED}, '[^\\p{{{{L}}}}\\p{{{{Nd}}}}²³¹⁰⁴-⁹₀-₉ .,\"\\-''!–/;&?+*_#|]')"),
    ("has_non_ascii", t.has_non_ascii, f"NOT regexp_matches({_MIXED}, '[^\\x00-\\x7F–\\p{{{{Nd}}}}²³¹⁰⁴-⁹₀-₉]')"),
):
    keep(f"flt_{_name}", "documents", "doc_id", lambda f=_f: ~f(F.expr(_MIXED)), _sql.replace("{{{{", "{{").replace("}}}}", "}}"))
keep("flt_minlen", "documents", "doc_id", lambda: F.length("text") > 20, "length(text) > 20")
keep("flt_dreaming", "messages", "pos", lambda: ~content().startswith("Dreaming") & ~content().contains("dreamt in"), "NOT starts_with(content, 'Dreaming') AND NOT contains(content, 'dreamt in')")
keep("flt_noop", "messages", "pos", lambda: F.lit(True), "true")
keep("flt_no_object", "label_log", "line_no", lambda: C("description") != "_no_object", "description <> '_no_object'")
keep("flt_golden", "annotations", "task", lambda: C("golden").isNull(), "golden IS NULL")
keep("flt_has_sep", "sft_text", "id", lambda: C("text").contains("</s>"), "contains(text, '</s>')")
keep("flt_nonempty_cand", "judged", "doc_id", lambda: F.length("expansion") > 0, "length(expansion) > 0")
register("flt_min_cands", lambda get: p.scored_enough(get("judged"), least=8).select("doc_id"), "SELECT doc_id FROM (SELECT doc_id, count(*) OVER (PARTITION BY prompt_id) AS n FROM {judged} WHERE overall IS NOT NULL) WHERE n >= 8")
register("flt_chosen_ne_rejected", lambda get: p.best_worst(get("judged"), min_gap=None, different=True).select("prompt_id"), "SELECT prompt_id FROM {judged} WHERE overall IS NOT NULL GROUP BY prompt_id HAVING count(*) >= 2 AND arg_max(expansion, overall * 100 - candidate_id) <> arg_min(expansion, overall * 100 + candidate_id)")
register("flt_gap", lambda get: p.best_worst(get("judged"), min_gap=8).select("prompt_id", "score_gap"), "SELECT prompt_id, max(overall) - min(overall) AS score_gap FROM {judged} WHERE overall IS NOT NULL GROUP BY prompt_id HAVING count(*) >= 2 AND max(overall) - min(overall) >= 8")


def _guard_sql(minimums: dict[str, int]) -> str:
    checks = " ".join(f"when {f} < {m} then 'chosen_{f}_below_{m}'" for f, m in minimums.items())
    return f"case {checks} when failure_modes_csv in ('magic_words', 'off_topic') then concat('chosen_hard_failure_', failure_modes_csv) end"


register(
    "flt_guardrails",
    lambda get: get("judged").withColumn("failure_modes", F.split("failure_modes_csv", ",")).select("doc_id", p.guardrail_failure(STRICT_GUARDRAILS, HARD_FAILURE_MODES).alias("strict"), p.guardrail_failure(LOOSE_GUARDRAILS, HARD_FAILURE_MODES).alias("loose")),
    f"SELECT doc_id, {_guard_sql(STRICT_GUARDRAILS)} AS strict, {_guard_sql(LOOSE_GUARDRAILS)} AS loose FROM {{judged}}",
)
_CORE = "case " + " ".join(f"when c.{f} < r.{f} then 'chosen_loses_{f}'" for f in ("fidelity", "style_fit", "non_genericness", "anti_magic_word_score")) + " end"


def _core(get):
    rows = get("judged").select("prompt_id", F.struct("candidate_id", "fidelity", "style_fit", "non_genericness", "anti_magic_word_score").alias("c"))
    both = rows.join(rows.select("prompt_id", C("c").alias("r")), "prompt_id").filter("c.candidate_id < r.candidate_id")
    return both.select("prompt_id", C("c.candidate_id").alias("a"), C("r.candidate_id").alias("b"), p.core_failure(C("c"), C("r")).alias("reason"))


register("flt_core_dominance", _core, f"SELECT c.prompt_id, c.candidate_id AS a, r.candidate_id AS b, {_CORE} AS reason FROM {{judged}} c JOIN {{judged}} r ON c.prompt_id = r.prompt_id AND c.candidate_id < r.candidate_id")
