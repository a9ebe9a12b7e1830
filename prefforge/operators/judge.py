"""Judge replies, score logs and their diagnostics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from prefforge.functions import constants as k
from prefforge.functions import numeric as n
from prefforge.functions import text as t
from prefforge.functions.constants import ALLOWED_FAILURE_MODES, OBJECTIVE_FIELDS
from prefforge.operators.dedup import last_wins

def without_fences(x: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(x, "(?U)" + k.FENCE_BEGIN, ""), k.FENCE_END, "")


def _number_in(x: Column, pattern: str) -> Column:
    got = F.regexp_extract(x, pattern, 1).try_cast("int")
    return F.when(got.between(1, 10), got)


def _reason_after(x: Column) -> Column:
    return F.regexp_extract(x, k.REASON_IN_PROSE, 1)


def parse_flat(reply: Column) -> Column:
    """(score, reason): of the last flat JSON object with a score from 1 to 10, else of a `score: n` in the prose; where
    there is none, no score and the beginning of the reply as reason."""
    text = F.trim(reply)
    clean = without_fences(text)
    objects = F.reverse(F.regexp_extract_all(clean, F.lit(k.FLAT_OBJECT), F.lit(0)))
    scored = F.filter(F.transform(objects, lambda o: F.struct(n.int_1_to_10(o, "$.score").alias("score"), F.coalesce(F.try_variant_get(F.try_parse_json(o), "$.reason", "string"), F.lit("")).alias("reason"))), lambda o: o["score"].isNotNull())
    prose = _number_in(clean, k.SCORE_IN_PROSE)
    found = F.when(F.size(scored) > 0, scored[0]).when(prose.isNotNull(), F.struct(prose.alias("score"), _reason_after(clean).alias("reason")))
    none = F.lit(None).cast("int")
    empty = F.coalesce(F.length(reply), F.lit(0)) == 0
    return F.when(empty, F.struct(none.alias("score"), F.lit("empty_response").alias("reason"))).otherwise(
        F.coalesce(found, F.struct(none.alias("score"), F.concat(F.lit("parse_failed: "), F.left(text, F.lit(150))).alias("reason")))
    )


#: An unescaped quote, within a stretch of text that does not begin behind a backslash.
_QUOTE = r'(?<!\\)(?:\\\\)*"'
#: Values that JSON does not know, where a value stands.
_NOT_NUMBERS = r"(?<=[:\[,]\s{0,20})-?(?:NaN|Infinity)(?=\s*[,}\]])"


def json_objects(text: Column) -> Column:
    """The texts from each opening brace to the one that closes it, the last opening one first; braces within strings are no
    brackets. An opening brace within a string begins an object of its own if it is one.

    The text is cut in front of each brace. How many quotes stand before a brace tells whether it is within a string as
    seen from another one: braces see those of their own parity. Depths are prefix sums over each parity, and an object ends
    where the depth falls below that of its beginning.
    """
    parts = F.regexp_extract_all(text, F.lit(r"[{}][^{}]*"), F.lit(0))
    places = "array<struct<parity: int, depth: int, opens: boolean>>"
    zero = F.struct(F.lit(0).alias("quotes"), F.array(F.lit(0), F.lit(0)).alias("depth"), F.array().cast(places).alias("out"))

    def scan(acc: Column, part: Column) -> Column:
        parity, opens = acc["quotes"] % 2, part.startswith("{")
        depth = F.transform(acc["depth"], lambda d, i: d + F.when(i == parity, F.when(opens, 1).otherwise(-1)).otherwise(0))
        quotes = acc["quotes"] + F.regexp_count(part, F.lit(_QUOTE))
        return F.struct(quotes.alias("quotes"), depth.alias("depth"), F.concat(acc["out"], F.array(F.struct(parity.alias("parity"), depth[parity].alias("depth"), opens.alias("opens")))).alias("out"))

    def objects(x: Column) -> Column:
        numbered = F.transform(x["places"], lambda p, i: F.struct(i.alias("at"), p["parity"].alias("parity"), p["depth"].alias("depth"), p["opens"].alias("opens")))

        def whole(both: Column) -> Column:
            ends = lambda p: F.filter(both, lambda e: ~e["opens"] & (e["at"] > p["at"]) & (e["parity"] == p["parity"]) & (e["depth"] == p["depth"] - 1))
            spans = F.transform(F.filter(both, lambda p: p["opens"]), lambda p: F.struct(p["at"].alias("at"), F.get(ends(p), F.lit(0))["at"].alias("end")))
            return F.transform(F.reverse(F.filter(spans, lambda s: s["end"].isNotNull())), lambda s: F.concat(F.array_join(F.slice(x["parts"], s["at"] + 1, s["end"] - s["at"]), ""), F.lit("}")))

        return t.bound(numbered, whole)

    return t.bound(parts, lambda p: t.bound(F.struct(p.alias("parts"), F.aggregate(p, zero, scan, lambda acc: acc["out"]).alias("places")), objects))


def _kind(v: Column, path: str) -> Column:
    """The type of a part of a variant; null where there is none."""
    return F.schema_of_variant(F.try_variant_get(v, path, "variant"))


def _whole(v: Column, path: str) -> Column:
    """A whole number from 1 to 10: fractions are cut, true counts as 1, a text must be a whole number."""
    text = F.try_variant_get(v, path, "string")
    number = F.when(_kind(v, path) == "STRING", F.when(text.rlike(r"(?U)^\s*[+-]?\d+\s*$"), F.regexp_replace(text, r"(?U)\s", "").try_cast("int"))).otherwise(F.try_variant_get(v, path, "double").try_cast("int"))
    return F.when(number.between(1, 10), number)


def _modes(v: Column) -> Column:
    """Failure modes that are allowed, of a text or of the texts of a list."""
    path = "$.failure_modes"
    items = F.transform(F.try_variant_get(v, path, "array<variant>"), lambda x: F.when(F.schema_of_variant(x) == "STRING", F.try_variant_get(x, "$", "string")))
    found = F.when(_kind(v, path) == "STRING", F.array(F.try_variant_get(v, path, "string"))).otherwise(items)
    return n.normalise_modes(found, ALLOWED_FAILURE_MODES)


def _reason(v: Column) -> Column:
    kind, text = _kind(v, "$.reason"), F.try_variant_get(v, "$.reason", "string")
    return F.when(kind.isNull(), F.lit("")).when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(text)).otherwise(text)


def parse_nested(reply: Column | str) -> Column:
    """The scores of the last JSON object, nested ones included, with an overall (or old-style) score from 1 to 10; else
    those of the prose. Of repeated keys the last counts, and NaN and Infinity count as null."""
    SparkSession.active().conf.set("spark.sql.variant.allowDuplicateKeys", "true")
    text = F.regexp_replace(F.col(reply) if isinstance(reply, str) else reply, r"(?U)^\s+|\s+$", "")
    objectives = ", ".join(f"{f}: int" for f in OBJECTIVE_FIELDS)
    no_modes = F.array().cast("array<string>")

    def row(overall: Column, fields: list[Column], modes: Column, reason: Column) -> Column:
        named = [f.cast("int").alias(c) for f, c in zip(fields, OBJECTIVE_FIELDS, strict=True)]
        return F.struct(overall.cast("int").alias("overall"), *named, modes.alias("failure_modes"), reason.alias("reason")).cast(f"struct<overall: int, {objectives}, failure_modes: array<string>, reason: string>")

    nothing = [F.lit(None)] * len(OBJECTIVE_FIELDS)

    def of_clean(x: Column) -> Column:
        clean = x["clean"]
        parsed = F.transform(json_objects(clean), lambda o: F.coalesce(F.try_parse_json(o), F.try_parse_json(F.regexp_replace(o, _NOT_NUMBERS, "null"))))
        scored = F.transform(parsed, lambda v: F.struct(F.coalesce(_whole(v, "$.overall"), _whole(v, "$.score")).alias("overall"), v.alias("v")))
        best = F.get(F.filter(scored, lambda s: s["overall"].isNotNull()), F.lit(0))
        prose = _number_in(clean, k.OVERALL_IN_PROSE)
        of = lambda s: row(s["overall"], [_whole(s["v"], f"$.{f}") for f in OBJECTIVE_FIELDS], _modes(s["v"]), _reason(s["v"]))
        failed = row(F.lit(None), nothing, no_modes, F.concat(F.lit("parse_failed: "), F.left(x["text"], F.lit(150))))
        told = F.when(prose.isNotNull(), row(prose, nothing, no_modes, _reason_after(clean))).otherwise(failed)
        return t.bound(best, lambda s: F.when(s.isNotNull(), of(s)).otherwise(told))

    empty = F.coalesce(F.length(reply), F.lit(0)) == 0
    found = t.bound(F.struct(text.alias("text"), without_fences(text).alias("clean")), of_clean)
    return F.when(empty, row(F.lit(None), nothing, no_modes, F.lit("empty_response"))).otherwise(found)


def upsert_scores(log: DataFrame, position: str = "line_no", missing_ids: str = "skip") -> DataFrame:
    """The latest record of each (prompt, candidate): old and new score columns fill each other, scores out of 1..10 are
    dropped, failure modes are normalised. Records without ids are skipped, or (minus_one) all fall on one key."""
    if missing_ids == "skip":
        log = log.filter("prompt_id is not null and candidate_id is not null")
    else:
        log = log.withColumns({c: F.coalesce(c, F.lit(-1)) for c in ("prompt_id", "candidate_id")})
    valid = {c: F.when(F.col(c).between(1, 10), F.col(c)) for c in ("score", "overall", *OBJECTIVE_FIELDS) if c in log.columns}
    log = log.withColumns(valid).withColumns({"overall": F.coalesce("overall", "score"), "score": F.coalesce("score", "overall")})
    if "failure_modes" in log.columns:
        log = log.withColumn("failure_modes", n.normalise_modes(F.col("failure_modes")))
    return last_wins(log, ["prompt_id", "candidate_id"], position)


def explode_candidates(cache: DataFrame, texts: str = "candidates") -> DataFrame:
    """One row for each candidate, numbered from 0."""
    return cache.select("prompt_id", "prompt", F.posexplode(texts).alias("candidate_id", "expansion"))


def todo(work: DataFrame, done: DataFrame) -> DataFrame:
    """Work without a record; a record without a score counts as done."""
    return work.join(done.select("prompt_id", "candidate_id").distinct(), ["prompt_id", "candidate_id"], "left_anti")


def resume_scoring(cache: DataFrame, log: DataFrame, score) -> DataFrame:
    """All records: those of the log, and new ones that `score` (frame to frame) makes of what is left."""
    done = upsert_scores(log)
    return done.unionByName(score(todo(explode_candidates(cache), done)), allowMissingColumns=True)


def wrong_sizes(cache: DataFrame, expected: int) -> DataFrame:
    """Prompts whose number of candidates is not the expected one."""
    size = F.coalesce(F.size("candidates"), F.lit(0))
    return cache.select("prompt_id", size.alias("n_candidates")).filter(F.col("n_candidates") != expected)


def validate_cache(cache: DataFrame, expected: int) -> DataFrame:
    """The cache; raises with the count and the first five offenders if sizes differ."""
    wrong = wrong_sizes(cache, expected)
    n_wrong = wrong.count()
    if n_wrong:
        first = [(r["prompt_id"], r["n_candidates"]) for r in wrong.orderBy("prompt_id").limit(5).collect()]
        raise ValueError(f"{n_wrong} prompts do not have {expected} candidates, the first: {first}")
    return cache


def histogram(scored: DataFrame, column: str = "overall", width: int = 40) -> DataFrame:
    """(value, n, bar) for 1 to 10, the longest bar being `width` wide."""
    spark = scored.sparkSession
    counts = scored.filter(F.col(column).isNotNull()).groupBy(F.col(column).cast("long").alias("value")).agg(F.count(F.lit(1)).alias("n"))
    all_values = spark.range(1, 11).withColumnRenamed("id", "value")
    full = all_values.join(counts, "value", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    most = full.agg(F.greatest(F.max("n"), F.lit(1)).alias("most"))
    return full.join(F.broadcast(most)).select("value", "n", F.expr(f"repeat('█', cast(floor(n * {width} / most) as int))").alias("bar"))


def distribution_warnings(scored: DataFrame, column: str = "overall") -> DataFrame:
    """Mean and the warnings on it: over- or under-rating, and a one-sided distribution."""
    x = F.col(column)
    stats = scored.filter(x.isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.avg(x).alias("mean"), F.avg((x <= 3).cast("int")).alias("low"), F.avg((x >= 8).cast("int")).alias("high"))
    return stats.select("n", F.round("mean", 6).alias("mean"), (F.col("mean") > 8.5).alias("over_rating"), (F.col("mean") < 3).alias("under_rating"), ((F.col("low") > 0.7) | (F.col("high") > 0.7)).alias("one_sided"))


def objective_means(scored: DataFrame) -> DataFrame:
    """(objective, mean, n) over rows with an overall score; an objective without values has no mean."""
    long = scored.filter("overall is not null").select(F.expr(f"stack({len(OBJECTIVE_FIELDS)}, " + ", ".join(f"'{f}', cast({f} as double)" for f in OBJECTIVE_FIELDS) + ") as (objective, value)"))
    return long.groupBy("objective").agg(F.round(F.avg("value"), 6).alias("mean"), F.count("value").alias("n"))


def failure_modes(scored: DataFrame) -> DataFrame:
    """(mode, n): rows with each mode, those without any as `none`."""
    return scored.filter("overall is not null").select(F.explode(n.default_modes(F.col("failure_modes"))).alias("mode")).groupBy("mode").agg(F.count(F.lit(1)).alias("n"))


def missing_objectives(scored: DataFrame) -> DataFrame:
    any_missing = F.greatest(*[F.col(f).isNull().cast("int") for f in OBJECTIVE_FIELDS])
    return scored.agg(F.sum(any_missing).alias("n_missing"), F.count(F.lit(1)).alias("n"))
