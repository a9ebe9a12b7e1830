"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the entities that fixed forms find: e-mail addresses, IP addresses, payment cards and phone numbers, and secrets
behind a word that names them. The lexical patterns around an entity are the word in front of it, the two words in front of
it, and the word behind it. Patterns and the identifier-like tokens that they stand at anywhere in the corpus are a graph,
which is scored in rounds: a pattern is as good as its tokens, and as the share of its occurrences that have an identifier;
a token that no form knows is as good as its best pattern. Tokens of patterns of high confidence are added to the seeds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions.tables import shared_table
from prefforge.llm.textops import WORD, lower_ascii, whole

#: The base kinds, which the fixed digest and counts are of, and one more.
KINDS = ("email", "ip", "card", "phone", "secret")
BASE = 4
#: The forms. Each finds, in linear time, exactly the leftmost matches (of those that can pass the test of its kind) of:
#: email [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+   ip [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)
#: card [0-9]([\x20-]?[0-9])+   phone \+[0-9][\x20().0-9-]+[0-9]
#: A local part can begin only behind another character or where the match before ends, a number only behind a
#: non-digit; a card is a whole run of digits and single separators.
FORMS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"(?i)(?<=(?:token|secret|passwd|password|api_?key|access_?key)[\"']?\x20{0,3}[=:]\x20{0,3}[\"']?)[a-z0-9+/_~-]{16,}+",
}
#: The texts without which a form cannot match, in lower case.
NEEDS = {"email": ["@"], "phone": ["+"], "secret": ["token", "secret", "passw", "key"]}
#: What does not belong to a token at its ends.
LEAD = r"^[^\p{L}\p{N}+@]+"
TRAIL = r"[^\p{L}\p{N}@]+$"
#: A token that looks like an identifier: it holds a digit or an @.
TOKEN = r"(?<![^\x20\x09-\x0D])[^\x20\x09-\x0D0-9@]*+[0-9@][^\x20\x09-\x0D]*+"
#: A token that can be a part of an identifier written with blanks.
NUMBER = r"^\+?[0-9().-]+$"
#: Rounds; distinct seeds that a pattern needs; confidence from which its tokens are added; weight of what is not a seed.
ROUNDS = 3
LEAST_SEEDS = 3
CONFIDENT = 0.6


def passes(kind: str, match: Column) -> Column:
    """The test of a match."""
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return F.forall(F.split(match, "[.]"), lambda x: F.coalesce(F.when(F.length(F.regexp_replace(x, "^0+", "")) <= 3, F.regexp_replace(x, "^0+(?=.)", "").try_cast("int") <= 255), F.lit(False)))
    if kind == "card":
        each = F.transform(F.reverse(F.split(digits, "")), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(F.floor(c.cast("int") * 2 / 10).cast("int") + c.cast("int") * 2 % 10))
        return F.length(digits).between(14, 19) & (F.aggregate(each, F.lit(0), lambda a, b: a + b) % 10 == 0)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _matches(text: Column, form: str) -> Column:
    """(gap, match) of each match, gap being the length of the text between it and the one before."""
    gaps = F.transform(F.split(text, form, -1), lambda x: F.length(x))
    return F.zip_with(F.regexp_extract_all(text, F.lit(form), F.lit(0)), gaps, lambda m, g: F.struct(g.alias("gap"), m.alias("match")))


def _placed(found: DataFrame, column: str) -> DataFrame:
    """Rows of (_row, start, end, match, ...) of the matches in an array column."""
    along = Window.partitionBy("_row").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    rows = found.filter(F.size(column) > 0).select("_row", F.posexplode(column).alias("_at", "m"))
    length = F.length("m.match").cast("long")
    rows = rows.filter("m.match is not null").withColumn("end", F.sum(F.col("m.gap") + length).over(along))
    return rows.select("_row", (F.col("end") - length).alias("start"), "end", "m.*")


def _seeds(found: DataFrame) -> DataFrame:
    """(_row, kind no., start, end, entity in lower case) of the base entities."""
    parts = []
    for n, kind in enumerate(KINDS):
        rows = _placed(found, kind).filter(passes(kind, F.col("match")))
        parts.append(rows.select("_row", F.lit(n).alias("kind"), "start", "end", F.lower("match").alias("entity")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added and n_found, for each row of docs.

    Counts and digest are those of the base entities; spans holds all, as kind:start:end by start and then kind, in code
    points, end exclusive. A null or empty text has none (the digest is that of the empty text). Repeated rows are
    told apart by a row number, so each gets its own result; an empty table gives no rows.
    """
    text = whole(F.col(f"`{text_col}`"))
    source = docs.select(F.col(f"`{id_col}`").alias("_id"), text.alias("_text"))
    # no form matches without one of these, so all other texts are left after this scan
    some = F.col("_text").rlike("[0-9@]")
    empty = F.from_json(F.lit("[]"), "array<struct<gap:int,match:string>>")
    low = F.lower("_text")
    needs = {k: F.greatest(*[low.contains(x) if k == "secret" else F.col("_text").contains(x) for x in v], F.lit(False)) for k, v in NEEDS.items()}
    arrays = [F.when(some & needs.get(k, F.lit(True)), _matches(F.col("_text"), f)).otherwise(empty).alias(k) for k, f in FORMS.items()]
    # the words around a token are the last ones of the gap before it and the first one of the gap behind it
    gaps = F.split(F.col("_text"), TOKEN, -1)
    last = lambda g, words: lower_ascii(F.regexp_replace(F.regexp_extract(g, rf"(?s)^(?:.*[\x20\x09-\x0D])?({words})[\x20\x09-\x0D]+$", 1), r"[\x20\x09-\x0D]+", " "))
    words = lambda g: F.struct(F.length(g).alias("gap"), last(g, WORD).alias("front"), last(g, rf"{WORD}[\x20\x09-\x0D]+{WORD}").alias("two"), lower_ascii(F.regexp_extract(g, r"^[\x20\x09-\x0D]+([^\x20\x09-\x0D]+)(?=[\x20\x09-\x0D]|$)", 1)).alias("next"), (g == " ").alias("spaced"))
    around = F.transform(gaps, words)
    token = lambda m, g: F.struct(g["gap"].alias("gap"), m.alias("match"), g["front"].alias("front"), g["two"].alias("two"), g["spaced"].alias("spaced"))
    tokens = F.zip_with(F.zip_with(F.regexp_extract_all(F.col("_text"), F.lit(TOKEN), F.lit(0)), around, token), F.slice(around, 2, F.greatest(F.size(around) - 1, F.lit(0))), lambda t, g: F.struct(*[t[c].alias(c) for c in ("gap", "match", "front", "two", "spaced")], g["next"].alias("behind")))
    no_tokens = F.from_json(F.lit("[]"), "array<struct<gap:int,match:string,front:string,two:string,spaced:boolean,behind:string>>")
    found = shared_table(source.select(F.monotonically_increasing_id().alias("_row"), "_id", *arrays, F.when(some, tokens).otherwise(no_tokens).alias("tokens")), "pii-found")
    seeds = shared_table(_seeds(found), "pii-seeds")
    added = _bootstrap(source, _placed(found, "tokens"), seeds)
    spans = seeds.drop("entity").withColumn("base", F.col("kind") < BASE).unionByName(added.withColumn("base", F.lit(False)))
    names = F.array(*[F.lit(k) for k in KINDS])
    as_text = lambda a: F.array_join(F.transform(a, lambda s: F.concat(F.element_at(names, s["kind"] + 1), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")
    grouped = spans.groupBy("_row").agg(F.array_sort(F.collect_list(F.struct("start", "kind", "end", "base"))).alias("s"))
    grouped = grouped.select(F.col("_row").alias("_r"), "s", F.filter("s", lambda x: x["base"]).alias("b"))
    none = F.lit(0).cast("long")
    count = lambda n: F.coalesce(F.size(F.filter("b", lambda x: x["kind"] == n)).cast("long"), none)
    out = found.select("_row", "_id").join(grouped, F.col("_row") == F.col("_r"), "left")
    return out.select(
        F.col("_id").alias(id_col),
        *[F.when(F.col("b").isNull(), none).otherwise(count(n)).alias(f"n_{k}") for n, k in enumerate(KINDS[:BASE])],
        F.sha2(F.coalesce(as_text(F.col("b")), F.lit("")), 256).alias("base_sha256"),
        F.coalesce(as_text(F.col("s")), F.lit("")).alias("spans"),
        F.coalesce(F.size("s") - F.size("b"), F.lit(0)).cast("long").alias("n_added"),
        F.greatest(F.coalesce(F.size("s"), F.lit(0)), F.lit(0)).cast("long").alias("n_found"),
    )


def _bootstrap(source: DataFrame, tokens: DataFrame, seeds: DataFrame) -> DataFrame:
    """(_row, kind, start, end) of tokens that no form knows but a confident pattern announces."""
    # tokens without what does not belong to them at their ends
    lead, trail = F.length(F.regexp_extract("match", LEAD, 0)), F.length(F.regexp_extract("match", TRAIL, 0))
    tokens = tokens.withColumn("start", F.col("start") + lead).withColumn("end", F.col("end") - trail).filter("start < end")
    tokens = tokens.withColumn("token", F.lower(F.regexp_replace(F.regexp_replace("match", LEAD, ""), TRAIL, ""))).filter(F.col("token").rlike("[0-9@]"))
    # which tokens touch a seed: one that begins before and ends in or behind them, or one that begins within
    nothing = {c: F.lit(None).cast(t) for c, t in (("token", "string"), ("front", "string"), ("two", "string"), ("behind", "string"), ("spaced", "boolean"), ("kind", "int"), ("entity", "string"))}
    columns = ["_row", "start", "end", *nothing]
    marks = tokens.withColumns({c: nothing[c] for c in ("kind", "entity")}).select(*columns).unionByName(seeds.withColumns({c: v for c, v in nothing.items() if c not in ("kind", "entity")}).select(*columns))
    order = Window.partitionBy("_row").orderBy("start", F.col("kind").asc_nulls_last())
    seed = F.col("kind").isNotNull()
    before = F.max(F.when(seed, F.struct("end", "kind", "entity"))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    behind = F.min(F.when(seed, F.struct("start", "kind", "entity"))).over(order.rowsBetween(0, Window.unboundedFollowing))
    touched = marks.withColumn("_b", before).withColumn("_f", behind).filter("token is not null")
    owner = F.when(F.col("_b.end") > F.col("start"), F.struct("_b.kind", "_b.entity")).when(F.col("_f.start") < F.col("end"), F.struct("_f.kind", "_f.entity"))
    # a token that touches a seed stands for the whole entity; numbers of no seed with one blank between them are one identifier
    touched = touched.select("_row", "start", "end", F.coalesce(owner["entity"], F.col("token")).alias("token"), "front", "two", "behind", owner["kind"].alias("kind"), "spaced")
    touched = touched.withColumn("_number", F.col("kind").isNull() & F.col("token").rlike(NUMBER))
    along = Window.partitionBy("_row").orderBy("start")
    goes_on = F.col("_number") & F.col("spaced") & F.coalesce(F.lag("_number").over(along), F.lit(False))
    touched = touched.withColumn("_head", F.when(~goes_on, F.col("start"))).withColumn("_head", F.max("_head").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    whole_token = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("start", "token"))), lambda x: x["token"]), " ")
    runs = touched.groupBy("_row", F.col("_head").alias("start")).agg(F.max("end").alias("end"), whole_token.alias("token"), F.max("front").alias("front"), F.max("two").alias("two"), F.max_by("behind", "start").alias("behind"), F.max("kind").alias("kind"))
    # a pattern is one or two words in front (l) or one behind (r); a token beside another token has none there
    pattern = lambda side, c: F.when(F.col(c) != "", F.concat(F.lit(side + " "), F.col(c)))
    places = runs.withColumn("front", F.explode(F.array_compact(F.array(pattern("l", "front"), pattern("l", "two"), pattern("r", "behind"))))).drop("two", "behind")
    places = shared_table(places, "pii-places")
    # patterns worth a look have enough distinct seeds; how often their word stands in the corpus at all decides with
    seeded = places.filter("kind is not null").select("front", "token").distinct().groupBy("front").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= LEAST_SEEDS).select("front")
    seeded = shared_table(seeded, "pii-patterns")
    spaced = F.translate(F.col("_text"), "\t\n\x0b\x0c\r", "     ")
    # only words of patterns are counted, not the whole vocabulary
    words = F.filter(F.split(lower_ascii(spaced), " "), lambda w: w != "")
    twos = lambda w: F.zip_with(F.slice(w, 1, F.greatest(F.size(w) - 1, F.lit(0))), F.slice(w, 2, F.greatest(F.size(w) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))
    all_words = source.select(F.explode(F.get(F.transform(F.array(words), lambda w: F.concat(w, twos(w))), F.lit(0))).alias("w"))
    wanted = seeded.select(F.substring("front", 3, 1 << 30).alias("own")).distinct()
    stands = all_words.join(wanted, F.col("w") == F.col("own"), "left_semi").groupBy("w").agg(F.count(F.lit(1)).alias("stands"))
    stands = seeded.join(stands, F.substring("front", 3, 1 << 30) == F.col("w")).select(F.col("front").alias("p"), "stands")
    followed = places.groupBy("front").agg(F.count(F.lit(1)).alias("followed"))
    patterns = shared_table(stands.join(followed, F.col("p") == F.col("front")).select("p", (F.col("followed") / F.col("stands")).alias("use")).filter("use >= 0.5"), "pii-use")
    # the graph, only around patterns that identifiers follow
    edges = shared_table(places.join(patterns, F.col("front") == F.col("p")).groupBy("p", "use", "token").agg(F.max("kind").alias("seed")), "pii-edges")
    own = edges.select("p", "use", "token", "seed", F.explode(F.sequence(F.lit(0), F.lit(len(KINDS) - 1))).alias("k"))
    scored = own.withColumn("score", F.when(F.col("seed") == F.col("k"), 1.0).otherwise(0.0))
    for _ in range(ROUNDS):
        good = scored.groupBy("p", "use", "k").agg((F.sum("score") / F.count(F.lit(1)) * F.first("use")).alias("good")).select(F.col("p").alias("gp"), F.col("k").alias("gk"), "good")
        reached = own.join(good, (F.col("p") == F.col("gp")) & (F.col("k") == F.col("gk"))).groupBy("token", "k").agg(F.max("good").alias("best"))
        reached = reached.select(F.col("token").alias("t"), F.col("k").alias("tk"), "best")
        scored = own.join(reached, (F.col("token") == F.col("t")) & (F.col("k") == F.col("tk"))).select("p", "use", "token", "seed", "k", F.when(F.col("seed").isNull(), F.col("best")).when(F.col("seed") == F.col("k"), 1.0).otherwise(0.0).alias("score"))
        scored = shared_table(scored, "pii-round")
    best = scored.filter(F.col("seed").isNull()).groupBy("p", "token").agg(F.max(F.struct("score", -F.col("k"))).alias("b"))
    best = best.filter(F.col("b.score") >= CONFIDENT).select(F.col("p").alias("bp"), F.col("token").alias("bt"), (-F.col("b.col2")).cast("int").alias("k"), F.col("b.score").alias("score"))
    added = places.filter("kind is null").join(best, (F.col("front") == F.col("bp")) & (F.col("token") == F.col("bt")))
    # several patterns may announce one token: the best decides
    return added.groupBy("_row", "start", "end").agg(F.max(F.struct("score", -F.col("k"))).alias("b")).select("_row", (-F.col("b.col2")).cast("int").alias("kind"), "start", "end")
