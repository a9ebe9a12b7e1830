"""Line dedup by winnowing over line hashes, with DataFrame functions only.

What is deleted are runs of lines that stood before (in a document with a smaller id, or earlier in the same one). The
shortest run that counts is measured by content: from a line on it has as many lines as hold `words` words, and three at
most. So one long line, or two, count as well as three short ones.

A window is such a shortest run from each line on. Its fingerprint is the least of its line hashes, leftmost of equals
(the window minimum): equal windows have the same fingerprint at the same place in them, and neighbouring windows mostly
share theirs, which thins them out. Only these places are sent on, each once, with the hashes of the lines beside it. Of
them, those whose fingerprint stands at several places are joined by it and extended to both sides, line by line, as far as
the windows reach that have their minimum there. Where the lines on both sides are equal too, all but the first of the
places are later repeats. Matches that follow each other join to longer runs, which are deleted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefforge.functions.tables import shared_table
from prefforge.llm.textops import n_words, named_columns, numbered_columns, whole

#: Most lines of the shortest run that is deleted, and the words from which fewer lines are enough.
RUN = 3
WORDS = 20


def _windows(hashes: Column, counts: Column, run: int, words: int) -> Column:
    """Of each line the window from it: (m, at): its number of lines, and where its least line hash stands; null where it does
    not fit into the text."""

    def window(i: Column) -> Column:
        so_far, m = F.get(counts, i), F.lit(run)
        tests = []
        for k in range(1, run):
            tests.append((so_far >= words, k))
            so_far = so_far + F.get(counts, i + k)
        for test, k in reversed(tests):
            m = F.when(test, k).otherwise(m)
        m = m.cast("int")
        line = lambda k: F.when(m > k, F.struct(F.get(hashes, i + k).alias("print"), (i + k).alias("at")))
        # nulls of lines beyond the window do not count
        least = F.array_min(F.array(*[line(k) for k in range(run)])) if run > 1 else line(0)
        return F.when(i + m <= F.size(hashes), F.struct(m.alias("m"), least["at"].alias("at")))

    return F.transform(F.sequence(F.lit(0), F.size(hashes) - 1), window)


def _places(hashes: Column, counts: Column, run: int, words: int) -> Column:
    """The places of window minima: (at, print, m0, m1, ..., l1, ..., r1, ...): the line, its hash, the lines of the window that
    begins k lines before and has its minimum here (null: none does), and the hashes of the lines before and behind it."""

    def of(windows: Column) -> Column:
        def place(at: Column) -> Column:
            own = [F.get(windows, at - k) for k in range(run)]
            ms = [F.when(w["at"] == at, w["m"]).alias(f"m{k}") for k, w in enumerate(own)]
            # F.get gives null beyond both ends
            beside = [F.get(hashes, at + side * k).alias(f"{name}{k}") for name, side in (("l", -1), ("r", 1)) for k in range(1, run)]
            return F.struct(at.alias("at"), F.get(hashes, at).alias("print"), *ms, *beside)

        each = F.transform(F.sequence(F.lit(0), F.size(hashes) - 1), place)
        return F.filter(each, lambda p: F.coalesce(*[p[f"m{k}"] for k in range(run)]).isNotNull())

    return F.get(F.transform(F.array(_windows(hashes, counts, run, words)), of), F.lit(0))


def repeated_lines(docs: DataFrame, id_col: str, text_col: str, run: int = RUN, words: int = WORDS) -> tuple[DataFrame, DataFrame]:
    """(texts by row number, (_row, _line) of the lines to delete). Rows without an id come last; of rows with equal ids that
    counts as earlier whose text has the smaller hash, so that it does not matter in which order they are read."""
    text = whole(F.col(f"`{text_col}`"))
    base = docs.select(F.col(f"`{id_col}`").alias("_id"), F.monotonically_increasing_id().alias("_row"), F.xxhash64(text, F.lit(1)).alias("_h"), F.split(text, "\n", -1).alias("_lines"))
    hashed = base.select("_id", "_row", "_h", F.transform("_lines", lambda x: F.xxhash64(x)).alias("_hashes"), F.transform("_lines", lambda x: n_words(x).cast("int")).alias("_counts"))
    rows = shared_table(hashed, "line-hashes")
    places = rows.select("_id", "_row", "_h", F.explode(_places(F.col("_hashes"), F.col("_counts"), run, words)).alias("p")).select("_id", "_row", "_h", "p.*")
    met = shared_table(places.groupBy("print").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("print").alias("p")), "repeated-prints")
    places = places.join(met, F.col("print") == F.col("p"), "left_semi")
    # the windows of a place: k lines before it and those behind it, which are compared one by one
    line = lambda name, d: F.col(f"{name}{d}")
    windows = F.array_compact(F.array(*[F.when(F.col(f"m{k}").isNotNull(), F.struct(
        (F.col("at") - k).alias("i"), F.lit(k).alias("k"), F.col(f"m{k}").alias("m"),
        *[(line("l", d) if d <= k else F.when(F.col(f"m{k}") > d, line("r", d - k))).alias(f"x{d}") for d in range(1, run)],
    )) for k in range(run)]))
    near = shared_table(places.select("_id", "_row", "_h", "print", F.explode(windows).alias("w")).select("_id", "_row", "_h", "print", "w.*"), "line-matches")
    order = F.struct(F.col("_id").isNull().alias("x"), "_id", "_h", "_row", F.col("i").alias("_line"))
    key = ["print", "k", "m", *[f"x{d}" for d in range(1, run)]]
    first = near.groupBy(*key).agg(F.min(order).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    first = shared_table(first.select(*[F.col(c).alias(f"_{c}") for c in key], F.col("first._row").alias("first_row"), F.col("first._line").alias("first_line")), "first-matches")
    equal = F.col("print") == F.col("_print")
    for c in key[1:]:
        equal = equal & F.col(c).eqNullSafe(F.col(f"_{c}"))
    later = near.join(first, equal).filter("_row <> first_row or i <> first_line")
    gone = later.select("_row", F.explode(F.sequence(F.col("i"), F.col("i") + F.col("m") - 1)).alias("_line")).distinct()
    return rows, gone


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """id, n_lines, n_removed, n_spans (maximal removed runs) and removed (line numbers as first-last from 0, joined by
    commas) of each row. Lines end at \\n; null texts count as empty, which is one empty line. Of repeated rows all but the
    first lose what repeats. An empty table gives no rows."""
    rows, gone = repeated_lines(docs, id_col, text_col, run, words)
    return _spans(rows, gone).select(F.col("_id").alias(id_col), "n_lines", "n_removed", "n_spans", "removed")


def _spans(rows: DataFrame, gone: DataFrame) -> DataFrame:
    along = Window.partitionBy("_row").orderBy("_line")
    runs = gone.withColumn("_g", F.col("_line") - F.row_number().over(along)).groupBy("_row", "_g").agg(F.min("_line").alias("a"), F.max("_line").alias("b"))
    spans = runs.groupBy(F.col("_row").alias("_r")).agg(F.array_sort(F.collect_list(F.struct("a", "b"))).alias("s"))
    out = rows.select("_row", "_id", F.size("_hashes").cast("long").alias("n_lines")).join(spans, F.col("_row") == F.col("_r"), "left")
    zero = F.lit(0).cast("long")
    return out.select(
        "_row",
        "_id",
        "n_lines",
        F.coalesce(F.aggregate("s", zero, lambda t, x: t + x["b"] - x["a"] + 1), zero).alias("n_removed"),
        F.when(F.col("s").isNull(), zero).otherwise(F.size("s").cast("long")).alias("n_spans"),
        F.coalesce(F.array_join(F.transform("s", lambda x: F.concat(x["a"].cast("string"), F.lit("-"), x["b"].cast("string"))), ","), F.lit("")).alias("removed"),
        "s",
    )


def remove_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", run: int = RUN, words: int = WORDS) -> DataFrame:
    """docs with the repeated lines cut out of their texts; all columns stay. Rows are known by a number, so ids may repeat."""
    plain, at = numbered_columns(docs)
    numbered = shared_table(plain.withColumn("_place", F.monotonically_increasing_id()), "numbered-texts")
    keyed = numbered.select(F.struct(F.col(at[id_col]).isNull().alias("x"), F.col(at[id_col]).alias("i"), F.xxhash64(whole(F.col(at[text_col])), F.lit(1)).alias("h"), F.col("_place").alias("p")).alias("key"), F.col(at[text_col]).alias("t"))
    rows, gone = repeated_lines(keyed, "key", "t", run, words)
    spans = _spans(rows, gone).filter("n_removed > 0").select(F.col("_id.p").alias("_p"), "s")
    text = F.col(at[text_col])
    joined = numbered.join(spans, F.col("_place") == F.col("_p"), "left")
    kept = F.filter(F.split(text, "\n", -1), lambda line, i: ~F.exists("s", lambda c: (i >= c["a"]) & (i <= c["b"])))
    return named_columns(joined.withColumn(at[text_col], F.when(F.col("s").isNull(), text).otherwise(F.array_join(kept, "\n"))), at)
