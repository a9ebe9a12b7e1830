"""The cleaning pipeline for chat-bot prompt logs, step by step."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefforge.functions import constants as k
from prefforge.functions import text as t
from prefforge.functions.tables import shared_table
from prefforge.operators.dedup import exact_first, near_dup_greedy


def completed(df: DataFrame) -> DataFrame:
    """Messages that are there and whose first token says that the job is done; blank ones do not match."""
    return df.filter(F.col("content").isNotNull() & (t.first_token(F.col("content")) == k.DONE_WORD))


def not_nsfw(df: DataFrame) -> DataFrame:
    c = F.col("content")
    return df.filter(~(c.contains(k.NSFW_WARNING) | c.contains("sex")))


def one_prompt(df: DataFrame) -> DataFrame:
    return df.filter(t.occurs_once(F.col("content"), k.COMMAND))


def one_author(df: DataFrame) -> DataFrame:
    return df.filter(t.occurs_once(F.col("content"), k.AUTHOR_MARK))


def without_middle_arguments(x: Column, most: int = k.LONGEST_MIDDLE_ARGUMENT) -> Column:
    """Null for a text that has `--` with a long text behind the first one."""
    return t.bound(x, lambda v: F.when(~(v.contains(k.ARGUMENT_MARK) & (F.length(t.after(v, k.ARGUMENT_MARK)) > most)), v))


def with_content(df: DataFrame, content: Column) -> DataFrame:
    """df with new texts, each made once, without the rows whose text becomes null."""
    return t.made_once(df, "content", content).filter(F.col("content").isNotNull())


def extract(df: DataFrame) -> DataFrame:
    """Selected messages as username and prompt body."""
    # a message may be an expression of a view, which each filter would compute again
    df = one_author(one_prompt(not_nsfw(completed(t.made_once(df, "content", F.col("content"))))))
    body = t.before(t.prompt_body(F.col("content")), k.NEGATIVE_ARGUMENT)
    body = t.before(t.strip_arguments(body), k.WARNING_MARK)
    return t.made_once(df.withColumn("username", t.username(F.col("content"))), "content", body)


def cut_arguments(df: DataFrame) -> DataFrame:
    """Prefixes, negative prompts, seeds and arguments are cut off."""
    steps = [t.drop_prefix, *[lambda x, p=p: t.before(x, p) for p in k.NEGATIVE_MARKS], t.trailing_seed, lambda x: t.before(x, k.SCALE_MARK)]
    cut = without_middle_arguments(reduce(lambda x, f: f(x), steps, F.col("content")))
    return with_content(df, t.before(cut, k.ARGUMENT_MARK))


def filter_characters(df: DataFrame) -> DataFrame:
    """Emoji and brackets go; texts without letters, with links or with odd characters are dropped."""
    fine = lambda v: F.when(~t.all_non_ascii(v) & ~t.all_not_alpha(v) & ~v.contains("http"), t.remove_characters(v))
    bare = t.bound(t.strip_emoji(F.col("content")), fine)
    return with_content(df, t.bound(bare, lambda v: F.when(~t.suspicious(v), v)))


def tidy(df: DataFrame) -> DataFrame:
    """White space and edges; what is left of status lines and very short texts is dropped."""
    even = t.squeeze_space(t.space_comma(t.glue_digits(F.col("content"))))
    plain = t.bound(even, lambda v: F.when(~t.has_non_ascii(v), t.strip_characters(v)))
    status = lambda v: v.contains(k.STATUS_TEXT) | v.startswith(k.STATUS_START)
    return with_content(df, t.bound(plain, lambda v: F.when(~status(v) & (F.length(v) > 2), v)))


def clean_messages(df: DataFrame, pos: str = "pos", date: str = "date") -> DataFrame:
    """The whole pipeline: columns pos, content, username, date, ordered by date; pos is the order of the rows."""
    # written once: the near-duplicate step reads it several times, and the steps behind it are not pushed below the window
    df = shared_table(exact_first(extract(df).select(pos, date, "username", "content"), ["content"], pos), "first-messages")
    df = near_dup_greedy(df, "username", date, "content", pos)
    df = tidy(filter_characters(cut_arguments(df)))
    return exact_first(df, ["content"], pos).orderBy(date, pos)
