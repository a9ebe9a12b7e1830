"""Column expressions on texts that several operators of this subpackage share."""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words are runs of anything but space, tab, newline, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


def lower_ascii(text: Column) -> Column:
    """Lower-case A-Z and leave every other character as it is."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def whole(text: Column) -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(text, F.lit(""))


def n_words(text: Column) -> Column:
    """Number of words; null and blank texts have none."""
    spaced = F.translate(whole(text), "\t\n\x0b\x0c\r", "     ")
    return F.size(F.filter(F.split(spaced, " "), lambda w: w != "")).cast("long")


def numbered_columns(df: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """df with columns d0, d1, ..., so that none of its names can clash, and the new name of each."""
    at = {c: f"d{i}" for i, c in enumerate(df.columns)}
    return df.select(*[F.col(f"`{c}`").alias(d) for c, d in at.items()]), at


def named_columns(df: DataFrame, at: dict[str, str]) -> DataFrame:
    """The columns of numbered_columns under their names."""
    return df.select(*[F.col(d).alias(c) for c, d in at.items()])
