"""String functions, as expressions of Spark columns."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefforge.functions import constants as k
from prefforge.functions.constants import END_OF_TEXT, SEPARATOR

#: Characters that do not make a prompt suspicious, inside a character class.
PLAIN = r" .,\"\-'!–/;&?"
#: Decimal digits and the superscript and subscript ones.
DIGITS = r"\p{Nd}²³¹⁰⁴-⁹₀-₉"
EMOJI = "[\U0001f000-\U0001faff☀-➿⬀-⯿️‍⃣\U000e0020-\U000e007f]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once, however often use refers to it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def made_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """df with a column that is computed once for each row: filters and expressions behind it, which would otherwise each hold all
    of it again, see a value of a generator, which nothing is pushed through."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != name]
    made = df.select(*rest, F.explode(F.array(value)).alias(name))
    return made if name not in df.columns else made.select(*[F.col(f"`{c}`") for c in df.columns])


def lower_columns(df: DataFrame) -> DataFrame:
    """All column names in lower case."""
    return df.toDF(*[c.lower() for c in df.columns])


def first_token(x: Column) -> Column:
    """The first of the parts between white space; empty for blank text."""
    return F.regexp_extract(x, r"(?U)^\s*(\S*)", 1)


def count_of(x: Column, part: str) -> Column:
    """Non-overlapping occurrences of part."""
    return ((F.length(x) - F.length(F.replace(x, F.lit(part), F.lit("")))) / F.lit(len(part))).cast("int")


def occurs_once(x: Column, part: str) -> Column:
    """Whether part is there and not again behind its first occurrence, found without a copy of the text."""
    at = F.instr(x, F.lit(part))
    return (at > 0) & (F.position(F.lit(part), x, at + len(part)) == 0)


def before(x: Column, part: str) -> Column:
    """What stands before the first occurrence of part; all of it if there is none."""
    return F.substring_index(x, part, 1)


def after(x: Column, part: str) -> Column:
    """What stands between the first and the second occurrence of part; empty if there is none. `split_part` would make a pattern and
    all parts for each row."""
    at = F.instr(x, F.lit(part))
    return F.when(at > 0, before(F.substring(x, at + len(part), F.length(x)), part)).when(x.isNotNull(), "")


def username(x: Column) -> Column:
    return before(after(x, k.AUTHOR_MARK), k.AUTHOR_END)


def ascii_only(x: Column) -> Column:
    """Whether a text has no character beyond ASCII: the patterns below look at each character with several Unicode classes, which
    such texts need not."""
    return F.octet_length(x) == F.length(x)


def without_last(x: Column) -> Column:
    return bound(x, lambda v: F.left(v, F.length(v) - 1))


def prompt_body(x: Column) -> Column:
    """What follows the command, without its last character."""
    return without_last(after(x, k.COMMAND))


def strip_arguments(x: Column) -> Column:
    """Cut ` key:...` to the end of the line."""
    return bound(x, lambda v: F.when(~v.contains(":"), v).otherwise(F.regexp_replace(v, k.ARGUMENTS, "")))


def drop_prefix(x: Column, prefix: str = "prompt") -> Column:
    """Without a prefix in any case."""
    return F.regexp_replace(x, "(?i)^" + re.escape(prefix), "")


def trailing_seed(x: Column) -> Column:
    """Without a `seed` at the end, if there is no other one."""
    return bound(x, lambda v: F.when(v.endswith("seed"), F.regexp_replace(v, r"(?s)\A((?:(?!seed).)*+)seed\z", "$1")).otherwise(v))


def strip_emoji(x: Column) -> Column:
    return bound(x, lambda v: F.when(ascii_only(v), v).otherwise(F.regexp_replace(v, EMOJI, "")))


def remove_characters(x: Column, characters: str = k.BRACKETS) -> Column:
    some = "[" + "".join("\\" + c for c in characters) + "]"
    return bound(x, lambda v: F.when(v.rlike(some), F.translate(v, characters, "")).otherwise(v))


def glue_digits(x: Column) -> Column:
    """No white space between a digit and a digit or a size suffix."""
    return F.regexp_replace(x, k.LOOSE_DIGITS, "")


def space_comma(x: Column) -> Column:
    return F.regexp_replace(x, k.SPACE_BEFORE_COMMA, ",")


def squeeze_space(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)\s+", " ")


def strip_characters(x: Column, characters: str = k.EDGE_CHARACTERS) -> Column:
    return F.btrim(x, F.lit(characters))


def as_prompt(x: Column) -> Column:
    """The part before the separator, with the separator."""
    return F.concat(before(x, SEPARATOR), F.lit(SEPARATOR))


def completion(x: Column) -> Column:
    """The part behind the separator, without the end token."""
    return F.replace(after(x, SEPARATOR), F.lit(END_OF_TEXT), F.lit(""))


def has_two_parts(x: Column, separator: str = SEPARATOR) -> Column:
    return count_of(x, separator) == 1


def without_special_tokens(x: Column) -> Column:
    return F.replace(F.replace(x, F.lit(END_OF_TEXT), F.lit("")), F.lit(SEPARATOR), F.lit(""))


def sft_template(description: Column, prompt: Column) -> Column:
    return F.concat(F.lit(k.SFT_BEGIN), description, F.lit(k.SFT_MIDDLE), prompt, F.lit(k.SFT_END))


def reward_text(description: Column, prompt: Column) -> Column:
    return F.concat(description, F.lit(SEPARATOR), prompt)


def fill_template(template: str, **values: Column) -> Column:
    """A template whose {name} (or {}) are replaced, with doubled braces standing for single ones."""
    out = F.lit(template)
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + ("" if name == "_" else name) + "}"), value)
    return F.replace(F.replace(out, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}"))


def url(base: str, name: Column, slash: bool = True) -> Column:
    return F.concat(F.lit(base + "/" * slash), name)


def truncate(x: Column, n: int, ellipsis: str = "") -> Column:
    return F.when(F.length(x) > n, F.concat(F.left(x, F.lit(n)), F.lit(ellipsis))).otherwise(x)


def phrase_hits(x: Column, phrases: list[str]) -> Column:
    """Occurrences of all phrases in lower-cased text; a phrase within another counts for both."""
    return bound(F.lower(x), lambda low: hits_in(low, phrases))


def hits_in(low: Column, phrases: list[str]) -> Column:
    """Occurrences of all phrases in a lower-cased text; those that it does not have cost one search and no copy."""
    return sum((F.when(low.contains(p), count_of(low, p)).otherwise(0) for p in phrases), F.lit(0))


def tokens(x: Column) -> Column:
    return F.regexp_extract_all(x, F.lit(r"(?U)\w+"), F.lit(0))


def token_count(x: Column) -> Column:
    return F.size(tokens(x))


def repeated_in(words: Column, n: int = 3) -> Column:
    """Sum over n-grams of a list of words of how often they repeat: all n-grams less the distinct ones. Words hold no blanks,
    so an n-gram is a text, which is told apart by hashing."""
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - n), lambda i: F.concat_ws(" ", *[F.get(words, i + k) for k in range(n)]))
    return F.when(F.size(words) >= n, bound(grams, lambda g: F.size(g) - F.size(F.array_distinct(g)))).otherwise(0)


def repeated_ngrams(x: Column, n: int = 3) -> Column:
    return bound(tokens(F.lower(x)), lambda words: repeated_in(words, n))


def known_words(prompt: Column) -> Column:
    """The distinct words of a prompt."""
    return F.array_distinct(tokens(F.lower(F.replace(prompt, F.lit(SEPARATOR), F.lit("")))))


def share_known(words: Column, known: Column) -> Column:
    """Share of the words that are among the known ones; 0 for no words."""
    return F.when(F.size(words) > 0, F.size(F.filter(words, lambda t: F.array_contains(known, t))) / F.size(words)).otherwise(0.0)


def copy_ratio(prompt: Column, text: Column) -> Column:
    """Share of the text's tokens that the prompt has; 0 for a text without tokens."""
    return bound(F.struct(tokens(F.lower(text)).alias("own"), known_words(prompt).alias("known")), lambda x: share_known(x["own"], x["known"]))


def round_half_even(x: Column, digits: int = 3) -> Column:
    return F.bround(x, digits)


def all_non_ascii(x: Column) -> Column:
    """No ASCII character other than plain punctuation and digits."""
    return ~x.rlike(r"[\x00-\x7F&&[^ .,\"\-'!/;&?0-9]]")


def all_not_alpha(x: Column) -> Column:
    return ~x.rlike(r"\p{L}")


def suspicious(x: Column) -> Column:
    """Whether a text has other characters than letters, digits and some others. Runs of plain ASCII are passed at once; only what
    stands between them is looked up in Unicode classes."""
    plain = rf"[a-zA-Z0-9{PLAIN.replace('–', '')}+*_#|]++"
    return bound(x, lambda v: F.when(ascii_only(v), ~v.rlike(rf"\A(?:{plain})?+\z")).otherwise(~v.rlike(rf"\A(?:{plain}|[\p{{L}}{DIGITS}–]++)*+\z")))


def has_non_ascii(x: Column) -> Column:
    return bound(x, lambda v: ~ascii_only(v) & v.rlike(rf"[^\x00-\x7F–{DIGITS}]"))


def words(x: Column) -> Column:
    """Parts between white space; none for blank text."""
    return F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")


def name_and_path(x: Column) -> tuple[Column, Column]:
    """`name:path`, split at the first colon; a missing colon raises."""
    at = F.instr(x, ":")
    checked = F.when(at > 0, x).otherwise(F.raise_error(F.concat(F.lit("expected name:path, got "), x)).cast("string"))
    return F.substring_index(checked, ":", 1), F.substring(checked, at + 1, F.length(x))


def checkpoint_name(step: Column) -> Column:
    return F.format_string(k.CHECKPOINT_FORMAT, step)


def tail_tokens(x: Column, n: int = 10) -> Column:
    """The last n tokens, joined: equal ends across a batch show a template (an extension)."""
    return bound(tokens(F.lower(x)), lambda t: F.array_join(F.slice(t, F.greatest(F.lit(1), F.size(t) - (n - 1)), F.lit(n)), " "))
