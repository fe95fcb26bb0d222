"""Words as SQL expressions, for operators that stay with DataFrame functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPACES = r"[\x20\x09-\x0D]+"


def starts_plain(w: Column) -> Column:
    """Whether a word starts with an ASCII letter or digit: a cheap test before a regular expression."""
    return ((w >= "a") & (w < "{")) | ((w >= "A") & (w < "[")) | starts_digit(w)


def starts_digit(w: Column) -> Column:
    return (w >= "0") & (w < ":")


def solid_words(text: Column) -> Column:
    """White-space words that hold a letter or digit, as they stand; none for a null text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: starts_plain(w) | w.rlike(r"[\p{L}\p{N}]"))


def cores(words: Column) -> Column:
    """Words without signs at either end."""

    def core(w: Column) -> Column:
        return F.when(starts_plain(w) & starts_plain(F.substr(w, F.lit(-1))), w).otherwise(F.regexp_replace(w, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", ""))

    return F.transform(words, core)


#: The same in DuckDB's SQL.
WORDS_SQL = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: regexp_matches(w, '[\p{L}\p{N}]'))"
CORES_SQL = r"list_transform(w, lambda x: regexp_replace(x, '^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$', '', 'g'))"
