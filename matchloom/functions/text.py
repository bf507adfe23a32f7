"""Text functions as Column expressions: normalising, tokens, character grams, missing values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Tokens that normalising removes.
STOP_TOKENS = ("inc", "ltd", "corp", "llc", "the", "a", "an", "and", "or", "of", "for", "by", "to", "in", "on", "at", "is", "it", "co", "corporation")

#: White space and word characters as the usual Unicode definition has them; Java's own classes leave some out.
SPACE = r"[\s\x1c-\x1f\x85\p{Z}]"
NOT_WORD = r"[^\p{L}\p{N}_\s\x1c-\x1f\x85\p{Z}]"
DIGIT_EDGE = r"(?<=\p{Nd})(?=[a-zA-Z])|(?<=[a-zA-Z])(?=\p{Nd})"


def tokens(c: Column) -> Column:
    """Words between white space; an empty array for null."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), SPACE + "+", -1), lambda t: t != "")


def normalize(c: Column) -> Column:
    """Lower case, punctuation to spaces, digits parted from letters, stop tokens dropped, single spaces; ``""`` for null."""
    spaced = F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), NOT_WORD, " "), DIGIT_EDGE, " ")
    return F.array_join(F.filter(tokens(spaced), lambda t: ~t.isin(*STOP_TOKENS)), " ")


def trigram_set(c: Column) -> Column:
    """Distinct three-character substrings; a shorter text is its own only one, an empty text has none."""
    n = F.length(c)
    windows = F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(n - 2, F.lit(1))), lambda i: F.substring(c, i, 3)))
    return F.when(n > 0, windows).otherwise(F.array().cast("array<string>"))


def numeric_tokens(c: Column) -> Column:
    """Distinct tokens made of digits only."""
    return F.array_distinct(F.filter(tokens(c), lambda t: t.rlike(r"^\p{Nd}+$")))


def word_trigrams(c: Column) -> Column:
    """Three-character windows of every word padded by one space on either side, repeated ones kept."""

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        return F.transform(F.sequence(F.lit(1), F.length(w)), lambda i: F.substring(padded, i, 3))

    return F.flatten(F.transform(tokens(c), grams))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, f"^{SPACE}+|{SPACE}+$", "")


def present_text(c: Column) -> Column:
    """False for null, blank and the spelling ``nan``."""
    return c.isNotNull() & ~F.lower(strip(c)).isin("", "nan")


def present_number(c: Column) -> Column:
    """False for null and not-a-number; zero is present."""
    return c.isNotNull() & ~F.isnan(c)


def decimal_text(c: Column) -> Column:
    """A double with a point and at least one decimal between 1e-4 and 1e16, else with a two-digit exponent."""
    plain = F.regexp_replace(F.regexp_replace(c.cast("decimal(38,17)").cast("string"), "0+$", ""), r"\.$", ".0")
    short = F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c.cast("string")), r"\.0e", "e"), r"e-(\d)$", "e-0$1"), r"e(\d+)$", "e+$1")
    size = F.abs(c)
    return F.when((size >= 1e-3) & (size < 1e7) | (size == 0), c.cast("string")).when((size >= 1e-4) & (size < 1e16), plain).otherwise(short)


def serialize_record(title: Column, manufacturer: Column, price: Column) -> Column:
    """``title | manufacturer | price`` with nothing between the bars for what is missing."""
    return F.concat_ws(
        " | ",
        F.when(present_text(title), title).otherwise(F.lit("")),
        F.when(present_text(manufacturer), manufacturer).otherwise(F.lit("")),
        F.when(present_number(price), decimal_text(price)).otherwise(F.lit("")),
    )
