"""Keys and other scalar functions of text, as columns. Null in, null out; '' gives ''."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import tables as T


def strip_accents(c: Column) -> Column:
    """Plain letters for the accented ones, one for one; marks on their own stay."""
    return F.translate(c, T.ACCENTED, T.PLAIN)


def clean_blanks(c: Column) -> Column:
    """Runs of white space to one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, f"[{T.WS}]+", " "))


def strip(c: Column) -> Column:
    """Without white space of any kind at the ends."""
    return F.regexp_replace(c, f"^[{T.WS}]+|[{T.WS}]+$", "")


def norm_key(c: Column) -> Column:
    """The match key: lower case, plain letters, dashes as '-', other signs as blanks, units set apart."""
    s = F.translate(strip_accents(F.lower(c)), "–—_", "-- ")
    s = F.regexp_replace(s, r"[^a-z0-9%/+.\- ]", " ")
    s = F.regexp_replace(s, r"([0-9]) *(" + "|".join(T.UNITS) + r")\b", "$1 $2")
    return F.trim(F.regexp_replace(s, " +", " "))


def norm_key_loose(c: Column) -> Column:
    """The key without numbers, units and joining signs."""
    s = F.regexp_replace(norm_key(c), r"[0-9]+([.,][0-9]+)?", " ")
    for unit in ("mg", "ml", "mcg", "/", "%", "-"):
        s = F.replace(s, F.lit(unit), F.lit(" "))
    return F.trim(F.regexp_replace(s, " +", " "))


def strip_salts(key: Column) -> Column:
    """A drug key without its salts."""
    return F.trim(F.regexp_replace(F.regexp_replace(key, r"\b(?:" + "|".join(T.SALTS) + r")\b", " "), " +", " "))


def tokens(key: Column) -> Column:
    """Words of a key."""
    return F.filter(F.split(key, " "), lambda x: x != "")


def char_ngrams(key: Column, n: int = 3) -> Column:
    """Set of character n-grams of a key without blanks; a shorter key is its own gram, '' has none."""
    s = F.replace(key, F.lit(" "), F.lit(""))
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.length(s) - n + 1, F.lit(1))), lambda i: F.substring(s, i, F.lit(n)))
    return F.when(F.length(s) > 0, F.array_distinct(grams)).otherwise(F.array().cast("array<string>"))


def parent_code(code: Column) -> Column:
    return F.substring_index(code, ".", 1)


def code_level(code: Column) -> Column:
    return F.when(code.contains("."), 4).otherwise(3)


def surface(token: Column) -> Column:
    """A corpus token as running text."""
    return F.replace(token, F.lit("_"), F.lit(" "))


def file_number(name: Column) -> Column:
    """The figures of a file name as a number; 0 if there are none."""
    return F.coalesce(F.try_to_number(F.regexp_replace(name, "[^0-9]", ""), F.lit("9" * 18)).cast("bigint"), F.lit(0).cast("bigint"))


def clause_left(text: Column, start: Column, n: int) -> Column:
    """The last `n` characters before `start`, from the last '.', ';' or line end on, as a plain key."""
    at = F.greatest(start - n, F.lit(0))
    window = F.substring(text, at + 1, start - at)
    return strip_accents(F.lower(F.regexp_extract(window, r"([^.;\n]*)\z", 1)))
