"""Tokenizers, separators and case, as Column expressions.

``WORD`` spells Python's word characters out: Spark's own ``\\w`` is ASCII only.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]+"
PLAIN_WORD = r"[\p{L}\p{N}]+"
SEPARATOR = r"[^\p{L}\p{N}_]+"


def all_matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def extract_url(header: Column) -> Column:
    """From the first ``http:`` to the last word boundary, or null."""
    found = F.regexp_extract(header, r"(?s)http:.*\b", 0)
    return F.when(found != "", found)


def clean_text(part: Column) -> Column:
    """NBSP and line ends as blanks, without the first character."""
    return F.translate(F.substring(F.translate(part, " ", " "), 2, 2**31 - 1), "\n", " ")


def index_terms(text: Column) -> Column:
    """Distinct lower-case words of a document."""
    return F.array_distinct(all_matches(F.lower(text), WORD))


def query_words(text: Column) -> Column:
    return all_matches(F.lower(text), PLAIN_WORD)


def query_words_cased(text: Column) -> Column:
    return all_matches(text, PLAIN_WORD)


def separators(text: Column) -> Column:
    return all_matches(text, SEPARATOR)


def restore_case(original: Column, fixed: Column) -> Column:
    """Upper case where the original had it, if both are equally long; else the fix as it is."""
    chars = F.zip_with(F.split(original, ""), F.split(fixed, ""), lambda a, b: F.when(a != F.lower(a), F.upper(b)).otherwise(b))
    return F.when(F.length(original) == F.length(fixed), F.array_join(chars, "")).otherwise(fixed)


def restore_separators(query: Column, words: Column, seps: Column, cased: Column) -> Column:
    """Words and separators in turn where their numbers allow it; case only if no word was lost or won."""
    fit = (F.size(words) == F.size(seps) + 1) | (F.size(words) == F.size(seps))
    same = F.size(words) == F.size(cased)
    recased = F.when(same, F.zip_with(cased, words, lambda a, b: restore_case(a, b))).otherwise(words)
    joined = F.array_join(F.flatten(F.zip_with(recased, seps, lambda a, b: F.array(F.coalesce(a, F.lit("")), F.coalesce(b, F.lit(""))))), "")
    return F.when(fit & (F.size(words) > 0), joined).otherwise(query)
