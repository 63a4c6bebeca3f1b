"""Keyboard layouts: what a text typed in the wrong layout was meant to be."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import WORD, all_matches

# The keys of a Latin and a Cyrillic keyboard, in the same order.
LATIN = "`qwertyuiop[]asdfghjkl;'zxcvbnm,./~QWERTYUIOP{}ASDFGHJKL:\"ZXCVBNM<>?@#$^&|"
CYRILLIC = "ёйцукенгшщзхъфывапролджэячсмитьбю.ЁЙЦУКЕНГШЩЗХЪФЫВАПРОЛДЖЭЯЧСМИТЬБЮ,\"№;:?/"


def is_english(text: Column) -> Column:
    return F.exists(all_matches(F.lower(text), WORD), lambda t: t.rlike("^[a-z0-9_]+$"))


def is_russian(text: Column) -> Column:
    return F.exists(all_matches(text, WORD), lambda t: t.rlike("^[а-я0-9_]+$"))


def to_cyrillic(text: Column) -> Column:
    return F.translate(text, LATIN, CYRILLIC)


def to_latin(text: Column) -> Column:
    return F.translate(text, CYRILLIC, LATIN)


def vocabularies(words: DataFrame) -> DataFrame:
    """(typed, meant, to_cyrillic): for each word (word) of one script what it is in the other layout, and the same backwards."""
    w = F.col("word")
    english = is_english(w)
    one = words.filter(english | is_russian(w)).select("word", F.when(english, to_cyrillic(w)).otherwise(to_latin(w)).alias("other"), english.alias("latin"))
    both = F.array(F.struct(F.col("word").alias("typed"), F.col("other").alias("meant"), F.col("latin").alias("to_cyrillic")), F.struct(F.col("other").alias("typed"), F.col("word").alias("meant"), (~F.col("latin")).alias("to_cyrillic")))
    return one.select(F.explode(both).alias("x")).select("x.*").distinct()


def swap(text: Column) -> Column:
    """struct(text, changed, lang): English wins if both scripts occur; lang is null if neither does."""
    english, russian = is_english(text), is_russian(text)
    return F.struct(
        F.when(english, to_cyrillic(text)).when(russian, to_latin(text)).otherwise(text).alias("text"),
        (english | russian).alias("changed"),
        F.when(english, 0).when(russian, 1).alias("lang"),
    )
