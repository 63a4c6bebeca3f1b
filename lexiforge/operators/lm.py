"""Bigram language model of a query log."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import query_words

#: Fixed values of the scores: weights of a candidate's prefix count and share, the base of its edits' cost; the edit that a change
#: of layout counts as, the score of nothing, and the factor of a joined word's share.
COUNT_WEIGHT, SHARE_WEIGHT, EDIT_BASE = 0.025, 25, 1.2
LAYOUT_COST, EMPTY_SCORE, JOIN_FACTOR = 0.7, -1000.0, 100_000

def tokens(log: DataFrame) -> DataFrame:
    """(qid, pos, word) of the right queries."""
    return log.select("qid", F.posexplode(query_words(F.col("right"))).alias("pos", "word"))


def unigrams(toks: DataFrame) -> DataFrame:
    """(word, cnt, p)."""
    counts = toks.groupBy("word").agg(F.count("*").alias("cnt"))
    total = counts.agg(F.sum("cnt").alias("n"))
    return counts.join(F.broadcast(total)).select("word", "cnt", (F.col("cnt") / F.col("n")).alias("p"))


def bigrams(log: DataFrame, uni: DataFrame) -> DataFrame:
    """(w1, w2, cnt, p): p is the count over that of the second word. Neighbours come from the row's own array, so no window is needed."""
    words = query_words(F.col("right"))
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.greatest(F.size(words) - 1, F.lit(0))).alias("b"))
    counts = log.select(F.explode(pairs).alias("x")).select(F.col("x.a").alias("w1"), F.col("x.b").alias("w2")).filter("w2 is not null").groupBy("w1", "w2").agg(F.count("*").alias("cnt"))
    second = uni.select(F.col("word").alias("w2"), F.col("cnt").alias("_c"))
    return counts.join(second, "w2").select("w1", "w2", "cnt", (F.col("cnt") / F.col("_c")).alias("p"))


def meta(toks: DataFrame) -> DataFrame:
    """(n_tokens, smooth)."""
    return toks.agg(F.count("*").alias("n_tokens")).select("n_tokens", (1 / F.col("n_tokens")).alias("smooth"))


def text_probability(texts: DataFrame, uni: DataFrame, bi: DataFrame, facts: DataFrame) -> DataFrame:
    """(text, prob) of distinct texts (text): bigrams of neighbours times the last word's share; unseen ones count 1/N, no words 0.

    Neighbours come from the text's own array, so no window is needed.
    """
    words = query_words(F.col("text"))
    pairs = F.arrays_zip(words.alias("a"), F.slice(words, F.lit(2), F.size(words)).alias("b"))
    long = texts.select("text", F.explode(F.when(F.size(words) > 0, pairs)).alias("x")).select("text", F.col("x.a").alias("w1"), F.col("x.b").alias("w2"))
    seen = long.join(bi.select("w1", "w2", F.col("p").alias("p2")), ["w1", "w2"], "left").join(uni.select(F.col("word").alias("w1"), F.col("p").alias("p1")), "w1", "left")
    factor = F.coalesce(F.when(F.col("w2").isNull(), F.col("p1")).otherwise(F.col("p2")), F.col("smooth"))
    return seen.join(F.broadcast(facts.select("smooth"))).groupBy("text").agg(F.product(factor).alias("prob"))


def query_probability(queries: DataFrame, uni: DataFrame, bi: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, prob) of each row of queries (qid, text), whatever its id: equal or null ids are rows of their own, a null text has no words."""
    probs = text_probability(queries.select("text").filter("text is not null").distinct(), uni, bi, facts)
    return queries.select("qid", "text").join(probs, "text", "left").select("qid", F.coalesce("prob", F.lit(0.0)).alias("prob"))


def features(queries: DataFrame, uni: DataFrame, bi: DataFrame, facts: DataFrame) -> DataFrame:
    """``queries`` (qid, text, ...) less the text, with prob, n_chars, n_words, n_other, n_known: known words occur at least twice in the log.

    One row for each row; all is worked out once for each distinct text, of which a null one counts as empty.
    """
    texts = queries.select(F.coalesce("text", F.lit("")).alias("text")).distinct()
    known = uni.filter("cnt >= 2").select("word")
    count = texts.select("text", F.explode(query_words(F.col("text"))).alias("word")).join(known, "word", "left_semi").groupBy("text").agg(F.count("*").alias("n_known"))
    other = F.length(F.regexp_replace("text", r"[\p{L}\p{N}_]+", ""))
    found = texts.join(text_probability(texts, uni, bi, facts), "text", "left").join(count, "text", "left").select(
        F.col("text").alias("_text"),
        F.coalesce("prob", F.lit(0.0)).alias("prob"),
        F.length("text").cast("long").alias("n_chars"),
        F.size(query_words(F.col("text"))).cast("long").alias("n_words"),
        other.cast("long").alias("n_other"),
        F.coalesce("n_known", F.lit(0)).alias("n_known"),
    )
    rest = [c for c in queries.columns if c not in ("text", "prob", "n_chars", "n_words", "n_other", "n_known")]
    return queries.select(*rest, F.coalesce("text", F.lit("")).alias("_text")).join(found, "_text").select(*rest, "prob", "n_chars", "n_words", "n_other", "n_known")


def lookahead(candidates: DataFrame, uni: DataFrame, bi: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, pos, idx, word, score) of candidates (qid, pos, idx, word): the best probability of the word and any candidate of the next place.

    Candidates of the last place have none. Lists hold a few candidates each, so a place's pairs are few.
    """
    after = candidates.select("qid", (F.col("pos") - 1).alias("pos"), F.col("word").alias("next"))
    both = candidates.join(after, ["qid", "pos"]).withColumn("text", F.concat_ws(" ", "word", "next"))
    probs = text_probability(both.select("text").distinct(), uni, bi, facts)
    return both.join(probs, "text", "left").groupBy("qid", "pos", "idx", "word").agg(F.max(F.coalesce("prob", F.lit(0.0))).alias("score"))


def argmax(candidates: DataFrame, uni: DataFrame, facts: DataFrame, by: list[str]) -> DataFrame:
    """(*by, text) of candidates (*by, idx, text, score): the largest score; of equal ones the larger product of its words' shares, then the earlier.

    Unseen words have the share 1/N, a text without words the product 1.
    """
    words = candidates.select("text").distinct().select("text", F.explode_outer(query_words(F.col("text"))).alias("word"))
    share = F.when(F.col("word").isNull(), 1.0).otherwise(F.coalesce("p", "smooth"))
    ties = words.join(uni.select("word", "p"), "word", "left").join(F.broadcast(facts.select("smooth"))).groupBy("text").agg(F.product(share).alias("tie"))
    best = F.max_by("text", F.struct("score", "tie", -F.col("idx")))
    return candidates.join(ties, "text").groupBy(*by).agg(best.alias("text"))


def score(cost: Column, count: Column, p: Column) -> Column:
    """How well a candidate fits: its prefix count, its edits and its share; larger is better."""
    return COUNT_WEIGHT * F.log2(count) - cost * F.log2(F.lit(EDIT_BASE)) + SHARE_WEIGHT * F.log2(1 + p)
