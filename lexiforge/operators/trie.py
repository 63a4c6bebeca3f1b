"""The prefix trie of a log's words, as a table: a node is a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import lm


def trie(words: DataFrame) -> DataFrame:
    """(prefix, parent, edge, depth, cnt) of words (word, cnt): how many occurrences begin so."""
    prefixes = F.transform(F.sequence(F.lit(1), F.length("word")), lambda i: F.substring("word", F.lit(1), i))
    counts = words.select("cnt", F.explode(prefixes).alias("prefix")).groupBy("prefix").agg(F.sum("cnt").alias("cnt"))
    n = F.length("prefix")
    edge = F.when(n == 1, F.concat(F.lit("^"), F.col("prefix"))).otherwise(F.substring("prefix", n - 1, F.lit(2)))
    return counts.select("prefix", F.substring("prefix", F.lit(1), n - 1).alias("parent"), edge.alias("edge"), n.cast("long").alias("depth"), "cnt")


def top_children(nodes: DataFrame, uni: DataFrame, facts: DataFrame, k: int = 6) -> DataFrame:
    """(parent, prefix, rank): each node's k children of best score without edits; of equal ones the later edge."""
    scored = nodes.join(uni.select(F.col("word").alias("prefix"), "p"), "prefix", "left").join(F.broadcast(facts.select("smooth")))
    s = F.round(lm.score(F.lit(0.0), F.col("cnt"), F.coalesce("p", "smooth")), 9)
    w = Window.partitionBy("parent").orderBy(s.desc(), F.desc("edge"))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("parent", "prefix", F.col("rank").cast("long").alias("rank"))


def layout_score(words: DataFrame, nodes: DataFrame, uni: DataFrame, facts: DataFrame) -> DataFrame:
    """(word, score): a swapped word that the trie holds is scored by its count, another as one edit of 0.7, an empty one -1000."""
    found = words.join(nodes.select(F.col("prefix").alias("word"), F.col("cnt").alias("_c")), "word", "left").join(uni.select("word", "p"), "word", "left").join(F.broadcast(facts.select("smooth")))
    p = F.coalesce("p", "smooth")
    s = F.when(F.col("word") == "", lm.EMPTY_SCORE).when(F.col("_c").isNull(), lm.score(F.lit(lm.LAYOUT_COST), F.lit(1), p)).otherwise(lm.score(F.lit(0.0), F.col("_c"), p))
    return found.select("word", s.alias("score"))


def join_candidates(words: DataFrame, uni: DataFrame, facts: DataFrame) -> DataFrame:
    """(qid, pos, joined, score) of neighbours (qid, pos, word) whose joined form occurs at least twice; score 100000 p."""
    after = words.select("qid", (F.col("pos") - 1).alias("pos"), F.col("word").alias("next"))
    both = words.join(after, ["qid", "pos"]).select("qid", "pos", F.concat("word", "next").alias("joined"))
    return both.join(uni.filter("cnt >= 2").select(F.col("word").alias("joined"), "p"), "joined").select("qid", "pos", "joined", (F.col("p") * lm.JOIN_FACTOR).alias("score"))


def cheapest_inserts(nodes: DataFrame, costs: DataFrame, contexts: DataFrame, k: int = 6) -> DataFrame:
    """(parent, prefix, cost, rank): each node's k children that are cheapest to insert; of equal ones the earlier edge.

    Inserting c after a has the context ``a_``; a child of the root comes after ``^``.
    """
    ctx = F.concat(F.substring("edge", 1, 1), F.lit("_"))
    kids = nodes.select("parent", "prefix", F.col("edge").alias("tgt"), ctx.alias("ctx"))
    own = contexts.select("ctx", F.lit(True).alias("_seen"))
    found = kids.join(costs.select("ctx", "tgt", "cost"), ["ctx", "tgt"], "left").join(own, "ctx", "left")
    cost = F.when(F.col("ctx") == F.col("tgt"), F.when(F.col("_seen"), 0.0).otherwise(1.0)).otherwise(F.coalesce("cost", F.lit(1.0)))
    found = found.select("parent", "prefix", "tgt", cost.alias("cost"))
    w = Window.partitionBy("parent").orderBy("cost", "tgt")
    return found.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("parent", "prefix", "cost", F.col("rank").cast("long").alias("rank"))


def deletion_neighbours(words: DataFrame, distance: int = 1) -> DataFrame:
    """(word, key): a word and what is left of it without up to ``distance`` of its characters."""
    shorter = lambda k: F.transform(F.sequence(F.lit(1), F.length(k)), lambda i: F.concat(F.substring(k, F.lit(1), i - 1), F.substring(k, i + 1, F.length(k))))
    keys = words.select("word", F.array("word").alias("_all"), F.array("word").alias("_last"))
    for _ in range(distance):
        last = F.array_distinct(F.flatten(F.transform(F.filter("_last", lambda k: F.length(k) > 0), shorter)))
        keys = keys.select("word", "_all", last.alias("_last")).select("word", F.array_union("_all", "_last").alias("_all"), "_last")
    return keys.select("word", F.explode("_all").alias("key"))


def close_words(typed: DataFrame, vocabulary: DataFrame, distance: int = 1) -> DataFrame:
    """(typed, word) within an edit distance, by an equi-join on deletions instead of all pairs.

    Two words at that distance become equal when at most so many characters are deleted from each.
    """
    a = deletion_neighbours(typed, distance).select(F.col("word").alias("typed"), "key")
    return a.join(deletion_neighbours(vocabulary, distance), "key").select("typed", "word").distinct().filter(F.levenshtein("typed", "word") <= distance)
