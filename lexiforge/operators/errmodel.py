"""Contextual edit costs, learnt from wrong and right words at the same place.

A context is the correct character before an edit (``^`` at a word's start) and
the character edited, ``_`` where there is none; a target is what was typed.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

from ..functions.text import query_words
from .lm import EDIT_BASE


def edit_script(right: str, wrong: str) -> list[tuple[str, int, int]]:
    """(op, place in right, place in wrong) that turn right into wrong, fewest first.

    Common ends are stripped; of equal scripts replacing goes before deleting
    before inserting, from the end.
    """
    lo = 0
    while lo < min(len(right), len(wrong)) and right[lo] == wrong[lo]:
        lo += 1
    hi = 0
    while hi < min(len(right), len(wrong)) - lo and right[-1 - hi] == wrong[-1 - hi]:
        hi += 1
    a, b = right[lo : len(right) - hi], wrong[lo : len(wrong) - hi]
    cost = [[i + j if not i or not j else 0 for j in range(len(b) + 1)] for i in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            cost[i][j] = min(cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]), cost[i - 1][j] + 1, cost[i][j - 1] + 1)
    out, i, j = [], len(a), len(b)
    while i or j:
        if i and j and cost[i][j] == cost[i - 1][j - 1] + (a[i - 1] != b[j - 1]):
            i, j = i - 1, j - 1
            if a[i] != b[j]:
                out.append(("replace", lo + i, lo + j))
        elif i and cost[i][j] == cost[i - 1][j] + 1:
            i -= 1
            out.append(("delete", lo + i, lo + j))
        else:
            j -= 1
            out.append(("insert", lo + i, lo + j))
    return out[::-1]


def edit_keys(right: str, wrong: str) -> list[tuple[str, str]]:
    """(context, target) of each edit."""
    keys = []
    for op, i, j in edit_script(right, wrong):
        before = right[i - 1] if i else "^"
        if op == "insert":
            keys.append((f"{before}_", before + wrong[j]))
        elif op == "delete":
            keys.append((before + right[i], f"{before}_"))
        else:
            keys.append((before + right[i], before + wrong[j]))
    return keys


@pandas_udf(T.ArrayType(T.StructType().add("op", "string").add("spos", "integer").add("dpos", "integer")))
def editops(right: pd.Series, wrong: pd.Series) -> pd.Series:
    return pd.Series([[{"op": o, "spos": i, "dpos": j} for o, i, j in edit_script(a, b)] for a, b in zip(right, wrong)])


@pandas_udf(T.ArrayType(T.StructType().add("ctx", "string").add("tgt", "string")))
def _keys(right: pd.Series, wrong: pd.Series) -> pd.Series:
    return pd.Series([[{"ctx": c, "tgt": t} for c, t in edit_keys(a, b)] for a, b in zip(right, wrong)])


def word_pairs(log: DataFrame) -> DataFrame:
    """(right, wrong) words at the same place, of lines with two columns and equally many words."""
    a, b = query_words(F.col("right")), query_words(F.col("wrong"))
    both = log.filter("ncols = 2").select(a.alias("a"), b.alias("b")).filter(F.size("a") == F.size("b"))
    return both.select(F.explode(F.arrays_zip("a", "b")).alias("x")).select(F.col("x.a").alias("right"), F.col("x.b").alias("wrong"))


def edit_counts(pairs: DataFrame) -> DataFrame:
    """(ctx, tgt, cnt), counted from 1. Pairs are summed first, so each distinct pair is edited once."""
    distinct = pairs.filter("right <> wrong").groupBy("right", "wrong").agg(F.count("*").alias("n"))
    return distinct.select("n", F.explode(_keys("right", "wrong")).alias("x")).groupBy(F.col("x.ctx").alias("ctx"), F.col("x.tgt").alias("tgt")).agg((F.sum("n") + 1).alias("cnt"))


def single_edit_counts(pairs: DataFrame) -> DataFrame:
    """``edit_counts`` of the pairs at distance 1, in built-in functions alone."""
    one = pairs.filter(F.levenshtein("right", "wrong") == 1)
    # The longest common beginning: equal characters up to the first that differs.
    same = F.expr("size(filter(sequence(0, least(length(right), length(wrong))), i -> substr(right, 1, i) = substr(wrong, 1, i))) - 1")
    c = one.withColumn("l", same).withColumn("pc", F.expr("case when l = 0 then '^' else substr(right, l, 1) end"))
    ctx = F.expr("case when length(wrong) > length(right) then pc || '_' else pc || substr(right, l + 1, 1) end")
    tgt = F.expr("case when length(wrong) < length(right) then pc || '_' else pc || substr(wrong, l + 1, 1) end")
    return c.select(ctx.alias("ctx"), tgt.alias("tgt")).groupBy("ctx", "tgt").agg((F.count("*") + 1).alias("cnt"))


def edit_costs(counts: DataFrame) -> DataFrame:
    """(ctx, tgt, cost): one less the target's share of its context; a context's own identity costs 0."""
    total = counts.groupBy("ctx").agg(F.sum("cnt").alias("_n"))
    return counts.join(total, "ctx").select("ctx", "tgt", F.when(F.col("tgt") == F.col("ctx"), 0.0).otherwise(1 - F.col("cnt") / F.col("_n")).alias("cost"))


def seen_contexts(pairs: DataFrame) -> DataFrame:
    """(ctx, total): how often each pair of neighbours occurs in the right words of the training pairs."""
    places = F.transform(F.sequence(F.lit(1), F.length("right")), lambda i: F.concat(F.when(i == 1, "^").otherwise(F.substring("right", i - 1, 1)), F.substring("right", i, 1)))
    return pairs.filter(F.length("right") > 0).select(F.explode(places).alias("ctx")).groupBy("ctx").agg(F.count("*").alias("total"))


def edit_probability(pairs: DataFrame, costs: DataFrame, base: float = EDIT_BASE) -> DataFrame:
    """(right, wrong, prob): base to the power of minus the summed costs; a sum of 0 counts as 1, unseen edits cost 1."""
    long = pairs.distinct().select("right", "wrong", F.explode_outer(_keys("right", "wrong")).alias("x")).select("right", "wrong", F.col("x.ctx").alias("ctx"), F.col("x.tgt").alias("tgt"))
    cost = F.when(F.col("ctx").isNull(), 0.0).otherwise(F.coalesce("cost", F.lit(1.0)))
    total = long.join(costs, ["ctx", "tgt"], "left").groupBy("right", "wrong").agg(F.sum(cost).alias("s"))
    return total.select("right", "wrong", F.pow(F.lit(base), -F.when(F.col("s") == 0, 1.0).otherwise(F.col("s"))).alias("prob"))
