"""Boolean document search: ``&``, ``|``, ``!`` and parentheses over index terms.

A query is parsed on the driver into a small tree, normalised, and lowered to a
plan in one of four ways that give the same ids:

* flags: one scan of the postings of its terms, one aggregation by document;
* set operations and semi- or anti-joins, one scan for each term;
* array functions over posting lists;
* a scan of the documents without an index.

A tree that holds for a document without any of its terms (``!a``) starts from
all documents. Whitespace only separates; anything else that isn't a term or an
operator, and terms without an operator between them, are errors.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_terms
from .codec import RANGE


class QueryError(ValueError):
    """A query that isn't an expression."""


@dataclass(frozen=True)
class Term:
    word: str


@dataclass(frozen=True)
class Not:
    x: object


@dataclass(frozen=True)
class And:
    l: object  # noqa: E741
    r: object


@dataclass(frozen=True)
class Or:
    l: object  # noqa: E741
    r: object


def lex(query: str) -> list[str]:
    found = re.findall(r"\w+|[&|!()]|\S", query)
    for t in found:
        if not re.fullmatch(r"\w+|[&|!()]", t):
            raise QueryError(f"unexpected {t!r}")
    return found


def parse(query: str):
    """Precedence climbing: ``!`` over ``&`` over ``|``, left to right."""
    tokens = lex(query)
    at = 0

    def peek():
        return tokens[at] if at < len(tokens) else None

    def take():
        nonlocal at
        at += 1
        return tokens[at - 1]

    def unary():
        t = peek()
        if t is None:
            raise QueryError("the query ends where a term is due")
        take()
        if t == "!":
            return Not(unary())
        if t == "(":
            inner = chain(0)
            if peek() != ")":
                raise QueryError("missing )")
            take()
            return inner
        if t in "&|)":
            raise QueryError(f"unexpected {t!r}")
        return Term(t.lower())

    levels = (("|", Or), ("&", And))

    def chain(level):
        if level == len(levels):
            return unary()
        sign, kind = levels[level]
        left = chain(level + 1)
        while peek() == sign:
            take()
            left = kind(left, chain(level + 1))
        return left

    tree = chain(0)
    if peek() is not None:
        raise QueryError(f"unexpected {peek()!r}")
    return normalise(tree)


def normalise(tree):
    """``!!x`` is x, and an operand that occurs twice counts once."""
    if isinstance(tree, Not):
        x = normalise(tree.x)
        return x.x if isinstance(x, Not) else Not(x)
    if isinstance(tree, (And, Or)):
        left, right = normalise(tree.l), normalise(tree.r)
        return left if left == right else type(tree)(left, right)
    return tree


def terms(tree) -> list[str]:
    if isinstance(tree, Term):
        return [tree.word]
    parts = [tree.x] if isinstance(tree, Not) else [tree.l, tree.r]
    return sorted({t for p in parts for t in terms(p)})


def evaluate(tree, has) -> bool:
    if isinstance(tree, Term):
        return has(tree.word)
    if isinstance(tree, Not):
        return not evaluate(tree.x, has)
    a, b = evaluate(tree.l, has), evaluate(tree.r, has)
    return a and b if isinstance(tree, And) else a or b


def accepts_empty(tree) -> bool:
    """Whether a document without any of the terms matches."""
    return evaluate(tree, lambda _: False)


def predicate(tree, has) -> Column:
    if isinstance(tree, Term):
        return has(tree.word)
    if isinstance(tree, Not):
        return ~predicate(tree.x, has)
    a, b = predicate(tree.l, has), predicate(tree.r, has)
    return a & b if isinstance(tree, And) else a | b


def search(tree, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """doc_id of the matches, by flags. ``docs`` needs doc_id alone and is read only if it has to be."""
    words = terms(tree)
    name = {w: f"_t{i}" for i, w in enumerate(words)}
    found = postings.filter(F.col("term").isin(words)).groupBy("doc_id").agg(*[F.max(F.col("term") == w).alias(name[w]) for w in words])
    if accepts_empty(tree):
        found = docs.select("doc_id").distinct().join(found, "doc_id", "left")
    return found.filter(predicate(tree, lambda w: F.coalesce(F.col(name[w]), F.lit(False)))).select("doc_id")


def search_sets(tree, postings: DataFrame, docs: DataFrame) -> DataFrame:
    """By set operations. A negated operand of ``&`` is an anti-join; other negations start from all documents."""
    everything = docs.select("doc_id").distinct()

    def go(x):
        if isinstance(x, Term):
            return postings.filter(F.col("term") == x.word).select("doc_id")
        if isinstance(x, Not):
            return everything.join(go(x.x), "doc_id", "left_anti")
        if isinstance(x, Or):
            return go(x.l).union(go(x.r)).distinct()
        for a, b in ((x.l, x.r), (x.r, x.l)):
            if isinstance(b, Not):
                return go(a).join(go(b.x), "doc_id", "left_anti")
        return go(x.l).join(go(x.r), "doc_id", "left_semi")

    return go(tree)


def search_arrays(tree, lists: DataFrame, docs: DataFrame) -> DataFrame:
    """By array functions over posting lists (term, part, ids), range of ids by range."""
    words = terms(tree)
    empty = F.array().cast("array<bigint>")
    picked = lists.filter(F.col("term").isin(words)).groupBy("part").agg(*[F.max(F.when(F.col("term") == w, F.col("ids"))).alias(f"_t{i}") for i, w in enumerate(words)])
    row = picked
    if _negates(tree):
        everything = docs.groupBy(F.floor(F.col("doc_id") / RANGE).alias("part")).agg(F.array_sort(F.collect_set("doc_id")).alias("_all"))
        row = everything.join(picked, "part", "left")
    names = {w: F.coalesce(F.col(f"_t{i}"), empty) for i, w in enumerate(words)}

    def go(x):
        if isinstance(x, Term):
            return names[x.word]
        if isinstance(x, Not):
            return F.array_except(F.col("_all"), go(x.x))
        if isinstance(x, Or):
            return F.array_union(go(x.l), go(x.r))
        return F.array_intersect(go(x.l), go(x.r))

    return row.select(F.explode(F.array_sort(go(tree))).alias("doc_id"))


def _negates(tree) -> bool:
    return isinstance(tree, Not) or (not isinstance(tree, Term) and (_negates(tree.l) or _negates(tree.r)))


def search_scan(tree, docs: DataFrame) -> DataFrame:
    """Without an index."""
    found = docs.withColumn("_terms", index_terms(F.col("text")))
    return found.filter(predicate(tree, lambda w: F.array_contains("_terms", w))).select("doc_id")


def search_batch(queries: list[tuple[int, str]], postings: DataFrame, docs: DataFrame) -> DataFrame:
    """(qid, doc_id, error) of many queries over one scan of the postings; a bad query gives one row with its error."""
    spark = postings.sparkSession
    trees, errors = {}, []
    for qid, q in queries:
        try:
            trees[qid] = parse(q)
        except QueryError as e:
            errors.append((qid, None, str(e)))
    out = spark.createDataFrame(errors, "qid long, doc_id long, error string")
    words = sorted({w for t in trees.values() for w in terms(t)})
    if not words:
        return out
    name = {w: f"_t{i}" for i, w in enumerate(words)}
    flags = postings.filter(F.col("term").isin(words)).groupBy("doc_id").agg(*[F.max(F.col("term") == w).alias(name[w]) for w in words])
    if any(map(accepts_empty, trees.values())):
        flags = docs.select("doc_id").distinct().join(flags, "doc_id", "left")
    hits = [F.when(predicate(t, lambda w: F.coalesce(F.col(name[w]), F.lit(False))), F.lit(qid).cast("long")) for qid, t in trees.items()]
    matched = flags.select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("qid"))
    return matched.select("qid", F.col("doc_id").cast("long").alias("doc_id"), F.lit(None).cast("string").alias("error")).unionByName(out)


def with_urls(ids: DataFrame, urls: DataFrame) -> DataFrame:
    """(doc_id, url) of the matches."""
    return ids.join(urls, "doc_id", "left")


def result_lines(ids: DataFrame, urls: DataFrame) -> DataFrame:
    """(place, line), in order: how many matches there are, then the URL of each by its id; a document without a URL has an empty line.

    The first line's place is -1, the others' is the document's id. Sorting deals ranges of ids to tasks, so the lines can be written
    as they are by ``write.text`` from several files in the order of their names.
    """
    found = with_urls(ids, urls).select(F.col("doc_id").cast("long").alias("place"), F.coalesce("url", F.lit("")).alias("line"))
    count = ids.agg(F.count("*").cast("string").alias("line")).select(F.lit(-1).cast("long").alias("place"), "line")
    return count.unionByName(found).orderBy("place")
