"""Query correction: fuzzy word search in the trie, and the decisions around it.

The search is sequential by nature (best first, with a few global stops), so it
runs in Python, in Arrow batches, over distinct queries. Its model holds the
log's vocabulary: each of its parts is counted first and broadcast up to
MAX_ROWS rows, a checked bound; beyond it ``joined_candidates`` finds candidates
by joins, from vocabularies of any size.

Whether a text is known in the other layout is asked of words alone, as the
vocabularies of the layouts hold words; a query of several words is taken apart.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.layout import CYRILLIC, LATIN
from .lm import COUNT_WEIGHT, EDIT_BASE, EMPTY_SCORE, JOIN_FACTOR, LAYOUT_COST, SHARE_WEIGHT, score
from .trie import close_words

MAX_ROWS = 2_000_000
#: Fixed values of the search: candidates, beam and pops; lengths of words that are searched; the priority over which candidates of words
#: under SHORT are left, that under which the edge stays, the edge's end and the most edits; weights of an insert's cost and count, of a
#: deletion's cost and count; the difference in length that a candidate stays under; the factor of a word's share that was left alone.
BEST, BEAM, POPS = 3, 6, 20_000
LEAST_LENGTH, MOST_LENGTH, SHORT, SHORT_LIMIT, EDGE_LIMIT, EDGE, MOST_COST = 4, 10, 7, 0.7, 0.32, 5, 3
INSERT_COST, INSERT_COUNT, DELETE_COST, DELETE_COUNT, LENGTH_GAP, FINE_FACTOR = 0.2, 2, 2, 1 / 4, 3, 100
MOST_WORDS = 8
TO_CYRILLIC, TO_LATIN = str.maketrans(LATIN, CYRILLIC), str.maketrans(CYRILLIC, LATIN)


@dataclass
class Model:
    counts: dict[str, int]  # word -> occurrences
    pairs: dict[tuple[str, str], float]
    costs: dict[tuple[str, str], float]
    seen: set[str]
    prefixes: dict[str, int]
    children: dict[str, str] = field(default_factory=dict)  # prefix -> next characters, ascending
    total: int = 1
    gate: Callable | None = None

    def share(self, word: str) -> float:
        return self.counts.get(word, 1) / self.total

    def known(self, word: str) -> bool:
        return self.counts.get(word, 0) >= 2

    def cost(self, ctx: str, tgt: str) -> float:
        if ctx == tgt:
            return 0.0 if ctx in self.seen else 1.0
        return self.costs.get((ctx, tgt), 1.0)

    def score(self, cost: float, count: float, word: str) -> float:
        return COUNT_WEIGHT * math.log2(count) - cost * math.log2(EDIT_BASE) + SHARE_WEIGHT * math.log2(1 + self.share(word))

    def probability(self, words: list[str]) -> float:
        if not words:
            return 0.0
        p = self.counts[words[-1]] / self.total if words[-1] in self.counts else 1 / self.total
        return math.prod((self.pairs.get(x, 1 / self.total) for x in zip(words, words[1:])), start=p)

    def features(self, text: str) -> list[float]:
        words = tokenize(text)
        return [self.probability(words), len(text), len(words), len(re.sub(r"\w+", "", text)), sum(map(self.known, words))]


def tokenize(text: str, lower: bool = True) -> list[str]:
    return re.findall(r"[^\W_]+", text.lower() if lower else text)


def collect_model(uni: DataFrame, bi: DataFrame, costs: DataFrame, contexts: DataFrame, nodes: DataFrame) -> Model:
    """The model on the driver, if each of its parts is within the bound."""

    def rows(name: str, df: DataFrame) -> list:
        # One row over the bound tells; no more is ever collected.
        found = df.limit(MAX_ROWS + 1).collect()
        if len(found) > MAX_ROWS:
            raise ValueError(f"over {MAX_ROWS} {name} are too many to broadcast; use joined_candidates")
        return found

    counts = {r["word"]: r["cnt"] for r in rows("words", uni.select("word", "cnt"))}
    m = Model(
        counts,
        {(r["w1"], r["w2"]): r["p"] for r in rows("pairs of words", bi.select("w1", "w2", "p"))},
        {(r["ctx"], r["tgt"]): r["cost"] for r in rows("edits", costs.select("ctx", "tgt", "cost"))},
        {r["ctx"] for r in rows("contexts", contexts.select("ctx"))},
        {r["prefix"]: r["cnt"] for r in rows("prefixes", nodes.select("prefix", "cnt"))},
    )
    m.total = max(1, sum(counts.values()))
    for p in sorted(m.prefixes):
        m.children[p[:-1]] = m.children.get(p[:-1], "") + p[-1]
    return m


def fuzzy_search(m: Model, word: str) -> list[tuple[float, str]]:
    """Up to BEST (score, candidate) in the order found; the word itself, scored 0, if there is none."""
    word = word.lower()
    n = len(word)
    if not LEAST_LENGTH <= n <= MOST_LENGTH:
        return [(0.0, word)]
    queue: list[tuple] = []
    serial = 0

    def push(priority, pos, prefix, cost):
        nonlocal serial
        serial += 1
        heapq.heappush(queue, (-priority, serial, pos, prefix, cost))

    def ranked(prefix, before, typed, cost):
        """Children by score after replacing ``typed``, the BEAM best; of equal ones the later."""
        out = []
        for c in m.children.get(prefix, ""):
            e = cost + m.cost(before + typed, before + c)
            out.append((m.score(e, m.prefixes[prefix + c], prefix + c if prefix else c), e, prefix + c))
        return sorted(out, key=lambda x: x[0])[-BEAM:]

    for s, e, prefix in ranked("", "^", word[0], 0.0):
        push(s, 1, prefix, e)
    found: list[tuple[float, str]] = []
    edge = pops = 0
    while queue and len(found) < BEST and pops < POPS:
        pops += 1
        low, _, pos, prefix, cost = heapq.heappop(queue)
        if low > SHORT_LIMIT and n < SHORT:
            continue
        edge = 0 if low < EDGE_LIMIT else edge + 1
        if edge > EDGE:
            break
        if cost > MOST_COST:
            continue
        if pos == n:
            if abs(n - len(prefix)) < LENGTH_GAP and all(prefix != w for _, w in found):
                found.append((m.score(cost, m.prefixes[prefix], prefix), prefix))
            continue
        last, typed = prefix[-1], word[pos]
        for s, e, longer in ranked(prefix, last, typed, cost):
            push(s, pos + 1, longer, e)
        inserts = sorted(((m.cost(last + "_", last + c), c) for c in m.children.get(prefix, "")), key=lambda x: x[0])[:BEAM]
        for e, c in inserts:
            e = cost + INSERT_COST * e
            push(m.score(e, INSERT_COUNT * m.prefixes[prefix + c], prefix + c), pos, prefix + c, e)
        e = cost + DELETE_COST * m.cost(last + typed, last + "_")
        push(m.score(e, m.prefixes[prefix] * DELETE_COUNT, prefix), pos + 1, prefix, e)
    return found or [(0.0, word)]


def swap_layout(text: str) -> tuple[str, bool, int | None]:
    words = re.findall(r"\w+", text)
    if any(re.fullmatch("[a-z0-9_]+", w.lower()) for w in words):
        return text.translate(TO_CYRILLIC), True, 0
    if any(re.fullmatch("[а-я0-9_]+", w) for w in words):
        return text.translate(TO_LATIN), True, 1
    return text, False, None


def restore_case(original: str, fixed: str) -> str:
    return "".join(b.upper() if a != a.lower() else b for a, b in zip(original, fixed)) if len(original) == len(fixed) else fixed


def restore(query: str, seps: list[str], cased: list[str]) -> str:
    words = tokenize(query)
    if len(words) not in (len(seps), len(seps) + 1) or not words:
        return query
    if len(words) == len(cased):
        words = [restore_case(a, b) for a, b in zip(cased, words)]
    return "".join(w + s for w, s in zip(words, [*seps, ""]))


def best(items: list, key: Callable, tie: Callable):
    """The item of largest key; of equal ones that of larger tie value, then the earlier."""
    return max(enumerate(items), key=lambda x: (key(x[1]), tie(x[1]), -x[0]))[1] if items else None


def layout_known(m: Model, text: str) -> str | None:
    """The text in the other layout, if the log knows it."""
    other, changed, _ = swap_layout(text)
    return other.lower() if changed and other.lower() in m.counts else None


def layout_score(m: Model, word: str) -> float:
    if not word:
        return EMPTY_SCORE
    return m.score(0.0, m.prefixes[word], word) if word in m.prefixes else m.score(LAYOUT_COST, 1, word)


def correct(m: Model, query: str) -> str:
    """One corrected query."""
    seps, cased = re.findall(r"[^\w]+", query), tokenize(query, lower=False)
    tie = lambda ws: math.prod(m.share(w) for w in ws)
    fine = m.gate or (lambda f: False)
    current = query
    for turn in (1, 2):
        words = tokenize(current)
        if turn == 1 and not 1 <= len(words) <= MOST_WORDS:
            return query
        if fine(m.features(current)):
            other = layout_known(m, current)
            if other is not None:
                return best([current, other], lambda q: m.probability(tokenize(q)), lambda q: tie(tokenize(q)))
            return restore(current, seps, cased)
        candidates = []
        for w in words:
            own = [(FINE_FACTOR * m.share(w), w)] if fine(m.features(w)) else fuzzy_search(m, w)
            other = layout_known(m, w)
            if other is not None:
                own = [*own, (layout_score(m, other), other)]
            candidates.append(own)
        if len(words) == 1:
            chosen = max(candidates[0], key=lambda x: x[0])[1]
            if chosen == words[0]:
                return restore_case(current, chosen)
            current = chosen
            continue
        if turn == 1:
            candidates = join_neighbours(m, candidates)
        out: list[str] = []
        for i, own in enumerate(candidates):
            names = [w for _, w in own]
            if out:
                value = lambda w: m.probability([out[-1], w])  # noqa: B023, E731
            elif len(candidates) > 1:
                value = lambda w, nxt=candidates[i + 1]: max(m.probability([w, x]) for _, x in nxt)
            else:
                value = dict((w, s) for s, w in own).__getitem__
            out.append(best(names, value, lambda w: tie([w])))
        fixed = " ".join(out)
        if fixed == " ".join(words):
            return restore(fixed, seps, cased)
        current = fixed
    return restore(current, seps, cased)


def join_neighbours(m: Model, candidates: list[list]) -> list[list]:
    """Where a candidate and one of the next word make a known word, it replaces both lists."""
    out, i = [], 0
    while i < len(candidates):
        joined = None
        if i + 1 < len(candidates):
            joined = next((a + b for _, a in candidates[i] for _, b in candidates[i + 1] if m.known(a + b)), None)
        if joined:
            out.append([(JOIN_FACTOR * m.share(joined), joined)])
            i += 2
        else:
            out.append(candidates[i])
            i += 1
    return out


def _over_distinct(spark: SparkSession, queries: DataFrame, m: Model, f: Callable, schema: str, tasks: int | None = None) -> DataFrame:
    """``f`` of each distinct text, in as many tasks as there are shuffle partitions, or ``tasks``: few bytes, but much work each."""
    shared = spark.sparkContext.broadcast(m)

    def run(frames):
        for df in frames:
            yield pd.DataFrame([(t, *r) for t in df["text"] for r in f(shared.value, t)], columns=[c.split()[0] for c in schema.split(", ")])

    tasks = tasks or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return queries.select("text").filter("text is not null").distinct().repartition(tasks, "text").mapInPandas(run, schema)


def search_words(spark: SparkSession, words: DataFrame, m: Model) -> DataFrame:
    """(text, rank, candidate, score) for distinct words (text)."""
    return _over_distinct(spark, words, m, lambda x, w: [(i + 1, c, s) for i, (s, c) in enumerate(fuzzy_search(x, w))], "text string, rank int, candidate string, score double")


def joined_candidates(words: DataFrame, uni: DataFrame, nodes: DataFrame, facts: DataFrame, distance: int = 2) -> DataFrame:
    """(text, rank, candidate, score) for distinct words (text): the BEST of the vocabulary within an edit distance, each edit at full cost.

    For vocabularies beyond the search's bound: joins alone. Words of other lengths than the search takes, and those without a
    candidate, are their own, scored 0; of equal scores the lesser word is first.
    """
    fits = F.length("text").between(LEAST_LENGTH, MOST_LENGTH)
    close = close_words(words.filter(fits).select(F.col("text").alias("word")), uni.select("word"), distance)
    priced = close.join(uni.select("word", "p"), "word").join(nodes.select(F.col("prefix").alias("word"), F.col("cnt").alias("_c")), "word")
    rated = priced.select(F.col("typed").alias("text"), F.col("word").alias("candidate"), score(F.levenshtein("typed", "word"), F.col("_c"), F.col("p")).alias("score"))
    w = Window.partitionBy("text").orderBy(F.desc(F.round("score", 9)), "candidate")
    ranked = rated.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= BEST)
    return words.select("text").join(ranked, "text", "left").select("text", F.coalesce("rank", F.lit(1)).alias("rank"), F.coalesce("candidate", "text").alias("candidate"), F.coalesce("score", F.lit(0.0)).alias("score"))


def correct_queries(spark: SparkSession, queries: DataFrame, m: Model) -> DataFrame:
    """(qid, text, fixed) of each row, equal and null ids too; each distinct text is corrected once, a null one stays null."""
    fixed = _over_distinct(spark, queries, m, lambda x, t: [(correct(x, t),)], "text string, fixed string")
    return queries.select("qid", "text").join(fixed, "text", "left").select("qid", "text", F.col("fixed"))
