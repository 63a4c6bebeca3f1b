"""The corrector, row by row, against a second, plain implementation: sorted lists in place of heaps, tables read row by row."""

import math
import re

import pytest
from pyspark.sql import functions as F

from lexiforge.functions.layout import CYRILLIC, LATIN
from lexiforge.operators import correct
from lexiforge.plans import registry


class Plain:
    def __init__(self, models, threshold=0.995):
        rows = lambda t: [r.asDict() for r in t.collect()]
        self.word = {r["word"]: r["cnt"] for r in rows(models.unigrams)}
        self.n = sum(self.word.values())
        self.pair = {(r["w1"], r["w2"]): r["p"] for r in rows(models.bigrams)}
        self.edit = {(r["ctx"], r["tgt"]): r["cost"] for r in rows(models.costs)}
        self.contexts = [r["ctx"] for r in rows(models.contexts)]
        self.node = {r["prefix"]: r["cnt"] for r in rows(models.trie)}
        self.fine = lambda text: False

    def p(self, word):
        return self.word[word] / self.n if word in self.word else 1 / self.n

    def chain(self, words):
        if not words:
            return 0.0
        out = self.p(words[-1])
        for a, b in zip(words, words[1:]):
            out *= self.pair.get((a, b), 1 / self.n)
        return out

    def price(self, ctx, tgt):
        if ctx == tgt:
            return 0.0 if ctx in self.contexts else 1.0
        return self.edit.get((ctx, tgt), 1.0)

    def value(self, cost, count, word):
        return math.log2(count) * 0.025 - math.log2(1.2) * cost + math.log2(1 + self.p(word)) * 25

    def kids(self, prefix):
        return sorted(x for x in self.node if len(x) == len(prefix) + 1 and x.startswith(prefix))

    def search(self, word):
        """Best first: the least (minus value, arrival) of a list that is sorted again each time."""
        word = word.lower()
        if len(word) < 4 or len(word) > 10:
            return [(0.0, word)]
        waiting, arrived, found, far, taken = [], 0, [], 0, 0

        def replaced(prefix, at, cost):
            before = prefix[-1] if prefix else "^"
            options = []
            for kid in self.kids(prefix):
                c = cost + self.price(before + word[at], before + kid[-1])
                options.append((self.value(c, self.node[kid], kid), c, kid))
            options.sort(key=lambda o: o[0])
            return options[max(0, len(options) - 6) :]

        def add(value, at, prefix, cost):
            nonlocal arrived
            arrived += 1
            waiting.append((-value, arrived, at, prefix, cost))

        for v, c, kid in replaced("", 0, 0.0):
            add(v, 1, kid, c)
        while waiting and len(found) < 3 and taken < 20000:
            taken += 1
            waiting.sort()
            rank, _, at, prefix, cost = waiting.pop(0)
            if len(word) < 7 and rank > 0.7:
                continue
            far = far + 1 if rank >= 0.32 else 0
            if far > 5:
                break
            if cost > 3:
                continue
            if at == len(word):
                if -3 < len(word) - len(prefix) < 3 and prefix not in [w for _, w in found]:
                    found.append((self.value(cost, self.node[prefix], prefix), prefix))
                continue
            end = prefix[-1]
            for v, c, kid in replaced(prefix, at, cost):
                add(v, at + 1, kid, c)
            cheap = sorted(self.kids(prefix), key=lambda kid: self.price(end + "_", end + kid[-1]))
            for kid in cheap[:6]:
                c = cost + self.price(end + "_", end + kid[-1]) * 0.2
                add(self.value(c, self.node[kid] * 2, kid), at, kid, c)
            c = cost + self.price(end + word[at], end + "_") * 2
            add(self.value(c, self.node[prefix] / 4, prefix), at + 1, prefix, c)
        return found if found else [(0.0, word)]

    def other_layout(self, text):
        tokens = re.findall(r"\w+", text)
        if any(all(c in "abcdefghijklmnopqrstuvwxyz0123456789_" for c in t.lower()) for t in tokens):
            keys = dict(zip(LATIN, CYRILLIC))
        elif any(all("а" <= c <= "я" or c in "0123456789_" for c in t) for t in tokens):
            keys = dict(zip(CYRILLIC, LATIN))
        else:
            return None
        changed = "".join(keys.get(c, c) for c in text).lower()
        return changed if changed in self.word else None

    def layout_value(self, word):
        if word == "":
            return -1000.0
        return self.value(0.0, self.node[word], word) if word in self.node else self.value(0.7, 1, word)

    def pick(self, items, key):
        """The largest key; of equal ones the larger product of shares; else the earlier."""
        top = items[0]
        for x in items[1:]:
            weight = lambda t: math.prod(self.p(w) for w in words_of(t))
            if key(x) > key(top) or (key(x) == key(top) and weight(x) > weight(top)):
                top = x
        return top

    def fix(self, query):
        gaps, shapes = re.findall(r"\W+", query), re.findall(r"[^\W_]+", query)
        text = query
        for again in (False, True):
            words = words_of(text)
            if not again and (not words or len(words) > 8):
                return query
            if self.fine(text):
                swapped = self.other_layout(text)
                return laid_out(text, gaps, shapes) if swapped is None else self.pick([text, swapped], lambda t: self.chain(words_of(t)))
            lists = []
            for w in words:
                own = [(self.p(w) * 100, w)] if self.fine(w) else list(self.search(w))
                if (swapped := self.other_layout(w)) is not None:
                    own.append((self.layout_value(swapped), swapped))
                lists.append(own)
            if len(words) == 1:
                top = lists[0][0]
                for x in lists[0]:
                    top = x if x[0] > top[0] else top
                if top[1] == words[0]:
                    return shaped(text, top[1])
                text = top[1]
                continue
            if not again:
                at = 0
                while at + 1 < len(lists):
                    whole = [a + b for _, a in lists[at] for _, b in lists[at + 1] if self.word.get(a + b, 0) >= 2]
                    if whole:
                        lists[at : at + 2] = [[(self.p(whole[0]) * 100000, whole[0])]]
                    at += 1
            line = []
            for at, own in enumerate(lists):
                if line:
                    key = lambda w, last=line[-1]: self.chain([last, w])
                elif len(lists) > 1:
                    key = lambda w, following=lists[1]: max(self.chain([w, x]) for _, x in following)
                else:
                    key = lambda w, own=own: {x: s for s, x in own}[w]
                line.append(self.pick([w for _, w in own], key))
            if line == words:
                return laid_out(" ".join(line), gaps, shapes)
            text = " ".join(line)
        return laid_out(text, gaps, shapes)


def words_of(text):
    return re.findall(r"[^\W_]+", text.lower())


def shaped(like, word):
    return word if len(like) != len(word) else "".join(w.upper() if c != c.lower() else w for c, w in zip(like, word))


def laid_out(text, gaps, shapes):
    words = words_of(text)
    if not words or len(words) - len(gaps) not in (0, 1):
        return text
    if len(shapes) == len(words):
        words = [shaped(s, w) for s, w in zip(shapes, words)]
    return "".join(x for pair in zip(words, [*gaps, ""]) for x in pair)


@pytest.fixture(scope="module")
def both(spark, sf):
    models = registry.models(spark, sf, gated=False)
    return models.collected(), Plain(models)


@pytest.fixture(scope="module")
def texts(spark, sf):
    own = [r["text"] for r in registry.typed(spark, sf).select("text").distinct().collect()]
    odd = ["", "  ", "a", "Big, LARGE... thing!", "one two three four five six seven eight nine", "12 34", "_x_", "Привет", "zzzzz", *(t.title() + "?" for t in own[:40]), *(t.replace(" ", ", ") for t in own[40:80]), *(t[::-1] for t in own[80:120])]
    return own + odd


def test_search_against_plain(spark, sf, both, texts):
    m, plain = both
    for word in sorted({w for t in texts for w in words_of(t)}):
        assert correct.fuzzy_search(m, word) == [(pytest.approx(s), w) for s, w in plain.search(word)], word


@pytest.mark.parametrize("gate", [None, lambda text: len(text) % 3 == 0])
def test_correction_against_plain(spark, both, texts, gate):
    m, plain = both
    m.gate = None if gate is None else (lambda f: gate("x" * int(f[1])))
    plain.fine = gate or (lambda text: False)
    rows = spark.createDataFrame(list(enumerate(texts)), "qid long, text string")
    got = {r["qid"]: r["fixed"] for r in correct.correct_queries(spark, rows, m).collect()} if gate is None else {i: correct.correct(m, t) for i, t in enumerate(texts)}
    m.gate = None
    assert [(t, got[i]) for i, t in enumerate(texts)] == [(t, plain.fix(t)) for t in texts]
    assert rows.filter(F.col("text") == "").count() == 1
