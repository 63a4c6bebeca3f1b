"""Token counts by a two-tier lookup of pre-tokens on the map side.

One pass over all texts finds the pre-tokens that occur most: each partition
keeps a bounded summary, and summaries, not pre-tokens, are merged in a tree.
The winners' lengths in tokens form a compact hash table that is broadcast; its
size is bounded by ``table_size``. The second pass looks each pre-token up in
that table, else in the worker's own cache, else encodes it alone. No pre-token
is shuffled.

Texts are first cut into chunks, which no pre-token crosses: strings without
white space, with the one space before them, and the white space that is left.
Most chunks are one pre-token; what the others add up to is kept by chunk too.

The table sets only the speed: a count never depends on what it holds.

Defined results: null and empty texts have 0 bytes and 0 tokens; each row of the
table gives one row, repeated ones and null ids too; an empty table gives none;
texts and pre-tokens of any length are counted whole; columns other than doc_id
and text are ignored; of pre-tokens that occur equally often the table takes the
lesser ones.
"""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import pyarrow as pa
from pyspark.sql import DataFrame

from .bpe import AWKWARD, PRE_TOKEN, Library, blocks
from .common import tokenizer_path

#: Fixed value: the characters of Unicode's White_Space property.
SPACE = "\t\n\v\f\r \x85\xa0  -     　"
#: What no pre-token crosses, by the pre-token pattern's own rules for white space.
CHUNK = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
SUMMARY_LIMIT, CACHED, LONGEST = 400_000, 1_000_000, 64
_counters: dict = {}


def chunks(text: str) -> tuple[list[str], list[str]]:
    """(chunks, strings that follow a space): of texts with lone spaces only, the second are cut at spaces, which is faster."""
    if AWKWARD.search(text):
        return CHUNK.findall(text), []
    head, *spaced = text.split(" ")
    return CHUNK.findall(head), spaced


def pre_tokens(chunk: str) -> list[str]:
    """The pre-tokens of a chunk."""
    return [chunk] if chunk.isalpha() or chunk[:1] == " " and chunk[1:].isalpha() else PRE_TOKEN.findall(chunk)


class Counts:
    """Token counts of texts; ``table`` is the first tier (pre-token: length), the rest is this worker's."""

    def __init__(self, path: str, table: dict[str, int], most: int = CACHED):
        self.library, self.table, self.most = Library(path), table, most
        self.length = self.library.own._encode_single_piece
        self.special, self.specials = self.library.special, self.library.specials
        self._forget()

    def _forget(self) -> None:
        self.cache: dict[str, int] = {}
        #: By chunk, and by chunk less its space: the table's own pre-tokens at first.
        self.whole = {t: n for t, n in self.table.items() if t[:1] != " "}
        self.spaced = {t[1:]: n for t, n in self.table.items() if t[:1] == " " and len(t) > 1}

    def of_pre_token(self, t: str) -> int:
        """Table, else cache, else encoded."""
        n = self.table.get(t)
        if n is None:
            n = self.cache.get(t)
            if n is None:
                n = len(self.length(t))
                if len(t) <= LONGEST:
                    self.cache[t] = n
        return n

    def _sum(self, parts: list[str], known: dict[str, int], lead: str) -> int:
        values = list(map(known.get, parts))
        if None in values:
            for p in set(parts).difference(known):
                known[p] = sum(map(self.of_pre_token, pre_tokens(lead + p)))
            values = map(known.__getitem__, parts)
        return sum(values)

    def _plain(self, text: str) -> int:
        whole, spaced = chunks(text)
        return self._sum(whole, self.whole, "") + self._sum(spaced, self.spaced, " ")

    def of_text(self, text: str | None) -> int:
        if not text:
            return 0
        if len(self.spaced) + len(self.whole) + len(self.cache) > 2 * self.most:
            self._forget()
        if not any(map(text.__contains__, self.specials)):
            return self._plain(text)
        return sum(1 if p in self.specials else self._plain(p) for p in self.special.split(text) if p)


def _summaries(batches, table_size: int, specials):
    """One row: the pre-tokens that a partition's texts hold most, with counts (lossy beyond SUMMARY_LIMIT)."""
    total: Counter = Counter()
    whole: Counter = Counter()
    spaced: Counter = Counter()

    def gather():
        for lead, found in (("", whole), (" ", spaced)):
            for c, n in found.items():
                if len(c) <= LONGEST:
                    for t, k in zip(pre_tokens(lead + c), repeat(n)):
                        total[t] += k
            found.clear()
        if len(total) > SUMMARY_LIMIT:
            most = total.most_common(SUMMARY_LIMIT // 4)
            total.clear()
            total.update(dict(most))

    for b in batches:
        for _, texts in blocks(b.column(0)):
            for t in texts:
                for part in specials.split(t)[::2] if t else []:  # the strings between are special
                    a, s = chunks(part)
                    whole.update(a)
                    spaced.update(s)
                if len(whole) + len(spaced) > SUMMARY_LIMIT:
                    gather()
    gather()
    top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:table_size]
    if top:
        yield pa.RecordBatch.from_arrays([pa.array([[t for t, _ in top]]), pa.array([[n for _, n in top]])], names=["pieces", "counts"])


def frequent_pre_tokens(docs: DataFrame, path: str, table_size: int = 4096) -> list[str]:
    """The pre-tokens that occur most in all texts, at most ``table_size``; only bounded summaries move."""

    def merge(a, b):
        total = Counter(dict(zip(*a)))
        total.update(dict(zip(*b)))
        top = sorted(total.items(), key=lambda x: (-x[1], x[0]))[:table_size]
        return [p for p, _ in top], [n for _, n in top]

    specials = Library(path).special
    rows = docs.select("text").mapInArrow(lambda it: _summaries(it, table_size, specials), "pieces array<string>, counts array<long>")
    found = rows.rdd.map(lambda r: (r[0], r[1]))
    return found.treeAggregate(([], []), merge, merge, depth=3)[0]


def token_counts(docs: DataFrame, limit: int = 512, path: str | None = None, table_size: int = 4096) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every whole text; one row for each row of ``docs``."""
    path = path or tokenizer_path()
    frequent = frequent_pre_tokens(docs, path, table_size)
    first = Counts(path, {})
    table = docs.sparkSession.sparkContext.broadcast({t: first.of_pre_token(t) for t in frequent})
    key = path, hash(tuple(frequent))

    def run(batches):
        if key not in _counters:
            _counters.clear()
            _counters[key] = Counts(path, table.value)
        own = _counters[key]
        for b in batches:
            for at, texts in blocks(b.column(1)):
                n = [own.of_text(t) for t in texts]
                sizes = [len(t.encode()) if t else 0 for t in texts]
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(at, len(texts)), pa.array(sizes, pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")
