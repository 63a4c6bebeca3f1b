"""Simple9: whole numbers below 2^28 packed into 32-bit words, largest first.

Ids of any size are packed less the start of their range: see ``blocks``.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

#: Fixed values of the format: bits of a number and numbers in a word, by selector.
WIDTHS = [(1, 28), (2, 14), (3, 9), (4, 7), (5, 5), (7, 4), (9, 3), (14, 2), (28, 1)]
BITS, ROOM = (np.array(x, np.int64) for x in zip(*WIDTHS))
SLOTS = np.arange(ROOM.max())
#: Ids of a range, of which a list's blocks hold at most so many.
RANGE = 1 << 16


def pack(ids: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each list) of lists of ascending ids, one after the other. The largest id left chooses a word's width, so all that follow fit."""
    if len(ids) and (ids.min() < 0 or ids.max() >= 1 << 28):
        raise ValueError("ids must be from 0 to 2^28 - 1")
    ends = np.cumsum(sizes)
    first = np.repeat(ends - sizes, sizes)
    if (np.diff(ids)[first[1:] == first[:-1]] < 0).any():
        raise ValueError("ids must be ascending")
    selector = np.searchsorted(BITS, np.frexp(np.maximum(ids, 1))[1])
    # Where words begin: from each list's last id on, a word's numbers further to the left; found by doubling the steps.
    none = len(ids)
    step = np.arange(none) - ROOM[selector]
    step = np.append(np.where(step >= first, step, none), none)
    begins = ends[sizes > 0] - 1
    while (step != none).any():
        begins = np.union1d(begins, step[begins])
        step = step[step]
    begins = begins[begins < none]
    owner = np.searchsorted(ends, begins, "right")
    order = np.lexsort((-begins, owner))
    begins, owner = begins[order], owner[order]
    kind = selector[begins]
    at = begins[:, None] - SLOTS
    held = (SLOTS < ROOM[kind][:, None]) & (at >= first[begins][:, None])
    shift = np.maximum(0, 28 - BITS[kind][:, None] * (SLOTS + 1))
    words = kind << 28 | (np.where(held, ids[np.maximum(at, 0)], 0) << shift).sum(1)
    return words, np.bincount(owner, minlength=len(sizes))


def unpack(words: np.ndarray, each: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The ascending ids of lists of words, one after the other: ``each`` words and ``sizes`` ids a list."""
    kind = words >> 28
    room = ROOM[kind]
    ends = np.cumsum(each)
    # All words of a list are full but its last one.
    last = ends[each > 0] - 1
    full = np.concatenate([[0], np.cumsum(room)])
    room[last] -= (full[ends] - full[ends - each] - sizes)[each > 0]
    value = words[:, None] >> np.maximum(0, 28 - BITS[kind][:, None] * (SLOTS + 1)) & ((1 << BITS[kind]) - 1)[:, None]
    ids = value[SLOTS < room[:, None]]
    # Descending within each list.
    stop = np.cumsum(sizes)
    back = np.repeat(2 * stop - sizes - 1, sizes) - np.arange(len(ids))
    return ids[back]


def encode(ids: list[int]) -> list[int]:
    return pack(np.array(ids, np.int64), np.array([len(ids)]))[0].tolist()


def decode(words: list[int], n: int) -> list[int]:
    """The n ascending ids of some words."""
    return unpack(np.array(words, np.int64), np.array([len(words)]), np.array([n])).tolist()


def _joined(lists: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    arrays = [np.empty(0, np.int64) if x is None else np.asarray(x, np.int64) for x in lists]
    return np.concatenate([*arrays, np.empty(0, np.int64)]), np.array([len(a) for a in arrays], np.int64)


def _cut(values: np.ndarray, sizes: np.ndarray, like: pd.Series) -> pd.Series:
    parts = np.split(values, np.cumsum(sizes)[:-1]) if len(sizes) else []
    return pd.Series([None if x is None else p for x, p in zip(like, parts)], dtype=object)


def simple9_encode(ids: Column) -> Column:
    """Words of an array of ascending ids; null stays null."""

    @pandas_udf("array<long>")
    def run(s: pd.Series) -> pd.Series:
        return _cut(*pack(*_joined(s)), s)

    return run(ids)


def simple9_decode(words: Column, n: Column) -> Column:
    @pandas_udf("array<long>")
    def run(s: pd.Series, k: pd.Series) -> pd.Series:
        values, each = _joined(s)
        sizes = k.where(s.notna(), 0).to_numpy(np.int64)
        return _cut(unpack(values, each, sizes), sizes, s)

    return run(words, n)


def blocks(postings: DataFrame) -> DataFrame:
    """(term, part, n, words binary): the blob table of an index. A block holds a term's ids of one range, less the range's start,
    as little-endian 32-bit words, so neither a block nor the largest id has to be bounded by the format."""
    part = F.floor(F.col("doc_id") / RANGE)
    lists = postings.groupBy("term", part.alias("part")).agg(F.array_sort(F.collect_list((F.col("doc_id") - part * RANGE).cast("long"))).alias("ids"))

    @pandas_udf("binary")
    def blob(s: pd.Series) -> pd.Series:
        words, each = pack(*_joined(s))
        return pd.Series([p.astype("<u4").tobytes() for p in np.split(words, np.cumsum(each)[:-1])])

    return lists.select("term", "part", F.size("ids").alias("n"), blob("ids").alias("words"))


def postings_of(table: DataFrame) -> DataFrame:
    """(term, doc_id) of a blob table."""

    @pandas_udf("array<long>")
    def ids(s: pd.Series, n: pd.Series) -> pd.Series:
        words = np.frombuffer(b"".join(s), "<u4").astype(np.int64)
        sizes = n.to_numpy(np.int64)
        return _cut(unpack(words, np.array([len(b) // 4 for b in s], np.int64), sizes), sizes, s)

    return table.select("term", "part", F.explode(ids("words", "n")).alias("at")).select("term", (F.col("at") + F.col("part") * RANGE).alias("doc_id"))
