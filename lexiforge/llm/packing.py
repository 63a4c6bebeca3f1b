"""Packing of documents into windows by Karmarkar-Karp multiway differencing.

Each document's ids, with an end id, are cut into whole windows, which need no
company, and a rest. Rests over ``max_piece`` are cut once more, as differencing
makes windows nearly equal only if each holds several pieces. The pieces left
are dealt by hash into groups of bounded size, and each group is packed alone:

every piece starts as a partition of k windows, one of them filled; the two
partitions of largest imbalance are merged again and again, the fullest windows
of one with the emptiest of the other, until one partition is left. k starts at
the smallest count that could hold the group and rises whenever the fullest
window exceeds the capacity.

Defined results: a null or empty text is its end id alone; an empty table gives
no rows; rows with equal or null doc_id are packed as documents of their own.
"""

from __future__ import annotations

import heapq
import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import blocks, id_encoder, pack_ids
from .common import lean, materialize, tokenizer_path

WINDOW = 2048
GROUP = 700


def difference(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: indices of ``sizes`` in k windows of nearly equal sums.

    A partition is its window sums, descending, less the least of them, and the
    root of each window's tree of pieces.
    """
    n = len(sizes)
    left, right = [-1] * n, [-1] * n
    heap = []
    for i, s in enumerate(sizes):
        sums, roots = np.zeros(k, np.int64), np.full(k, -1, np.int64)
        sums[0], roots[0] = s, i
        if k == 1:
            sums[0] = 0
        heap.append((-int(sums[0]), i, sums, roots))
    heapq.heapify(heap)
    serial = n
    while len(heap) > 1:
        _, _, s1, r1 = heapq.heappop(heap)
        _, _, s2, r2 = heapq.heappop(heap)
        sums, s_roots = s1 + s2[::-1], r2[::-1]
        both = np.flatnonzero((r1 >= 0) & (s_roots >= 0))
        roots = np.where(r1 >= 0, r1, s_roots)
        for j in both.tolist():
            left.append(int(r1[j]))
            right.append(int(s_roots[j]))
            roots[j] = len(left) - 1
        order = np.argsort(-sums, kind="stable")
        sums, roots = sums[order], roots[order]
        sums = sums - sums[-1]
        heapq.heappush(heap, (-int(sums[0]), serial, sums, roots))
        serial += 1
    windows = []
    for root in heap[0][3].tolist() if heap else []:
        members, todo = [], [root] if root >= 0 else []
        while todo:
            x = todo.pop()
            if x < n:
                members.append(x)
            else:
                todo += [right[x], left[x]]
        windows.append(members)
    return [w for w in windows if w]


def pack(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """Windows of at most ``window``; their count rises whenever the capacity is exceeded."""
    k = max(1, math.ceil(sum(sizes) / window))
    while True:
        windows = difference(sizes, k)
        over = sum(max(0, sum(sizes[i] for i in w) - window) for w in windows)
        if not over:
            return windows
        k += max(1, k // 100, over // (2 * window))


def pieces(docs: DataFrame, path: str, end_id: int, window: int, max_piece: int) -> DataFrame:
    """Cut every document: whole windows first, then the rest in near-equal parts of at most ``max_piece``."""

    def cut(n: int):
        whole = n // window * window
        for at in range(0, whole, window):
            yield at, window
        rest = n - whole
        parts = -(-rest // max_piece)
        for i in range(parts):
            at, to = rest * i // parts, rest * (i + 1) // parts
            yield whole + at, to - at

    def run(batches):
        enc = id_encoder(path, trie=False)
        end = pack_ids([end_id])
        for b in batches:
            for at, texts in blocks(b.column(1)):
                rows = []
                for i, ids in enumerate(enc.encode(texts)):
                    ids += end
                    view = memoryview(ids)
                    rows += [(at + i, s, n, zlib.crc32(view[4 * s : 4 * (s + n)]), len(ids) // 4) for s, n in cut(len(ids) // 4)]
                which, *cols = zip(*rows)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(which)), *(pa.array(c, pa.int64()) for c in cols)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(lean(run), f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long")


def pack_documents(docs: DataFrame, path: str | None = None, end_id: int = 1, window: int = WINDOW, max_piece: int = WINDOW // 4, group: int = GROUP) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""
    cut = materialize(pieces(docs, path or tokenizer_path(), end_id, window, max_piece), "pieces").withColumn("_no", F.monotonically_increasing_id())
    rest = cut.filter(F.col("length") < window)
    groups = max(1, math.ceil(rest.count() / group))
    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by([("length", "ascending"), ("ids_crc32", "ascending"), ("start", "ascending"), ("_no", "ascending")])
        sizes = g["length"].to_pylist()
        seq, off = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        base = g["_group"][0].as_py() << 32
        for w, members in enumerate(pack(sizes, window)):
            at = 0
            for i in members:
                seq[i], off[i] = 2 * (base | w), at
                at += sizes[i]
        return g.select(columns).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(off))

    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    packed = rest.withColumn("_group", F.pmod(F.xxhash64("_no"), F.lit(groups))).groupBy("_group").applyInArrow(run, schema)
    whole = cut.filter(F.col("length") == window).select(*columns, (F.col("_no") * 2 + 1).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return whole.unionByName(packed)
