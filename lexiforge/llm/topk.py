"""Exact top-k inner products by pivot tables.

Pivots are vectors of the table, far from each other, picked from a bounded
sample (``SAMPLE`` rows of least hash). The distances of every vector to all
pivots are worked out once and stored beside it, as whole steps of a fine scale.
For a query q and a candidate x, |d(q,p) - d(x,p)| is a lower bound of their
distance for every pivot p, the greatest bounds it best, and
2 q.x = |q|^2 + |x|^2 - |q-x|^2 turns it into an upper bound of their inner
product. Candidates are evaluated in the order of that bound, a batch at a time,
until the next bound is below the k-th best score: no other candidate can enter.

Vectors lie in blocks by their nearest pivot. Each query first meets its own
block, which gives it a k-th best score to beat. The ranges of two blocks'
distances to the pivots bound all their inner products; a block that can't beat
the k-th score of any query of another isn't sent to it. The rest meet in pairs,
at most one task's work each, and give at most k rows a query, so no task or
driver holds more than two blocks, whatever the table's size.

Defined results: vectors that are null, empty, or hold null or non-finite
components take no part; a null vec_id takes no part; a shorter vector is
compared as if zeros followed; every row whose vec_id is divisible is a query of
its own and meets all rows but itself, rows of the same id included; ties go to
the smaller vec_id; scores beyond a long are held at its ends; an empty table
gives no rows; columns other than vec_id and embedding are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import discard, materialize

PIVOTS, SAMPLE, BATCH = 256, 4096, 256
#: Rows of a block: 32 times the root of the table's, between these.
LEAST_BLOCK, MOST_BLOCK = 1024, 32768
#: Sums below these are exact in doubles and floats.
EXACT, EXACT_FLOAT = 2.0**52, 2.0**23
STEPS = 32000
LONG_MAX = 2**63 - 1


def quantise(vectors: DataFrame, scale: int = 64) -> DataFrame:
    """(vec_id, q array<double>): floor(scale * x) of each component, x as double; only vectors that take part."""
    x = F.col("embedding")
    fine = F.size(x) > 0
    kept = vectors.select(F.col("vec_id").cast("long"), x).filter(F.col("vec_id").isNotNull() & fine & ~F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v.cast("double")) == float("inf"))))
    # floor() of a double is a long in Spark; beyond its range the double itself is whole.
    whole = lambda v: F.when(F.abs(v) < 2.0**53, F.floor(v).cast("double")).otherwise(v)
    return kept.select("vec_id", F.transform(x, lambda v: whole(v.cast("double") * float(scale))).alias("q"))


def _matrix(rows: pa.Array, dims: int) -> np.ndarray:
    lengths = np.asarray(rows.value_lengths())
    if len(lengths) and (lengths == dims).all():
        return np.asarray(rows.flatten()).reshape(-1, dims)
    out = np.zeros((len(lengths), dims))
    for i, r in enumerate(rows.to_pylist()):
        out[i, : len(r)] = r
    return out


class PivotTable:
    """Pivots, and the fixed scale of the distances to them.

    ``unit`` is the table's largest component: bounds are worked out on vectors divided by it where their products may not be exact.
    """

    def __init__(self, sample: np.ndarray, reach: float, most: int = PIVOTS):
        dims = sample.shape[1]
        self.exact = reach * reach * 4 * dims < EXACT
        self.kind = np.float32 if reach * reach * dims < EXACT_FLOAT else np.float64
        self.unit = 1.0 if self.exact else reach
        points = sample / self.unit
        # Far from each other: each next one is the farthest from all before, the first from the sample's mean.
        picked: list[int] = []
        gap = ((points - points.mean(0)) ** 2).sum(1)
        for _ in range(min(most, len(points))):
            best = int(np.argmax(gap))
            if picked and gap[best] <= 0:
                break
            dx = ((points - points[best]) ** 2).sum(1)
            gap = np.minimum(gap, dx) if picked else dx
            picked.append(best)
        self.pivots = points[picked]
        self.norms = (self.pivots**2).sum(1)
        #: No distance is over twice the longest possible vector.
        self.longest = 2 * math.sqrt(dims) * reach / self.unit
        self.step = STEPS / max(self.longest, 1e-300)
        #: Rounding of the distances, in their own unit; whole numbers that doubles hold have none to speak of.
        self.slack = 1e-9 * self.longest if self.exact else 1e-6 * self.longest

    def norms_of(self, x: np.ndarray) -> np.ndarray:
        return ((x / self.unit) ** 2).sum(1)

    def distances(self, x: np.ndarray) -> np.ndarray:
        """Steps (int16, a column for each pivot) of the distances of vectors to the pivots."""
        x = x / self.unit
        squares = (x * x).sum(1)[:, None] - 2 * x @ self.pivots.T + self.norms
        return np.floor(np.sqrt(np.maximum(0, squares)) * self.step).astype(np.int16)

    def bound(self, apart: np.ndarray, norms: np.ndarray) -> np.ndarray:
        """Upper bounds of inner products, from differences in steps and sums of squared norms."""
        lower = np.maximum(0, (apart - 1.0) / self.step - self.slack)
        return (norms - lower * lower) / 2 * (1 if self.exact else 1 + 1e-9) + (0 if self.exact else 1e-9 * norms)

    def products(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Inner products as longs: by floats or doubles where they are exact, else in Python's integers."""
        if self.exact:
            return (x @ q).astype(np.int64)
        own = [int(v) for v in q]
        return np.array([max(-LONG_MAX - 1, min(LONG_MAX, sum(a * int(b) for a, b in zip(own, r)))) for r in x.tolist()], np.int64).reshape(len(x))

    def floor_of(self, scores: np.ndarray, k: int) -> float:
        """What a bound must reach, given the best scores so far."""
        if len(scores) < k or scores.min() <= -LONG_MAX - 1:
            return -np.inf
        return float(scores.min()) / self.unit / self.unit


def _apart(table: np.ndarray, own: np.ndarray) -> np.ndarray:
    """The greatest difference over all pivots (rows of the table) of each candidate's and the query's distance."""
    most = np.zeros(table.shape[1], np.int16)
    for at in range(0, len(table), 16):
        d = np.subtract(table[at : at + 16], own[at : at + 16, None])
        np.maximum(most, np.abs(d, out=d).max(0), out=most)
    return most


def search(pivots: PivotTable, queries: dict, points: dict, k: int, floors: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(query, vec_id, score) of each query's k best of a block, by number of the query, ties to the smaller id; and how many products were evaluated.

    Both sides have ``row`` (a row is no candidate of its own), ``ids``, ``x``, ``norms`` and ``steps``; ``floors`` are scores, in the
    bound's unit, below which nothing enters.
    """
    order = np.argsort(points["ids"], kind="stable")
    x, ids, norms, rows = points["x"][order], points["ids"][order], points["norms"][order], points["row"][order]
    table = np.ascontiguousarray(points["steps"][order].T)
    found, evaluated = [], 0
    if pivots.exact:
        x = x.astype(pivots.kind)
    for i, q in enumerate(queries["x"].astype(x.dtype)):
        upper = pivots.bound(_apart(table, queries["steps"][i]), queries["norms"][i] + norms)
        upper[rows == queries["row"][i]] = -np.inf
        scores, best = np.empty(0, np.int64), np.empty(0, np.int64)
        least = floor = -np.inf if floors is None else floors[i]
        step = BATCH
        while True:
            # The next candidates in the order of their bounds.
            left = np.flatnonzero((upper >= floor) & (upper > -np.inf))
            if not len(left):
                break
            if len(left) > step:
                left = left[np.argpartition(-upper[left], step)[:step]]
            s = pivots.products(q, x[left])
            evaluated += len(left)
            upper[left] = -np.inf
            if len(scores) == k:
                left, s = left[s >= scores[-1]], s[s >= scores[-1]]
            scores, best = np.concatenate([scores, s]), np.concatenate([best, left])
            top = np.lexsort((best, ~scores))[:k]
            scores, best = scores[top], best[top]
            floor = max(least, pivots.floor_of(scores, k))
            step *= 16
        found.append((np.full(len(best), i), ids[best], scores))
    return *(np.concatenate([f[j] for f in found]) if found else np.empty(0, np.int64) for j in range(3)), evaluated


def _side(table: pa.Table, pivots: PivotTable, dims: int) -> dict:
    """A block's rows as arrays."""
    steps = table["steps"].combine_chunks()
    x = _matrix(table["q"].combine_chunks(), dims)
    width = len(pivots.pivots)
    packed = np.frombuffer(b"".join(steps.to_pylist()), np.int16).reshape(-1, width)
    return {"row": table["row"].to_numpy(), "ids": table["vec_id"].to_numpy(), "x": x, "norms": pivots.norms_of(x), "steps": packed}


def _cells(counts: dict[int, int], pivots: np.ndarray, rows: int) -> dict[int, tuple[int, int]]:
    """Each cell's first block and number of blocks: neighbouring cells share a block of ``rows``, larger ones are split."""
    cells = sorted(counts)
    chain = [cells.pop(0)] if cells else []
    while cells:
        gaps = ((pivots[cells] - pivots[chain[-1]]) ** 2).sum(1)
        chain.append(cells.pop(int(np.argmin(gaps))))
    out, block, held = {}, 0, 0
    for c in chain:
        if held and held + counts[c] > rows:
            block, held = block + 1, 0
        parts = max(1, math.ceil(counts[c] / rows))
        out[c] = (block, parts)
        held += counts[c]
        if parts > 1:
            block, held = block + parts, 0
    return out


FOUND = "query long, query_id long, vec_id long, score long"


def _found(queries: dict, at: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> pa.Table:
    return pa.table([pa.array(queries["row"][at]), pa.array(queries["ids"][at]), pa.array(ids), pa.array(scores)], names=["query", "query_id", "vec_id", "score"])


def exact_top_k(vectors: DataFrame, k: int = 20, query_step: int = 20, scale: int = 64, pivots: int = PIVOTS, block_rows: int | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row whose vec_id is divisible by ``query_step``, its k best of all other rows."""
    spark = vectors.sparkSession
    paths: list[str] = []
    whole = materialize(quantise(vectors, scale).withColumn("row", F.monotonically_increasing_id()), "vectors", paths)
    facts = whole.agg(F.count("*").alias("n"), F.max(F.size("q")).alias("dims"), F.max(F.array_max(F.transform("q", lambda v: F.abs(v)))).alias("reach")).first()
    if not facts["n"]:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    dims = facts["dims"]
    sample = whole.select("q").orderBy(F.xxhash64("row"), "row").limit(SAMPLE).toArrow()
    shared = spark.sparkContext.broadcast(PivotTable(_matrix(sample["q"].combine_chunks(), dims), facts["reach"], pivots))

    def measure(batches):
        table = shared.value
        for b in batches:
            steps = table.distances(_matrix(b.column(2), dims))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([s.tobytes() for s in steps], pa.binary()), pa.array(steps.argmin(1).astype(np.int32))], names=["row", "vec_id", "q", "steps", "cell"])

    tables = materialize(whole.select("row", "vec_id", "q").mapInArrow(measure, "row long, vec_id long, q array<double>, steps binary, cell int"), "tables", paths)
    rows = block_rows or max(LEAST_BLOCK, min(MOST_BLOCK, math.ceil(32 * math.sqrt(facts["n"]))))
    counts = {r["cell"]: r["n"] for r in tables.groupBy("cell").agg(F.count("*").alias("n")).collect()}  # one row a pivot
    cells = _cells(counts, shared.value.pivots, rows)
    placed = F.create_map(*[x for c, (first, parts) in cells.items() for x in (F.lit(c), F.lit(first * (1 << 20) + parts).cast("long"))])[F.col("cell")]
    block = (F.floor(placed / (1 << 20)) + F.pmod(F.xxhash64("row"), placed % (1 << 20))).cast("int")
    blocks = tables.select(block.alias("block"), "row", "vec_id", "q", "steps")
    n_blocks = max(first + parts for first, parts in cells.values())
    is_query = lambda ids: np.fmod(ids, query_step) == 0

    def at_home(t: pa.Table) -> pa.Table:
        """Queries against their own block, and what the block's ranges are, in a row of its own."""
        table = shared.value
        points = _side(t, table, dims)
        asks = {key: v[is_query(points["ids"])] for key, v in points.items()}
        at, ids, scores, _ = search(table, asks, points, k)
        out = _found(asks, at, ids, scores)
        floors = [table.floor_of(scores[at == i], k) for i in range(len(asks["ids"]))]
        ranges = lambda p: p["steps"].min(0).tobytes() + p["steps"].max(0).tobytes()
        none = [None] * out.num_rows
        out = out.append_column("floor", pa.array(none, pa.float64())).append_column("norm", pa.array(none, pa.float64())).append_column("asks", pa.array(none, pa.binary())).append_column("has", pa.array(none, pa.binary()))
        some = len(asks["ids"]) > 0
        facts = {"query": -1 - t["block"][0].as_py(), "query_id": len(asks["ids"]), "vec_id": None, "score": None, "floor": min(floors) if some else None, "norm": float(points["norms"].max()), "asks": ranges(asks) if some else None, "has": ranges(points)}
        return pa.concat_tables([out, pa.Table.from_pylist([facts], out.schema)])

    home = materialize(blocks.groupBy("block").applyInArrow(at_home, FOUND + ", floor double, norm double, asks binary, has binary"), "home", paths)
    found = home.filter("query >= 0").select("query", "query_id", "vec_id", "score")
    if n_blocks > 1:
        facts = home.filter("query < 0").select((-1 - F.col("query")).cast("int").alias("block"), "floor", "norm", "asks", "has")

        def promising(batches):
            """Whether any product of two blocks can reach the least k-th score of the first one's queries."""
            table = shared.value
            width = len(table.pivots)
            for b in batches:
                keep = []
                for floor, a, norm_a, has, norm_b in zip(*(b.column(i).to_pylist() for i in range(2, 7))):
                    a, has = (np.frombuffer(r, np.int16).reshape(2, width).astype(np.int32) for r in (a, has))
                    apart = max(0, int((has[0] - a[1]).max()), int((a[0] - has[1]).max()))
                    keep.append(bool(table.bound(np.array([apart]), np.array([norm_a + norm_b]))[0] >= floor))
                yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep)) for c in b.columns[:2]], names=["qb", "cb"])

        asks = facts.filter("asks is not null").select(F.col("block").alias("qb"), "floor", "asks", F.col("norm").alias("norm_a"), F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))).alias("cb"))
        pairs = asks.join(facts.select(F.col("block").alias("cb"), "has", F.col("norm").alias("norm_b")), "cb").filter("qb <> cb")
        pairs = materialize(pairs.select("qb", "cb", "floor", "asks", "norm_a", "has", "norm_b").mapInArrow(promising, "qb int, cb int"), "pairs", paths)
        worst = found.groupBy("query").agg(F.count("*").alias("c"), F.min("score").alias("s")).filter(F.col("c") == k).select(F.col("query").alias("row"), "s")
        ask = blocks.filter(F.col("vec_id") % query_step == 0).join(worst, "row", "left").withColumnRenamed("block", "qb").join(pairs, "qb")
        have = blocks.withColumnRenamed("block", "cb").join(pairs, "cb")

        def meet(left: pa.Table, right: pa.Table) -> pa.Table:
            table = shared.value
            asks = _side(left, table, dims)
            if not right.num_rows or not left.num_rows:
                none = np.empty(0, np.int64)
                return _found(asks, none, none, none)
            floors = np.array([-np.inf if s is None else table.floor_of(np.full(k, s), k) for s in left["s"].to_pylist()])
            return _found(asks, *search(table, asks, _side(right, table, dims), k, floors)[:3])

        anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])  # noqa: E731  the two sides stem from one table
        met = anew(ask).groupBy("qb", "cb").cogroup(anew(have).groupBy("qb", "cb")).applyInArrow(meet, FOUND)
        found = found.unionByName(met)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
    ranked = materialize(ranked, "top")
    discard(spark, paths)
    return ranked
