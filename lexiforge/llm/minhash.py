"""Near-duplicate documents by bottom-k MinHash sketches of one hash function.

A document's sketch is the k least of its shingles' hashes. Documents with the
same shingle set form one class, and only classes are compared:

1. Inverted lists. Two sets of similarity t share at least m of their retained
   values (exactly so while a sketch holds the whole set; else but for a chance
   below 1e-7, see ``least_shared``). So they also share one of the
   len - m + 1 retained values that fewest classes hold, and only those are
   listed. A passage that many documents share is in the lists only of documents
   that it dominates.
2. Blocks. Each class has a home: the longest list it is in. Two classes that
   share any list meet once, in the block of their two homes, so a pair isn't
   met again in each of the many lists that near copies share, and a class
   travels once for each home it may have a partner in. Blocks over
   ``BLOCK_VALUES`` hashes are split into parts that meet pair by pair.
3. Within a block, overlaps of sketches come from their common retained values,
   the sketch of the union, merged from both, estimates the similarity and drops
   pairs far below the threshold, and the full sets decide on the rest. Only
   links that join components leave the task, as a star for each component of
   the block. No pair of a list leaves a task, and no link between components is
   lost.

With ``k`` of at least the largest set's size sketches are whole sets and nothing
is left to chance; that is the exact way, at the cost of longer lists.

Shingles are hashed to 63 bits; equal hashes count as equal shingles.

Defined results: null texts and those without words have an empty set, size 0,
and are linked with nothing; equal or null ids are allowed, and each row is
given the component of its text; rows may repeat; columns other than doc_id and
text are ignored; texts of any length are hashed whole; an empty table gives no
rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, give_back, lean, materialize
from .components import components

SKETCH, SHINGLE, PERCENT = 64, 5, 80
BROADCAST_ROWS = 200_000
#: A part of a block holds about BLOCK_VALUES hashes, where each class counts as LEAST_VALUES at least.
BLOCK_VALUES, LEAST_VALUES = 1 << 20, 1 << 11
#: Classes of a block after which a worker gives memory back.
LARGE = 200
LOW63 = np.uint64(1)
TOP = np.iinfo(np.int64).max


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Ascending 63-bit hashes of the distinct word shingles of a text; A-Z are lower-cased, ASCII space parts words."""
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, np.int64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = max(1, len(h) - size + 1)
    out = np.full(n, min(size, len(h)), np.uint64)
    for i in range(min(size, len(h))):
        out = _mix(out * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
    return np.unique(out >> LOW63).astype(np.int64)


def least_of_large(k: int, percent: int) -> int:
    """Retained values that two sets of similarity percent/100 share when both may be cut off at k, but for a chance below 1e-7.

    The k least of the union hold a binomial number of common values; the bound is where Chernoff's bound on its lower tail is 1e-7.
    """
    t, m = percent / 100, round(k * percent / 100)

    def tail(x):
        q = x / k
        return (q * math.log(q / t) if q else 0) + (1 - q) * math.log((1 - q) / (1 - t)) if q < t else 0

    while m > 1 and k * tail(m - 1) < -math.log(1e-7):
        m -= 1
    return max(1, m - 1)


def least_shared(n, k: int, percent: int, when, ceil):
    """Retained values that a set of n shingles shares with any set of similarity percent/100, at least.

    Up to k * percent / 100 shingles no partner's sketch is cut off: exact.
    ``when(condition, x, y)`` and ``ceil`` are those of columns or of arrays.
    """
    return when(n * 100 <= k * percent, ceil(n * percent / 100), least_of_large(k, percent))


def sketches(docs: DataFrame, shingle: int, k: int) -> DataFrame:
    """(doc_id, th, n, key, sketch): hash of the text, set size, digest of the whole set, and its k least hashes."""

    def run(batches):
        for b in batches:
            sizes, keys, mins = [], [], []
            for t in b.column(2):
                s = shingle_set(t.as_py(), shingle)
                sizes.append(len(s))
                keys.append(xxhash.xxh3_128_digest(s.tobytes()))
                mins.append(s[:k])
            ends = np.cumsum([0, *map(len, mins)]).astype(np.int32)
            values = pa.array(np.concatenate([*mins, np.empty(0, np.int64)]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), values)], names=["doc_id", "th", "n", "key", "sketch"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(lean(run), f"doc_id {kind}, th long, n long, key binary, sketch array<long>")


def full_sets(docs: DataFrame, wanted: DataFrame, shingle: int) -> DataFrame:
    """(cid, full) of the wanted classes (cid, rep, th, n, key), worked out again from the texts of their representatives.

    A representative is found by its id, which may be null, and the hash of its text, so rows that share an id aren't tried for each other.
    """
    texts = docs.select(F.col("doc_id").alias("_id"), F.xxhash64("text").alias("_th"), "text")
    texts = texts.join(wanted, F.col("_id").eqNullSafe(F.col("rep")) & (F.col("_th") == F.col("th")))

    def run(batches):
        done = set()  # copies of a text that share its id, or have none
        for b in batches:
            for text, cid, n, key in zip(b.column(0), b.column(1), b.column(2), b.column(3)):
                if cid in done:
                    continue
                s = shingle_set(text.as_py(), shingle)
                if len(s) == n.as_py() and xxhash.xxh3_128_digest(s.tobytes()) == key.as_py():
                    done.add(cid)
                    yield pa.RecordBatch.from_arrays([pa.array([cid.as_py()], pa.int64()), pa.array([s], pa.list_(pa.int64()))], names=["cid", "full"])

    found = texts.select("text", "cid", "n", "key").mapInArrow(lean(run), "cid long, full array<long>")
    return found.dropDuplicates(["cid"])


def _overlaps(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """Sizes of the intersections of each set of a with each of b."""
    total = np.zeros((len(a), len(b)), np.float32)
    in_a, in_b = (np.concatenate([*x, np.empty(0, np.int64)]) for x in (a, b))
    common = np.intersect1d(in_a, in_b)
    if not len(common):
        return total

    def found(sets, values):
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        at = np.minimum(np.searchsorted(common, values), len(common) - 1)
        ok = common[at] == values
        return owner[ok], at[ok]

    (own_a, at_a), (own_b, at_b) = found(a, in_a), found(b, in_b)
    for lo in range(0, len(common), 4096):
        parts = []
        for own, at, n in ((own_a, at_a, len(a)), (own_b, at_b, len(b))):
            pick = (at >= lo) & (at < lo + 4096)
            m = np.zeros((n, min(4096, len(common) - lo)), np.float32)
            m[own[pick], at[pick] - lo] = 1
            parts.append(m)
        total += parts[0] @ parts[1].T
    return total


def _filled(sketches: list[np.ndarray], k: int) -> np.ndarray:
    """Sketches as rows of k values, filled up with TOP."""
    out = np.full((len(sketches), k), TOP)
    for row, s in zip(out, sketches):
        row[: len(s)] = s
    return out


def _similar(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray, k: int, percent: int) -> np.ndarray:
    """Whether the sketch of the union of rows i of a and j of b (see ``_filled``) allows the threshold; a few thousand pairs at a time."""
    out, least = np.empty(len(i), bool), least_of_large(k, percent)
    for lo in range(0, len(i), 4096):
        at = slice(lo, lo + 4096)
        both = np.sort(np.concatenate([a[i[at]], b[j[at]]], 1), 1)
        twice = (both[:, 1:] == both[:, :-1]) & (both[:, 1:] != TOP)
        rank = np.arange(twice.shape[1]) - np.cumsum(twice, 1) + 1  # of a value held twice, among the distinct ones
        shared = (twice & (rank < k)).sum(1)
        width = np.minimum(k, (both != TOP).sum(1) - twice.sum(1))
        out[at] = shared * k >= least * width
    return out


def candidates(a: list[np.ndarray], b: list[np.ndarray] | None, k: int, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """(row of a, row of b) of the pairs whose sketches allow the threshold, most shared values first; rows i < j of a if b is None."""
    low_a = [s[:k] for s in a]
    low_b = low_a if b is None else [s[:k] for s in b]
    shared = _overlaps(low_a, low_b)
    n_a = np.array([len(s) for s in a], np.int64)
    n_b = n_a if b is None else np.array([len(s) for s in b], np.int64)
    least = lambda n: least_shared(n, k, percent, np.where, np.ceil)
    ok = (shared >= least(n_a)[:, None]) & (shared >= least(n_b)[None])
    ok &= (100 * n_a[:, None] >= percent * n_b) & (100 * n_b >= percent * n_a[:, None])
    i, j = np.nonzero(np.triu(ok, 1) if b is None else ok)
    cut = np.flatnonzero((n_a[i] > k) | (n_b[j] > k))
    if len(cut):
        fair = np.ones(len(i), bool)
        fair[cut] = _similar(_filled(low_a, k), _filled(low_b, k), i[cut], j[cut], k, percent)
        i, j = i[fair], j[fair]
    order = np.argsort(-shared[i, j], kind="stable")
    return i[order], j[order]


def block_links(a: list[np.ndarray], b: list[np.ndarray] | None, k: int, percent: int) -> np.ndarray:
    """Component (its least member's number) of each set of a, then of b, when links within a (b is None) or between a and b hold."""
    first = 0 if b is None else len(a)
    sets = a if b is None else a + b
    n = np.array([len(s) for s in sets], np.int64)
    up = np.arange(len(sets))

    def find(x):
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    def join(x, y):
        x, y = find(x), find(y)
        up[max(x, y)] = min(x, y)

    def linked(x, y):
        both = len(np.intersect1d(sets[x], sets[y], assume_unique=True))
        return 100 * both >= percent * (n[x] + n[y] - both)

    def roots():
        out = up
        while (out[out] != out).any():
            out = out[out]
        return out

    i, j = candidates(a, b, k, percent)
    j = j + first
    # The best partners first: they join most components.
    best = np.zeros(len(i), bool)
    best[np.unique(i, return_index=True)[1]] = True
    best[np.unique(j, return_index=True)[1]] = True
    for x, y in zip(i[best].tolist(), j[best].tolist()):
        if find(x) != find(y) and linked(x, y):
            join(x, y)
    own = roots()
    left = ~best & (own[i] != own[j])
    i, j = i[left], j[left]
    used_i, at_i = np.unique(i, return_inverse=True)
    used_j, at_j = np.unique(j, return_inverse=True)
    if len(i) > 4 * (len(used_i) + len(used_j)):
        both = _overlaps([sets[x] for x in used_i], [sets[y] for y in used_j])[at_i, at_j]
        near = 100 * both >= percent * (n[i] + n[j] - both)
        for x, y in zip(i[near].tolist(), j[near].tolist()):
            join(x, y)
    else:
        for x, y in zip(i.tolist(), j.tolist()):
            if find(x) != find(y) and linked(x, y):
                join(x, y)
    return roots()


def _links_of(block: pa.Table, k: int, percent: int) -> pa.Table:
    """Links (a, b) of a block (cid, far, full): a star for each component; classes meet those of the other side, or all if there is one."""
    ids, far = np.asarray(block["cid"]), np.asarray(block["far"])
    sets = [np.asarray(x.values) for x in block["full"].combine_chunks()]
    order = np.lexsort((ids, far))
    ids, far, sets = ids[order], far[order], [sets[x] for x in order]
    near = int((~far).sum())
    within = block["within"][0].as_py()
    out = np.zeros(0, np.int64)
    if within or 0 < near < len(ids):
        own = block_links(sets, None, k, percent) if within else block_links(sets[:near], sets[near:], k, percent)
        out = np.flatnonzero(own != np.arange(len(own)))
        if len(ids) > LARGE:
            give_back()
        return pa.table({"a": pa.array(ids[own[out]]), "b": pa.array(ids[out])})
    return pa.table({"a": pa.array(out), "b": pa.array(out)})


def _blocks(members: DataFrame, paths: list[str]) -> DataFrame:
    """(h, g, i, j, within, far, cid): members (cid, n, home, other) dealt to the block h <= g of their two homes and to its parts i, j."""
    members = members.select("cid", "n", F.least("home", "other").alias("h"), F.greatest("home", "other").alias("g"), (F.col("home") > F.col("other")).alias("far"))
    parts = F.ceil(F.sum(F.greatest("n", F.lit(LEAST_VALUES))) / BLOCK_VALUES).cast("int").alias("parts")
    sizes = members.groupBy("h", "g", "far").agg(parts).filter("parts > 1")
    sizes = sizes.groupBy("h", "g").agg(F.max(F.when(~F.col("far"), F.col("parts"))).alias("_p"), F.max(F.when(F.col("far"), F.col("parts"))).alias("_q"))
    sizes = materialize(sizes, "sizes", paths)
    dealt = members.join(broadcast_if(sizes, sizes.count(), BROADCAST_ROWS), ["h", "g"], "left")
    p, q = F.coalesce("_p", F.lit(1)), F.coalesce("_q", F.lit(1))
    own = F.pmod(F.xxhash64("cid"), F.when(F.col("far"), q).otherwise(p)).cast("int")
    same = F.col("h") == F.col("g")
    partners = F.when(same | F.col("far"), p).otherwise(q)
    dealt = dealt.select("cid", "h", "g", "far", own.alias("_own"), F.explode(F.sequence(F.lit(0), partners - 1)).alias("_to"))
    # Of a home's own block the parts i <= j meet; a part that meets itself is compared within.
    low, high = F.least("_own", "_to"), F.greatest("_own", "_to")
    i = F.when(same, low).when(F.col("far"), F.col("_to")).otherwise(F.col("_own"))
    j = F.when(same, high).when(F.col("far"), F.col("_own")).otherwise(F.col("_to"))
    far = F.when(same, F.col("_own") > F.col("_to")).otherwise(F.col("far"))
    return dealt.select("h", "g", i.alias("i"), j.alias("j"), (same & (F.col("_own") == F.col("_to"))).alias("within"), far.alias("far"), "cid")


def links(docs: DataFrame, classes: DataFrame, shingle: int, k: int, percent: int, paths: list[str]) -> DataFrame:
    """(a, b): links between classes (cid, rep, th, n, key, sketch) that connect all that the threshold connects."""
    values = classes.select("cid", "n", F.explode("sketch").alias("v"))
    # Tables that rows of a hot value are joined with are written first: Spark can then split the hot side.
    common = materialize(values.groupBy("v").agg(F.count("*").alias("df")).filter("df > 1"), "common", paths)
    listed = values.join(common, "v").groupBy("cid", "n").agg(F.array_sort(F.collect_list(F.struct("df", "v"))).alias("vs"))
    held = F.least(F.col("n"), F.lit(k))
    least = least_shared(F.col("n"), k, percent, lambda c, x, y: F.when(c, x).otherwise(y), F.ceil)
    prefix = held - least + 1 - (held - F.size("vs"))
    listed = listed.withColumn("p", prefix.cast("int")).filter("p > 0")
    lists = materialize(listed.select("cid", "n", F.explode(F.expr("slice(vs, 1, p)")).alias("x")).select("cid", "n", F.col("x.v").alias("v")), "lists", paths)
    lengths = materialize(lists.groupBy("v").agg(F.count("*").alias("c")).filter("c > 1"), "lengths", paths)
    homes = lists.join(lengths, "v").groupBy("cid", "n").agg(F.max(F.struct("c", "v")).alias("x"), F.collect_list("v").alias("vs"))
    homes = materialize(homes.select("cid", "n", F.col("x.v").alias("home"), "vs"), "homes", paths)
    placed = homes.select("cid", "n", "home", F.explode("vs").alias("v"))
    met = materialize(placed.groupBy("v").agg(F.collect_set("home").alias("hs")).filter("size(hs) > 1"), "met", paths)
    others = placed.join(met, "v").groupBy("cid", "n", "home").agg(F.array_distinct(F.flatten(F.collect_set("hs"))).alias("hs"))
    others = others.select("cid", "n", "home", F.explode(F.array_remove("hs", F.col("home"))).alias("other"))
    members = materialize(homes.select("cid", "n", "home", F.col("home").alias("other")).unionByName(others), "members", paths)

    known = classes.join(homes.select("cid"), "cid", "left_semi")
    wanted = materialize(known.filter(F.col("n") > k).select("cid", "rep", "th", "n", "key"), "wanted", paths)
    fulls = full_sets(docs, broadcast_if(wanted, wanted.count(), BROADCAST_ROWS), shingle)
    fulls = fulls.unionByName(known.filter(F.col("n") <= k).select("cid", F.col("sketch").alias("full")))
    met_in = _blocks(members, paths).join(fulls, "cid")
    return met_in.groupBy("h", "g", "i", "j").applyInArrow(lambda t: _links_of(t, k, percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row: its near-duplicate group's least id, and whether it is that one."""
    component = F.coalesce("first.doc_id", "doc_id")
    return groups(docs, percent, shingle, k).select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def groups(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, k: int = SKETCH) -> DataFrame:
    """(doc_id, th, n_shingles, first) for each row: hash of its text, and its group's first (no_id, doc_id, th): least id, then least hash; null ids are last."""
    spark = docs.sparkSession
    paths: list[str] = []
    rows = materialize(sketches(docs, shingle, k), "sketches")
    grouped = rows.filter("n > 0").groupBy("n", "key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th")).alias("r"), F.first("sketch").alias("sketch"))
    grouped = grouped.select("n", "key", "r", F.col("r.doc_id").alias("rep"), F.col("r.th").alias("th"), "sketch")
    classes = materialize(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes", paths)
    labels = materialize(components(links(docs, classes, shingle, k, percent, paths), paths).withColumnRenamed("node", "cid"), "labels", paths)
    least = labels.join(classes.select("cid", "r"), "cid").groupBy("label").agg(F.min("r").alias("least"))
    firsts = labels.join(materialize(least, "least", paths), "label").select("cid", "least")
    found = classes.select("n", "key", "r", "cid").join(firsts, "cid", "left").select("n", "key", F.coalesce("least", "r").alias("first"))
    found = materialize(found, "found")
    discard(spark, paths)
    out = rows.select("doc_id", "th", "n", "key").join(found, ["n", "key"], "left")
    return out.select("doc_id", "th", F.col("n").alias("n_shingles"), "first")
