"""Language-model scores by context-tree weighting over bytes.

A text is scored as its tokens, A-Z lower-cased, a blank between them and a line
end after the last: the same events that the unigram base scores. Each byte is
eight binary decisions; each decision has a tree of the up to DEPTH bytes before
it. In every tree the weighted probability of a context is half its own
Krichevsky-Trofimov estimate and half the product of its longer contexts', so all
depths are mixed. After training the mixture's weights are the posterior ones,
and a decision's probability is the weighted mean of the estimates along its path.

Counts cover all training texts. Texts are dealt into blocks; what a block holds
(words, and grams of DEPTH bytes and the byte after them) is counted in it,
packed by bucket of words and by the last two context bytes of grams, summed over
blocks, GROUP of them at a time in as many rounds as that takes, and comes back
to the blocks that hold it. So no table of all words or grams is gathered,
broadcast or sent to the driver: a block meets its own part of the model. Grams
that only held-out texts hold take part with count 0, so their probability comes
from the same trees.

Grams whose last two context bytes are shared by parts of over SPLIT_BYTES are
dealt by a third byte, and by a fourth if need be, up to DEPTH, so no task holds
a hot ending whole.

What is written grows with the text: a block has at most BUCKETS rows of words
and 65,536 of grams before such splits, and on the way back a key's part of the
model is copied only as often as the blocks' own parts of that key outweigh it.

The trees split at these endings into subtrees that are worked out apart. What
lies above a split ending is mixed in one row for each ending, of 255 decisions
at most; above two bytes there is a table of at most 256 * 255 rows, which the
driver mixes.

Defined results: a null or empty text is the end alone; without training texts
every decision has probability 1/2 and N and V are 0; rows of equal doc_id are
scored each; a doc_id that is null counts as training.
"""

from __future__ import annotations

import math
from collections import Counter
from functools import lru_cache
from inspect import signature

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, discard, fold, give_back, lean, materialize

DEPTH = 6
BLOCK_BYTES, CHUNK, LEAST_BLOCKS, GROUP, BUCKETS = 20 << 20, 4 << 20, 8, 64, 4096
#: On the way back a task meets held parts of about so many bytes, or four times the model's part if that is more.
RETURN_BYTES = 32 << 20
#: Packed bytes after which a worker gives memory back.
LARGE_BYTES = 1 << 20
#: Packed parts of one ending, of all blocks, over which it is dealt by one more byte.
SPLIT_BYTES = 8 << 20
#: Rows of the tables by key (a few numbers) and by split ending (up to 30 kB) that are broadcast; beyond, the join shuffles.
MOST_KEYS, MOST_CHAINS = 200_000, 1000
END = b"\n"
HALF = math.log(0.5)


def stream(text: str | None) -> bytes:
    """A text as the bytes that are scored."""
    return b" ".join((text or "").encode().lower().split()) + END


def gram_codes(streams: bytes, depth: int = DEPTH) -> np.ndarray:
    """For each byte of streams in a row, its gram: the ``depth`` bytes before it and itself, oldest first.

    Bytes before a stream's first are taken as ends, as if each text followed many ends.
    """
    b = np.frombuffer(END * depth + streams, np.uint8).astype(np.uint64)
    n = len(streams)
    code = b[:n].copy()
    for i in range(1, depth + 1):
        code <<= np.uint64(8)
        code |= b[i : i + n]
    # The first bytes of each stream: everything up to the end before it becomes ends.
    first = np.flatnonzero(np.frombuffer(streams, np.uint8) == END[0])[:-1] + 1
    for k in range(depth):
        at = first[first + k < n] + k
        at = at[_same_stream(b, at, depth, k)]
        bits = np.uint64(8 * (k + 1))
        low = code[at] & ((np.uint64(1) << bits) - np.uint64(1))
        code[at] = low | _ENDS[depth] >> bits << bits
    return code


_ENDS = {d: np.uint64(int.from_bytes(END * (d + 1), "big")) for d in range(1, 8)}


def _same_stream(b: np.ndarray, at: np.ndarray, depth: int, k: int) -> np.ndarray:
    """Whether no stream ends within the k bytes before each place."""
    ok = np.ones(len(at), bool)
    for j in range(1, k + 1):
        ok &= b[at + depth - j] != END[0]
    return ok


def kt_block(n0: np.ndarray, n1: np.ndarray) -> np.ndarray:
    """Natural log of the Krichevsky-Trofimov probability of n0 zeros and n1 ones."""
    return _log_gamma(0.5, n0) + _log_gamma(0.5, n1) - _log_gamma(1.0, n0 + n1) - math.log(math.pi)


_lgamma = np.frompyfunc(math.lgamma, 1, 1)


@lru_cache
def _gammas(more: float) -> np.ndarray:
    return _lgamma(np.arange(1 << 14) + more).astype(np.float64)


def _log_gamma(more: float, n: np.ndarray) -> np.ndarray:
    """Log gamma of n + more for whole n: from a table, of larger ones once for each value."""
    n, table = n.astype(np.int64), _gammas(more)
    out = table[np.minimum(n, len(table) - 1)]
    large = np.flatnonzero(n >= len(table))
    if len(large):
        values, at = np.unique(n[large], return_inverse=True)
        out[large] = _lgamma(values + more).astype(np.float64)[at]
    return out


class Subtrees:
    """The part of all trees whose contexts share their last ``top`` bytes, from (gram, count) rows.

    Level d lists the distinct pairs of a context of d bytes and a decision; a
    level's rows know their parents one level up.
    """

    def __init__(self, codes: np.ndarray, counts: np.ndarray, depth: int = DEPTH, top: int = 2):
        self.depth, self.top = depth, top
        symbols = (codes & np.uint64(255)).astype(np.int64)
        context = codes >> np.uint64(8)
        backwards = np.zeros(len(codes), np.uint64)
        for i in range(depth):
            backwards = backwards << np.uint64(8) | (context >> np.uint64(8 * i)) & np.uint64(255)
        keys, bits = [], []
        for j in range(8):
            node = (1 << j) | (symbols >> (8 - j))
            keys.append(backwards << np.uint64(8) | node.astype(np.uint64))
            bits.append((symbols >> (7 - j)) & 1)
        key, self.bit = np.concatenate(keys), np.concatenate(bits)
        weight = np.tile(counts.astype(np.float64), 8)
        level, self.row = np.unique(key, return_inverse=True)
        n1 = np.bincount(self.row, weight * self.bit, len(level))
        n0 = np.bincount(self.row, weight, len(level)) - n1
        self.levels = {depth: (level, n0, n1, kt_block(n0, n1), np.ones(len(level)))}
        self.parent = {}
        for d in range(depth - 1, top - 1, -1):
            below, b0, b1, logp, _ = self.levels[d + 1]
            # Keys are (last byte, ..., oldest byte, decision): one context byte less keeps the order of the rest.
            short = below >> np.uint64(16) << np.uint64(8) | below & np.uint64(255)
            level, up = np.unique(short, return_inverse=True)
            n0, n1, longer = (np.bincount(up, x, len(level)) for x in (b0, b1, logp))
            own = kt_block(n0, n1)
            mixed = np.logaddexp(HALF + own, HALF + longer)
            self.levels[d], self.parent[d + 1] = (level, n0, n1, mixed, np.exp(HALF + own - mixed)), up

    def roots(self) -> tuple[np.ndarray, ...]:
        """Level ``top``: keys, n0, n1 and the logs of the weighted probabilities."""
        return self.levels[self.top][:4]

    def decisions(self) -> tuple[np.ndarray, np.ndarray]:
        """For each gram's eight decisions (decision by decision): probability within the subtree, and row of level ``top``."""
        at = self.row
        p = _estimate(self.levels[self.depth], at, self.bit)
        for d in range(self.depth - 1, self.top - 1, -1):
            at = self.parent[d + 1][at]
            w = self.levels[d][4][at]
            p = w * _estimate(self.levels[d], at, self.bit) + (1 - w) * p
        return p, at


def _estimate(level: tuple, at: np.ndarray, bit: np.ndarray) -> np.ndarray:
    n0, n1 = level[1][at], level[2][at]
    return (np.where(bit == 1, n1, n0) + 0.5) / (n0 + n1 + 1)


class Crown:
    """Levels 1 and 0 of all trees, from the sums over level 2 by last byte and decision."""

    def __init__(self, last: np.ndarray, node: np.ndarray, n0: np.ndarray, n1: np.ndarray, longer: np.ndarray):
        shape = (256, 256)
        self.n = np.zeros((2, *shape))
        self.n[0][last, node], self.n[1][last, node] = n0, n1
        below = np.zeros(shape)
        below[last, node] = longer
        own = kt_block(self.n[0].ravel(), self.n[1].ravel()).reshape(shape)
        mixed = np.logaddexp(HALF + own, HALF + below)
        self.w1 = np.exp(HALF + own - mixed)
        self.root = self.n.sum(1)
        own0, below0 = kt_block(self.root[0], self.root[1]), mixed.sum(0)
        self.w0 = np.exp(HALF + own0 - np.logaddexp(HALF + own0, HALF + below0))

    def mix(self, p: np.ndarray, last: np.ndarray, node: np.ndarray, bit: np.ndarray) -> np.ndarray:
        one = (self.n[bit, last, node] + 0.5) / (self.n[0][last, node] + self.n[1][last, node] + 1)
        none = (self.root[bit, node] + 0.5) / (self.root[0][node] + self.root[1][node] + 1)
        p = self.w1[last, node] * one + (1 - self.w1[last, node]) * p
        return self.w0[node] * none + (1 - self.w0[node]) * p


def log10_of_grams(trees: Subtrees, crown: Crown, n: int, chain: list[tuple] = ()) -> np.ndarray:
    """log10 of the probability of each gram's last byte after the others.

    ``chain`` lists (decisions, n0, n1, own weights) of the endings that the trees' ending was split from, shortest first.
    """
    p, at = trees.decisions()
    key = trees.levels[trees.top][0][at]
    node = (key & np.uint64(255)).astype(np.int64)
    for nodes, n0, n1, w in reversed(chain):
        row = np.searchsorted(nodes, node)
        p = w[row] * _estimate((None, n0, n1), row, trees.bit) + (1 - w[row]) * p
    last = (key >> np.uint64(8 * trees.top)).astype(np.int64) & 255
    p = crown.mix(p, last, node, trees.bit)
    return np.log10(p).reshape(8, n).sum(0)


def _lean(run):
    """A function of one or two tables whose worker gives memory back after large ones."""

    def after(out, *tables):
        if sum(t.nbytes for t in tables) > LARGE_BYTES:
            give_back()
        return out

    if len(signature(run).parameters) == 1:
        return lambda g: after(run(g), g)
    return lambda left, right: after(run(left, right), left, right)


def _blobs(docs: DataFrame, blocks: int) -> DataFrame:
    """Texts of a block and batch in one compressed row: (block, ids, held, blob); streams end in END."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=1)
        for b in batches:
            block = b.column(3).to_numpy()
            for k in np.unique(block):
                own = pa.array(np.flatnonzero(block == k))
                ids, texts, held = (b.column(i).take(own) for i in range(3))
                at = 0
                while at < len(own):
                    parts, size, first = [], 0, at
                    while at < len(own) and size < 1 << 20:
                        parts.append(stream(texts[at].as_py()))
                        size, at = size + len(parts[-1]), at + 1
                    row = [pa.array([int(k)], pa.int32()), pa.array([ids[first:at].to_pylist()], pa.list_(ids.type)), pa.array([held[first:at].to_pylist()], pa.list_(pa.bool_())), pa.array([z.compress(b"".join(parts))], pa.binary())]
                    yield pa.RecordBatch.from_arrays(row, names=["block", "ids", "held", "blob"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    held = F.coalesce(fold("doc_id", 5) == 1, F.lit(False))
    block = F.pmod(F.xxhash64(F.col("doc_id").cast("string"), F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), F.lit(blocks)).cast("int")
    return docs.select("doc_id", "text", held.alias("held"), block.alias("block")).mapInArrow(lean(run), f"block int, ids array<{kind}>, held array<boolean>, blob binary")


def _streams(table: pa.Table):
    """(ids, held, streams) of a block, in chunks of about CHUNK bytes."""
    z = zstandard.ZstdDecompressor()
    ids, held, data, size = [], [], [], 0
    for i, h, blob in zip(table["ids"], table["held"], table["blob"]):
        ids += i.as_py()
        held += h.as_py()
        data.append(z.decompress(blob.as_py()))
        size += len(data[-1])
        if size >= CHUNK:
            yield ids, held, b"".join(data)
            ids, held, data, size = [], [], [], 0
    if ids:
        yield ids, held, b"".join(data)


def _planes(x: np.ndarray) -> bytes:
    """Numbers as planes of their bytes, which compress well."""
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _numbers(data: bytes, n: int, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, n).T).view(kind).ravel()


def pack_numbers(keys: np.ndarray, values: np.ndarray) -> bytes:
    """Ascending 64-bit keys with counts or float32 values."""
    values = values.astype(np.float32) if values.dtype.kind == "f" else values.astype(np.uint64)
    tag = b"f" if values.dtype.kind == "f" else b"n"
    deltas = np.diff(keys, prepend=np.uint64(0))
    return zstandard.ZstdCompressor(level=1).compress(tag + len(keys).to_bytes(8, "little") + _planes(deltas) + _planes(values))


def unpack_numbers(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[1:9], "little")
    kind = np.float32 if data[:1] == b"f" else np.uint64
    return np.cumsum(_numbers(data[9 : 9 + 8 * n], n, np.uint64), dtype=np.uint64), _numbers(data[9 + 8 * n :], n, kind)


def pack_words(words: list[bytes], counts) -> bytes:
    """Words, none of which holds an end unless it is the end itself, with counts."""
    return zstandard.ZstdCompressor(level=1).compress(len(words).to_bytes(8, "little") + _planes(np.array(counts, np.uint64)) + b" ".join(words))


def unpack_words(blob: bytes) -> tuple[list[bytes], np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(blob)
    n = int.from_bytes(data[:8], "little")
    return data[8 + 8 * n :].split(b" ") if n else [], _numbers(data[8 : 8 + 8 * n], n, np.uint64)


WORDS, GRAMS = 0, 1
PARTS = "kind int, key long, block int, blob binary"
#: A key of grams is the number of bytes of their ending, above bit 56, and the ending.
TOP, LENGTH_BIT = 2, 56


def _parts(rows: list[tuple]) -> pa.Table:
    cols = list(zip(*rows)) or [[]] * 4
    return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["kind", "key", "block", "blob"])


def _key(top: int, ending: int) -> int:
    return top << LENGTH_BIT | ending


def _shorter(top: int, key: str = "key"):
    """The key of the last ``top`` bytes of a key's ending."""
    return F.lit(_key(top, 0)).bitwiseOR(F.col(key).bitwiseAND(F.lit((1 << 8 * top) - 1)))


def _by_ending(code: np.ndarray, n: np.ndarray, top: int):
    """(key, grams, counts) of each ending of ``top`` context bytes; grams stay ascending."""
    ending = (code >> np.uint64(8)) & np.uint64((1 << 8 * top) - 1)
    order = np.argsort(ending, kind="stable")
    code, n, ending = code[order], n[order], ending[order]
    cuts = [0, *(np.flatnonzero(np.diff(ending)) + 1).tolist(), len(ending)]
    for i, j in zip(cuts, cuts[1:]):
        yield _key(top, int(ending[i])), code[i:j], n[i:j]


def _holdings(blobs: DataFrame, depth: int, buckets: int) -> DataFrame:
    """Each block's distinct words, by bucket, and grams, by their last two context bytes, with their counts in training texts."""

    def run(g: pa.Table) -> pa.Table:
        block = g["block"][0].as_py()
        words: Counter = Counter()
        unseen: set[bytes] = {END}
        codes, counts = [], []
        for ids, held, data in _streams(g):
            texts = data.split(END)[:-1]
            for h in (False, True):
                own = [t for t, x in zip(texts, held) if x is h]
                if not own:
                    continue
                tokens = b" ".join(own).split()
                if h:
                    unseen.update(tokens)
                else:
                    words.update(tokens)
                    words[END] += len(own)
                code, n = np.unique(gram_codes(END.join(own) + END, depth), return_counts=True)
                codes.append(code)
                counts.append(n * (not h))
            if sum(map(len, codes)) > 1 << 22:
                codes, counts = [[x] for x in _summed(codes, counts)]
        code, n = _summed(codes, counts)
        rows = []
        for w in unseen:
            words.setdefault(w, 0)
        by: dict[int, list[bytes]] = {}
        for w in words:
            by.setdefault(xxhash.xxh3_64_intdigest(w) % buckets, []).append(w)
        for k, own in by.items():
            own.sort()
            rows.append((WORDS, k, block, pack_words(own, [words[w] for w in own])))
        rows += [(GRAMS, key, block, pack_numbers(c, x)) for key, c, x in _by_ending(code, n, TOP)]
        return _parts(rows)

    return blobs.groupBy("block").applyInArrow(_lean(run), PARTS)


def _summed(codes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Distinct codes, ascending, with their summed counts."""
    code, n = np.concatenate(codes), np.concatenate(counts)
    order = np.argsort(code)
    code = code[order]
    first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
    return code[first], np.add.reduceat(n[order], first)


def _merge_numbers(blobs) -> tuple[np.ndarray, np.ndarray]:
    """Sums of packed counts; what is held at once is about twice the distinct codes."""
    codes, counts, size = [], [], 0
    for b in blobs:
        c, n = unpack_numbers(b.as_py())
        codes.append(c)
        counts.append(n)
        if sum(map(len, codes)) > max(1 << 20, 2 * size):
            codes, counts = [[x] for x in _summed(codes, counts)]
            size = len(codes[0])
    code, n = _summed(codes, counts)
    return code, n.astype(np.int64)


def _merge_words(blobs) -> tuple[list[bytes], list[int]]:
    total: Counter = Counter()
    for b in blobs:
        words, n = unpack_words(b.as_py())
        for w, c in zip(words, n.tolist()):
            total[w] += c
    words = sorted(total)
    return words, [total[w] for w in words]


def _sized(parts: DataFrame) -> DataFrame:
    """Parts with their sizes, which are read without the parts."""
    return parts.withColumn("size", F.octet_length("blob"))


def _split(parts: DataFrame, depth: int, paths: list[str]) -> tuple[DataFrame, int]:
    """The written parts with each ending of over SPLIT_BYTES dealt by one more byte, and again; and the length of the longest ending."""

    def run(batches, top):
        for b in batches:
            for block, blob in zip(b.column(0), b.column(1)):
                rows = [(GRAMS, key, block.as_py(), pack_numbers(c, n)) for key, c, n in _by_ending(*unpack_numbers(blob.as_py()), top)]
                yield from _parts(rows).to_batches()

    done, top = [], TOP
    while top < depth:
        weight = parts.filter(F.col("key") >= _key(TOP, 0)).groupBy("key").agg(F.sum("size").alias("_s"))
        hot = materialize(weight.filter(F.col("_s") > SPLIT_BYTES).select("key"), "hot", paths)
        n = hot.count()
        if not n:
            break
        hot, top = broadcast_if(hot, n, MOST_KEYS), top + 1
        done.append(parts.join(hot, "key", "left_anti").select(*parts.columns))
        longer = parts.join(hot, "key", "left_semi").select("block", "blob").mapInArrow(lambda batches, top=top: run(batches, top), PARTS)
        parts = materialize(_sized(longer), "split", paths)
    for d in done:
        parts = parts.unionByName(d)
    return parts, top


def _merged(parts: DataFrame) -> DataFrame:
    """Sums over GROUP blocks at a time, so that no task holds a key's parts of all blocks; GROUP sums count as a block of the next round."""

    def run(g: pa.Table) -> pa.Table:
        kind, key = g["kind"][0].as_py(), g["key"][0].as_py()
        blob = pack_words(*_merge_words(g["blob"])) if kind == WORDS else pack_numbers(*_merge_numbers(g["blob"]))
        return _parts([(kind, key, g["group"][0].as_py(), blob)])

    return parts.withColumn("group", F.floor(F.col("block") / GROUP).cast("int")).groupBy("kind", "key", "group").applyInArrow(_lean(run), PARTS)


def _roots(grams: DataFrame, depth: int) -> DataFrame:
    """(key, node, n0, n1, logp): for each ending and decision the counts and the log of the weighted probability."""

    def run(g: pa.Table) -> pa.Table:
        own = g["key"][0].as_py()
        key, n0, n1, logp = Subtrees(*_merge_numbers(g["blob"]), depth, own >> LENGTH_BIT).roots()
        return pa.table({"key": pa.array(np.full(len(key), own)), "node": pa.array((key & np.uint64(255)).astype(np.int32)), "n0": pa.array(n0), "n1": pa.array(n1), "logp": pa.array(logp)})

    return grams.groupBy("key").applyInArrow(_lean(run), "key long, node int, n0 double, n1 double, logp double")


def _upper(roots: DataFrame, longest: int, paths: list[str]) -> tuple[Crown, DataFrame | None]:
    """What lies above the subtrees: the upper levels and, if endings were split, (key, chain) of those (see ``log10_of_grams``).

    A split ending's counts and longer contexts are the sums over the endings it was split into, the longest first. At most
    256 * 255 sums come to the driver.
    """
    sums = [F.sum(c).alias(c) for c in ("n0", "n1", "logp")]

    def run(g: pa.Table) -> pa.Table:
        g = g.sort_by("node")
        n0, n1, longer = (g[c].to_numpy() for c in ("n0", "n1", "logp"))
        own = kt_block(n0, n1)
        mixed = np.logaddexp(HALF + own, HALF + longer)
        return g.set_column(g.schema.get_field_index("logp"), "logp", pa.array(mixed)).append_column("w", pa.array(np.exp(HALF + own - mixed)))

    level = lambda top: roots.filter(F.shiftright("key", LENGTH_BIT) == top)
    rows, mixed = level(longest), {}
    for top in range(longest - 1, TOP - 1, -1):
        summed = rows.select(_shorter(top).alias("key"), "node", "n0", "n1", "logp").groupBy("key", "node").agg(*sums)
        mixed[top] = materialize(summed.groupBy("key").applyInArrow(run, "key long, node int, n0 double, n1 double, logp double, w double"), "mixed", paths)
        rows = level(top).unionByName(mixed[top].drop("w"))
    chains = longer = None
    for top in sorted(mixed):
        own = mixed[top].groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n0", "n1", "w"))).alias("own"))
        if longer is None:
            longer = own.select("key", F.array("own").alias("chain"))
        else:
            up = longer.select(F.col("key").alias("_up"), "chain")
            longer = own.withColumn("_up", _shorter(top - 1)).join(up, "_up").select("key", F.concat("chain", F.array("own")).alias("chain"))
        longer = materialize(longer, "chains", paths)
        chains = longer if chains is None else chains.unionByName(longer)
    table = rows.groupBy(F.col("key").bitwiseAND(F.lit(255)).alias("last"), "node").agg(*sums).toPandas()
    return Crown(*(table[c].to_numpy(t) for c, t in (("last", np.int64), ("node", np.int64), ("n0", float), ("n1", float), ("logp", float)))), chains


def _models(merged: DataFrame, crown: Crown, chains: DataFrame | None, longest: int, depth: int) -> DataFrame:
    """(kind, key, blob): the words of a bucket with their counts, the grams of an ending with their log10 probabilities."""
    shared = merged.sparkSession.sparkContext.broadcast(crown)

    def run(g: pa.Table) -> pa.Table:
        kind, key = g["kind"][0].as_py(), g["key"][0].as_py()
        if kind == WORDS:
            return _parts([(kind, key, 0, pack_words(*_merge_words(g["blob"])))])
        codes, n = _merge_numbers(g["blob"])
        chain = (g["chain"][0].values or []) if "chain" in g.column_names else []
        above = [tuple(np.asarray(x) for x in own.values.flatten()) for own in chain]
        return _parts([(kind, key, 0, pack_numbers(codes, log10_of_grams(Subtrees(codes, n, depth, key >> LENGTH_BIT), shared.value, len(codes), above)))])

    if chains is not None:
        up = F.coalesce(*[F.when(F.shiftright("key", LENGTH_BIT) == top + 1, _shorter(top)) for top in range(TOP, longest)])
        chains = chains.withColumnRenamed("key", "_up")
        merged = merged.withColumn("_up", up).join(broadcast_if(chains, chains.count(), MOST_CHAINS), "_up", "left")
    return merged.groupBy("kind", "key").applyInArrow(_lean(run), PARTS)


def _returned(parts: DataFrame, models: DataFrame, paths: list[str]) -> DataFrame:
    """The model's part for each block: what the block holds of each key, with the model's values."""

    def run(held: pa.Table, table: pa.Table) -> pa.Table:
        if not held.num_rows:
            return _parts([])
        kind, key = held["kind"][0].as_py(), held["key"][0].as_py()
        if kind == WORDS:
            words, n = unpack_words(table["blob"][0].as_py())
            value = dict(zip(words, n.tolist()))
            own = ((b, unpack_words(x.as_py())[0]) for b, x in zip(held["block"], held["blob"]))
            return _parts([(kind, key, b.as_py(), pack_words(w, [value[x] for x in w])) for b, w in own])
        codes, values = unpack_numbers(table["blob"][0].as_py())
        own = ((b, unpack_numbers(x.as_py())[0]) for b, x in zip(held["block"], held["blob"]))
        return _parts([(kind, key, b.as_py(), pack_numbers(c, values[np.searchsorted(codes, c)])) for b, c in own])

    bytes_of = lambda t, name: t.groupBy("kind", "key").agg(F.sum("size").alias(name))
    shares = bytes_of(parts, "_held").join(bytes_of(models, "_own"), ["kind", "key"])
    shares = shares.select("kind", "key", F.ceil(F.col("_held") / F.greatest(F.lit(RETURN_BYTES), 4 * F.col("_own"))).cast("int").alias("_n"))
    shares = materialize(shares, "shares", paths)
    shares = broadcast_if(shares, shares.count(), MOST_KEYS)
    left = parts.join(shares, ["kind", "key"]).select("kind", "key", "block", "blob", F.pmod(F.xxhash64("block"), F.col("_n")).cast("int").alias("group"))
    right = models.join(shares, ["kind", "key"]).select("kind", "key", "blob", F.explode(F.sequence(F.lit(0), F.col("_n") - 1)).alias("group"))
    anew = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns]).groupBy("kind", "key", "group")
    return anew(left).cogroup(anew(right)).applyInArrow(_lean(run), PARTS)


def _scored(blobs: DataFrame, model: DataFrame, total: int, distinct: int, depth: int) -> DataFrame:
    """Each document's scores, from its block's texts and its block's part of the model."""
    norm = total + 0.5 * (distinct + 1)

    def run(texts: pa.Table, table: pa.Table) -> pa.Table:
        out: list[tuple] = []
        unknown = math.log10(0.5 / norm)
        logs: dict[bytes, float] = {}
        codes, values = [], []
        for kind, blob in zip(table["kind"].to_pylist(), table["blob"]):
            if kind == WORDS:
                words, n = unpack_words(blob.as_py())
                logs.update(zip(words, np.where(n > 0, np.log10((n + 0.5) / norm), unknown).tolist()))
            else:
                c, v = unpack_numbers(blob.as_py())
                codes.append(c)
                values.append(v)
        codes, values = np.concatenate([np.empty(0, np.uint64), *codes]), np.concatenate([np.empty(0, np.float32), *values])
        order = np.argsort(codes)
        codes, values = codes[order], values[order]
        for ids, held, data in _streams(texts):
            code = gram_codes(data, depth)
            order = np.argsort(code)
            code = code[order]
            first = np.flatnonzero(np.concatenate([[True], code[1:] != code[:-1]]))
            each_gram = values[np.searchsorted(codes, code[first])].astype(np.float64)
            own = np.empty(len(code))
            own[order] = np.repeat(each_gram, np.diff(first, append=len(code)))
            texts_here = data.split(END)[:-1]
            sizes = [len(t) + 1 for t in texts_here]
            scores = np.add.reduceat(own, np.cumsum([0, *sizes[:-1]]))
            for i, h, t, size, s in zip(ids, held, texts_here, sizes, scores.tolist()):
                each = [*map(logs.__getitem__, t.split()), logs[END]]
                out.append((i, h, len(each), len(each) - each.count(unknown), sum(each), s, size))
        cols = list(zip(*out)) or [[]] * 7
        kinds = [texts["ids"].type.value_type, pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.int64()]
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

    kind = blobs.schema["ids"].dataType.elementType.simpleString()
    schema = f"doc_id {kind}, held_out boolean, n_tokens long, n_known long, base_score double, score double, n_bytes long"
    return blobs.groupBy("block").cogroup(model.groupBy("block")).applyInArrow(_lean(run), schema)


def _facts(words: DataFrame) -> tuple[int, int]:
    """Tokens and distinct tokens of the training texts: N and V."""

    def run(batches):
        for b in batches:
            n = [unpack_words(x.as_py())[1] for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([int(sum(x.sum() for x in n))], pa.int64()), pa.array([int(sum((x > 0).sum() for x in n))], pa.int64())], names=["n", "v"])

    r = words.select("blob").mapInArrow(run, "n long, v long").agg(F.sum("n"), F.sum("v")).first()
    return r[0] or 0, r[1] or 0


def score_documents(docs: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, n_bytes, bits_per_byte) of every document."""
    spark = docs.sparkSession
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("s")).first()["s"]
    n_blocks = max(LEAST_BLOCKS, math.ceil(size / BLOCK_BYTES))
    blobs = _blobs(docs, n_blocks)
    paths: list[str] = []
    held = materialize(_sized(_holdings(blobs, depth, min(n_blocks, BUCKETS))), "holdings", paths)
    held, longest = _split(held, depth, paths)
    merged, left, sums = held, n_blocks, []
    while left > 1 or merged is held:
        old, sums = sums, []
        merged, left = materialize(_merged(merged), "merged", sums), math.ceil(left / GROUP)
        discard(spark, old)
    roots = materialize(_roots(merged.filter(F.col("kind") == GRAMS), depth), "roots", sums)
    crown, chains = _upper(roots, longest, sums)
    models = materialize(_sized(_models(merged, crown, chains, longest, depth)), "models", paths)
    discard(spark, sums)
    total, distinct = _facts(models.filter(F.col("kind") == WORDS))
    back = _returned(held, models, paths)
    scored = materialize(_scored(blobs, back, total, distinct, depth), "scored")
    discard(spark, paths)
    return scored.select(
        "doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", "n_bytes", (-F.col("score") / math.log10(2) / F.col("n_bytes")).alias("bits_per_byte")
    )
