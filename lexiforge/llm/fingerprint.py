"""Improbable-feature digests of documents (similarity digests, after Roussev 2010).

Each window of 64 bytes has an entropy. Windows whose entropy is improbable for
a text rank first. In every run of 64 neighbouring windows the first-ranked one
gets a point; windows with enough points are the document's features. Their
hashes set bits in Bloom filters of 2048 bits, a new one being chained after
every 160 features. Two digests are compared by the bits that their filters
share, beyond what chance would share, over the most they could share: the bits
of the smaller filter, or of the larger one if the smaller has under SPARSE bits,
as so few are found by chance in one of a long chain's filters.

Rarity follows a rule, so digests can be compared whatever table they came
from: the further an entropy is from that of usual prose, TYPICAL thousandths of
the most a window can have, the rarer it is; nearly constant windows rank last.

Defined results: a null text counts as empty; an empty text has an empty digest,
like only to another empty one; a text under 64 bytes is one feature, as is one
without windows that rank; equal texts always have equal digests and likeness 1;
of equally rare windows the leftmost gets the point; texts of any length are read
whole. Each row gives one row: rows of null id come first, rows of one id follow
each other by their texts. Columns other than doc_id and text are ignored; an
empty table gives no rows.
"""

from __future__ import annotations

import base64
import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WINDOW, RUN, POINTS = 64, 64, 16
FILTER_BITS, FILTER_FEATURES, HASHES = 2048, 160, 5
TYPICAL, LEAST = 640, 100
SPARSE = 64
BLOCK = 1 << 20
LEAST_KEY = -(2**63)
MOST_RANGES = 20_000

_c = np.arange(WINDOW + 2)
#: c * log2(c) in fixed point, so that sums don't depend on their order.
C_LOG_C = np.round(_c * np.log2(np.maximum(1, _c)) * (1 << 20)).astype(np.int64)


def entropies(b: np.ndarray) -> np.ndarray:
    """Entropy of every window of 64 bytes, in thousandths of the most, from how often each byte recurs near itself."""
    n = len(b)
    before, after = np.zeros(n, np.uint8), np.zeros(n, np.uint8)
    for d in range(1, WINDOW):
        same = (b[d:] == b[:-d]).view(np.uint8)
        before[d:] += same
        after[:-d] += same
    # What a byte's coming in adds to the sum of c log c, and what its going out takes off.
    comes = C_LOG_C[before + 1] - C_LOG_C[before]
    goes = C_LOG_C[after + 1] - C_LOG_C[after]
    return _entropy_from(comes, goes, b)


def _entropy_from(comes: np.ndarray, goes: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The window that slides by one first loses its first byte, of which ``goes`` counts the other 63, then gains one."""
    total = np.empty(len(b) - WINDOW + 1, np.int64)
    total[0] = comes[:WINDOW].sum()
    total[1:] = total[0] + np.cumsum(comes[WINDOW:] - goes[: len(b) - WINDOW])
    e = math.log2(WINDOW) - total / (WINDOW * (1 << 20))
    return np.round(e * (1000 / math.log2(WINDOW))).astype(np.int64)


def ranks(e: np.ndarray) -> np.ndarray:
    """The rarest first; 1001 for windows that never become features."""
    return np.where(e < LEAST, 1001, 1000 - np.abs(e - TYPICAL))


def feature_starts(texts: list[bytes]) -> list[np.ndarray]:
    """Where the features of each text begin; worked out for all texts of a block at once."""
    out = [np.empty(0, np.int64)] * len(texts)
    ends = np.cumsum([len(t) for t in texts])
    n = int(ends[-1]) if len(ends) else 0
    if n < WINDOW:
        return out
    r = ranks(entropies(np.frombuffer(b"".join(texts), np.uint8)))
    # The first-ranked, then leftmost, window of each run, by doubling.
    pad = np.full(RUN - 1, 1001 << 40, np.int64)
    key = np.concatenate([(r << 40) + np.arange(len(r)), pad])
    width = 1
    while width < RUN:
        key[: len(key) - width] = np.minimum(key[: len(key) - width], key[width:])
        width *= 2
    key = key[: len(r)]
    start = 0
    for i, end in enumerate(ends.tolist()):
        windows = end - start - WINDOW + 1
        if windows > 0:
            runs = max(1, windows - RUN + 1)
            own = key[start : start + runs]
            if windows < RUN:
                part = r[start : start + windows]
                own = np.array([(int(part.min()) << 40) + start + int(part.argmin())])
            own = own[(own >> 40) <= 1000]
            at, points = np.unique((own & ((1 << 40) - 1)) - start, return_counts=True)
            need = min(POINTS, runs)
            out[i] = at[points >= need]
        start = end
    return out


def filters(text: bytes, starts: np.ndarray) -> np.ndarray:
    """Chained Bloom filters, 256 bytes each, of a text's features in their order."""
    if not text:
        return np.empty((0, FILTER_BITS // 8), np.uint8)
    parts = [text[s : s + WINDOW] for s in starts.tolist()] or [text]
    parts = list(dict.fromkeys(parts))
    h = np.frombuffer(b"".join(hashlib.sha1(p).digest() for p in parts), ">u4").reshape(-1, HASHES) & (FILTER_BITS - 1)
    bits = np.zeros((-(-len(parts) // FILTER_FEATURES), FILTER_BITS), bool)
    bits[np.repeat(np.arange(len(parts)) // FILTER_FEATURES, HASHES), h.ravel()] = True
    return np.packbits(bits, axis=1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Mean over the filters of the shorter chain of the best normalised overlap with a filter of the other, 0 to 1."""
    if not len(a) or not len(b):
        return 1.0 if len(a) == len(b) else 0.0
    if a.shape == b.shape and (a == b).all():
        return 1.0
    if len(a) > len(b):
        a, b = b, a
    bits_b = np.unpackbits(b, axis=1).astype(np.float32)
    size_b = bits_b.sum(1)
    best = []
    for at in range(0, len(a), 64):
        bits_a = np.unpackbits(a[at : at + 64], axis=1).astype(np.float32)
        size_a = bits_a.sum(1)[:, None]
        chance = size_a * size_b / FILTER_BITS
        most = np.minimum(size_a, size_b)
        most = np.where(most < SPARSE, np.maximum(size_a, size_b), most)
        cut = chance + 0.3 * (most - chance)
        best.append(np.clip((bits_a @ bits_b.T - cut) / np.maximum(1e-9, most - cut), 0, 1).max(1))
    return float(np.round(np.concatenate(best).mean(), 6))


def digest(f: np.ndarray) -> str:
    """A digest as text: the number of filters and their bits."""
    return f"{len(f)}:{base64.b64encode(f.tobytes()).decode()}" if len(f) else "0:"


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    return [filters(t, s) for t, s in zip(texts, feature_starts(texts))]


def edited(text: str, following: str) -> str:
    """The last half of the code points replaced by as many first ones of the following text, or all it has."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint) for every text."""

    def run(batches):
        for b in batches:
            texts = [(t.as_py() or "").encode() for t in b.column(1)]
            at = 0
            for block in _runs(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(block)), pa.array(map(digest, fingerprints(block)))], names=["id", "fingerprint"])
                at += len(block)

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"id {kind}, fingerprint string").withColumnRenamed("id", id_col)


def _runs(texts: list[bytes]):
    """Runs of texts of about BLOCK bytes."""
    run: list[bytes] = []
    held = 0
    for t in texts:
        run.append(t)
        held += len(t)
        if held >= BLOCK:
            yield run
            run, held = [], 0
    if run:
        yield run


def _compared(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    """Rows (id, text, whether only the following one) in order; all but the last are given with what follows them."""
    own = [t.encode() for _, t, _ in rows]
    prints: list[np.ndarray] = []
    changed = [edited(a[1], b[1]).encode() for a, b in zip(rows, rows[1:])]
    for block in _runs(own):
        prints += fingerprints(block)
    other: list[np.ndarray] = []
    for block in _runs(changed):
        other += fingerprints(block)
    keep = [i for i in range(len(rows) - 1) if not rows[i][2]]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([rows[i][0] for i in keep], kind),
            pa.array([len(rows[i][1]) for i in keep], pa.int64()),
            pa.array([hashlib.sha256(changed[i]).hexdigest() for i in keep], pa.string()),
            pa.array([digest(prints[i]) for i in keep], pa.string()),
            pa.array([digest(other[i]) for i in keep], pa.string()),
            pa.array([likeness(prints[i], other[i]) for i in keep], pa.float64()),
            pa.array([likeness(prints[i], prints[i + 1]) for i in keep], pa.float64()),
        ],
        names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
    )


def compare_with_next(docs: DataFrame, rows_per_bucket: int = 1000) -> DataFrame:
    """Fingerprints of each document and its edited text, and their likenesses.

    The next document is that of the next higher doc_id (null ids first, rows of
    one id by text), after the last the first. Ids are cut into ranges at ids
    that exist, so each range's first document is known: it is sent to the range
    before as well, and texts are shuffled once. There are MOST_RANGES ranges at
    most; beyond that a range holds more rows, which only pass through its task,
    a few at a time.
    """
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(LEAST_KEY)).alias("_key"))
    size = keyed.agg(F.count("*").alias("n")).first()["n"]
    n = max(1, min(MOST_RANGES, math.ceil(size / rows_per_bucket)))
    cuts = keyed.agg(F.percentile_approx("_key", [i / n for i in range(n)], 10 * n).alias("c"), F.min("_key").alias("lo")).first()
    cuts = sorted({cuts["lo"], *cuts["c"]}) if size else [0]
    shared = docs.sparkSession.sparkContext.broadcast(np.array(cuts, np.int64))

    def place(batches):
        bounds = shared.value
        for b in batches:
            key = b.column(2).to_numpy()
            bucket = np.searchsorted(bounds, key, "right") - 1
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(bucket, pa.int32()), pa.array(np.zeros(len(key), bool))], names=["doc_id", "text", "_key", "_bucket", "_follows"])
            first = np.flatnonzero(bounds[np.maximum(bucket, 0)] == key)
            if len(first):
                at = pa.array(first)
                before = (bucket[first] - 1) % len(bounds)
                yield pa.RecordBatch.from_arrays([*(c.take(at) for c in b.columns), pa.array(before, pa.int32()), pa.array(np.ones(len(first), bool))], names=["doc_id", "text", "_key", "_bucket", "_follows"])

    def run(batches):
        held: list[tuple] = []
        bucket, chars = -1, 0
        done = False  # the bucket's following row has been taken

        def rows():
            for b in batches:
                for r in zip(*(c for c in (b.column(0), b.column(1), b.column(3), b.column(4)))):
                    yield b.column(0).type, *(x.as_py() for x in r)

        for kind, doc_id, text, at, follows in rows():
            if at != bucket:
                if len(held) > 1:
                    yield _compared(held, kind)
                held, chars, done, bucket = [], 0, False, at
            if done:
                continue
            held.append((doc_id, text, follows))
            chars += len(text)
            done = follows
            if chars >= 1 << 20 and len(held) > 1:
                yield _compared(held, kind)
                held, chars = held[-1:], len(held[-1][1])
        if len(held) > 1:
            yield _compared(held, kind)

    kind = docs.schema["doc_id"].dataType.simpleString()
    placed = keyed.mapInArrow(place, f"doc_id {kind}, text string, _key long, _bucket int, _follows boolean")
    dealt = placed.repartition(len(cuts), "_bucket").sortWithinPartitions("_bucket", "_follows", "_key", "text")
    return dealt.mapInArrow(run, f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")
