"""Language identification in two steps: the family, then the language within it.

A linear SVM for each family against the rest picks the family; within it, one
linear SVM for each pair of languages casts a vote. The features are hashed
frequencies of byte 2-, 3- and 4-grams of the whole text, lower-cased, all but
letters as blanks.

The classifiers are fitted on a bounded sample of labelled rows: at most
``per_language`` rows of each language and ``MAX_SAMPLE`` in all (two of each
language at least), those of least hash of their id and text; rows that share
both count once. Every language of the labels is learned; over MAX_LANGUAGES
distinct labels end in an error, as such a column isn't one of languages.
Prediction uses the text alone.

Defined results: a null text, or one without a letter, is ``und`` with score 0;
so is every text if nothing labelled was there to learn from; one learned
language is predicted for all other texts, with score 1. Texts of any length are
read whole, in blocks. Each row gives one row, repeated ones and null ids too;
equal texts get equal results, and ties go to the lesser family, then to the
language of more votes, of greater summed margins, and the lesser code. Columns
other than doc_id, text and lang are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fold, lean, materialize

#: Families of languages by ISO 639-1 code; a language not named is a family of its own.
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is fy af lb yi",
    "romance": "fr es it pt ro ca gl oc la",
    "slavic": "ru uk be pl cs sk sl hr sr bs bg mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk ky uz tk tt",
    "indic": "hi bn mr ne gu pa ur",
}
FAMILY_OF = {code: family for family, codes in FAMILIES.items() for code in codes.split()}
DIMS = 1 << 13
PER_LANGUAGE, MAX_SAMPLE, MAX_LANGUAGES = 300, 4000, 2000
LETTER = regex.compile(r"\p{L}")
BLOCK = 1 << 18
_bytes = np.arange(256)
_fold = np.where((_bytes >= 65) & (_bytes <= 90), _bytes + 32, _bytes)
FOLD = np.where(((_fold >= 97) & (_fold <= 122)) | (_fold >= 128), _fold, 32).astype(np.uint64)


def grams(data: bytes) -> np.ndarray:
    """Hashed codes of the 2-, 3- and 4-grams of bytes, one blank before and after."""
    b = FOLD[np.frombuffer(b" " + data + b" ", np.uint8)]
    two = b[:-1] << np.uint64(8) | b[1:]
    three = two[:-1] << np.uint64(8) | b[2:]
    four = three[:-1] << np.uint64(8) | b[3:]
    codes = np.concatenate([two | np.uint64(2 << 32), three | np.uint64(3 << 32), four | np.uint64(4 << 32)])
    return ((codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 13)).astype(np.int32)


def chunks(data: bytes):
    """Blocks of long texts, each with the three bytes before it, so that no gram is lost."""
    for at in range(0, len(data), BLOCK):
        yield data[max(0, at - 3) : at + BLOCK]


def features(text: str) -> np.ndarray:
    """Frequencies of the hashed grams, scaled to length 1."""
    x = np.zeros(DIMS)
    for part in chunks(text.encode()):
        x += np.bincount(grams(part), minlength=DIMS)
    return (x / (np.sqrt((x * x).sum()) or 1)).astype(np.float32)


def linear_svms(x: np.ndarray, sides: np.ndarray, c: float = 10.0, steps: int = 150) -> tuple[np.ndarray, np.ndarray]:
    """L2-regularised squared-hinge SVMs by accelerated gradient steps, all at once: (weights, bias), a column for each.

    The last column of x is the constant 1. A column of ``sides`` has 1 and -1 for the rows of a plane's two sides, which weigh
    the same, and 0 for rows that take no part.
    """
    sides = sides.astype(np.float32)
    ones, others = np.maximum(1, (sides > 0).sum(0)), np.maximum(1, (sides < 0).sum(0))
    weight = (np.where(sides > 0, 0.5 / ones, 0.5 / others) * np.abs(sides) * c).astype(np.float32)
    w = v = np.zeros((x.shape[1], sides.shape[1]), np.float32)
    rate = (1 / (1 + 4 * weight.sum(0))).astype(np.float32)
    for t in range(steps):
        miss = np.maximum(0, 1 - sides * (x @ v))
        new = v - rate * (v - 2 * (x.T @ (weight * miss * sides)))
        v = new + np.float32(t / (t + 3)) * (new - w)
        w = new
    return w[:-1].astype(np.float64), w[-1].astype(np.float64)


@dataclass
class LanguageModel:
    languages: list[str] = field(default_factory=list)
    families: list[list[int]] = field(default_factory=list)
    pairs: list[tuple[int, int]] = field(default_factory=list)
    weights: np.ndarray | None = None  # a row for each gram: families, then pairs
    bias: np.ndarray | None = None

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not LETTER.search(text):
            return "und", 0.0
        if len(self.languages) == 1:
            return self.languages[0], 1.0
        total, norm = np.zeros(self.weights.shape[1]), np.zeros(DIMS)
        data = text.encode()
        for part in chunks(data):
            norm += np.bincount(grams(part), minlength=DIMS)
        total = norm @ self.weights / np.sqrt((norm * norm).sum()) + self.bias
        margins, at = total[: len(self.families)], len(self.families)
        best = int(np.argmax(margins))
        rest = np.delete(margins, best)
        sure = 1 / (1 + np.exp(-2 * (margins[best] - rest.max()))) if len(rest) else 1.0
        own = self.families[best]
        if len(own) == 1:
            return self.languages[own[0]], float(sure)
        votes = {k: [0, 0.0] for k in own}
        for (a, b), m in zip(self.pairs, total[at:]):
            if a in votes:
                votes[a if m > 0 else b][0] += 1
                votes[a][1] += np.tanh(m)
                votes[b][1] -= np.tanh(m)
        chosen = max(own, key=lambda k: (*votes[k], -k))
        least = min(m if a == chosen else -m for (a, b), m in zip(self.pairs, total[at:]) if chosen in (a, b))
        return self.languages[chosen], float(sure / (1 + np.exp(-2 * least)))


def sample(docs: DataFrame, labelled: Column, per_language: int = PER_LANGUAGE) -> list:
    """(lang, (places, values)) of the bounded sample; features are worked out where the texts are and travel sparse."""
    rows = docs.filter(labelled & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("text") != ""))
    # Id and text together, so that rows of one id, or of none, are spread as others are.
    rows = rows.select("lang", "text", (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 2) / F.lit(2.0**62)).alias("h"))
    counts = materialize(rows.groupBy("lang").agg(F.countDistinct("h").alias("n")), "languages")
    languages = counts.count()
    if languages > MAX_LANGUAGES:
        raise ValueError(f"{languages} distinct labels; at most {MAX_LANGUAGES} languages can be learned")
    if not languages:
        return []
    each = max(2, min(per_language, MAX_SAMPLE // languages))
    # Of each language the rows of least hash, by a bound that lets a few more than needed through, whatever the table's size.
    share = F.least(F.lit(1.0), F.lit(each + 5 * each**0.5 + 5) / F.col("n")).alias("share")
    rows = rows.join(F.broadcast(counts.select("lang", share)), "lang")

    def run(batches):
        for b in batches:
            found = [features(t.as_py()) for t in b.column(2)]
            at = [np.flatnonzero(x) for x in found]
            packed = ([i.astype(np.uint16).tobytes() for i in at], [x[i].tobytes() for i, x in zip(at, found)])
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array(p, pa.binary()) for p in packed)], names=["lang", "h", "at", "x"])

    picked = rows.filter("h < share").groupBy("lang", (F.col("h") / F.col("share")).alias("h")).agg(F.first("text").alias("text"))
    found: dict[str, list] = {}
    for r in picked.mapInArrow(lean(run), "lang string, h double, at binary, x binary").orderBy("h", "lang").limit(max(3 * MAX_SAMPLE, 3 * each * languages)).toLocalIterator():
        if len(got := found.setdefault(r["lang"], [])) < each:
            got.append((np.frombuffer(r["at"], np.uint16), np.frombuffer(r["x"], np.float32)))
    return [(lang, x) for lang in sorted(found) for x in found[lang]]


def fit(docs: DataFrame, labelled: Column, families: dict[str, str] | None = None, per_language: int = PER_LANGUAGE) -> LanguageModel:
    """Fit family and pair classifiers; ``families`` maps language to family."""
    families = families or FAMILY_OF
    rows = sample(docs, labelled, per_language)
    languages = sorted({lang for lang, _ in rows})
    if len(languages) < 2:
        return LanguageModel(languages)
    x = np.zeros((len(rows), DIMS + 1), np.float32)
    x[:, DIMS] = 1
    for i, (_, (at, values)) in enumerate(rows):
        x[i, at] = values
    y = np.array([languages.index(lang) for lang, _ in rows])
    groups: dict[str, list[int]] = {}
    for i, lang in enumerate(languages):
        groups.setdefault(families.get(lang, f"only {lang}"), []).append(i)
    m = LanguageModel(languages, [groups[g] for g in sorted(groups)])
    m.pairs = [p for own in m.families for p in combinations(own, 2)]
    sides = [np.where(np.isin(y, own), 1, -1) if len(m.families) > 1 else np.zeros(len(y)) for own in m.families]
    sides += [(y == a).astype(int) - (y == b) for a, b in m.pairs]
    m.weights, m.bias = linear_svms(x, np.stack(sides, 1))
    return m


def predict(docs: DataFrame, model: LanguageModel, columns: list[str]) -> DataFrame:
    """``columns`` of every row with lang_pred and score; the model is of fixed size."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            found = [m.predict(t.as_py()) for t in b.column(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [*b.columns[:-1], pa.array([x for x, _ in found], pa.string()), pa.array([s for _, s in found], pa.float64())], names=[*columns, "lang_pred", "score"]
            )

    schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in columns)
    return docs.select(*columns, F.col("text").alias("_text")).mapInArrow(lean(run), f"{schema}, lang_pred string, score double")


def identify_documents(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learning from rows whose fold of 4 is not 2."""
    m = fit(docs, F.coalesce(fold("doc_id", 4), F.lit(0)) != 2)
    held = docs.select("doc_id", "text", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"))
    return predict(held, m, ["doc_id", "held_out"])
