"""The gate: a classifier that says whether a query needs a fix at all."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Vectors
from pyspark.ml.feature import IDF, CountVectorizer, ElementwiseProduct, Normalizer, RegexTokenizer, VectorAssembler
from pyspark.mllib.linalg.distributed import RowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.storage import shared_dir

COLUMNS = ["prob", "n_chars", "n_words", "n_other", "n_known"]
#: The probability of being fine from which a text is left alone, and the rounds of boosting.
THRESHOLD, ROUNDS = 0.995, 150


def balanced(rows: DataFrame, label: str = "need_fix", seed: int = 7) -> DataFrame:
    """Both labels about equally often: rows of the rarer one are repeated, the odd copy drawn by a hash of the row, so a lost task gives the same rows again."""
    n = {r[label]: r["count"] for r in rows.groupBy(label).count().collect()}
    if len(n) < 2:
        return rows
    rare = min(n, key=n.get)
    times = max(n.values()) / n[rare]
    odd = F.pmod(F.xxhash64(*rows.columns, F.lit(seed)), F.lit(1 << 20)) < int((times - int(times)) * (1 << 20))
    copies = F.lit(int(times)) + odd.cast("int")
    again = rows.filter(F.col(label) == rare).withColumn("_copy", F.explode(F.sequence(F.lit(1), copies))).drop("_copy")
    return rows.filter(F.col(label) != rare).unionByName(again)


def folds(rows: DataFrame, k: int, key: str = "qid"):
    """(train, test) of each of k folds."""
    fold = F.pmod(F.xxhash64(key), F.lit(k))
    for i in range(k):
        yield balanced(rows.filter(fold != i)), rows.filter(fold == i)


def train(features: DataFrame, rounds: int = ROUNDS):
    """Boosted trees over the five features; ``features`` has need_fix."""
    return Pipeline(stages=[VectorAssembler(inputCols=COLUMNS, outputCol="features"), GBTClassifier(labelCol="need_fix", maxIter=rounds, maxDepth=3, seed=1)]).fit(balanced(features))


def f1_of_folds(features: DataFrame, k: int = 5, rounds: int = ROUNDS, columns: list[str] | None = None) -> DataFrame:
    """(fold, f1): each fold's F1 of need_fix by trees trained on the others, which are balanced; on five features or the given columns."""
    out = []
    for i, (rest, own) in enumerate(folds(features, k)):
        stages = [VectorAssembler(inputCols=columns or COLUMNS, outputCol="features"), GBTClassifier(labelCol="need_fix", maxIter=rounds, maxDepth=3, seed=1)]
        found = Pipeline(stages=stages).fit(rest).transform(own)
        hit, said, is_so = (F.sum((F.col(c).cast("int")) if isinstance(c, str) else c.cast("int")) for c in ((F.col("prediction") == 1) & (F.col("need_fix") == 1), F.col("prediction") == 1, F.col("need_fix") == 1))
        r = found.agg(hit.alias("h"), said.alias("s"), is_so.alias("t")).first()
        out.append((i, 2 * (r["h"] or 0) / max(1, (r["s"] or 0) + (r["t"] or 0))))
    return features.sparkSession.createDataFrame(out, "fold int, f1 double")


def predict(model, features: DataFrame) -> DataFrame:
    """(qid, p_fine, fine)."""
    p = F.element_at(vector_to_array("probability"), 1)
    return model.transform(features).select("qid", p.alias("p_fine"), (p >= THRESHOLD).alias("fine"))


@dataclass
class InlineGate:
    """The trained trees as a plain function, for use inside the correction loop: whether P(fine) reaches the threshold.

    A node is a value, or (feature, threshold, node at or below it, node above).
    """

    trees: list
    weights: list[float]
    threshold: float = THRESHOLD

    def p_fine(self, x: list[float]) -> float:
        margin = 0.0
        for node, weight in zip(self.trees, self.weights):
            while isinstance(node, tuple):
                node = node[2] if x[node[0]] <= node[1] else node[3]
            margin += weight * node
        return 1 / (1 + math.exp(max(-500.0, min(500.0, 2 * margin))))

    def __call__(self, x: list[float]) -> bool:
        return self.p_fine(x) >= self.threshold


def inline_gate(model, threshold: float = THRESHOLD) -> InlineGate:
    """A model of ``train`` as a plain function of the five features."""

    def plain(node):
        if node.getClass().getSimpleName() == "LeafNode":
            return node.prediction()
        return node.split().featureIndex(), node.split().threshold(), plain(node.leftChild()), plain(node.rightChild())

    boosted = model.stages[-1]
    return InlineGate([plain(t._java_obj.rootNode()) for t in boosted.trees], list(boosted.treeWeights), threshold)


def tfidf(texts: DataFrame, vocabulary: int | None = None):
    """(model, qid and tf-idf vectors of length 1) of texts (qid, text); all words of two characters or more count unless ``vocabulary`` bounds them.

    The inverse document frequency is log((1 + n) / (1 + df)) + 1, so words of all texts count too.
    """
    words = RegexTokenizer(inputCol="text", outputCol="words", pattern=r"[\p{L}\p{N}_]{2,}", gaps=False)
    if vocabulary is None:
        vocabulary = max(1, words.transform(texts).select(F.explode("words").alias("word")).distinct().count())
    counted = Pipeline(stages=[words, CountVectorizer(inputCol="words", outputCol="tf", vocabSize=vocabulary), IDF(inputCol="tf", outputCol="_idf")]).fit(texts)
    weights = ElementwiseProduct(inputCol="tf", outputCol="weighted", scalingVec=Vectors.dense(counted.stages[2].idf.toArray() + 1))
    model = PipelineModel([*counted.stages[:2], weights, Normalizer(inputCol="weighted", outputCol="vector")])
    return model, model.transform(texts).select("qid", "vector")


def _decomposed(vectors: DataFrame, k: int):
    """The singular value decomposition. Its rounds read the rows again and again, so they are written first; all of it stays JVM-side."""
    spark = vectors.sparkSession
    path = shared_dir(spark, "vectors")
    vectors.select("vector").write.parquet(path)
    m = RowMatrix(MLUtils.convertVectorColumnsFromML(spark.read.schema(vectors.select("vector").schema).parquet(path), "vector"))
    return m.computeSVD(min(k, m.numCols()), computeU=False)


def svd(vectors: DataFrame, k: int = 15) -> DataFrame:
    """(component, singular_value), descending: at most k of the distributed matrix."""
    s = _decomposed(vectors, k).s.toArray().tolist()
    return vectors.sparkSession.createDataFrame([(i, v) for i, v in enumerate(s)], "component int, singular_value double")


def projected(vectors: DataFrame, k: int = 15) -> DataFrame:
    """(qid, c0, c1, ...): each row of vectors (qid, vector) on the first k right singular vectors, a matrix of words by k that is broadcast."""
    found = _decomposed(vectors, k)
    shared = vectors.sparkSession.sparkContext.broadcast(found.V.toArray())
    names = [f"c{i}" for i in range(shared.value.shape[1])]

    def run(frames):
        for df in frames:
            out = [np.asarray(values) @ shared.value[np.asarray(at, int)] for at, values in zip(df["at"], df["values"])]
            yield pd.DataFrame([(q, *x.tolist()) for q, x in zip(df["qid"], out)], columns=["qid", *names])

    kind = vectors.schema["qid"].dataType.simpleString()
    parts = vectors.select("qid", F.unwrap_udt("vector").alias("v")).select("qid", F.col("v.indices").alias("at"), F.col("v.values").alias("values"))
    return parts.mapInPandas(run, ", ".join([f"qid {kind}", *(f"{c} double" for c in names)]))
