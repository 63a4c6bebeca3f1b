"""Index and models in folders of their own: built once by one application, opened by any other.

An index folder holds the postings by term, the same as Simple9 blobs, the ids
of all documents and the URL table; a model folder holds the language model, the
edit costs, the trie and, if there is one, the trained gate.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession

from ..operators import codec, correct, gate, index


@dataclass
class Index:
    postings: DataFrame  # (term, doc_id), sorted within files
    blobs: DataFrame  # (term, part, n, words)
    ids: DataFrame  # (doc_id)
    urls: DataFrame  # (doc_id, url)


def save_index(docs: DataFrame, urls: DataFrame, folder: str) -> None:
    """Writes the index of docs (doc_id, text) and their urls (doc_id, url); what the folder held is replaced."""
    index.sorted_postings(docs).write.mode("overwrite").parquet(f"{folder}/postings")
    written = docs.sparkSession.read.parquet(f"{folder}/postings")
    codec.blocks(written).write.mode("overwrite").parquet(f"{folder}/blobs")
    docs.select("doc_id").write.mode("overwrite").parquet(f"{folder}/ids")
    urls.select("doc_id", "url").write.mode("overwrite").parquet(f"{folder}/urls")


def load_index(spark: SparkSession, folder: str) -> Index:
    return Index(*(spark.read.parquet(f"{folder}/{name}") for name in ("postings", "blobs", "ids", "urls")))


@dataclass
class Models:
    unigrams: DataFrame
    bigrams: DataFrame
    costs: DataFrame
    contexts: DataFrame
    trie: DataFrame
    gate: PipelineModel | None = None

    def collected(self) -> correct.Model:
        """What the correction loop uses, with the gate if one was saved."""
        m = correct.collect_model(self.unigrams, self.bigrams, self.costs, self.contexts, self.trie)
        m.gate = gate.inline_gate(self.gate) if self.gate else None
        return m


TABLES = ["unigrams", "bigrams", "costs", "contexts", "trie"]


def save_models(models: Models, folder: str) -> None:
    for name in TABLES:
        getattr(models, name).write.mode("overwrite").parquet(f"{folder}/{name}")
    if models.gate is not None:
        models.gate.write().overwrite().save(f"{folder}/gate")


def load_models(spark: SparkSession, folder: str) -> Models:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{folder}/gate")
    gated = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
    return Models(*(spark.read.parquet(f"{folder}/{name}") for name in TABLES), gate=PipelineModel.load(f"{folder}/gate") if gated else None)
