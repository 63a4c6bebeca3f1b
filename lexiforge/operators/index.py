"""The inverted index: postings, posting lists, and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import index_terms
from ..plans.storage import shared_dir
from .codec import RANGE


def postings(docs: DataFrame) -> DataFrame:
    """(term, doc_id), each pair once: terms are made distinct within a document, so nothing is shuffled."""
    return docs.select(F.explode(index_terms(F.col("text"))).alias("term"), "doc_id")


def sorted_postings(docs: DataFrame) -> DataFrame:
    """Postings laid out for pruning: ranges of terms, sorted within files.

    Finding the ranges takes a sample first, so postings are written once before: texts are tokenized once.
    """
    spark = docs.sparkSession
    path, raw = shared_dir(spark, "raw-postings"), postings(docs)
    raw.write.parquet(path)
    return spark.read.schema(raw.schema).parquet(path).repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id")


def posting_lists(table: DataFrame) -> DataFrame:
    """(term, part, df, ids): a term's ascending ids of one range of RANGE ids, so no row grows without bound; df is that of the range."""
    return table.groupBy("term", F.floor(F.col("doc_id") / RANGE).alias("part")).agg(F.count("*").alias("df"), F.array_sort(F.collect_list("doc_id")).alias("ids"))


def document_frequency(table: DataFrame) -> DataFrame:
    return table.groupBy("term").agg(F.count("*").alias("df"))


def url_table(pages: DataFrame) -> DataFrame:
    """(page_id, line): the lines of a url file."""
    return pages.select("page_id", F.concat("url", F.lit("/")).alias("line"))
