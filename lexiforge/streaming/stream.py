"""Queries as a stream of text lines: the batch operators, applied to each micro-batch.

Neither search nor correction keeps state between lines, so there is nothing to
watermark; the index and the models are static tables. Each line of a file has
its number, so the answers can be put in the order of the lines, and equal lines
are answered each.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boolean, correct

#: Query files of a micro-batch.
FILES = 100


def read_lines(spark: SparkSession, folder: str, files: int = FILES) -> DataFrame:
    """(file, line, text) of a folder of query files; lines count from 0, and what ends a file's last line starts no other."""
    whole = spark.readStream.option("maxFilesPerTrigger", files).text(folder, wholetext=True)
    lines = F.split(F.regexp_replace("value", r"\r?\n\z", ""), r"\r?\n", -1)
    return whole.select(F.col("_metadata.file_path").alias("file"), F.posexplode(lines).alias("line", "text"))


def _stream(lines: DataFrame, out: str, checkpoint: str, answer) -> None:
    def each(batch: DataFrame, batch_id: int) -> None:
        answer(batch).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    lines.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def search_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, postings: DataFrame, docs: DataFrame, files: int = FILES) -> None:
    """Answer all waiting query lines, then stop; rows (file, line, query, doc_id, error) are added to ``out``.

    Empty lines are skipped; a line without a match gives no row. The distinct lines of ``files`` files are parsed on the driver:
    they are queries, not data.
    """

    def answer(batch: DataFrame) -> DataFrame:
        queries = [r["text"] for r in batch.select("text").distinct().orderBy("text").collect()]
        found = boolean.search_batch(list(enumerate(queries)), postings, docs)
        names = batch.sparkSession.createDataFrame(list(enumerate(queries)), "qid long, query string")
        found = found.join(F.broadcast(names), "qid").select("query", "doc_id", "error")
        return batch.withColumnRenamed("text", "query").join(found, "query").select("file", "line", "query", "doc_id", "error")

    _stream(read_lines(spark, folder, files).filter("text <> ''"), out, checkpoint, answer)


def correct_stream(spark: SparkSession, folder: str, out: str, checkpoint: str, model: correct.Model, files: int = FILES) -> None:
    """Correct all waiting lines, then stop; one row (file, line, text, fixed) for each line, empty ones too, is added to ``out``."""

    def answer(batch: DataFrame) -> DataFrame:
        lines = batch.select(F.struct("file", "line").alias("qid"), "text")
        return correct.correct_queries(batch.sparkSession, lines, model).select("qid.*", "text", "fixed")

    _stream(read_lines(spark, folder, files), out, checkpoint, answer)
