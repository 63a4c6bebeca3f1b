"""Crawl archives: gzip files of length-prefixed records, whose parts are set apart by \\x1a."""

from __future__ import annotations

import gzip
import io
import struct

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_text, extract_url
from ..plans.storage import shared_dir


def records(data: bytes):
    """The parts of each record; parts under two characters are dropped."""
    with gzip.open(io.BytesIO(data)) as f:
        while len(head := f.read(4)) == 4:
            (size,) = struct.unpack("=i", head)
            text = f.read(size).decode("utf-8", "ignore")
            yield [p for p in text.split("\x1a") if len(p) >= 2]


def write_records(items: list[tuple[str, str]]) -> bytes:
    """An archive of (header, text) items."""
    out = io.BytesIO()
    with gzip.GzipFile(fileobj=out, mode="wb", mtime=0) as f:
        for header, text in items:
            data = f"{header}\x1a{text}".encode()
            f.write(struct.pack("=i", len(data)) + data)
    return out.getvalue()


def read_crawl(spark: SparkSession, paths: list[str]) -> DataFrame:
    """(doc_id, url, text, path): archives in the order given, folders in the order of their names.

    A path given twice counts twice. Ids are dense, from the counts of records per file. Archives are decoded once: their records
    are written in the shared folder, as their number must be known before the first id is given. An archive is a row of Spark's
    binary reader, which takes files of up to 2 GB.
    """
    files = spark.read.format("binaryFile").load(sorted(set(paths)))

    def run(batches):
        for b in batches:
            for path, data in zip(b.column(0).to_pylist(), b.column(1)):
                rows = []
                for i, parts in enumerate(records(data.as_py())):
                    rows.append((path, i, *(parts + [None, None])[:2]))
                    if len(rows) == 1000:
                        yield _batch(rows)
                        rows = []
                yield _batch(rows)

    def _batch(rows):
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int64(), pa.string(), pa.string()))], names=["path", "rec_no", "header", "body"])

    found = files.select("path", "content").mapInArrow(run, "path string, rec_no long, header string, body string")
    written = shared_dir(spark, "records")
    found.write.parquet(written)
    found = spark.read.schema(found.schema).parquet(written)
    bare = F.regexp_replace("path", "^file:/+", "/")
    order = spark.createDataFrame([(i, p.removeprefix("file://").rstrip("/")) for i, p in enumerate(paths)], "file_order int, given string")
    counts = files.select("path").join(F.broadcast(order), (bare == F.col("given")) | bare.startswith(F.concat("given", F.lit("/"))))
    sizes = found.groupBy("path").agg(F.count("*").alias("n"))
    # One row for each file: the ordered sum is over files, not over records.
    starts = counts.join(sizes, "path").select("path", "file_order", F.coalesce(F.sum("n").over(Window.orderBy("file_order", "path").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("start"))
    return found.join(starts, "path").select(
        (F.col("start") + F.col("rec_no")).alias("doc_id"), extract_url(F.col("header")).alias("url"), F.coalesce(clean_text(F.col("body")), F.lit("")).alias("text"), "path"
    )
