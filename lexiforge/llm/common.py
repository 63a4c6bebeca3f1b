"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable

import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BYTE_BPE = "byte_bpe_50k.json"


def tokenizer_path(name: str = BYTE_BPE) -> str:
    """Where a public vocabulary file lies on this machine (the same on every worker)."""
    return public_tokenizers.path(name)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under the cluster's shared checkpoint folder, in a folder of this application that goes when it ends.

    That is spark.checkpoint.dir, or else the context's checkpoint folder. Only
    where neither is set and the master is local, as in tests, a temporary
    folder is made; on a cluster each executor would write to its own disk.
    """
    sc = spark.sparkContext
    top = getattr(sc, "_lexiforge_folder", None)
    if top is None:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="lexiforge-")
        top = sc._lexiforge_folder = f"{base.rstrip('/')}/lexiforge-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        path = sc._jvm.org.apache.hadoop.fs.Path(top)
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    path = f"{top}/{label}-{uuid.uuid4().hex}"
    made(spark).append(path)
    return path


def made(spark: SparkSession) -> list[str]:
    """The folder names given out by ``shared_dir``, in order."""
    sc = spark.sparkContext
    if not hasattr(sc, "_lexiforge_made"):
        sc._lexiforge_made = []
    return sc._lexiforge_made


def materialize(df: DataFrame, label: str, keep: list[str] | None = None) -> DataFrame:
    """Cut the lineage: write the rows as Parquet in the shared folder, read them back.

    ``keep`` collects the folder's name, for ``discard``.
    """
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    return spark.read.schema(df.schema).parquet(path)


def in_tasks(df: DataFrame, rows: int, each: int = 50_000) -> DataFrame:
    """As many partitions as ``rows`` rows need, at ``each`` a task: small tables of a loop aren't spread over all partitions."""
    return df.coalesce(max(4, -(-rows // each)))


def discard(spark: SparkSession, paths: list[str]) -> None:
    """Delete intermediate tables that no later plan reads."""
    jvm = spark.sparkContext._jvm
    for path in paths:
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    paths.clear()


def give_back() -> None:
    """Memory that this worker no longer uses goes back to the machine; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of glibc alone
    if trim:
        trim(0)


def lean(run: Callable) -> Callable:
    """A function of batches that leaves its worker small at its end."""

    def leaner(batches):
        yield from run(batches)
        give_back()

    return leaner


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def fold(doc_id, buckets: int):
    """crc32 of the id as text, modulo ``buckets``: the documented split of the rows."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % buckets


def broadcast_if(df: DataFrame, rows: int, most: int) -> DataFrame:
    """Hint a broadcast only for a side counted as small; beyond it the join shuffles."""
    return F.broadcast(df) if rows <= most else df
