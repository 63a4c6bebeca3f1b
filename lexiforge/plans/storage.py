"""Tables that are written once in the cluster's shared folder and read many times by one application."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_tables: dict[tuple, str] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder under spark.checkpoint.dir or the context's checkpoint folder, in one of this application that goes when it ends.

    Only where neither is set and the master is local, as in tests, a temporary folder is made.
    """
    sc = spark.sparkContext
    key = (sc.applicationId, "folder")
    if key not in _tables:
        base = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
        if not base:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir isn't set: it has to name a folder that all executors share")
            base = tempfile.mkdtemp(prefix="lexiforge-")
        _tables[key] = f"{base.rstrip('/')}/lexiforge-core-{sc.applicationId}-{uuid.uuid4().hex[:8]}"
        path = sc._jvm.org.apache.hadoop.fs.Path(_tables[key])
        files = path.getFileSystem(sc._jsc.hadoopConfiguration())
        files.mkdirs(path)
        files.deleteOnExit(path)
    return f"{_tables[key]}/{label}-{uuid.uuid4().hex}"


def table(spark: SparkSession, label: str, source: str, build) -> DataFrame:
    """The table ``label`` of a source folder: built on first use in this application."""
    key = (spark.sparkContext.applicationId, label, source)
    if key not in _tables:
        path = shared_dir(spark, label)
        build().write.parquet(path)
        _tables[key] = path
    return spark.read.parquet(_tables[key])
