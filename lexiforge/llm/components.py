"""Connected components of a distributed edge list, by alternating star contraction.

Large-star hangs each node's larger neighbours on its least one; small-star does
the same with its smaller neighbours (Kiveris et al., 2014). Edges always lead
from the larger node to the smaller, so large-star is a join of each edge's
smaller end with that node's least neighbour. Only a root, the node that all of a
component hangs on in the end, has many edges to it; the table it is joined with
is written first, so Spark can split a hot root's edges over tasks. No edge
comes to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from .common import discard, in_tasks, materialize


def _written(edges: DataFrame, paths: list[str]) -> tuple[DataFrame, tuple]:
    """The edges written, with their number and a sum of hashes that tells whether a round has changed them."""
    seen = Observation()
    h = F.xxhash64("a", "b").bitwiseAND(F.lit((1 << 40) - 1))
    table = materialize(edges.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(h).alias("h")), "edges", paths)
    return table, (seen.get["n"], seen.get["h"])


def components(edges: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """(node, label): the least node that each node of the edges (a, b; longs) can reach.

    ``keep`` collects the names of the folders that the result reads.
    """
    edges = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    paths: list[str] = []
    e, state = _written(edges, paths)
    before = None
    while state != before and state[0]:
        old, before, rows = paths, state, state[0]
        paths = []
        least = materialize(in_tasks(e.groupBy("a").agg(F.min("b").alias("m")), rows), "least", old)
        large = e.join(least.withColumnRenamed("a", "b"), "b", "left").select("a", F.coalesce("m", "b").alias("b"))
        small = in_tasks(large, rows).withColumn("m", F.min("b").over(Window.partitionBy("a")))
        small = small.select(F.when(F.col("b") == F.col("m"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("m").alias("b"))
        e, state = _written(in_tasks(small.distinct(), rows), paths)
        discard(e.sparkSession, old)
    if keep is not None:
        keep += paths
    return e.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(e.select(F.col("b").alias("node"), F.col("b").alias("label")).distinct())
