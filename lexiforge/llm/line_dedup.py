"""Site-relative line frequency: lines that too many pages of a host share are boilerplate.

For every host, the pages that contain a line are divided by the host's pages;
a line over ``ratio``, on at least ``min_pages`` pages, is dropped from all
pages of that host. Built-in functions only. Lines travel as 64-bit hashes, one
for each page and distinct line, summed before the shuffle; the table of
boilerplate lines holds at most (mean lines per page / ratio) rows a host.

Two limits spare small hosts and whole pages, and both can be turned off: with
``min_pages=1`` the ratio alone decides on hosts of any size, and with
``keep_whole=False`` a page of boilerplate alone loses all its lines.

Defined results: blank lines are never boilerplate; with ``keep_whole`` a page
that would lose all its lines that aren't blank is left as it is, as a whole
page is no boilerplate of another (copies of whole pages are for the
near-duplicate operator); null and empty texts stay as they are; pages without a
host count as one host; a repeated row is a page of its own; a line counts once
a page; lines of equal share go or stay together; texts of any length are split
whole; columns n_lines and n_dropped that a table has are replaced, all others
are kept, whatever their names; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if, materialize

RATIO, MIN_PAGES, BROADCAST_HOSTS = 0.1, 10, 10_000


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _is_blank(line: Column) -> Column:
    return F.trim(F.translate(line, "\t\r\f\v", "    ")) == ""


def boilerplate(pages: DataFrame, ratio: float = RATIO, min_pages: int = MIN_PAGES) -> DataFrame:
    """(_host, _lines): hashes of each host's boilerplate lines. ``pages`` has _host and _text."""
    total = pages.groupBy("_host").agg(F.count("*").alias("_pages"))
    distinct = F.array_distinct(F.transform(F.filter(_lines(F.col("_text")), lambda x: ~_is_blank(x)), lambda x: F.xxhash64(x)))
    each = pages.select("_host", F.explode(distinct).alias("_line")).groupBy("_host", "_line").agg(F.count("*").alias("_on")).filter(F.col("_on") >= min_pages)
    over = each.join(total, "_host").filter(F.col("_on") > ratio * F.col("_pages"))
    return over.groupBy("_host").agg(F.array_sort(F.collect_list("_line")).alias("_drop"))


def drop_boilerplate(docs: DataFrame, host: Column, ratio: float = RATIO, min_pages: int = MIN_PAGES, keep_whole: bool = True) -> DataFrame:
    """``docs`` with text cleaned, and the columns n_lines and n_dropped (bigint) added."""
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), F.col("text").alias("_text"), F.coalesce(host.cast("string"), F.lit("\x00none")).alias("_host"))
    drop = materialize(boilerplate(keyed.select("_host", "_text"), ratio, min_pages), "boilerplate")
    joined = keyed.join(broadcast_if(drop, drop.count(), BROADCAST_HOSTS), "_host", "left")
    split = joined.withColumn("_all", F.when(F.col("_drop").isNotNull(), _lines(F.col("_text"))))
    rest = split.withColumn("_rest", F.filter("_all", lambda x: _is_blank(x) | ~F.array_contains(F.col("_drop"), F.xxhash64(x))))
    some = F.exists("_rest", lambda x: ~_is_blank(x))
    cut = F.coalesce(F.size("_rest") < F.size("_all"), F.lit(False)) & (F.coalesce(some, F.lit(False)) | F.lit(not keep_whole))
    cleaned = F.when(cut, F.array_join("_rest", "\n")).otherwise(F.col("_text"))
    return rest.select(
        *[(cleaned if c == "text" else F.col("_row").getField(c)).alias(c) for c in docs.columns if c not in ("n_lines", "n_dropped")],
        F.when(F.col("_text").isNull(), 0).otherwise(F.size(_lines(F.col("_text")))).cast("long").alias("n_lines"),
        F.when(cut, F.size("_all") - F.size("_rest")).otherwise(0).cast("long").alias("n_dropped"),
    )
