"""Query logs: lines of one column (a right query) or two (a wrong one and the right one).

Of lines with more columns the first one is an example that needs no fix, and the middle one counts as the right query.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.layout import CYRILLIC, LATIN


def read_log(spark: SparkSession, path: str) -> DataFrame:
    """(wrong, right, ncols) of a log file."""
    return parse_lines(spark.read.text(path))


def parse_lines(lines: DataFrame) -> DataFrame:
    cols = F.split("value", "\t")
    n = F.size(cols)
    return lines.select(F.when(n >= 2, cols[0]).alias("wrong"), F.element_at(cols, (F.floor(n / 2) + 1).cast("int")).alias("right"), n.alias("ncols"))


def labelled(log: DataFrame) -> DataFrame:
    """(qid, text, need_fix), lower-cased: of lines of two columns the first needs a fix and the second none; of others the first column needs none."""
    both = F.when(F.col("ncols") == 2, F.array(F.struct(F.lower("wrong").alias("text"), F.lit(1).alias("need_fix")), F.struct(F.lower("right").alias("text"), F.lit(0).alias("need_fix"))))
    one = F.array(F.struct(F.lower(F.coalesce("wrong", "right")).alias("text"), F.lit(0).alias("need_fix")))
    return log.select("qid", F.explode(F.coalesce(both, one)).alias("x")).select("qid", "x.text", "x.need_fix")


def sql_literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


#: How a wrong query follows from a part's key and name, in SQL that Spark and DuckDB read alike.
WRONG_SQL = """
case p_partkey % 6
  when 1 then substr(p_name, 1, pos - 1) || substr(p_name, pos + 1)
  when 2 then substr(p_name, 1, pos - 1) || 'x' || substr(p_name, pos + 1)
  when 3 then substr(p_name, 1, pos) || substr(p_name, pos)
  when 4 then {swap}
  when 5 then replace(p_name, ' ', '')
end
"""


def log_of_parts(part: DataFrame) -> DataFrame:
    """(qid, wrong, right, ncols): a log derived from part names."""
    pos = (1 + F.col("p_partkey") % F.length("p_name")).cast("int")
    base = part.select("p_partkey", "p_name", pos.alias("pos"))
    kinds: dict[int, Column] = {
        1: F.expr("substr(p_name, 1, pos - 1) || substr(p_name, pos + 1)"),
        2: F.expr("substr(p_name, 1, pos - 1) || 'x' || substr(p_name, pos + 1)"),
        3: F.expr("substr(p_name, 1, pos) || substr(p_name, pos)"),
        4: F.translate("p_name", LATIN, CYRILLIC),
        5: F.expr("replace(p_name, ' ', '')"),
    }
    wrong = F.lit(None).cast("string")
    for k, c in kinds.items():
        wrong = F.when(F.col("p_partkey") % 6 == k, c).otherwise(wrong)
    out = base.select(F.col("p_partkey").alias("qid"), wrong.alias("wrong"), F.col("p_name").alias("right"))
    return out.withColumn("ncols", F.when(F.col("wrong").isNull(), 1).otherwise(2))


LOG_SQL = f"""
log as (
  select p_partkey qid, {WRONG_SQL.format(swap=f"translate(p_name, {sql_literal(LATIN)}, {sql_literal(CYRILLIC)})")} wrong, p_name as right_q
  from (select p_partkey, p_name, (1 + p_partkey % length(p_name))::int pos from part))
"""
