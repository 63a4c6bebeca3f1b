"""The corpus pipeline: language ID, line dedup, near-dedup, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows its predecessor
kept; ``run`` writes each stage's rows as Parquet in the shared folder and reads
them back as the next one's documents. What a stage has written on the way goes
when its rows are written.

Defined results of all stages: columns other than those of documents are
ignored, whatever their names; any column may be null; an empty table gives no
rows; texts of any length are read whole. Each stage says below what it does
with null and empty texts, repeated rows and ties.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lexiforge.llm import langid, line_dedup, minhash, packing
from lexiforge.llm.common import broadcast_if, discard, made, materialize, read

MOST_MARKS = 200_000
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark, docs, sf_dir):
    """Learns from every labelled row of its input; documents of no language (``und``) go, whether or not any row is labelled.

    Those are null and empty texts and texts without a letter. Every other row stays, repeated ones too, whatever its score;
    a tie between languages is settled by their names, so equal texts get one decision.
    """
    docs = docs.select(*COLUMNS)
    model = langid.fit(docs, F.lit(True))
    if not model.languages:
        model = langid.LanguageModel(["any"])  # nothing was learned, so the text alone decides
    found = langid.predict(docs, model, COLUMNS)
    return found.filter("lang_pred <> 'und'").select(*COLUMNS)


def site_lines(spark, docs, sf_dir):
    """Drops boilerplate lines of each source; n_chars follows the text.

    Every row stays. Null and empty texts stay as they are; rows without a source count as one site; a repeated row counts as a
    page of its own; lines of equal share go or stay together.
    """
    cleaned = line_dedup.drop_boilerplate(docs.select(*COLUMNS), F.col("source"))
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.withColumn("n_chars", chars).select(*COLUMNS)


def near_duplicates(spark, docs, sf_dir):
    """Of each group of near duplicates (five words, similarity 0.8) one row stays.

    It is the row of least id, null ids last; of several texts of that id the one of least hash; of rows of the same id and text
    the one of least lang, source and n_chars. Rows are judged by id and text, so no row goes for another that shares its id.
    Null texts and those without words are in no group and stay.
    """
    docs = docs.select(*COLUMNS)
    rows = minhash.groups(docs, percent=80, shingle=5).filter("n_shingles > 0")
    stays = F.col("doc_id").eqNullSafe(F.col("first.doc_id")) & (F.col("th") == F.col("first.th"))
    marks = rows.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), stays.alias("_stays"))
    marks = marks.groupBy("_id", "_th", "_stays").agg(F.count("*").alias("_times")).filter("not _stays or _times > 1").drop("_times")
    marks = materialize(marks, "marks")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th"))
    marks = broadcast_if(marks, marks.count(), MOST_MARKS)  # else all texts are shuffled
    out = docs.join(marks, same, "left_anti")
    repeated = marks.filter("_stays")
    if not repeated.isEmpty():
        rest = [c for c in COLUMNS if c not in ("doc_id", "text")]
        one = docs.join(repeated, same, "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(*rest)).alias("_rest"))
        out = out.unionByName(one.select("doc_id", "text", "_rest.*"))
    return out.select(*COLUMNS)


def pack(spark, docs, sf_dir):
    """Packs what is left into windows of 2048 tokens; null and empty texts are their end alone, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [("language_id", language_id), ("line_dedup", site_lines), ("near_dedup", near_duplicates), ("packing", pack)]

#: Tokenizing and packing can't be expressed in SQL.
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        own = len(made(spark))
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        last = made(spark)[-1]
        discard(spark, [p for p in made(spark)[own:] if p != last])
    return docs
