"""The training-text pipeline: five stages over `documents`, each written and reread as the next one's input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tenderline.llm import decontaminate, language, lines, neardup, pieces
from tenderline.llm.storage import store

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Predicts each text's language, learning from the labelled rows; `lang` becomes the prediction.

    Texts that are null or hold no letter (`und`) go.
    """
    model = language.train(docs.select("text", "lang"))
    found = language.predict(docs, model, *COLUMNS[:2], *COLUMNS[3:])
    return found.where("lang_pred <> 'und'").withColumn("lang", F.col("lang_pred")).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Deletes later copies of repeated line runs; documents of which nothing but blank lines stays go."""
    clean = lines.dedup_lines(docs, maximal=True)
    return clean.where((F.col("n_removed") == 0) | (F.trim(F.translate("text", "\n\t\r", "   ")) != "")).withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies, that of the least doc_id; of rows with one doc_id and text, one.

    Different texts of one doc_id are documents of their own (ordered by hash); rows with a null doc_id are compared with nothing and all stay.
    """
    own = docs.where("doc_id is not null").withColumn("_h", F.xxhash64("text"))
    numbers = lines.dense_rank(own.select("doc_id", "_h").distinct(), ["doc_id", "_h"], "_n")
    rows = store(own.join(numbers, ["doc_id", "_h"]).select("_n", *COLUMNS).dropDuplicates(["_n"]), "numbered")
    found = store(neardup.near_duplicates(rows.select(F.col("_n").cast("long").alias("doc_id"), "text")).where("not kept").select(F.col("doc_id").alias("_n")).distinct(), "dropped")
    return rows.join(found, "_n", "left_anti").select(*COLUMNS).unionByName(docs.where("doc_id is null").select(*COLUMNS))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark window go, whatever their doc_id: rows are known by the hash of the text."""
    keyed = docs.withColumn("_h", F.xxhash64("text"))
    marked = decontaminate.contamination(keyed.select(F.col("_h").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    found = marked.where("contaminated").select(F.col("doc_id").alias("_h")).distinct()
    return keyed.join(found, "_h", "left_anti").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of each text, and whether they decode to it."""
    return pieces.digest(pieces.encode(docs))


STAGES = [("language ID", language_id), ("line dedup", line_dedup), ("MinHash near-dedup", near_dedup), ("benchmark decontamination", decontamination), ("SentencePiece encoding and decoding", tokens)]
#: Cross-parsing, MinHash and piece encoding are not SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of sf_dir."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = store(stage(spark, docs, sf_dir), "stage")
    return STAGES[-1][1](spark, docs, sf_dir)
