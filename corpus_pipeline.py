"""The corpus pipeline: language ID, line dedup, near-dedup, decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each stage's rows as Parquet under the
session's checkpoint folder, reads them again for the next, and then removes what the stage and the one before it left there. All
stages but the last return the columns of documents; the last returns the chosen documents with how often each is to be repeated.

Defined results: a null text, or one without a letter, goes with the first stage, and so do all texts where none is labelled; a text
that line dedup empties goes with it, since all of it stands earlier; rows without a doc_id are never taken for near copies; rows that
share a doc_id are one document for near-dedup and are judged by their own texts elsewhere; an empty table gives an empty table;
columns of the documents table besides the five of COLUMNS are left behind by run(), and kept by a stage that is given them.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from passagelens.llm.common import discard, hinted, kept_columns, mark, remove, settled, shared_folder, small_batches, table, train_row
from passagelens.llm.decontaminate import decontaminate
from passagelens.llm.language_id import classified, learn_languages
from passagelens.llm.line_dedup import dedup_lines
from passagelens.llm.minhash_forest import near_duplicates
from passagelens.llm.pareto_mix import pareto_mix

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is not rejected."""
    model = learn_languages(docs.where(train_row(F.col("doc_id"))).select("doc_id", "text", "lang"))
    judged = classified(docs.select("text", kept_columns(docs).alias("own")), model)
    return judged.where(~F.col("rejected")).select("own.*")


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated runs, and without those of which nothing is left; n_chars follows the text."""
    out = dedup_lines(docs.select("doc_id", "text", kept_columns(docs).alias("own")))
    n_chars = F.when(F.col("n_deleted") > 0, F.length("text").cast("long")).otherwise(F.col("own.n_chars"))
    left = out.where((F.col("n_deleted") == 0) | (F.col("text") != ""))
    return left.select(F.col("own").withField("text", F.col("text")).withField("n_chars", n_chars).alias("own")).select("own.*")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group. The ids to drop are a table of one column: while that is counted to be small, no text is shuffled."""
    gone = near_duplicates(docs.select("doc_id", "text")).where("NOT kept AND doc_id IS NOT NULL").select("doc_id").distinct()
    return docs.join(hinted(settled(gone)), "doc_id", "left_anti").select(*docs.columns)


def drop_benchmark_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated."""
    judged = decontaminate(docs.select("doc_id", "text", kept_columns(docs).alias("own")), table(spark, sf_dir, "benchmark"))
    return judged.where(~F.col("contaminated")).select("own.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with the number of copies and the words taken."""
    return pareto_mix(docs).where("taken > 0")


STAGES = [
    ("language ID", identify_language),
    ("line dedup", drop_repeated_lines),
    ("MinHash near-dedup", drop_near_duplicates),
    ("benchmark decontamination", drop_benchmark_copies),
    ("mixing sources", mix_sources),
]

#: SQL can't express compression by dictionaries, so there is none; tests hold each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder, before, since = shared_folder(spark), None, mark()
    docs = table(spark, sf_dir, "documents").select(*COLUMNS)
    for number, (_, stage) in enumerate(STAGES):
        path = f"{folder}/pipeline-{uuid.uuid4().hex}-{number}"
        with small_batches(spark):  # stages may end in Python workers that read whole texts
            stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        discard(spark, since)
        if before is not None:
            remove(spark, before)
        before = path
    return docs
