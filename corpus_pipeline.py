"""The corpus pipeline: language identification, near-duplicates, repeated passages, benchmark leaks, packing.

Every stage takes all rows its predecessor kept and works on whole texts. Rows repeated under one id stay or go
together until the passage stage, which empties all but one of them. Stages are written to the shared checkpoint
folder and read again, so a lost executor costs at most the stage under way.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import decontaminate, langid, packing, simhash, substrings
from tessera.llm.common import load, split_column
from tessera.llm.components import ensure_checkpoints, removed

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")

#: No SQL expresses the suffix arrays or the tokenizer; the stages are tested against brute force.
ORACLE_SQL = None


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a nameable language: null texts and texts without a letter.

    The model rejects nothing else: a text with a letter is given the likeliest learned language, however low its
    score, so lettered junk and languages outside the labels stay. Only a table that teaches no language loses all rows.
    """
    model = langid.fit(docs.where(split_column(F.col("doc_id"), 5) != 0))
    return langid.accepted(docs, model).select(*COLUMNS)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest id of each component of near-duplicates; nulls count as an id."""
    first = simhash.classes(docs).where("doc_id <=> component_id").select(F.col("doc_id").alias("first_id")).distinct()
    return docs.join(first.hint("merge"), docs["doc_id"].eqNullSafe(first["first_id"]), "left_semi").select(*COLUMNS)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 100 bytes or more that also stand earlier; a document left without a word goes.

    Bytes of characters that a cut breaks are dropped too; n_chars counts the text that is left.
    """
    rows = substrings.repeated(docs, carry=("lang", "source"), texts_out=("kept_text",))
    left = rows.select("doc_id", F.col("kept_text").alias("text"), "carried.lang", "carried.source")
    worded = F.length(F.translate("text", " \t\n\x0b\x0c\r", "")) > 0
    return left.where(worded).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold at least four fifths of the shingles of a benchmark item; nulls count as an id, rows of one id go together.

    Null and blank texts and items match nothing; without items, or without documents, all that is there stays.
    """
    leaks = decontaminate.contaminated(docs, load(spark, sf_dir, "benchmark")).select(F.col("doc_id").alias("leak_id")).distinct()
    return docs.join(leaks.hint("merge"), docs["doc_id"].eqNullSafe(leaks["leak_id"]), "left_anti").select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences of 2048 tokens; null texts and ids and repeated rows are documents like any other, an empty table gives no piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", language),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_leaks", benchmark_leaks),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to the documents of sf_dir; the last stage's rows are returned, and what came before is deleted."""
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs, last = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        if last:
            removed(spark, last)
        last = f"{folder}/{name}"
    return docs
