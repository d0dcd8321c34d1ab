"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept; all but the last return the
columns of ``documents`` and drop any others, whatever their names.  Stages stand empty tables, which stay empty, null or
empty texts, null ids and repeated rows; each says what becomes of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import circulant_minhash, divergence, line_runs, mixing, packing
from quern.llm.common import Work
from quern.llm.queries import vocabulary

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go: by the base rules, or as text unlike their language's.

    A null or empty text has too few words and goes; repeated rows are judged alike; null is a language; a null id is kept
    or goes like any other.
    """
    return divergence.keep_good(docs).select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Shared lines go, but in the last document that holds them; ``n_chars`` follows the text.

    Every row stays, if need be with an empty text, which a null one becomes, too.  Rows that share an id are one
    document and keep or lose lines alike; rows without an id keep all.
    """
    cleaned = line_runs.dedup_lines(docs.select(*COLUMNS))
    return cleaned.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays, that of the smallest id (five words, similarity 0.8).

    Texts without words have no duplicates and stay, as do rows without an id; rows repeated under the id that stays
    all stay.
    """
    return circulant_minhash.keep_first(docs, size=5, percent=80).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated or thinned to their target weights.

    Null is a source of its own; rows with the same id are repeated alike; a row of a source without words goes.
    """
    return mixing.mix_documents(docs).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces with their places in sequences of 2048.

    A null or empty text is one piece, its end; repeated rows, as the mix makes them, are packed as often.
    """
    return packing.pack_documents(docs, vocabulary(), 2048)


STAGES = [
    ("quality_rules", quality_rules), ("line_dedup", line_dedup), ("near_dedup", near_dedup), ("mix", mix), ("pack", pack),
]

#: Tokenizing and near-duplicate components are beyond SQL; tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each stage's result is written to the shared folder and read again."""
    work = Work(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = work.save(docs, name)
            if k:
                work.drop(STAGES[k - 1][0])  # the next stage's table stands
    return docs
