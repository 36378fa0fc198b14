"""A corpus pipeline over ``documents``: quality, near-duplicates, repeated passages,
benchmark passages, then SentencePiece ids.

Each stage takes what the one before it kept and, but for the last, returns the columns of
``documents``; ``n_chars`` follows the text where a stage changes it.

In all stages a null text counts as empty, an empty or very long text is a row like any
other, and an empty table gives no rows. Columns that the tables have beside those named here
are kept, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from newsflow.llm.common import cut, free_name, quoted
from newsflow.llm.decontaminate import decontaminate
from newsflow.llm.near_dedup import near_dedup
from newsflow.llm.pieces import encode
from newsflow.llm.quality import CUT, score_quality, train
from newsflow.llm.queries import PIECE_BPE, table
from newsflow.llm.suffix_dedup import suffix_dedup


def _as(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """``changed`` with the columns of ``docs`` and code points counted anew."""
    return changed.select(
        *[
            F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else quoted(c)
            for c in docs.columns
        ]
    )


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject (score of at least ``CUT``).

    Only the text is scored: rows that repeat one, or an id, or have a null id, go by their own
    text. Without labels or documents to learn from every score is 0.5, and all stay.
    """
    model = train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "quality_score")
    return score_quality(docs, model, to=score).where(F.col(score) >= CUT).drop(score)


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: the one with the smallest id.

    Texts without words and null ids are like nothing and stay. Rows that repeat both id and
    text stay or go together; rows that share an id alone go by their own texts.
    """
    return near_dedup(docs)


def suffix_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages that a document with a smaller id holds.

    No row goes. Rows of one id, and rows with a null id, are as :func:`suffix_dedup` says.
    """
    return _as(docs, suffix_dedup(docs, replace=True))


def decontaminate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words covered by benchmark windows. No row goes; rows are independent
    of each other, and an empty benchmark changes nothing."""
    return _as(docs, decontaminate(docs, table(spark, sf_dir, "benchmark"), remove=True))


def sentencepiece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether decoding them gives the text back. Rows are independent
    of each other; a null or empty text has no ids and is exact."""
    rows = encode(docs.select("doc_id", "text"), PIECE_BPE, decoded="decoded")
    exact = F.col("decoded") == F.coalesce("text", F.lit(""))
    return rows.select("doc_id", "text", "ids", "n_tokens", "ids_crc32", exact.alias("exact"))


STAGES = [
    ("quality", quality_stage),
    ("near_dedup", near_dedup_stage),
    ("suffix_dedup", suffix_dedup_stage),
    ("decontaminate", decontaminate_stage),
    ("sentencepiece", sentencepiece_stage),
]

#: SQL cannot express the learnt and sampled stages; tests compare them with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read from what the one before it wrote."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
