"""From raw documents to packed sequences.

Stages, each over all that the one before kept: language identification drops rejected
documents, the shingle join keeps one document of each near-duplicate group, substring
dedup cuts passages that occur earlier, decontamination drops documents that hold benchmark
windows, and best-fit packing places what is left. All stages but the last return the
columns of documents; each is written as Parquet and read again before the next.

Defined cases, as its operators state them: a null, empty or letterless text has no language
and goes with the first stage; a text in no single language goes too; of copies and near copies
the smallest doc_id stays, and beside it one of their rows without a doc_id; texts under one
doc_id are judged apart; a document all of whose words occur earlier goes; very long texts are
read whole and packed in pieces; an empty table gives no rows; other columns than doc_id, text,
lang and n_chars may have any names and stay as they are, n_chars follows the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from hostmill.llm import best_fit, decontaminate, ngram_join, substring_dedup, zstd_lang
from hostmill.llm.common import table, written


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return zstd_lang.drop_rejected(docs)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.keep_first(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return substring_dedup.remove(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return best_fit.place(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("substrings", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Compression, similarity components and packing have no SQL form; tests/llm/test_pipeline.py
#: holds each stage against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name)
    return docs
