"""Corpus pipeline: quality rules, near duplicates, benchmark
decontamination, secret scans, SentencePiece encoding.

Each stage takes (spark, docs, sf_dir), works on everything that its
predecessor kept, and returns a DataFrame; ``run`` writes each result as
Parquet to the shared scratch folder and rereads it as the next one's
``docs``.  All stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from coverlake.llm.common import importable, read, stored
from coverlake.llm.decontaminate import drop_leaks
from coverlake.llm.near_copies import drop_near_copies
from coverlake.llm.pieces import encode_column
from coverlake.llm.quality import filter_quality
from coverlake.llm.secrets import redact_secrets


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the base or the adaptive rules reject go."""
    importable(spark)
    return filter_quality(docs)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    importable(spark)
    return drop_near_copies(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a passage of the benchmark go."""
    importable(spark)
    return drop_leaks(docs, read(spark, sf_dir, "benchmark"))


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets in the texts are replaced; every document stays."""
    importable(spark)
    return redact_secrets(docs)


def piece_encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without their text, with its piece ids."""
    importable(spark)
    return encode_column(docs).drop("text")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_copies", near_copies),
    ("decontamination", decontamination),
    ("secret_scan", secret_scan),
    ("piece_encoding", piece_encoding),
]

ORACLE_SQL = None
"""The alignment, the automata and the pieces have no counterpart in SQL;
the pipeline is tested against a brute-force version."""


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
