"""A corpus pipeline over ``documents``: language ID, near-duplicates, benchmark passages, secrets, packing.

Each stage takes (spark, docs, sf_dir) and returns a table; all but the last return the columns of ``documents``. The
driver writes each stage's table and gives it to the next one; :func:`run` does the same in the shared folder.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpuskin.llm.decontaminate import drop_contaminated
from corpuskin.llm.langid import fit_language_model, keep_known_languages
from corpuskin.llm.packing import pack
from corpuskin.llm.secrets import mask_secrets
from corpuskin.llm.simhash import drop_near_duplicates
from corpuskin.plans.shared import materialize


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language the model knows; those that it rejects go."""
    return keep_known_languages(docs, fit_language_model(docs))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each group of near copies: the one with the smallest id. Shingles have five words."""
    return drop_near_duplicates(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a window of a benchmark item occurs."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts; all documents stay. ``n_chars`` follows the text."""
    return mask_secrets(docs, length="n_chars")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Places the documents' tokens in sequences: a row per piece."""
    return pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("simhash_near_dedup", near_dedup),
    ("benchmark_decontamination", decontaminate),
    ("secret_scan", mask),
    ("best_fit_packing", packing),
]

#: Language ID and packing learn and solve: SQL can't express them. Tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
