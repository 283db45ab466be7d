"""The corpus pipeline: quality, exact copies, near copies, packing.

``STAGES`` lists its stages; each takes ``(spark, docs, sf_dir)``, works on all rows that the stage before kept, and
returns a DataFrame. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.llm import exact_dedup, packing, quality, simhash
from lumberline.llm.queries import WORD_FILE, table, tokenizer_path
from lumberline.llm.store import written


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier takes for good; it learns from the labels that are not held out."""
    learnt = ~quality.in_fold("doc_id", 3, 1)
    known = quality.known_labels(table(spark, sf_dir, "labels"), "quality", learnt)
    name = "quality"
    while name in docs.columns:
        name += "_"
    scored = quality.score(docs, quality.train(docs, known), name=name)
    return scored.where(F.col(name) >= 0.5).drop(name)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts: the one of the largest id."""
    return exact_dedup.drop_copies(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of fingerprints that differ in at most three bits: the one of the least id."""
    return simhash.keep_one(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of full sequences of 2048 ids, each document with the id 1 after it."""
    return packing.piece_rows(packing.pack(docs, tokenizer_path(WORD_FILE), end_id=1))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("exact_dedup", drop_exact_copies),
    ("simhash_near_dedup", drop_near_copies),
    ("packing", pack_sequences),
]

# A trained classifier decides what is kept, which SQL can't express.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
