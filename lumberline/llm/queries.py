"""The registered queries of the operators: each applies one to its whole table and derives the columns to compare."""

from __future__ import annotations

import zlib
from collections.abc import Callable
from functools import partial

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.llm import (
    exact_dedup,
    language_model,
    mixing,
    packing,
    periodic_runs,
    pieces,
    preference,
    quality,
    simhash,
    source_terms,
    token_files,
    topk,
    warc,
)
from lumberline.llm.store import ship_package

WORD_FILE, PIECE_FILE = "word_bpe_49k.json", "piece_bpe_32k.model"


def tokenizer_path(name: str) -> str:
    """The place of a public tokenizer file; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, for executors that have this package."""
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    held_out = quality.in_fold("doc_id", 3, 1)
    known = quality.known_labels(table(spark, sf_dir, "labels"), "quality", ~held_out)
    scored = quality.score(docs.select("doc_id", "text"), quality.train(docs, known))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", held_out.alias("held_out"), "score", predicted.alias("predicted"))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode, write coded files, read them back."""
    files = token_files.token_files(table(spark, sf_dir, "documents"), tokenizer_path(WORD_FILE), end_id=2)
    return token_files.read_token_files(files).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op3_piece_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of the piece model and the text decoded from them, as digests."""
    both = pieces.encode_and_decode(table(spark, sf_dir, "documents"), tokenizer_path(PIECE_FILE))
    return both.select(
        "doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which document stays of each group of equal texts."""
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents"), hash_all=True)


def op5_seekable_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Write the pages to bundles and read the bundles."""
    return warc.read_archives(warc.archive_pages(table(spark, sf_dir, "pages")))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components of all documents."""
    groups = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return groups.select("doc_id", simhash.hex_digits(F.col("fingerprint")).alias("fingerprint"), "component_id")


def op7_language_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of those that are not held out."""
    return language_model.score_texts(table(spark, sf_dir, "documents"), quality.in_fold("doc_id", 7, 2), order=3)


def op8_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents, a row per piece."""
    return packing.piece_rows(packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(WORD_FILE), end_id=1))


def op9_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best others of every fiftieth vector."""
    return topk.top_k(table(spark, sf_dir, "embeddings"), k=5, every=50)


def op10_preference_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation with an answer as a pair: its last answer against a repetition of the one before."""
    return preference.format_preferences(preference.repeated_answer_pairs(table(spark, sf_dir, "conversations")), every_message=True)


def op11_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 5, 2, 1 over and over, and none is taken more than three times."""
    mixed = mixing.mix(table(spark, sf_dir, "documents"), partial(mixing.repeating, (5, 2, 1)), repeats=3)
    return mixed.drop("source", "spans")


def repeated_tail(doc: int | None, n: int) -> np.ndarray | None:
    """Every tenth document by the CRC of its id repeats a stretch to its end: the places of the words it then has."""
    h = zlib.crc32(str(doc).encode())
    if doc is None or h % 10 or not n:
        return None
    g = h // 10
    first = g % n
    period = 1 + (n - first) // (3 + g % 8)
    return np.concatenate([np.arange(first), first + np.arange(n - first) % period])


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of the words of all documents, every tenth of them with a planted one, and the texts without them."""
    found = periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), places=repeated_tail)
    best = F.col("strongest")
    line = lambda r: F.concat(r["start"], F.lit(","), r["length"], F.lit(","), r["period"], F.lit("\n"))
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "strongest.*",
        F.call_function("div", best["length"] * 1000, best["period"]).alias("exponent_milli"),
        F.sha2(F.array_join(F.transform("runs", line), "").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How each source's terms differ from those of other sources and of its language."""
    return source_terms.audit(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_quality": op1_quality,
    "op2_token_files": op2_token_files,
    "op3_piece_round_trip": op3_piece_round_trip,
    "op4_exact_dedup": op4_exact_dedup,
    "op5_seekable_warc": op5_seekable_warc,
    "op6_simhash": op6_simhash,
    "op7_language_model": op7_language_model,
    "op8_concatenate_and_cut": op8_concatenate_and_cut,
    "op9_exact_top_k": op9_exact_top_k,
    "op10_preference_pairs": op10_preference_pairs,
    "op11_mix_sources": op11_mix_sources,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_source_audit": op13_source_audit,
}
