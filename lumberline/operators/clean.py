"""Deduplicate lines by their cleaned key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.functions.text import cleaned_key, has_url


def with_key(lines: DataFrame) -> DataFrame:
    """Lines without URLs, with their key; the key is declared not NULL, or joins on it would test it twice."""
    key = F.coalesce(cleaned_key(F.col("line")), F.lit(""))
    return lines.where(~has_url(F.col("line"))).withColumn("cleaned_log", key)


def clean(lines: DataFrame, known_duplicates: DataFrame | None = None) -> DataFrame:
    """One row per file and key, the last line winning: ``(file, line_no, cleaned_log, raw_log)``.

    The aggregate is combined before the shuffle, so a key shared by a third of all lines travels once per task. Known
    keys are left out after it, when a key stands once per file.
    """
    last = F.max(F.struct("line_no", "line")).alias("last")
    cleaned = (
        with_key(lines)
        .groupBy("file", "cleaned_log")
        .agg(last)
        .select("file", F.col("last.line_no").alias("line_no"), "cleaned_log", F.col("last.line").alias("raw_log"))
    )
    return cleaned if known_duplicates is None else exclude_known(cleaned, known_duplicates)


def exclude_known(keyed: DataFrame, known: DataFrame) -> DataFrame:
    """Drop rows whose key is in ``known(cleaned_log)``."""
    return keyed.join(known.select("cleaned_log"), "cleaned_log", "left_anti").select(keyed.columns)
