"""Structured output: record and mapping CSV, crash JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.sinks.buckets import write_mapping


def write_records_csv(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    named = records.select(
        F.col("cleaned_log").alias("Cleaned Log"),
        F.col("raw_log").alias("Raw Log"),
        F.date_format("created_at", "yyyy-MM-dd HH:mm:ss").alias("Created At"),
    )
    named.write.mode(mode).csv(path, header=True, escape='"', emptyValue="")


def write_mapping_csv(mapping: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """``key,line_no,log,regex`` in line order, in a fixed number of folders; see :mod:`lumberline.sinks.buckets`."""
    write_mapping(mapping, path, mode)


def write_crashes_json(crashes: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One JSON object per crash and line, partitioned by detector."""
    crashes.write.partitionBy("detector").mode(mode).json(path)
