"""Numbered lines kept as a table with a sparse index, so that a range of lines opens only the parts that hold it.

``lines`` holds the lines in parts of a bounded number of rows, in the order they were read. ``index`` has one row per
part and log: the first and last line number there. It is small, sorted by log and written last, so a folder without it
is an unfinished one. Totals and errors are told from the index alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.runtime import measured
from lumberline.sources.lines import range_bounds, short_files

PART_LINES = 1 << 20


def keep_lines(lines: DataFrame, path: str, mode: str = "errorifexists", part_lines: int = PART_LINES) -> None:
    """Keep ``(file, line_no, line)`` under ``path``; an unfinished folder is written anew with the mode ``overwrite``.

    Lines of no log (a null ``file``) are kept and belong to no range. No lines give an empty table and an empty index.
    """
    spark = lines.sparkSession
    kept = lines.select("file", "line_no", "line")
    kept.write.mode(mode).option("maxRecordsPerFile", part_lines).option("compression", "zstd").parquet(f"{path}/lines")
    parts = (
        spark.read.parquet(f"{path}/lines")
        .groupBy(F.col("_metadata.file_name").alias("part"), "file")
        .agg(F.min("line_no").alias("first_line"), F.max("line_no").alias("last_line"))
    )
    parts.sort("file", "first_line").write.mode(mode).parquet(f"{path}/index")


def _index(spark: SparkSession, path: str, files: list | None) -> DataFrame:
    index = spark.read.parquet(f"{path}/index").where(F.col("file").isNotNull())
    return index if files is None else index.where(F.col("file").isin(files))


def kept_totals(spark: SparkSession, path: str, files: list | None = None) -> DataFrame:
    """``(file, total_lines)`` of the logs, or of those named; no line is read."""
    return _index(spark, path, files).groupBy("file").agg(F.max("last_line").alias("total_lines"))


def _overlaps(first: int, last: int) -> Column:
    return (F.col("first_line") <= last) & (F.col("last_line") >= first)


def kept_range(
    spark: SparkSession, path: str, start: int, end: int, max_lines: int = 20, files: list | None = None
) -> DataFrame:
    """Lines ``start..end`` (at most ``max_lines``) of every log, or of those named, that has them all.

    For named logs the index names the few parts that hold such lines, and only these are opened. For all logs the
    bounds are pushed to the scan, which passes over row groups outside them.
    """
    first, last = range_bounds(start, end, max_lines)
    totals = kept_totals(spark, path, files)
    long_enough = measured(totals.where(F.col("total_lines") >= end).select("file"))
    lines = spark.read.parquet(f"{path}/lines")
    if files is not None:
        parts = _index(spark, path, files).where(_overlaps(first, last)).select("part").distinct().collect()
        schema = lines.schema
        opened = [f"{path}/lines/{row['part']}" for row in parts]
        lines = spark.read.schema(schema).parquet(*opened) if opened else spark.createDataFrame([], schema)
        lines = lines.where(F.col("file").isin(files))
    return lines.where(F.col("line_no").between(first, last)).join(long_enough.small(), "file", "left_semi")


def kept_range_errors(spark: SparkSession, path: str, start: int, end: int, files: list | None = None) -> DataFrame:
    """Logs too short for the range, with their length."""
    return short_files(kept_totals(spark, path, files), start, end)
