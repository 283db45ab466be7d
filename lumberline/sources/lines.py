"""Log lines as ``(file, line_no, line)``, numbered from 1 in file order."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumberline.runtime import measured, written
from lumberline.sources.paths import literal_path, shown_path
from lumberline.sources.wide_lines import MARKS, wide_lines

BOM_HEAD_BYTES = 16384  # enough for 4096 characters of UTF-8
BOM_HEAD_CHARS = 4096


def split_lines(text: Column) -> Column:
    """Lines of a text: LF, CRLF and CR end a line, and a final line end opens no further line."""
    unified = F.when(text.contains("\r"), F.regexp_replace(text, r"\r\n?", "\n")).otherwise(text)
    parts = F.split(F.regexp_replace(unified, r"\n\z", ""), "\n", -1)
    return F.when(text != "", parts).otherwise(F.array().cast("array<string>"))


def lines_from_table(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    numbered = df.select(F.col(id_col).alias("file"), F.posexplode(split_lines(F.col(text_col))).alias("pos", "line"))
    return numbered.select("file", (F.col("pos") + 1).cast("bigint").alias("line_no"), "line")


def _repaired(raw: Column, errors: str) -> Column:
    valid = F.make_valid_utf8(raw)
    if errors == "replace":
        return valid
    if errors == "ignore":
        return F.when(F.is_valid_utf8(raw), raw).otherwise(F.replace(valid, F.lit("�"), F.lit("")))
    raise ValueError(f"errors must be 'replace' or 'ignore', not {errors!r}")


def _text_scan(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Raw lines with the file split they come from and an id that grows by one per line inside a split."""
    return (
        spark.read.option("recursiveFileLookup", "true")
        .text(path)
        .select(
            shown_path(F.col("_metadata.file_path")).alias("file"),
            F.col("_metadata.file_block_start").alias("split"),
            F.col("value").alias("raw"),
            F.monotonically_increasing_id().alias("scan_id"),
        )
    )


def _split_table(scan: DataFrame) -> DataFrame:
    """Per file split: first id, lines in the earlier splits of the file, and the UTF-16 mark its first line has."""
    head = F.substring(F.col("raw").cast("binary"), 1, 2)
    mark = F.when(head == bytearray(MARKS["utf-16-le"]), "utf-16-le").when(head == bytearray(MARKS["utf-16-be"]), "utf-16-be")
    splits = scan.groupBy("file", "split").agg(
        F.min("scan_id").alias("first_id"),
        F.count(F.lit(1)).alias("lines"),
        F.min_by(mark, "scan_id").alias("mark"),
        F.min(F.when(F.col("raw").contains("\x00"), F.col("scan_id"))).alias("nul_id"),
    )
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    return splits.withColumn("offset", F.coalesce(F.sum("lines").over(earlier), F.lit(0))).drop("lines")


def _utf16_files(scan: DataFrame, splits: DataFrame) -> DataFrame:
    """``(file, encoding)`` of files with a mark, or with a NUL among their first characters, whose heads alone are read."""
    first = splits.where("split = 0")
    early = first.where(F.col("mark").isNull() & (F.col("nul_id") - F.col("first_id") < BOM_HEAD_CHARS)).select("file", "nul_id")
    head = scan.where("split = 0").join(early, "file").where("scan_id <= nul_id")
    length = F.when(F.col("scan_id") < F.col("nul_id"), F.char_length("raw") + 1).otherwise(F.instr("raw", "\x00"))
    near = head.groupBy("file").agg(F.sum(length).alias("chars")).where(F.col("chars") <= BOM_HEAD_CHARS)
    marked = first.where(F.col("mark").isNotNull()).select("file", F.col("mark").alias("encoding"))
    return marked.unionByName(near.select("file", F.lit("utf-16-le").alias("encoding")))


def read_lines(spark: SparkSession, path: str | list[str], errors: str = "replace") -> DataFrame:
    """Numbered lines of all text files under ``path``.

    The files are read once: raw lines are written with their split, and both the counts that number them and the
    lines themselves come from that table. So the numbers do not depend on how Spark cuts files later, nor on files
    that grow meanwhile. The text is never shuffled; the small table of split offsets is joined to it. UTF-16 files
    are read again in splits of their own; see :mod:`lumberline.sources.wide_lines`.
    """
    scan = written(_text_scan(spark, path))
    splits = measured(_split_table(scan))
    wide = measured(_utf16_files(scan, splits.rows))
    offsets = splits.small().select("file", "split", "first_id", "offset")
    numbered = scan.join(offsets, ["file", "split"]).select(
        "file",
        (F.col("scan_id") - F.col("first_id") + F.col("offset") + 1).alias("line_no"),
        _repaired(F.col("raw"), errors).alias("line"),
    )
    paths: dict[str, list[str]] = {}
    for row in wide.rows.toLocalIterator():
        paths.setdefault(row["encoding"], []).append(literal_path(row["file"]))
    if not paths:
        return numbered
    found = numbered.join(wide.small(), "file", "left_anti")
    for encoding, files in paths.items():
        found = found.unionByName(wide_lines(spark, files, encoding))
    return found


def is_utf16(content: Column) -> Column:
    """Byte order mark, or a NUL among the first characters."""
    marked = F.substring(content, 1, 2).isin(bytearray(b"\xff\xfe"), bytearray(b"\xfe\xff"))
    head = F.substring(F.make_valid_utf8(F.substring(content, 1, BOM_HEAD_BYTES).cast("string")), 1, BOM_HEAD_CHARS)
    return marked | head.contains("\x00")


def _utf16_decoder():
    @F.pandas_udf("string")
    def decode_utf16(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: None if raw is None else bytes(raw).decode("utf-16", errors="replace"))

    return decode_utf16


def decode_files(spark: SparkSession, path: str | list[str], errors: str = "replace") -> DataFrame:
    """Numbered lines of files read whole (below 2 GB each), with UTF-16 recognised; for UTF-8 use ``read_lines``."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(shown_path(F.col("_metadata.file_path")).alias("file"), "content")
    )
    wide = F.when(is_utf16(F.col("content")), F.col("content"))
    decoded = files.select(
        "file",
        F.coalesce(_utf16_decoder()(wide), _repaired(F.col("content").cast("string"), errors)).alias("text"),
    )
    return lines_from_table(decoded, "file", "text")


def line_range(lines: DataFrame, start: int, end: int, max_lines: int = 20) -> DataFrame:
    """Lines ``start..end`` (at most ``max_lines``) of every file that has them all."""
    first, last = range_bounds(start, end, max_lines)
    long_enough = lines.where(F.col("line_no") == end).select("file")
    return lines.where(F.col("line_no").between(first, last)).join(long_enough, "file", "left_semi")


def range_bounds(start: int, end: int, max_lines: int) -> tuple[int, int]:
    """First and last line to show; a start of 0 means the first line."""
    first = 1 if start == 0 else start
    if first < 1 or first > end:
        raise ValueError(f"invalid line range {start}-{end}")
    return first, min(end, first + max_lines - 1)


def line_range_errors(lines: DataFrame, start: int, end: int) -> DataFrame:
    """Files too short for the range, with their length."""
    return short_files(lines.groupBy("file").agg(F.max("line_no").alias("total_lines")), start, end)


def short_files(totals: DataFrame, start: int, end: int) -> DataFrame:
    """Those of ``(file, total_lines)`` that end before the range does."""
    message = F.format_string(f"file has %d lines, requested {start}-{end}", F.col("total_lines"))
    return totals.where(F.col("total_lines") < end).withColumn("message", message)
