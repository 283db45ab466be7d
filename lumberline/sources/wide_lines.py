"""Lines of UTF-16 files, read in splits.

Spark cuts the files at the two bytes of a line feed. Where the same two bytes lie across two characters, a record ends
too early and has an odd number of bytes; it is put together again with the records up to the next odd one. A byte that
was lost, so that no odd record follows soon, damages its own line and no other.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumberline.operators.blocks import lines_in_ranges, lines_near, running_total
from lumberline.runtime import measured, written
from lumberline.sources.paths import shown_path

# Marks and line feeds of both byte orders.
MARKS = {"utf-16-le": b"\xff\xfe", "utf-16-be": b"\xfe\xff"}
LINE_FEEDS = {"utf-16-le": "\n\x00", "utf-16-be": "\x00\n"}

# Records that may lie between the two odd ends of one line; beyond that a byte was lost.
LINE_RECORDS = 1 << 16


def _decoder(encoding: str):
    @F.pandas_udf("string")
    def decode_utf16(content: pd.Series) -> pd.Series:
        return content.map(lambda raw: None if raw is None else bytes(raw).decode(encoding, errors="replace"))

    return decode_utf16


def _scan(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """Records with their split and an id that grows by one per record inside a split."""
    rows = spark.read.option("lineSep", LINE_FEEDS[encoding]).text(paths)
    return rows.select(
        shown_path(F.col("_metadata.file_path")).alias("file"),
        F.col("_metadata.file_block_start").alias("split"),
        F.col("_metadata.file_size").alias("file_bytes"),
        F.monotonically_increasing_id().alias("scan_id"),
        F.col("value").alias("raw"),
    )


def _odd() -> Column:
    return F.octet_length("raw") % 2 == 1


def _split_table(scan: DataFrame) -> DataFrame:
    """Per split: first id, records in the earlier splits of the file, and what keeps records from being lines."""
    # A return that ends a record is part of its line end; any other ends a line itself.
    returns = F.octet_length("raw") - F.octet_length(F.replace("raw", F.lit("\r"), F.lit("")))
    closing = F.substring(F.col("raw").cast("binary"), -2, 2).isin(bytearray(b"\r\x00"), bytearray(b"\x00\r"))
    splits = scan.groupBy("file", "split").agg(
        F.min("scan_id").alias("first_id"),
        F.count(F.lit(1)).alias("records"),
        F.max(_odd() | (returns > closing.cast("int"))).alias("uneven"),
    )
    of_file = Window.partitionBy("file")
    earlier = of_file.orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("records").over(earlier), F.lit(0))
    return splits.select("file", "split", "first_id", offset.alias("offset"), F.max("uneven").over(of_file).alias("uneven"))


def _broken_lines(records: DataFrame) -> DataFrame:
    """``(file, start_line, end_line)``: records that are one line together, from an odd one to the next.

    Odd records pair up along chains of odd records that are close to each other. One without a partner stays alone.
    """
    in_file = Window.partitionBy("file").orderBy("line_no")
    odd = records.where(_odd()).select("file", "line_no")
    far = F.coalesce(F.col("line_no") - F.lag("line_no").over(in_file) > LINE_RECORDS, F.lit(True))
    chained = odd.withColumn("chain", F.sum(far.cast("int")).over(in_file))
    in_chain = Window.partitionBy("file", "chain").orderBy("line_no")
    paired = chained.select(
        "file",
        F.col("line_no").alias("start_line"),
        F.lead("line_no").over(in_chain).alias("end_line"),
        F.row_number().over(in_chain).alias("nth"),
    )
    return paired.where((F.col("nth") % 2 == 1) & F.col("end_line").isNotNull()).drop("nth")


def _mended(records: DataFrame, encoding: str) -> DataFrame:
    """Records with those of a broken line put together; only these are shuffled."""
    broken = measured(_broken_lines(records)).rows
    lines = records.withColumnRenamed("raw", "line")
    parts = lines_in_ranges(lines, broken)
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "line")))
    whole = parts.groupBy("file", "start_line").agg(F.array_join(ordered["line"], LINE_FEEDS[encoding]).alias("raw"))
    inside = lines_near(lines, broken).select("file", "line_no")
    alone = records.join(inside, ["file", "line_no"], "left_anti")
    return alone.unionByName(whole.withColumnRenamed("start_line", "line_no"))


def _texts(records: DataFrame, encoding: str) -> DataFrame:
    """The lines of each record: a final return belongs to the line end, one before it ends a line."""
    text = _decoder(encoding)(F.col("raw").cast("binary"))
    return records.withColumn("text", text).select(
        "file", "line_no", F.split(F.regexp_replace("text", r"\r\z", ""), "\r", -1).alias("texts")
    )


def wide_lines(spark: SparkSession, paths: list[str], encoding: str) -> DataFrame:
    """Numbered lines of UTF-16 files of one byte order; a file may have any size, a line stays below 2 GB.

    Bytes that are no character become U+FFFD. In files whose lines all end in LF or CRLF, a record is a line and is
    numbered where it is read. In files with lone CR, or with the bytes of a line feed across characters, lines are
    numbered by running sums over cells of records, which shuffles these files once.
    """
    scan = written(_scan(spark, paths, encoding))
    splits = measured(_split_table(scan))
    at = scan.join(splits.small(), ["file", "split"])
    raw, mark = F.col("raw"), F.lit(bytearray(MARKS[encoding]))
    number = F.col("scan_id") - F.col("first_id") + F.col("offset")
    marked = (number == 0) & (F.substring(raw.cast("binary"), 1, 2) == mark)
    records = at.where(~(marked & (F.col("file_bytes") == 2))).select(
        "file",
        number.alias("line_no"),
        F.when(marked, F.substring(raw.cast("binary"), 3, 1 << 30).cast("string")).otherwise(raw).alias("raw"),
        "uneven",
    )
    even = _texts(records.where(~F.col("uneven")).drop("uneven"), encoding)
    lines = even.select("file", (F.col("line_no") + 1).alias("line_no"), F.col("texts")[0].alias("line"))
    if splits.rows.where("uneven").isEmpty():
        return lines
    uneven = written(_texts(_mended(records.where("uneven").drop("uneven"), encoding), encoding))
    counted = running_total(uneven, F.size("texts").cast("bigint"), "before", inclusive=False)
    exploded = counted.select("file", "before", F.posexplode("texts").alias("pos", "line"))
    return lines.unionByName(exploded.select("file", (F.col("before") + F.col("pos") + 1).alias("line_no"), "line"))
