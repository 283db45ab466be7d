"""How many lines fit a character budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumberline.functions.text import char_length
from lumberline.operators.blocks import running_total
from lumberline.runtime import CELL_LINES


def _total_to_here(rows: DataFrame, value, name: str, bound: int, width: int) -> DataFrame:
    """Running total per file; a plain window when ``bound`` proves that a file has few rows left."""
    if bound <= width:
        here = Window.partitionBy("file").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.sum(value).over(here))
    return running_total(rows, value, name, width=width)


def truncate_lines(lines: DataFrame, max_length: int, width: int = CELL_LINES) -> DataFrame:
    """Whole lines, each counted with its line end, up to ``max_length`` characters per file.

    When the first line alone is longer, its first ``max_length`` characters are kept. A line takes at least one
    character, so no line after number ``max_length`` can be part of the result.
    """
    near = lines.where(F.col("line_no") <= max_length)
    totalled = _total_to_here(near, F.length("line") + 1, "total", max_length, width)
    fits = F.col("total") <= max_length
    cut = F.when(fits, F.col("line")).otherwise(F.substring("line", 1, max_length))
    return totalled.where(fits | (F.col("line_no") == 1)).select("file", "line_no", cut.alias("line"))


def used_lines(
    lines: DataFrame, max_chars: int, start: int = 0, max_lines: int = 1000, width: int = CELL_LINES
) -> DataFrame:
    """``(file, used)``: lines after the first ``start`` that fit ``max_chars``, at most ``max_lines``.

    Line ends are not counted. A line longer than the whole budget counts when it is the one that does not fit.
    """
    in_reach = (F.col("line_no") > start) & (F.col("line_no") <= start + max_lines)
    size = F.when(in_reach, char_length(F.col("line"))).cast("bigint")
    near = lines.where(in_reach | (F.col("line_no") == 1)).select("file", "line_no", size.alias("size"))
    totalled = _total_to_here(near, F.coalesce("size", F.lit(0)), "total", max_lines + 1, width)
    over = F.col("size").isNotNull() & (F.col("total") > max_chars)
    counted = totalled.groupBy("file").agg(
        F.count_if(F.col("size").isNotNull() & (F.col("total") <= max_chars)).alias("fit"),
        F.min(F.when(over, F.struct("line_no", "size")))["size"].alias("next_size"),
    )
    extra = F.when(F.col("next_size") > max_chars, 1).otherwise(0)
    used = F.when(F.col("fit") >= max_lines, F.lit(max_lines)).otherwise(F.col("fit") + extra)
    return counted.select("file", used.cast("bigint").alias("used"))
