"""Line search: keyword lines and regex matches with context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.functions.text import has_error_stem, is_short_line, render_line, strip_blanks
from lumberline.operators.blocks import byte_part, lines_near
from lumberline.runtime import RANGE_CELL

# A match list holds about this many bytes; a file of more has several lists.
GROUP_BYTES = 64 << 20


def error_lines(lines: DataFrame, stems: list[str] | None = None) -> DataFrame:
    """Lines holding any of the error stems, in any case."""
    return lines.where(has_error_stem(F.col("line"), stems) if stems else has_error_stem(F.col("line")))


def short_lines(lines: DataFrame, limit: int) -> DataFrame:
    return lines.where(is_short_line(F.col("line"), limit))


def grep(lines: DataFrame, regex: str, context: int = 0, direction: str = "both") -> DataFrame:
    """Matching lines and ``context`` lines before and/or after each: ``(file, line_no, line, is_match)``.

    The line numbers of the matches become ranges; the text is read again, and is shuffled only when the ranges are
    too many to broadcast.
    """
    if direction not in ("up", "down", "both"):
        raise ValueError("direction must be 'up', 'down' or 'both'")
    is_match = F.col("line").rlike(f"(?U){regex}")
    if context == 0:
        return lines.where(is_match).select("file", "line_no", "line", F.lit(True).alias("is_match"))
    up = context if direction in ("up", "both") else 0
    down = context if direction in ("down", "both") else 0
    ranges = lines.where(is_match).select(
        "file", (F.col("line_no") - up).alias("start_line"), (F.col("line_no") + down).alias("end_line")
    )
    return lines_near(lines, ranges, max(RANGE_CELL, context)).select("file", "line_no", "line", is_match.alias("is_match"))


def match_groups(found: DataFrame, group_bytes: int = GROUP_BYTES) -> DataFrame:
    """Found lines as lists of ``line n: text`` per file: ``(file, part, match_lines)``, part 0 for all but huge files."""
    ordered = F.sort_array(F.collect_list(F.struct("line_no", "text")))
    text = render_line(F.col("line_no"), strip_blanks(F.col("line")), "line").alias("text")
    rendered = found.select("file", "line_no", text)
    parts = byte_part(rendered, F.octet_length("text"), group_bytes, ("file",))
    return parts.groupBy("file", F.col("part").cast("bigint").alias("part")).agg(ordered["text"].alias("match_lines"))
