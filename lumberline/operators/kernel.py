"""Kernel oops blocks: from the first oops line to the line that closes its report."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.functions.text import BLANK, matches_any_case
from lumberline.operators.blocks import byte_part, joined_text, lines_in_ranges, segment_ranges
from lumberline.runtime import CELL_LINES, measured

# Line patterns of an oops report.
OOPS_START = r"Kernel panic|Internal error|Unable to handle kernel paging request|Oops:"
OOPS_END = r"Modules linked in:|---\[ end trace"
HEX_DUMP = rf"^{BLANK}*([0-9a-fA-F]{{8}}|[0-9a-fA-F]{{16}})[: ]"

# A block's text has about this many bytes; a longer block makes further rows, part 1, 2, ….
BLOCK_BYTES = 64 << 20


def kernel_ranges(lines: DataFrame, width: int = CELL_LINES) -> DataFrame:
    line = F.col("line")
    is_start = matches_any_case(line, OOPS_START)
    is_end = matches_any_case(line, OOPS_END) & ~line.rlike(HEX_DUMP)
    marks = lines.select("file", "line_no", is_start.alias("is_start"), is_end.alias("is_end"))
    events = measured(marks.where("is_start or is_end"))
    return segment_ranges(events.rows, width, one_cell=events.last_line < width)


def kernel_blocks(lines: DataFrame, width: int = CELL_LINES, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(file, start_line, end_line, part, block)``; hex-dump lines are left out of the text."""
    inside = lines_in_ranges(lines, kernel_ranges(lines, width)).where(~F.col("line").rlike(HEX_DUMP))
    block = ("file", "start_line", "end_line")
    parts = byte_part(inside, F.octet_length("line") + 1, block_bytes, block, width)
    return parts.groupBy(*block, "part").agg(joined_text(F.col("line_no"), F.col("line")).alias("block"))
