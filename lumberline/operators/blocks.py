"""Sequence operators on lines: latest earlier line, running totals, blocks, and lines inside ranges.

None of them puts a large file into one task. A file is cut into cells of consecutive lines; windows run inside a
cell, one summary row per cell is ordered over the file, and the result is joined back to the cell. Only when no file
is longer than a cell, which callers measure, is the plain window used (``one_cell``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.runtime import CELL_LINES, RANGE_CELL, cell_of, measured


# Words of 64 bits of the table that tells which cells ranges touch: 16 million bits, however many ranges there are.
FILTER_WORDS = 1 << 18


def _cells(width: int) -> Column:
    return cell_of(F.col("line_no"), width)


def latest_at_or_before(
    rows: DataFrame,
    is_mark: Column,
    mark: Column,
    name: str,
    keys: tuple[str, ...] = ("file",),
    width: int = CELL_LINES,
    one_cell: bool = False,
) -> DataFrame:
    """Add ``name``: the value ``mark`` had on the latest row with ``is_mark``, this row included; NULL before it.

    ``mark`` is a struct made of columns of ``rows``; it is carried together with the line number it comes from.
    """
    if one_cell:
        here = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
        return rows.withColumn(name, F.last(F.when(is_mark, mark), ignorenulls=True).over(here))
    marked = rows.withColumn("_cell", _cells(width)).withColumn(
        "_mark", F.when(is_mark, F.struct(F.col("line_no").alias("_at"), mark.alias("_value")))
    )
    cell_keys = [*keys, "_cell"]
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        marked.groupBy(*cell_keys)
        .agg(F.max("_mark").alias("_last"))
        .select(*cell_keys, F.last("_last", ignorenulls=True).over(before).alias("_carried"))
        .where(F.col("_carried").isNotNull())
    )
    inside = Window.partitionBy(*cell_keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    local = marked.withColumn("_mark", F.last("_mark", ignorenulls=True).over(inside))
    found = F.coalesce(F.col("_mark"), F.col("_carried"))["_value"].alias(name)
    return local.join(carried, cell_keys, "left").select(*rows.columns, found)


def running_total(
    rows: DataFrame,
    value: Column,
    name: str,
    keys: tuple[str, ...] = ("file",),
    width: int = CELL_LINES,
    inclusive: bool = True,
    one_cell: bool = False,
) -> DataFrame:
    """Add ``name``: the sum of ``value`` over the rows up to this one, or before it."""
    last = 0 if inclusive else -1
    if one_cell:
        here = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, last)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(here), F.lit(0)))
    valued = rows.withColumn("_cell", _cells(width)).withColumn("_value", value)
    cell_keys = [*keys, "_cell"]
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        valued.groupBy(*cell_keys)
        .agg(F.sum("_value").alias("_sum"))
        .select(*cell_keys, F.sum("_sum").over(before).alias("_carried"))
        .where(F.col("_carried").isNotNull())
    )
    inside = Window.partitionBy(*cell_keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, last)
    local = valued.withColumn("_local", F.coalesce(F.sum("_value").over(inside), F.lit(0)))
    total = (F.col("_local") + F.coalesce(F.col("_carried"), F.lit(0))).alias(name)
    return local.join(carried, cell_keys, "left").select(*rows.columns, total)


def capture_blocks(
    rows: DataFrame, keys: tuple[str, ...] = ("file",), width: int = CELL_LINES, one_cell: bool = False
) -> DataFrame:
    """Give every start and member row the block it belongs to.

    ``rows`` holds only candidate rows, with ``line_no``, ``tid`` and ``is_start``. A start row opens a block that
    stays open until the next start row; another row belongs to the open block when its ``tid`` equals the tid of the
    start row, both NULL counting as equal. Adds ``start_line``; rows outside any block are dropped.
    """
    start = F.struct(F.col("line_no").alias("line_no"), F.col("tid").alias("tid"))
    opened = latest_at_or_before(rows, F.col("is_start"), start, "_start", keys, width, one_cell)
    in_block = F.col("_start").isNotNull() & (F.col("is_start") | F.col("tid").eqNullSafe(F.col("_start.tid")))
    return opened.where(in_block).select(*rows.columns, F.col("_start.line_no").alias("start_line"))


def segment_ranges(events: DataFrame, width: int = CELL_LINES, one_cell: bool = False) -> DataFrame:
    """Ranges from the first start to the next end: ``(file, start_line, end_line)``.

    ``events(file, line_no, is_start, is_end)`` holds only start and end rows. Starts inside a range are ignored, a
    range without end is dropped, and one row may be both.
    """
    ends = F.col("is_end").cast("bigint")
    segments = running_total(events, ends, "segment", width=width, inclusive=False, one_cell=one_cell)
    return (
        segments.groupBy("file", "segment")
        .agg(
            F.min(F.when(F.col("is_start"), F.col("line_no"))).alias("start_line"),
            F.max(F.when(F.col("is_end"), F.col("line_no"))).alias("end_line"),
        )
        .where("start_line <= end_line")
        .drop("segment")
    )


def _range_cells(ranges: DataFrame, width: int) -> DataFrame:
    first, last = cell_of(F.col("start_line"), width), cell_of(F.col("end_line"), width)
    return ranges.withColumn("_cell", F.explode(F.sequence(first, last)))


def _merged_cells(ranges: DataFrame, width: int) -> DataFrame:
    """Ranges cut at the borders of cells, those of a cell that overlap or touch made one: ``(file, _cell, start_line, end_line)``.

    A cell has few distinct cut ranges, so lists of them are bounded however many ranges there are.
    """
    first = F.col("_cell") * F.lit(width).cast("bigint")
    cut = _range_cells(ranges, width).select(
        "file",
        "_cell",
        F.greatest("start_line", first).alias("start_line"),
        F.least("end_line", first + (width - 1)).alias("end_line"),
    )
    listed = cut.groupBy("file", "_cell").agg(F.array_sort(F.collect_set(F.struct("start_line", "end_line"))).alias("all"))

    def add(merged: Column, r: Column) -> Column:
        last = F.element_at(merged, -1)
        joined = F.struct(last["start_line"].alias("start_line"), F.greatest(last["end_line"], r["end_line"]).alias("end_line"))
        touches = (F.size(merged) > 0) & (r["start_line"] <= F.try_element_at(merged, F.lit(-1))["end_line"] + 1)
        return F.when(touches, F.concat(F.slice(merged, 1, F.size(merged) - 1), F.array(joined))).otherwise(F.concat(merged, F.array(r)))

    none = F.array().cast("array<struct<start_line:bigint,end_line:bigint>>")
    return listed.select("file", "_cell", F.explode(F.aggregate("all", none, add)).alias("r")).select("file", "_cell", "r.*")


def in_touched_cells(celled: DataFrame, cells: DataFrame) -> DataFrame:
    """Rows of ``celled(file, _cell, …)`` whose cell may be one of ``cells``, found without a shuffle.

    The cells are hashed to the bits of a table of fixed size, which is broadcast word by word. A row of another cell
    passes when it shares a bit, so the exact join comes after; but the lines that it shuffles are few.
    """
    bit = F.pmod(F.xxhash64("file", "_cell"), F.lit(64 * FILTER_WORDS).cast("bigint"))
    word, mask = F.shiftrightunsigned(bit, 6), F.call_function("shiftleft", F.lit(1).cast("bigint"), bit.bitwiseAND(63).cast("int"))
    words = cells.select(word.alias("_word"), mask.alias("_mask")).groupBy("_word").agg(F.bit_or("_mask").alias("_bits"))
    passed = celled.withColumn("_word", word).join(F.broadcast(words), "_word").where(mask.bitwiseAND(F.col("_bits")) != 0)
    return passed.select(celled.columns)


def lines_in_ranges(lines: DataFrame, ranges: DataFrame, width: int = RANGE_CELL) -> DataFrame:
    """Every line inside every range: the columns of ``ranges`` with ``line_no`` and ``line``.

    ``ranges(file, start_line, end_line, …)`` is materialized, measured, and broadcast when small, so that the lines
    are not shuffled for a few ranges; for many ranges only the lines of their cells are.
    """
    spread = measured(_range_cells(ranges, width))
    inside = F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    celled = lines.withColumn("_cell", _cells(width))
    if not spread.is_small:
        celled = in_touched_cells(celled, spread.rows)
    return celled.join(spread.small(), ["file", "_cell"]).where(inside).select(*ranges.columns, "line_no", "line")


def lines_near(lines: DataFrame, ranges: DataFrame, width: int = RANGE_CELL) -> DataFrame:
    """Lines inside at least one range, each once; ``ranges`` is treated as in ``lines_in_ranges``, and merged.

    Choose a ``width`` of about the ranges' length, so that a range meets few cells.
    """
    merged = measured(_merged_cells(ranges, width))
    inside = F.col("line_no").between(F.col("start_line"), F.col("end_line"))
    celled = lines.withColumn("_cell", _cells(width))
    if not merged.is_small:
        celled = in_touched_cells(celled, merged.rows)
    # Merged ranges of a cell share no line, so a line is found once.
    return celled.join(merged.small(), ["file", "_cell"]).where(inside).select(lines.columns)


def byte_part(rows: DataFrame, size: Column, limit: int, keys: tuple[str, ...], width: int = CELL_LINES, one_cell: bool = False) -> DataFrame:
    """Add ``part``: 0, 1, 2, … by the bytes of the rows of the same keys before the row, ``limit`` to a part."""
    before = running_total(rows, size.cast("bigint"), "_before", keys, width, inclusive=False, one_cell=one_cell)
    return before.withColumn("part", F.floor(F.col("_before") / limit).cast("int")).drop("_before")


def joined_text(line_no: Column, text: Column, end: str = "\n") -> Column:
    """Aggregate: texts in line order, each followed by ``end``. The group must be bounded."""
    ordered = F.sort_array(F.collect_list(F.struct(line_no.alias("n"), text.alias("t"))))
    return F.concat(F.array_join(ordered["t"], end), F.lit(end))
