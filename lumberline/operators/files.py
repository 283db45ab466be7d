"""Classify files as logcat or kernel logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.functions.text import BLANK
from lumberline.operators.blocks import running_total
from lumberline.runtime import CELL_LINES, cell_of, materialize, measured

# What the lines of each class look like.
KERNEL_TIME = rf"\[{BLANK}*\d+\.\d+(?:@\d+)?\]"
LOGCAT_HEAD = rf"^{BLANK}*+\d{{2}}-\d{{2}}{BLANK}+\d{{2}}:\d{{2}}:\d{{2}}\.\d+{BLANK}+(\d+{BLANK}+\d+{BLANK}+)?[VDIWEF]"
BOOT_BANNER = "Hello world, Now in BL33Z"

# Lines that one number marks, a bit each.
MARK_LINES = 64


def detect_file_types(lines: DataFrame, threshold: int = 20) -> DataFrame:
    """``(file, file_type)``: the class whose ``threshold``-th line comes first, a boot banner meaning kernel.

    Lines of a kind are marked as bits, 64 lines to a number, and combined before the shuffle. Running counts of the bits
    tell which number holds the ``threshold``-th line of a kind; no line is sorted.
    """
    line = F.col("line")
    kind = (
        F.when(line.contains("[") & line.rlike(KERNEL_TIME), "kernel")
        .when(line.rlike(LOGCAT_HEAD), "logcat")
        .when(line.contains(BOOT_BANNER), "banner")
        .otherwise("other")
    )
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.pmod("line_no", F.lit(MARK_LINES)).cast("int"))
    start = cell_of(F.col("line_no"), MARK_LINES) * MARK_LINES
    # Lines of no kind tell only that there is such a file.
    marks = measured(
        lines.select("file", kind.alias("kind"), "line_no", bit.alias("bit"))
        .select("file", "kind", F.when(F.col("kind") != "other", start).alias("line_no"), "bit")
        .groupBy("file", "kind", "line_no")
        .agg(F.bit_or("bit").alias("mask"))
    )
    of_kind = marks.rows.where(F.col("kind") != "other")
    here, wanted = F.bit_count("mask").cast("bigint"), F.when(F.col("kind") == "banner", 1).otherwise(threshold)
    one_cell = marks.last_line < CELL_LINES
    counted = running_total(of_kind, here, "before", ("file", "kind"), inclusive=False, one_cell=one_cell)
    nth = (wanted - F.col("before")).cast("int")
    bits = F.filter(F.sequence(F.lit(0), F.lit(MARK_LINES - 1)), lambda n: F.getbit("mask", n) == 1)
    reached = counted.where((nth >= 1) & (nth <= here)).select("file", "kind", (F.col("line_no") + F.element_at(bits, nth)).alias("at"))

    def line_of(name: str):
        return F.min(F.when(F.col("kind") == name, F.col("at")))

    files = marks.rows.select("file", F.lit(None).cast("string").alias("kind"), F.lit(None).cast("bigint").alias("at"))
    decided = reached.unionByName(files).groupBy("file").agg(
        F.least(line_of("kernel"), line_of("banner")).alias("kernel_at"),
        line_of("logcat").alias("logcat_at"),
    )
    is_kernel = F.col("kernel_at").isNotNull() & (
        F.col("logcat_at").isNull() | (F.col("kernel_at") < F.col("logcat_at"))
    )
    file_type = F.when(is_kernel, "kernel").when(F.col("logcat_at").isNotNull(), "logcat").otherwise("unknown")
    return decided.select("file", file_type.alias("file_type"))


def files_by_type(file_types: DataFrame, per_list: int = 10_000) -> DataFrame:
    """File lists per class: ``(file_type, part, files)``; a list holds about ``per_list`` files, large classes several.

    Files are dealt to lists by hash, with as many lists per class as its count asks for.
    """
    typed = materialize(file_types)
    counts = typed.groupBy("file_type").agg(F.ceil(F.count(F.lit(1)) / per_list).alias("parts"))
    dealt = typed.join(F.broadcast(counts), "file_type").withColumn(
        "part", F.pmod(F.xxhash64("file"), F.col("parts"))
    )
    return dealt.groupBy("file_type", "part").agg(F.sort_array(F.collect_list("file")).alias("files"))
