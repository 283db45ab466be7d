"""Crash detectors: line sequences turned into crash rows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.functions.heads import (
    dump_origin,
    kernel_origin,
    runtime_origin,
    tag_origin,
    thread_id,
    tombstone_origin,
)
from lumberline.functions.text import BLANK
from lumberline.operators.blocks import byte_part, capture_blocks, joined_text, lines_in_ranges
from lumberline.runtime import CELL_LINES, Cut, cell_of, measured

DEBUG, RUNTIME, NATIVE, JAVA, KEYWORDS, PANIC = "debug", "runtime", "native", "java", "keywords", "kernel_panic"
DEFAULT_DETECTORS = (DEBUG, RUNTIME, NATIVE, KEYWORDS, PANIC)

# Marks of the detectors.
DUMP_RULER = " ".join(["***"] * 16)
NATIVE_FRAME = rf"#\d{{2}}{BLANK}+pc{BLANK}+[0-9a-fA-F]"
NATIVE_FIRST_FRAME = rf"#00{BLANK}+pc{BLANK}+[0-9a-fA-F]"
JAVA_EXCEPTION = r"java\.lang\.[a-zA-Z0-9_$]+Exception"
JAVA_FRAME = rf"{BLANK}at{BLANK}+[a-zA-Z0-9_$.]+\("
TOMBSTONE_WORDS = ("tombstoned:", "/system/bin/tombstoned")
LOOK_BACK = 200  # lines searched for the hardware name, the panic line included
TAIL = 6  # lines kept after the panic line

# A trace of more bytes than this is given in several rows of the same crash, with trace_part 0, 1, 2, ….
TRACE_BYTES = 64 << 20


@dataclass(frozen=True)
class BlockDetector:
    """Start and member tests of a block detector, and where process and pid are read from."""

    is_start: Column
    is_member: Column
    origin: Column
    origin_on_start: bool
    origin_on_members: bool


def block_detectors() -> dict[str, BlockDetector]:
    line = F.col("line")
    return {
        DEBUG: BlockDetector(line.contains(DUMP_RULER), line.contains("DEBUG"), dump_origin(line), True, True),
        RUNTIME: BlockDetector(
            line.rlike("(?i)fatal exception"), line.contains("AndroidRuntime"), runtime_origin(line), False, True
        ),
        NATIVE: BlockDetector(
            line.contains("#00") & line.rlike(NATIVE_FIRST_FRAME),
            line.contains("#") & line.rlike(NATIVE_FRAME),
            tag_origin(line),
            True,
            False,
        ),
        JAVA: BlockDetector(
            line.contains("java.lang.") & line.rlike(JAVA_EXCEPTION),
            line.contains("at") & line.rlike(JAVA_FRAME),
            tag_origin(line, "A-Za-z0-9_./"),
            True,
            False,
        ),
    }


def is_tombstone_line(line: Column) -> Column:
    return line.contains(TOMBSTONE_WORDS[0]) | line.contains(TOMBSTONE_WORDS[1])


def candidate_lines(lines: DataFrame, detectors: tuple[str, ...]) -> DataFrame:
    """The lines that can matter to a detector, one row per line and detector, from one scan.

    Detectors that need no line but those they match keep nothing else, so all later steps work on few rows.
    """
    line = F.col("line")
    blocks = block_detectors()
    roles = []
    for name in detectors:
        if name in blocks:
            found = blocks[name]
            roles.append((name, found.is_start, found.is_start | found.is_member))
        elif name == KEYWORDS:
            roles.append((name, F.lit(True), is_tombstone_line(line)))
        elif name == PANIC:
            panic = line.contains("Kernel panic")
            roles.append((name, panic, panic | line.contains("Hardware name")))
        else:
            raise ValueError(f"unknown detector {name!r}")
    role = F.filter(
        F.array(
            *[
                F.when(wanted, F.struct(F.lit(name).alias("detector"), is_start.alias("is_start")))
                for name, is_start, wanted in roles
            ]
        ),
        lambda r: r.isNotNull(),
    )
    any_wanted = roles[0][2]
    for _, _, wanted in roles[1:]:
        any_wanted = any_wanted | wanted
    return (
        lines.where(any_wanted)
        .select("file", "line_no", "line", F.explode(role).alias("role"))
        .select("file", "line_no", "line", "role.detector", "role.is_start")
    )


def block_crashes(candidates: Cut, detectors: tuple[str, ...], width: int, trace_bytes: int) -> DataFrame:
    """Crash rows of the block detectors, all captured in one pass keyed by detector and file."""
    chosen = {name: found for name, found in block_detectors().items() if name in detectors}
    rows = candidates.rows.where(F.col("detector").isin(*chosen)).withColumn("tid", thread_id(F.col("line")))
    captured = capture_blocks(rows, ("detector", "file"), width, one_cell=candidates.last_line < width)

    first_origin = F.lit(None)
    for name, found in chosen.items():
        allowed = (F.col("is_start") & F.lit(found.origin_on_start)) | (
            ~F.col("is_start") & F.lit(found.origin_on_members)
        )
        first_origin = F.when((F.col("detector") == name) & allowed, found.origin).otherwise(first_origin)
    told = captured.withColumn("origin", first_origin)
    block = ("detector", "file", "start_line")
    parts = byte_part(told, F.octet_length("line") + 1, trace_bytes, block, width, one_cell=candidates.last_line < width)
    first = F.min(F.when(F.col("origin").isNotNull(), F.struct("line_no", "origin"))).alias("first")
    trace = joined_text(F.col("line_no"), F.col("line")).alias("full_stack_trace")
    texts = parts.groupBy(*block, "part").agg(F.max("line_no").alias("last"), first, trace)
    # The few parts of a block share its last line and the first origin that any of them has.
    of_block = Window.partitionBy(*block)
    crashes = texts.select(
        *block,
        F.max("last").over(of_block).alias("end_line"),
        F.min("first").over(of_block)["origin"].alias("origin"),
        "full_stack_trace",
        F.col("part").alias("trace_part"),
    )
    return crashes.select(
        "detector",
        F.col("file").alias("file_name"),
        "start_line",
        "end_line",
        F.coalesce("origin.process_name", F.lit("Unknown")).alias("process_name"),
        F.coalesce("origin.pid", F.lit("Unknown")).alias("pid"),
        "full_stack_trace",
        F.lit(None).cast("string").alias("crash_type"),
        "trace_part",
    )


def keyword_crashes(candidates: DataFrame) -> DataFrame:
    """Each tombstone line is a crash row of its own."""
    told = tombstone_origin(F.col("line"))
    return candidates.where(F.col("detector") == KEYWORDS).select(
        "detector",
        F.col("file").alias("file_name"),
        F.col("line_no").alias("start_line"),
        F.col("line_no").alias("end_line"),
        F.coalesce(told["process_name"], F.lit("Unknown")).alias("process_name"),
        F.coalesce(told["pid"], F.lit("Unknown")).alias("pid"),
        F.concat("line", F.lit("\n")).alias("full_stack_trace"),
        F.lit(None).cast("string").alias("crash_type"),
        F.lit(0).alias("trace_part"),
    )


def panic_ranges(candidates: DataFrame, width: int) -> DataFrame:
    """Per panic line the nearest hardware-name line within the look-back: ``(file, panic_line, start_line, end_line)``.

    The look-back is bounded, so a cell only needs its own rows and the hardware names of the cell before it.
    """
    width = max(width, LOOK_BACK)
    rows = candidates.where(F.col("detector") == PANIC).select(
        "file", "line_no", F.col("is_start").alias("is_panic"), F.col("line").contains("Hardware name").alias("is_name")
    )
    own = cell_of(F.col("line_no"), width)
    in_reach = F.when(F.col("is_name"), F.array(own, own + 1)).otherwise(F.array(own))
    spread = rows.withColumn("own", own).withColumn("cell", F.explode(in_reach))
    up_to_here = Window.partitionBy("file", "cell").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    nearest = F.last(F.when(F.col("is_name"), F.col("line_no")), ignorenulls=True).over(up_to_here)
    return (
        spread.withColumn("start_line", nearest)
        .where(F.col("is_panic") & (F.col("own") == F.col("cell")))
        .where(F.col("line_no") - F.col("start_line") < LOOK_BACK)
        .select("file", F.col("line_no").alias("panic_line"), "start_line", (F.col("line_no") + TAIL).alias("end_line"))
    )


def panic_crashes(lines: DataFrame, candidates: DataFrame, width: int) -> DataFrame:
    """Kernel panics: the lines from the hardware name to a few lines after the panic, with the line before them."""
    found = panic_ranges(candidates, width).withColumn("body_line", F.col("start_line"))
    reach = found.withColumn("start_line", F.col("start_line") - 1)
    body = F.col("line_no") >= F.col("body_line")
    told = kernel_origin(F.col("line"))
    return (
        lines_in_ranges(lines, reach)
        .groupBy("file", "panic_line", "body_line")
        .agg(
            F.max("line_no").alias("end_line"),
            F.max(F.when(~body, told)).alias("origin"),
            joined_text(F.col("line_no"), F.when(body, F.col("line"))).alias("full_stack_trace"),
        )
        .select(
            F.lit(PANIC).alias("detector"),
            F.col("file").alias("file_name"),
            F.col("body_line").alias("start_line"),
            "end_line",
            F.coalesce("origin.process_name", F.lit("kernel")).alias("process_name"),
            F.coalesce("origin.pid", F.lit("unknown")).alias("pid"),
            "full_stack_trace",
            F.lit("kernel_panic").alias("crash_type"),
            F.lit(0).alias("trace_part"),
        )
    )


def extract_crashes(
    lines: DataFrame,
    detectors: tuple[str, ...] = DEFAULT_DETECTORS,
    width: int = CELL_LINES,
    trace_bytes: int = TRACE_BYTES,
) -> DataFrame:
    """Crash rows of all requested detectors.

    The lines are scanned once for candidates, which are cut off with a checkpoint; only a panic's surrounding lines
    need a second look at ``lines``.
    """
    candidates = measured(candidate_lines(lines, tuple(detectors)))
    parts = []
    if set(detectors) & set(block_detectors()):
        parts.append(block_crashes(candidates, tuple(detectors), width, trace_bytes))
    if KEYWORDS in detectors:
        parts.append(keyword_crashes(candidates.rows))
    if PANIC in detectors:
        parts.append(panic_crashes(lines, candidates.rows, width))
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result
