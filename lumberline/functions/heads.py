"""What a log line says about its origin: format, thread id, process and pid."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumberline.functions.text import BLANK

# Line formats and the names given to them.
DAY_TIME = rf"^{BLANK}*\d{{2}}-\d{{2}}{BLANK}+\d{{2}}:\d{{2}}:\d{{2}}\.\d{{3}}{BLANK}+"
THREADTIME = rf"{DAY_TIME}(?:\d+{BLANK}+){{1,2}}(\d+){BLANK}+[A-Z](?:{BLANK}|$)"
BRIEF = rf"{DAY_TIME}[A-Z]/[^:]+\({BLANK}*(\d+)\):"
THREADTIME_NAME = "Logcat (ThreadTime extended)"
BRIEF_NAME = "Logcat (Brief/Process)"
UNKNOWN_NAME = "Unknown"


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """Like ``regexp_extract`` but NULL when nothing matches; the group must not be empty on a match."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def thread_id(line: Column) -> Column:
    return F.coalesce(first_group(line, THREADTIME), first_group(line, BRIEF))


def log_info(line: Column) -> Column:
    extended = first_group(line, THREADTIME)
    brief = first_group(line, BRIEF)
    kind = F.when(extended.isNotNull(), THREADTIME_NAME).when(brief.isNotNull(), BRIEF_NAME).otherwise(UNKNOWN_NAME)
    return F.struct(kind.alias("type"), F.coalesce(extended, brief).alias("thread_id"))


def origin(name: Column, pid: Column) -> Column:
    return F.struct(name.alias("process_name"), pid.alias("pid"))


def runtime_origin(line: Column) -> Column:
    pattern = rf"Process:{BLANK}+([^\n]+?),{BLANK}+PID:{BLANK}+(\d+)"
    pid = first_group(line, pattern, 2)
    return F.when(pid.isNotNull(), origin(first_group(line, pattern, 1), pid))


def tag_origin(line: Column, tag_chars: str = "A-Za-z0-9_") -> Column:
    pattern = rf"([{tag_chars}]+)\({BLANK}*(\d+)\):"
    pid = first_group(line, pattern, 2)
    return F.when(pid.isNotNull(), origin(first_group(line, pattern, 1), pid))


def dump_origin(line: Column) -> Column:
    pid = first_group(line, rf"pid:{BLANK}*(\d+),{BLANK}*tid:{BLANK}*(\d+),")
    return F.when(pid.isNotNull(), origin(first_group(line, rf">>>{BLANK}+([^\n]+?){BLANK}+<<<"), pid))


def tombstone_origin(line: Column) -> Column:
    denied = origin(first_group(line, 'comm="([^"]+)"'), first_group(line, r"pid=(\d+)"))
    plain = origin(F.lit(None).cast("string"), first_group(line, rf"\({BLANK}*(\d+)\):"))
    return F.when(line.contains("avc: denied"), denied).otherwise(plain)


def kernel_origin(line: Column) -> Column:
    both = line.contains("PID:") & line.contains("Comm:")
    return F.when(both, origin(first_group(line, r"Comm:\s+(\S+)"), first_group(line, r"PID:\s*(\d+)")))
