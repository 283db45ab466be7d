"""What kind of archive a list of entries describes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.sources.listing import base_name

# Entries of a test-result archive and of a bug report.
RESULT_FILES = ("test_result.xml", "test_result.html", "test_result_failures_suite.html")
RESULT_DIRS = ("module_reports/", "report-log-files/")
RESULT_DEPTH = 3
BUGREPORT_ENTRIES = r"^bugreport-.*\.txt$|dumpstate_board\.txt$|dumpstate_log\.txt$|version\.txt$"


def test_result_archives(entries: DataFrame) -> DataFrame:
    """Archives with a directory that holds every required file and directory: ``(archive, is_test_result)``."""
    path = F.lower(F.replace("entry", F.lit("\\"), F.lit("/")))
    bare = F.btrim(path, F.lit("/"))
    leaf = base_name(bare)
    name = F.concat(leaf, F.when(path.endswith("/"), "/").otherwise(""))
    required = [*RESULT_FILES, *RESULT_DIRS]
    placed = entries.select(
        "archive",
        F.substr(bare, F.lit(1), F.length(bare) - F.length(leaf)).alias("parent"),
        F.when(F.length(path) - F.length(F.replace(path, F.lit("/"), F.lit(""))) <= RESULT_DEPTH, name).alias("name"),
    )
    held = placed.groupBy("archive", "parent").agg(
        *[F.max(F.col("name").eqNullSafe(one)).alias(f"has_{number}") for number, one in enumerate(required)]
    )
    complete = F.lit(True)
    for number in range(len(required)):
        complete = complete & F.col(f"has_{number}")
    return held.groupBy("archive").agg(F.bool_or(complete).alias("is_test_result"))


def bugreport_archives(entries: DataFrame) -> DataFrame:
    """``(archive, is_bugreport, core_entry)``: by archive name or by any entry; the core entry is the first report text."""
    name = F.lower(base_name(F.col("archive")))
    lower = F.lower("entry")
    by_name = name.startswith("bugreport-") & name.endswith(".zip")
    by_entry = name.endswith(".zip") & lower.rlike(BUGREPORT_ENTRIES)
    is_core = lower.endswith(".txt") & lower.contains("bugreport")
    return (
        entries.groupBy("archive")
        .agg(
            F.bool_or(by_name | by_entry).alias("is_bugreport"),
            F.min(F.when(is_core, F.struct("pos", "entry"))).alias("core"),
        )
        .select("archive", "is_bugreport", F.col("core.entry").alias("core_entry"))
    )


def archive_actions(entries: DataFrame) -> DataFrame:
    """How each archive is unpacked: ``(archive, action, only_entry)`` with action all, core or skip."""
    kinds = bugreport_archives(entries).join(test_result_archives(entries), "archive")
    action = (
        F.when(F.col("is_bugreport"), F.when(F.col("core_entry").isNotNull(), "core").otherwise("skip"))
        .when(F.col("is_test_result"), "skip")
        .otherwise("all")
    )
    return kinds.select(
        "archive", action.alias("action"), F.when(F.col("is_bugreport"), F.col("core_entry")).alias("only_entry")
    )
