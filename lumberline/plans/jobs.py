"""The jobs: clean and store, subtract what is known, extract crashes, error lines, filter by modules."""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.operators.clean import clean
from lumberline.operators.crashes import DEFAULT_DETECTORS, extract_crashes
from lumberline.operators.history import batch_records, line_records, subtract_known
from lumberline.operators.modules import known_module_names, requested, resolve_modules, unknown_modules
from lumberline.operators.patterns import (
    combine_patterns,
    filter_lines,
    invalid_patterns,
    map_patterns,
    mapping_stats,
    valid_patterns,
)
from lumberline.operators.search import error_lines
from lumberline.runtime import job_tables, materialize, written
from lumberline.sinks.history import append_new, committed_records
from lumberline.sinks.tables import write_crashes_json, write_mapping_csv, write_records_csv
from lumberline.sinks.text import write_pattern_lists, write_rendered
from lumberline.sources.history import read_history
from lumberline.sources.kept_lines import keep_lines
from lumberline.sources.lines import read_lines
from lumberline.sources.modules import load_patterns


# Names of a catalog that an error message lists at most.
NAMES_SHOWN = 1000


def clean_and_store(
    spark: SparkSession,
    log_path: str,
    history_path: str,
    clean_path: str | None = None,
    csv_path: str | None = None,
    created_at: dt.datetime | None = None,
    token: str | None = None,
) -> int:
    """Clean the logs under ``log_path``, append keys never seen before to the history, return how many.

    The CSV is written from the records that were committed. A job with a ``token`` may be run again after any failure:
    it adds nothing that its first run committed, and writes the same CSV over what there is of it.
    """
    with job_tables(spark):
        lines = read_lines(spark, log_path)
        if clean_path is not None:
            cleaned = written(clean(lines))
            write_rendered(cleaned, clean_path, mode="errorifexists" if token is None else "overwrite")
        stamp = created_at or dt.datetime.now().replace(microsecond=0)
        records = line_records(lines, stamp) if clean_path is None else batch_records(cleaned, stamp)
        commit = append_new(records, history_path, token, dealt=clean_path is None)
        if csv_path is not None:
            write_records_csv(committed_records(spark, history_path, commit), csv_path, "errorifexists" if token is None else "overwrite")
        return commit.records


def subtract(spark: SparkSession, log_path: str, history_path: str, output_path: str) -> None:
    """Write the cleaned lines of the logs that the history does not know."""
    with job_tables(spark):
        unknown = subtract_known(clean(read_lines(spark, log_path)), read_history(spark, history_path))
        write_rendered(unknown, output_path)


def keep_log_lines(spark: SparkSession, log_path: str, kept_path: str, mode: str = "errorifexists") -> None:
    """Number the lines of the logs once and keep them with an index, from which ranges are read without the rest."""
    with job_tables(spark):
        keep_lines(read_lines(spark, log_path), kept_path, mode)


def crashes_to_json(
    spark: SparkSession, log_path: str, output_path: str, detectors: tuple[str, ...] = DEFAULT_DETECTORS
) -> None:
    with job_tables(spark):
        write_crashes_json(extract_crashes(read_lines(spark, log_path, errors="ignore"), detectors), output_path)


def error_lines_to_text(spark: SparkSession, log_path: str, output_path: str, stems: list[str] | None = None) -> None:
    """Write the numbered lines of the logs that hold an error stem."""
    with job_tables(spark):
        write_rendered(error_lines(read_lines(spark, log_path), stems), output_path, text_col="line")


class UnknownModules(ValueError):
    """A request names modules the catalog lacks; the message lists those it has."""


@dataclass(frozen=True)
class ModuleFilter:
    """Result of filtering lines by modules; ``invalid`` has the patterns that no regex engine takes."""

    patterns: DataFrame
    filtered: DataFrame
    mapping: DataFrame
    stats: DataFrame
    invalid: DataFrame


def combined_patterns(spark: SparkSession, module_names: str, catalog: DataFrame) -> DataFrame:
    """Patterns of all requested modules with their validity."""
    request = spark.createDataFrame([(module_names,)], "request STRING").withColumn("id", F.lit(0))
    wanted = requested(request, "id", "request")
    if wanted.isEmpty():
        raise UnknownModules("no module requested")
    unknown = [row["module_name"] for row in unknown_modules(wanted, catalog).collect()]
    if unknown:
        known = sorted(row["module_name"] for row in known_module_names(catalog).limit(NAMES_SHOWN).collect())
        raise UnknownModules(f"not in the catalog: {', '.join(sorted(unknown))}; known: {', '.join(known)}")
    found = resolve_modules(wanted, catalog).select("regex_file_path").distinct().collect()
    return materialize(combine_patterns(load_patterns(spark, [row["regex_file_path"] for row in found])))


def filter_modules(
    spark: SparkSession, lines: DataFrame, module_names: str, catalog: DataFrame, max_patterns_per_line: int = 1
) -> ModuleFilter:
    """Cleaned lines matching any pattern of the requested modules, and which pattern matched each."""
    combined = combined_patterns(spark, module_names, catalog)
    usable = valid_patterns(combined)
    filtered = materialize(filter_lines(clean(lines), usable))
    mapping = map_patterns(filtered, usable, max_patterns_per_line)
    return ModuleFilter(combined, filtered, mapping, mapping_stats(mapping, combined), invalid_patterns(combined))


def filter_modules_to_files(
    spark: SparkSession, log_path: str, module_names: str, catalog: DataFrame, output_path: str, max_patterns_per_line: int = 1
) -> ModuleFilter:
    """Filter the logs under ``log_path`` and write the lines, the mapping as CSV, and the valid and invalid patterns."""
    with job_tables(spark):
        result = filter_modules(spark, read_lines(spark, log_path), module_names, catalog, max_patterns_per_line)
        write_rendered(result.filtered, f"{output_path}/filtered", text_col="log")
        write_mapping_csv(result.mapping, f"{output_path}/mapping")
        write_pattern_lists(result.patterns, f"{output_path}/patterns")
    return result
