"""One query per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import inputs
from lumberline.functions import answers, heads, names, text
from lumberline.operators import archives, budget, crashes, files, history, kernel, modules, search
from lumberline.operators import patterns as pattern_ops
from lumberline.operators.clean import clean
from lumberline.runtime import materialize, shared_folder
from lumberline.sinks.history import append_new
from lumberline.sinks.text import markdown_rows, rendered
from lumberline.sources import listing
from lumberline.sources.history import read_history, stored_keys
from lumberline.sources.kept_lines import keep_lines, kept_range, kept_range_errors
from lumberline.sources.lines import line_range, line_range_errors

Query = Callable[[SparkSession, str], DataFrame]

CLASS_LINKS = {f"class_{n}": f"https://docs.example.com/debug/{n}" for n in (3, 6, 7)}
LINE_LIMIT = 200
GREP = "Kernel panic|retry [0-9]*7$"


def clean_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(inputs.document_lines(spark, sf_dir))


def clean_dedup_logcat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean(inputs.log_lines(spark, sf_dir))


def clean_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_dedup_logcat(spark, sf_dir).orderBy("file", "line_no").limit(10)


def rendered_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rendered(clean_dedup_logcat(spark, sf_dir))


def url_lines_dropped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return inputs.log_lines(spark, sf_dir).where(~text.has_url(F.col("line")))


def normalize_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.document_lines(spark, sf_dir)
    return lines.select("file", "line_no", text.normalized_line(F.col("line")).alias("normalized"))


def stop_words_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.document_lines(spark, sf_dir)
    return lines.select("file", "line_no", text.without_stop_words(F.col("line")).alias("words"))


def log_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = inputs.log_lines(spark, sf_dir).select("file", "line_no", heads.log_info(F.col("line")).alias("info"))
    return told.select("file", "line_no", F.col("info.type").alias("type"), "info.thread_id")


def error_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.error_lines(inputs.document_lines(spark, sf_dir))


def error_lines_logcat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.error_lines(inputs.log_lines(spark, sf_dir))


def error_counts_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = error_lines(spark, sf_dir).groupBy("file").agg(F.count(F.lit(1)).alias("n"))
    sources = inputs.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file"), "source")
    return found.join(sources, "file").groupBy("source").agg(F.sum("n").alias("error_lines"))


def long_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    short = search.short_lines(inputs.document_lines(spark, sf_dir), LINE_LIMIT)
    return short.select("file", "line_no", text.char_length(F.col("line")).alias("n_chars"))


def grep_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep(inputs.log_lines(spark, sf_dir), GREP, context=3, direction="both")


def grep_context_down(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search.grep(inputs.document_lines(spark, sf_dir), "tion[.,]", context=1, direction="down")


def grep_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = search.match_groups(search.grep(inputs.log_lines(spark, sf_dir), GREP, context=2, direction="up"))
    return found.select("file", "part", F.array_join("match_lines", "\n").alias("match_lines"))


def ranged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_range(inputs.document_lines(spark, sf_dir), 2, 8, max_lines=5)


def ranged_line_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_range_errors(inputs.document_lines(spark, sf_dir), 2, 8)


def _kept_lines(spark: SparkSession, sf_dir: str) -> str:
    path = shared_folder(spark, "kept")
    keep_lines(inputs.document_lines(spark, sf_dir), path)
    return path


def kept_ranged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_range(spark, _kept_lines(spark, sf_dir), 2, 8, max_lines=5)


def kept_ranged_line_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kept_range_errors(spark, _kept_lines(spark, sf_dir), 2, 8)


def _crashes(*detectors: str) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        return crashes.extract_crashes(inputs.log_lines(spark, sf_dir), detectors or crashes.DEFAULT_DETECTORS)

    return query


def kernel_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.kernel_blocks(inputs.log_lines(spark, sf_dir))


def file_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files.detect_file_types(inputs.log_lines(spark, sf_dir))


def files_by_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = files.files_by_type(file_types(spark, sf_dir))
    return lists.select("file_type", "part", F.array_join(F.col("files").cast("array<string>"), ",").alias("files"))


def _batch_and_history(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """All document lines as the new batch, the records of all conversation lines as the history."""
    empty = spark.createDataFrame([], "cleaned_log STRING")
    return clean_dedup(spark, sf_dir), history.new_records(clean(inputs.conversation_lines(spark, sf_dir)), empty)


def store_new_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.new_records(*_batch_and_history(spark, sf_dir)).drop("created_at")


def store_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history after two appends: the conversations, then those of the documents' keys that it lacks."""
    path = shared_folder(spark, "history")
    for lines in (inputs.conversation_lines(spark, sf_dir), inputs.document_lines(spark, sf_dir)):
        append_new(history.line_records(lines), path, dealt=True)
    return read_history(spark, path).drop("created_at")


def stored_key_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stored_keys(clean_dedup(spark, sf_dir))


def subtract_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.subtract_known(*_batch_and_history(spark, sf_dir))


def store_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.history_counts(*_batch_and_history(spark, sf_dir))


def known_duplicates_excluded(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = clean(inputs.benchmark_lines(spark, sf_dir)).select("cleaned_log").distinct()
    return clean(inputs.document_lines(spark, sf_dir), known_duplicates=known)


def _requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.requested(inputs.module_requests(spark, sf_dir), "c_custkey", "request")


def module_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.resolve_modules(_requested(spark, sf_dir), inputs.catalog(spark, sf_dir))


def module_unknown(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.unknown_modules(_requested(spark, sf_dir), inputs.catalog(spark, sf_dir))


def module_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.known_module_names(inputs.catalog(spark, sf_dir))


def _combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_ops.combine_patterns(inputs.patterns(spark, sf_dir))


def patterns_combined(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _combined(spark, sf_dir).orderBy("pattern")


def patterns_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pattern_ops.invalid_patterns(_combined(spark, sf_dir))


def _filtered(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    combined = materialize(_combined(spark, sf_dir))
    usable = pattern_ops.valid_patterns(combined)
    return pattern_ops.filter_lines(clean_dedup_logcat(spark, sf_dir), usable), combined


def pattern_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _filtered(spark, sf_dir)[0]


def _mapped(most: int) -> Query:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        filtered, combined = _filtered(spark, sf_dir)
        return pattern_ops.map_patterns(filtered, pattern_ops.valid_patterns(combined), most)

    return query


def pattern_mapping_all_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = clean_dedup_logcat(spark, sf_dir).select("file", "line_no", F.col("raw_log").alias("log"))
    combined = materialize(_combined(spark, sf_dir))
    return pattern_ops.map_patterns(lines, pattern_ops.valid_patterns(combined), 1)


def pattern_mapping_long_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = clean_dedup_logcat(spark, sf_dir).select("file", "line_no", F.col("raw_log").alias("log"))
    combined = materialize(pattern_ops.combine_patterns(inputs.long_patterns(spark, sf_dir)))
    return pattern_ops.map_patterns(lines, pattern_ops.valid_patterns(combined), 2)


def pattern_mapping_letters(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.document_lines(spark, sf_dir).withColumnRenamed("line", "log")
    combined = pattern_ops.combine_patterns(inputs.letter_patterns(spark))
    return pattern_ops.map_patterns(lines, pattern_ops.valid_patterns(combined), 2)


def pattern_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    filtered, combined = _filtered(spark, sf_dir)
    mapping = pattern_ops.map_patterns(filtered, pattern_ops.valid_patterns(combined), 2)
    return pattern_ops.mapping_stats(mapping, combined)


def parse_clean_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = inputs.log_lines(spark, sf_dir)
    plain = text.render_line(F.col("line_no"), F.col("line"))
    numbered = F.concat(F.col("file").cast("string"), F.lit(":"), plain)
    shown = F.when(F.col("line_no") % 3 == 0, plain).when(F.col("line_no") % 3 == 1, numbered).otherwise(F.col("line"))
    parsed = lines.select("file", F.col("line_no").alias("at"), text.parse_rendered(shown).alias("p"))
    return parsed.select("file", "at", "p.line_no", "p.log")


def rendered_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = rendered(inputs.log_lines(spark, sf_dir), "line")
    return shown.select("file", "line_no", text.rendered_tail(F.col("value")).alias("raw_log"))


def truncate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.truncate_lines(inputs.document_lines(spark, sf_dir), 300)


def truncate_content(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.truncate_whole_lines(F.col("text"), 300).alias("content"))


def truncate_chars(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.truncate_chars(F.col("text"), 120).alias("content"))


def char_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = inputs.table(spark, sf_dir, "documents")
    return docs.select("doc_id", text.char_length(F.col("text")).cast("bigint").alias("n_chars_no_lf"))


def used_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return budget.used_lines(inputs.document_lines(spark, sf_dir), max_chars=150, start=1, max_lines=4)


def markdown_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = inputs.table(spark, sf_dir, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    return markdown_rows(shown, ["s_suppkey"])


def think_removed(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = inputs.answers(spark, sf_dir, inputs.THINK_ANSWER)
    return told.select("conv_id", "turn", answers.without_think(F.col("answer")).alias("answer"))


def think_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = inputs.answers(spark, sf_dir, inputs.THINK_ANSWER)
    return told.select("conv_id", "turn", answers.think_content(F.col("answer")).alias("thought"))


def fence_markdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = inputs.answers(spark, sf_dir, inputs.MARKDOWN_ANSWER)
    return told.select("conv_id", "turn", answers.unfence_markdown(F.col("answer")).alias("answer"))


def fence_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = inputs.answers(spark, sf_dir, inputs.JSON_ANSWER)
    parsed = told.select("conv_id", "turn", answers.fenced_json(F.col("answer")).alias("v"))
    return parsed.select(
        "conv_id",
        "turn",
        F.try_variant_get("v", "$.conv", "bigint").alias("conv"),
        F.try_variant_get("v", "$.role", "string").alias("role"),
        F.try_variant_get("v", "$.share", "double").alias("share"),
        F.try_variant_get("v", "$.note", "string").alias("note"),
    )


def class_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    typed = inputs.table(spark, sf_dir, "part").selectExpr(
        "p_partkey", "CASE WHEN p_size % 11 < 10 THEN 'class_' || (p_size % 11) END AS class_type"
    )
    return typed.select("p_partkey", names.class_link(F.col("class_type"), CLASS_LINKS).alias("link"))


def archive_test_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.test_result_archives(inputs.archive_entries(spark, sf_dir))


def archive_bugreports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.bugreport_archives(inputs.archive_entries(spark, sf_dir))


def archive_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archives.archive_actions(inputs.archive_entries(spark, sf_dir))


def latest_logset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.latest_logset(inputs.logset_listing(spark, sf_dir))


def log_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.log_files(inputs.file_listing(spark, sf_dir)).select("path")


def files_kept_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return listing.kept_by_name(inputs.file_listing(spark, sf_dir), r"^F_.*[05]\.").select("path")


QUERIES: dict[str, Query] = {
    "clean_dedup": clean_dedup,
    "clean_dedup_logcat": clean_dedup_logcat,
    "clean_preview": clean_preview,
    "rendered_lines": rendered_lines,
    "url_lines_dropped": url_lines_dropped,
    "normalize_line": normalize_line,
    "stop_words_removed": stop_words_removed,
    "log_info": log_info,
    "error_lines": error_lines,
    "error_lines_logcat": error_lines_logcat,
    "error_counts_by_source": error_counts_by_source,
    "long_lines": long_lines,
    "grep_context": grep_context,
    "grep_context_down": grep_context_down,
    "grep_groups": grep_groups,
    "line_range": ranged_lines,
    "line_range_errors": ranged_line_errors,
    "kept_line_range": kept_ranged_lines,
    "kept_line_range_errors": kept_ranged_line_errors,
    "crash_debug": _crashes(crashes.DEBUG),
    "crash_runtime": _crashes(crashes.RUNTIME),
    "crash_native": _crashes(crashes.NATIVE),
    "crash_java": _crashes(crashes.JAVA),
    "crash_keywords": _crashes(crashes.KEYWORDS),
    "crash_kernel_panic": _crashes(crashes.PANIC),
    "crash_all": _crashes(),
    "kernel_blocks": kernel_blocks,
    "file_types": file_types,
    "files_by_type": files_by_type,
    "store_new_records": store_new_records,
    "stored_keys": stored_key_set,
    "subtract_known": subtract_known,
    "store_counts": store_counts,
    "store_committed": store_committed,
    "known_duplicates_excluded": known_duplicates_excluded,
    "module_lookup": module_lookup,
    "module_unknown": module_unknown,
    "module_names": module_names,
    "patterns_combined": patterns_combined,
    "patterns_invalid": patterns_invalid,
    "pattern_filter": pattern_filter,
    "pattern_mapping": _mapped(1),
    "pattern_mapping_top2": _mapped(2),
    "pattern_mapping_all_lines": pattern_mapping_all_lines,
    "pattern_mapping_long_list": pattern_mapping_long_list,
    "pattern_mapping_letters": pattern_mapping_letters,
    "pattern_stats": pattern_stats,
    "parse_clean_line": parse_clean_line,
    "rendered_tails": rendered_tails,
    "truncate_lines": truncate_lines,
    "truncate_content": truncate_content,
    "truncate_chars": truncate_chars,
    "char_lengths": char_lengths,
    "used_lines": used_lines,
    "markdown_table": markdown_table,
    "think_removed": think_removed,
    "think_extracted": think_extracted,
    "fence_markdown": fence_markdown,
    "fence_json": fence_json,
    "class_links": class_links,
    "archive_test_results": archive_test_results,
    "archive_bugreports": archive_bugreports,
    "archive_actions": archive_actions,
    "latest_logset": latest_logset,
    "log_files": log_files,
    "files_kept_by_name": files_kept_by_name,
}
