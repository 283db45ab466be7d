"""Text output: rendered lines per log, pattern lists and Markdown table rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.functions.text import render_line
from lumberline.sinks.buckets import write_text


def rendered(lines: DataFrame, text_col: str = "raw_log") -> DataFrame:
    """``(file, line_no, value)`` with ``Line n: text``."""
    return lines.select("file", "line_no", render_line(F.col("line_no"), F.col(text_col)).alias("value"))


def write_rendered(lines: DataFrame, path: str, text_col: str = "raw_log", mode: str = "errorifexists") -> None:
    """Write ``Line n: text`` in line order, in a fixed number of folders; see :mod:`lumberline.sinks.buckets`."""
    write_text(rendered(lines, text_col), path, mode)


def write_pattern_lists(combined: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Valid and invalid patterns, each sorted, under ``valid`` and ``invalid``."""
    for name, kept in (("valid", F.col("valid")), ("invalid", ~F.col("valid"))):
        combined.where(kept).select("pattern").orderBy("pattern").write.mode(mode).text(f"{path}/{name}")


def markdown_rows(df: DataFrame, order_by: list[str]) -> DataFrame:
    """Lines of a Markdown table: ``(section, order columns…, line)``, sections 0 and 1 being header and rule.

    Cells are not escaped. Sorted by section and the order columns the lines are the table.
    """
    spark = df.sparkSession
    cells = [F.coalesce(F.col(name).cast("string"), F.lit("None")) for name in df.columns]
    body = df.select(
        F.lit(2).alias("section"),
        *order_by,
        F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("line"),
    )
    head = [
        (0, "| " + " | ".join(df.columns) + " |"),
        (1, "| " + " | ".join(["---"] * len(df.columns)) + " |"),
    ]
    header = spark.createDataFrame(head, "section INT, line STRING")
    return body.unionByName(header, allowMissingColumns=True)


def write_markdown(df: DataFrame, path: str, order_by: list[str], mode: str = "errorifexists") -> None:
    ordered = markdown_rows(df, order_by).orderBy("section", *order_by)
    ordered.select("line").write.mode(mode).text(path)
