"""Module catalog and pattern files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.functions.text import strip_blanks

CATALOG_SCHEMA = "module_name STRING, regex_file_path STRING"


def load_catalog(spark: SparkSession, path: str) -> DataFrame:
    """``(pos, module_name, regex_file_path)`` from a JSON array of modules; ``pos`` keeps the array order."""
    entries = spark.read.text(path, wholetext=True).select(
        F.posexplode(F.from_json("value", f"array<struct<{CATALOG_SCHEMA.replace(' STRING', ':string')}>>")).alias(
            "pos", "entry"
        )
    )
    return entries.select("pos", "entry.module_name", "entry.regex_file_path")


def load_patterns(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``(regex_file_path, pattern)``: one regex per line, stripped, blank lines dropped."""
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("regex_file_path"), "value")
    text = F.replace(F.make_valid_utf8("value"), F.lit("�"), F.lit(""))
    return raw.select("regex_file_path", strip_blanks(text).alias("pattern")).where("pattern <> ''")
