"""Requested modules against the catalog."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.functions.names import module_key, requested_modules


def requested(requests: DataFrame, id_col: str, request_col: str) -> DataFrame:
    """One row per request and module name: ``(id, module_name, module_key)``."""
    names = requests.select(id_col, F.explode(requested_modules(F.col(request_col))).alias("module_name"))
    return names.withColumn("module_key", module_key(F.col("module_name")))


def first_by_key(catalog: DataFrame) -> DataFrame:
    """The catalog row that answers for each normalised name: the first one."""
    first = F.min(F.struct("pos", "regex_file_path")).alias("first")
    keyed = catalog.withColumn("module_key", module_key(F.col("module_name")))
    return keyed.groupBy("module_key").agg(first).select("module_key", F.col("first.regex_file_path"))


def resolve_modules(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested modules the catalog knows, with their pattern file."""
    return wanted.join(first_by_key(catalog), "module_key").select(*wanted.columns, "regex_file_path")


def unknown_modules(wanted: DataFrame, catalog: DataFrame) -> DataFrame:
    """Requested modules the catalog does not know."""
    return wanted.join(first_by_key(catalog), "module_key", "left_anti").select(wanted.columns)


def known_module_names(catalog: DataFrame) -> DataFrame:
    return catalog.select("pos", "module_name")
