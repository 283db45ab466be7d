"""File listings: which files count as logs, which are kept by name, which log set is the newest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """Every file below ``path`` with size and modification time; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("mtime"), "length")


def base_name(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def log_files(listing: DataFrame) -> DataFrame:
    """Files ending in ``.log`` or ``.txt``; the full path stays, so equal base names do not overwrite each other."""
    return listing.where(F.lower("path").rlike(r"\.(log|txt)$"))


def kept_by_name(listing: DataFrame, pattern: str) -> DataFrame:
    """Files whose base name the pattern matches anywhere."""
    return listing.where(base_name(F.col("path")).rlike(pattern))


def latest_logset(listing: DataFrame) -> DataFrame:
    """Newest ``<module>_logset`` directory per module below ``<module>_wrapper`` or ``<module>_wraper``.

    ``listing`` holds directories as ``(path, mtime)``.
    """
    path = F.concat(F.lit("/"), F.lower("path"))
    leaf = base_name(path)
    module = F.substr(leaf, F.lit(1), F.length(leaf) - len("_logset"))
    wrapped = path.contains(F.concat(F.lit("/"), F.col("module"), F.lit("_wrapper/"))) | path.contains(
        F.concat(F.lit("/"), F.col("module"), F.lit("_wraper/"))
    )
    return (
        listing.where(leaf.endswith("_logset"))
        .withColumn("module", module)
        .where(wrapped)
        .groupBy("module")
        .agg(F.max(F.struct("mtime", "path")).alias("latest"))
        .select("module", F.col("latest.path").alias("path"))
    )
