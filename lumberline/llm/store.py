"""Folders that all executors share: written tables that cut the lineage, and files that tasks write and read."""

from __future__ import annotations

import os
import posixpath
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Broadcasts are allowed for tables that were written and counted below this many rows of a few numbers each.
SMALL_ROWS = 100_000

# Equal rows that are written out from one count together.
BUNDLE = 1 << 16


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Give the executors this package, once per application, so that they need no installed copy of it."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    package = Path(__file__).resolve().parent.parent
    archive = os.path.join(tempfile.mkdtemp(prefix="lumberline-code-"), f"{package.name}.zip")
    with zipfile.ZipFile(archive, "w") as packed:
        for path in sorted(package.rglob("*.py")):
            packed.write(path, path.relative_to(package.parent))
    context.addPyFile(archive)
    _shipped.add(context.applicationId)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder name under the session's ``spark.checkpoint.dir``; a local session without it gets its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        base = tempfile.mkdtemp(prefix="lumberline-llm-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, partitions: int | None = None) -> DataFrame:
    """Write ``df`` as Parquet to a new shared folder and read it from there: a lost executor repeats nothing before it."""
    spark = df.sparkSession
    ship_package(spark)
    folder = shared_folder(spark, name)
    (df.coalesce(partitions) if partitions else df).write.option("compression", "zstd").parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def discard(df: DataFrame) -> None:
    """Delete the files of a written table that nothing will read again, and let go of the shuffles that read it."""
    for uri in df.inputFiles():
        system, path = _at(uri)
        system.delete_file(path)
    df.sparkSession.sparkContext._jvm.System.gc()


def small(df: DataFrame) -> DataFrame:
    """A written table marked for broadcast when it counts few rows; else Spark joins by shuffle and splits hot keys."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def rows_with(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows as one column ``row`` beside keys made from them: no column of ``docs`` can clash with a key's name."""
    columns = [F.col("`{}`".format(name.replace("`", "``"))) for name in docs.columns]
    return docs.select(F.struct(*columns).alias("row"), *[key.alias(name) for name, key in keys.items()])


def each_copy(df: DataFrame, count: str) -> DataFrame:
    """Every row as often as its ``count`` says, numbered from 1 in ``copy``; dealt in bundles, so that no list is long."""
    bundles = df.withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"({count} - 1) div {BUNDLE}"))))
    own = F.least(F.lit(BUNDLE).cast("bigint"), F.col(count) - F.col("bundle") * BUNDLE)
    each = bundles.withColumn("copy", F.explode(F.sequence(F.lit(1).cast("bigint"), own)))
    return each.withColumn("copy", F.col("copy") + F.col("bundle") * BUNDLE).drop("bundle")


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri)


def create_file(folder: str, prefix: str):
    """Open a new file for writing. Its name is unique for each task attempt, so a repeated task disturbs nobody.

    Returns the name below ``folder`` and the stream. Files of attempts that failed are never named in a table.
    """
    name = f"{prefix}-{uuid.uuid4().hex}"
    system, path = _at(folder)
    system.create_dir(path, recursive=True)
    return name, system.open_output_stream(posixpath.join(path, name))


def open_file(folder: str, name: str):
    """Open a file of the folder for random reads."""
    system, path = _at(folder)
    return system.open_input_file(posixpath.join(path, name))


def local_path(folder: str, name: str) -> str | None:
    """The path of a file that this machine can map into memory, or None in a store without paths."""
    system, path = _at(folder)
    if not isinstance(system, fs.LocalFileSystem):
        return None
    return os.path.join(path, name)
