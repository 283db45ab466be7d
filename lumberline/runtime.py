"""Session defaults, reliable cut points and the size check that guards every broadcast."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Lines of one file that share a cell. Windows run inside a cell, so no window partition is larger than this
# however large the file is; only one summary row per cell is ordered over the whole file.
CELL_LINES = 1 << 17

# Cells used to join lines with line ranges: small, so that few lines are compared with a range they miss.
RANGE_CELL = 256

# A side is broadcast only when it was counted and measured below this size.
BROADCAST_BYTES = 64 << 20

# Folders of the tables that the running job wrote, or None outside of jobs that delete theirs.
_job_tables: ContextVar[list[str] | None] = ContextVar("job_tables", default=None)


def build_session(cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session with the settings the library assumes; on a cluster use the cluster's own session."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("lumberline")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.driver.memory", "8g")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _checkpoint_folder(spark: SparkSession) -> None:
    """Use the folder the session names in ``spark.checkpoint.dir``; make a private one only in a local session."""
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = os.path.join(tempfile.mkdtemp(prefix="lumberline-"), "checkpoints")
    context.setCheckpointDir(folder)


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage with a reliable checkpoint, so that later branches do not repeat the work behind ``df``."""
    _checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new folder's path beside the checkpoints, where all executors can write."""
    _checkpoint_folder(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, compression: str = "snappy") -> DataFrame:
    """Write ``df`` as Parquet beside the checkpoints and read it from there: for large cuts that are read in columns."""
    spark = df.sparkSession
    folder = shared_folder(spark, "table")
    of_job = _job_tables.get()
    if of_job is not None:
        of_job.append(folder)
    df.write.option("compression", compression).parquet(folder)
    return spark.read.schema(df.schema).parquet(folder)


def _delete_tables(spark: SparkSession, folders: Iterable[str]) -> None:
    """Delete those of the folders that are tables beside the checkpoints."""
    ours = f"{spark.sparkContext.getCheckpointDir()}/table-"
    for folder in folders:
        place = spark._jvm.org.apache.hadoop.fs.Path(folder)
        if place.toUri().getPath().startswith(spark._jvm.org.apache.hadoop.fs.Path(ours).toUri().getPath()):
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def delete_written(df: DataFrame) -> None:
    """Delete the folder of a table that :func:`written` made and that nothing will read again."""
    _delete_tables(df.sparkSession, {name.rsplit("/", 1)[0] for name in df.inputFiles()})


@contextmanager
def job_tables(spark: SparkSession) -> Iterator[None]:
    """A job whose tables by :func:`written`, the raw copies of its logs among them, are deleted when it ends or fails.

    What the job returns must not read them any more.
    """
    folders: list[str] = []
    outer = _job_tables.set(folders)
    try:
        yield
    finally:
        _job_tables.reset(outer)
        _delete_tables(spark, folders)


@dataclass(frozen=True)
class Cut:
    """Materialized rows with what was measured while they were written.

    A task that ran twice may count twice, so ``size`` errs only towards not broadcasting.
    """

    rows: DataFrame
    size: int
    last_line: int

    @property
    def is_small(self) -> bool:
        return self.size <= BROADCAST_BYTES

    def small(self) -> DataFrame:
        """The rows, marked for broadcast when their size allows it; otherwise the join is left to Spark."""
        return F.broadcast(self.rows) if self.is_small else self.rows


def measured(df: DataFrame) -> Cut:
    """Materialize ``df`` and measure it in the same job: bytes held, and the highest ``line_no`` if there is one."""
    size = F.lit(0)
    for field in df.schema.fields:
        if isinstance(field.dataType, (T.StringType, T.BinaryType)):
            size = size + F.coalesce(F.octet_length(F.col(field.name)), F.lit(0)) + 40
        else:
            size = size + 16
    last_line = F.max("line_no") if "line_no" in df.columns else F.lit(None)
    seen = Observation()
    watched = df.observe(
        seen,
        F.coalesce(F.sum(size.cast("bigint")), F.lit(0)).alias("size"),
        F.coalesce(last_line.cast("bigint"), F.lit(0)).alias("last_line"),
    )
    rows = materialize(watched)
    return Cut(rows, seen.get["size"], seen.get["last_line"])


def spread(df: DataFrame, key: str) -> DataFrame:
    """Deal the rows of an input that has fewer splits than there are cores; a large input is left as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores, key) if df.rdd.getNumPartitions() < cores else df


def cell_of(line_no: Column, width: int) -> Column:
    """The cell of ``width`` consecutive lines a line is in."""
    return F.call_function("div", line_no, F.lit(width).cast("bigint"))
