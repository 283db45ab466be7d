"""The stored history of log records: committed batches, each in folders by the first digits of its record ids.

``_batches/batch=…/bucket=…`` holds records, ``_commits`` one small file per version that names a batch. A batch that no
commit names is not part of the history. A commit may instead name a batch that replaces all up to a version. A plain
Parquet table in the folder itself, as older histories are, counts as records stored before the first version.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

RECORD_SCHEMA = T.StructType(
    [
        T.StructField("record_id", T.StringType()),
        T.StructField("cleaned_log", T.StringType()),
        T.StructField("raw_log", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
    ]
)
STORED_SCHEMA = T.StructType([*RECORD_SCHEMA.fields, T.StructField("batch", T.StringType()), T.StructField("bucket", T.StringType())])
COMMIT_SCHEMA = "version BIGINT, batch STRING, token STRING, replaces BIGINT, records BIGINT"

# A batch lies in folders by the first digits of the record ids, as many digits as leave a folder about so many records,
# and at most so many digits: 4 096 folders, whatever a batch holds. A small batch has one folder.
FOLDER_RECORDS = 1 << 20
MAX_DIGITS = 3
WHOLE = "all"


@dataclass(frozen=True)
class Commit:
    """A version of the history; ``replaces`` is the last version whose records its batch holds anew, 0 for none."""

    version: int
    batch: str
    token: str | None
    replaces: int
    records: int


def record_id(cleaned_log: Column) -> Column:
    return F.sha2(cleaned_log, 256)


def digits_for(records: int) -> int:
    """How many digits of a record id name the folders of a batch of so many records."""
    return next((d for d in range(MAX_DIGITS) if records <= FOLDER_RECORDS * 16**d), MAX_DIGITS)


def bucket_of(record: Column, digits: int = MAX_DIGITS) -> Column:
    return F.substring(record, 1, digits) if digits else F.lit(WHOLE)


def by_stretch(records: DataFrame) -> DataFrame:
    """Deal records by stretches of their ids, named in ``stretch``; a folder of a batch lies in one or a few of them."""
    stretches = min(16**MAX_DIGITS, 4 * int(records.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    first = F.conv(F.substring(F.hex("id"), 1, MAX_DIGITS), 16, 10).cast("int")
    stretch = F.coalesce(F.call_function("div", first * stretches, F.lit(16**MAX_DIGITS)), F.lit(0))
    return records.withColumn("stretch", stretch).repartition("stretch")


def read_commits(spark: SparkSession, path: str) -> list[Commit]:
    """All versions in order; there is one row per append, and none of its size grows with the records."""
    try:
        rows = spark.read.schema(COMMIT_SCHEMA).json(f"{path}/_commits").collect()
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return []
    return sorted((Commit(**row.asDict()) for row in rows), key=lambda commit: commit.version)


def live_commits(commits: list[Commit]) -> list[Commit]:
    """The commits whose batches make up the history: the last replacement and what it does not replace."""
    last = max((c for c in commits if c.replaces), key=lambda c: (c.replaces, c.version), default=None)
    if last is None:
        return commits
    return [c for c in commits if c is last or (c.version > last.replaces and not c.replaces)]


def read_batches(spark: SparkSession, path: str, commits: list[Commit], buckets: list[str] | None = None) -> DataFrame:
    """Records of the batches of some commits; of some buckets (first ``MAX_DIGITS`` digits), no folder without them is read."""
    if not commits:
        return spark.createDataFrame([], RECORD_SCHEMA)
    folder = f"{path}/_batches"
    stored = spark.read.schema(STORED_SCHEMA).option("basePath", folder).parquet(*[f"{folder}/batch={c.batch}" for c in commits])
    if buckets is not None:
        folders = {WHOLE} | {bucket[:digits] for bucket in buckets for digits in range(1, MAX_DIGITS + 1)}
        stored = stored.where(F.col("bucket").isin(sorted(folders)))
    return stored.select(RECORD_SCHEMA.names)


def read_plain(spark: SparkSession, path: str) -> DataFrame:
    """Records of a plain Parquet table; columns it lacks read as NULL, and a table not yet written is empty."""
    try:
        return spark.read.schema(RECORD_SCHEMA).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], RECORD_SCHEMA)


def read_history(spark: SparkSession, path: str) -> DataFrame:
    """All stored records: those of the live commits, and of a plain table where no commit has replaced it."""
    live = live_commits(read_commits(spark, path))
    stored = read_batches(spark, path, live)
    return stored if any(c.replaces for c in live) else stored.unionByName(read_plain(spark, path))


def stored_keys(history: DataFrame) -> DataFrame:
    return history.select(F.col("cleaned_log")).distinct()
