"""Output of many logs in a fixed number of folders, with a table that tells which log is where.

A record begins with the key of its log, a hash of the path, and lies in the folder of the key's bucket, so neither the
number of logs nor the length of their paths shows in the folders. The table of logs is written last: output without it
is not complete. A log is read from its bucket alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.functions.text import parse_rendered
from lumberline.runtime import delete_written, written

BUCKETS = 64
KEY_DIGITS = 24
LOGS = "key STRING, bucket INT, file STRING, records BIGINT, buckets INT"
MAPPING = "key STRING, line_no BIGINT, log STRING, regex STRING"


def log_key(file: Column) -> Column:
    """The key of a log: the first digits of the SHA-256 of its path."""
    return F.substring(F.sha2(file, 256), 1, KEY_DIGITS)


def bucket_of(key: Column, buckets: int) -> Column:
    return F.pmod(F.conv(F.substring(key, 1, 8), 16, 10).cast("bigint"), F.lit(buckets)).cast("int")


def _ordered(rows: DataFrame, buckets: int) -> DataFrame:
    """Rows with ``key`` and ``bucket``, a log's rows in order in as many parts as it needs."""
    keyed = rows.withColumn("key", log_key(F.col("file"))).withColumn("bucket", bucket_of(F.col("key"), buckets))
    return keyed.repartitionByRange("bucket", "key", "line_no").sortWithinPartitions("bucket", "key", "line_no")


def _write_logs(cut: DataFrame, path: str, mode: str, buckets: int) -> None:
    """Write the table of logs, which completes the output, and delete the cut that the output was made from."""
    logs = cut.groupBy("file").agg(F.count(F.lit(1)).alias("records")).withColumn("key", log_key(F.col("file")))
    logs = logs.select("key", bucket_of(F.col("key"), buckets).alias("bucket"), "file", "records", F.lit(buckets).alias("buckets"))
    logs.write.mode(mode).parquet(f"{path}/logs")
    delete_written(cut)


def write_text(rows: DataFrame, path: str, mode: str = "errorifexists", buckets: int = BUCKETS) -> None:
    """Write ``value`` of ``(file, line_no, value)``: each line has the log's key, a tab and the value."""
    cut = written(rows)
    line = F.concat("key", F.lit("\t"), F.col("value")).alias("value")
    _ordered(cut, buckets).select("bucket", line).write.partitionBy("bucket").mode(mode).text(f"{path}/lines")
    _write_logs(cut, path, mode, buckets)


def write_mapping(rows: DataFrame, path: str, mode: str = "errorifexists", buckets: int = BUCKETS) -> None:
    """Write ``(file, line_no, log, regex)`` as CSV with the log's key in front; a missing number is an empty field."""
    cut = written(rows.select("file", "line_no", "log", "regex"))
    out = _ordered(cut, buckets).select("bucket", "key", "line_no", "log", "regex")
    out.write.partitionBy("bucket").mode(mode).csv(f"{path}/lines", header=True, escape='"', emptyValue="", nullValue="")
    _write_logs(cut, path, mode, buckets)


def read_logs(spark: SparkSession, path: str) -> DataFrame:
    """The table of logs: ``key, bucket, file, records, buckets``."""
    return spark.read.schema(LOGS).parquet(f"{path}/logs")


def _of_logs(spark: SparkSession, records: DataFrame, path: str, file: str | None) -> DataFrame:
    """Records with the path of their log; of one log, from its bucket alone."""
    logs = read_logs(spark, path).select("key", "bucket", "file", "buckets").distinct()
    if file is not None:
        known = logs.where(F.col("file") == file).select("key", "bucket").head()
        if known is None:
            raise FileNotFoundError(f"no log {file} in {path}")
        return records.where((F.col("bucket") == known["bucket"]) & (F.col("key") == known["key"])).withColumn("file", F.lit(file))
    return records.join(logs.drop("buckets"), ["bucket", "key"])


def read_text(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """``(file, line_no, log)`` of rendered lines that :func:`write_text` wrote, of all logs or of one."""
    raw = spark.read.text(f"{path}/lines")
    at = KEY_DIGITS + 2
    parts = raw.select("bucket", F.substring("value", 1, KEY_DIGITS).alias("key"), F.expr(f"substring(value, {at})").alias("line"))
    parsed = parse_rendered(F.col("line"))
    return _of_logs(spark, parts, path, file).select("file", parsed["line_no"].alias("line_no"), parsed["log"].alias("log"))


def read_mapping(spark: SparkSession, path: str, file: str | None = None) -> DataFrame:
    """``(file, line_no, log, regex)`` that :func:`write_mapping` wrote, of all logs or of one."""
    raw = spark.read.schema(f"{MAPPING}, bucket INT").option("header", "true").option("escape", '"').option("multiLine", "false").csv(f"{path}/lines")
    named = _of_logs(spark, raw, path, file)
    return named.select("file", "line_no", *[F.coalesce(c, F.lit("")).alias(c) for c in ("log", "regex")])
