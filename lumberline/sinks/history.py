"""Appends to the stored history, each a commit: all of a batch is in the history or none of it, and no key twice.

A batch is written first and becomes part of the history with the file that commits it, which is renamed to the next
version and never over another file. Who finds the version taken leaves out what was committed meanwhile and tries the
next. So jobs that end early or run at once leave no key twice in local folders and where the file system renames in one
step, as HDFS does; an object store that can't must be written by one job at a time.
"""

from __future__ import annotations

import json
import os
import uuid
from dataclasses import replace

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.runtime import delete_written, measured, written
from lumberline.sources.history import (
    RECORD_SCHEMA,
    Commit,
    bucket_of,
    by_stretch,
    digits_for,
    live_commits,
    read_batches,
    read_commits,
    read_history,
    read_plain,
    record_id,
)


def _publish(spark: SparkSession, path: str, commit: Commit) -> bool:
    """Make the commit visible as its version, unless that version exists."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    folder = jvm.org.apache.hadoop.fs.Path(f"{path}/_commits")
    files = folder.getFileSystem(conf)
    folder = files.makeQualified(folder)
    draft = jvm.org.apache.hadoop.fs.Path(folder, f".{uuid.uuid4().hex}")
    out = files.create(draft, False)
    out.write(bytearray((json.dumps(commit.__dict__) + "\n").encode()))
    out.close()
    target = jvm.org.apache.hadoop.fs.Path(folder, f"{commit.version:020d}.json")
    if files.getScheme() == "file":
        # A local rename may overwrite; a link may not.
        try:
            os.link(draft.toUri().getPath(), target.toUri().getPath())
        except FileExistsError:
            return False
        finally:
            files.delete(draft, False)
        return True
    no_overwriting = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), conf).rename(draft, target, no_overwriting)
    except Py4JJavaError as refused:
        files.delete(draft, False)
        if not files.exists(target):
            raise refused
        return False
    return True


def _moved(records: DataFrame) -> DataFrame:
    """Records as they travel, with the bytes of their ids."""
    return records.select(F.unhex("record_id").alias("id"), *RECORD_SCHEMA.names[1:])


def _write_batch(moved: DataFrame, path: str, digits: int, dealt: bool) -> Commit:
    """Write records as a batch of the history, sorted in its folders; the result is not committed yet.

    Records that are ``dealt``, those of a folder in one or a few partitions, are written where they are.
    """
    batch = uuid.uuid4().hex
    named = moved.withColumn("record_id", F.lower(F.hex("id"))).withColumn("bucket", bucket_of(F.col("record_id"), digits))
    placed = named if dealt or not digits else named.repartition("bucket")
    ordered = placed.sortWithinPartitions("bucket", "id").select(*RECORD_SCHEMA.names, "bucket")
    ordered.write.partitionBy("bucket").option("compression", "zstd").parquet(f"{path}/_batches/batch={batch}")
    draft = Commit(0, batch, None, 0, 0)
    return replace(draft, records=read_batches(moved.sparkSession, path, [draft]).count())


def _write_unknown(dealt: DataFrame, known: DataFrame, path: str, digits: int) -> Commit:
    """Write those whose ids are not among the known ones: ids meet alone, and those found are broadcast when they are few."""
    found = measured(dealt.select("id").join(known.select(F.unhex("record_id").alias("id")), "id", "left_semi"))
    return _write_batch(dealt.join(found.small(), "id", "left_anti"), path, digits, found.is_small)


def append_new(candidates: DataFrame, path: str, token: str | None = None, dealt: bool = False) -> Commit:
    """Commit those of ``candidates``, one record per key, whose keys the history lacks; only their buckets are read.

    ``token`` names the append: where a commit has it already, that commit is returned and nothing is added. Without
    new records there is no commit; the result then has an empty batch name. ``dealt`` tells that the candidates lie by
    stretches of their ids, as those of ``line_records`` do.
    """
    spark = candidates.sparkSession
    commits = read_commits(spark, path)
    done = _with_token(commits, token)
    if done is not None:
        return done
    moved = _moved(candidates)
    cut = written(moved if dealt else by_stretch(moved).drop("stretch"), compression="zstd")
    buckets = [row["bucket"] for row in cut.select(bucket_of(F.lower(F.hex("id"))).alias("bucket")).distinct().collect()]
    digits = digits_for(cut.count())
    live = live_commits(commits)
    known = read_batches(spark, path, live, buckets).select("record_id")
    if not any(c.replaces for c in live):
        known = known.unionByName(read_plain(spark, path).select(record_id(F.col("cleaned_log")).alias("record_id")))
    draft = _write_unknown(cut, known, path, digits)
    delete_written(cut)
    while draft.records or token is not None:
        commit = replace(draft, version=commits[-1].version + 1 if commits else 1, token=token)
        if _publish(spark, path, commit):
            return commit
        seen, commits = {c.batch for c in commits}, read_commits(spark, path)
        done = _with_token(commits, token)
        if done is not None:
            return done
        meanwhile = [c for c in commits if c.batch not in seen and not c.replaces]
        known = read_batches(spark, path, meanwhile, buckets).select("record_id")
        draft = _write_unknown(_moved(read_batches(spark, path, [draft])), known, path, digits)
    return Commit(commits[-1].version if commits else 0, "", token, 0, 0)


def _with_token(commits: list[Commit], token: str | None) -> Commit | None:
    return next((c for c in commits if token is not None and c.token == token), None)


def committed_records(spark: SparkSession, path: str, commit: Commit) -> DataFrame:
    """The records that a commit added."""
    return read_batches(spark, path, [commit] if commit.batch else [])


def compact(spark: SparkSession, path: str) -> Commit:
    """Write the whole history as one batch that replaces all versions so far; appends may go on meanwhile."""
    commits = read_commits(spark, path)
    last = commits[-1].version if commits else 0
    records = read_history(spark, path).withColumn("record_id", record_id(F.col("cleaned_log")))
    draft = _write_batch(_moved(records), path, digits_for(records.count()), dealt=False)
    # A plain table that no commit came after is replaced too, so that the first version counts as replaced.
    commit = replace(draft, version=last + 1, replaces=max(last, 1))
    while not _publish(spark, path, commit):
        if last == 0:
            raise RuntimeError("the history got its first version while it was compacted; compact it again")
        commit = replace(commit, version=commit.version + 1)
    return commit
