"""New records against the stored history, and lines not known to it."""

from __future__ import annotations

import datetime as dt
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.text import strip_blanks
from lumberline.operators.clean import with_key
from lumberline.sources.history import by_stretch, record_id


def _stamp(created_at: dt.datetime | None) -> Column:
    stamp = F.current_timestamp() if created_at is None else F.lit(created_at).cast("timestamp")
    return stamp.alias("created_at")


def _first(place: Column | str, raw: str) -> Column:
    """What a key's records are compared by: the first file, the first place in it, and the stripped line."""
    return F.struct("file", place, strip_blanks(F.col(raw)).alias("raw_log"))


def batch_records(cleaned: DataFrame, created_at: dt.datetime | None = None) -> DataFrame:
    """One record per key of cleaned lines, the first of them standing for it."""
    return cleaned.groupBy("cleaned_log").agg(F.min(_first("line_no", "raw_log")).alias("first")).select(
        record_id(F.col("cleaned_log")).alias("record_id"), "cleaned_log", F.col("first.raw_log").alias("raw_log"), _stamp(created_at)
    )


def _firsts():
    """The first row of each id in a batch, in the order of the batch: a frequent key is left once in some thousand rows.

    A function made here takes its code to the executors, which need not have this package.
    """

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column("id").dictionary_encode()
            if len(codes.dictionary) < batch.num_rows:
                keys = pa.table({"id": codes.indices, **{name: batch.column(name) for name in ("file", "place", "raw_log")}})
                order = pc.sort_indices(keys, sort_keys=[(name, "ascending") for name in keys.column_names], null_placement="at_start")
                order = order.to_numpy()
                ids = codes.indices.to_numpy()[order]
                batch = batch.take(pa.array(np.sort(order[np.concatenate([[True], ids[1:] != ids[:-1]])])))
            yield batch

    return firsts


def line_records(lines: DataFrame, created_at: dt.datetime | None = None) -> DataFrame:
    """The records of ``batch_records(clean(lines))``: the last line of a key in its first file.

    Lines are moved once, to the stretches of their ids, so that ``append_new`` need not move them again.
    """
    keyed = with_key(lines).select(
        F.unhex(record_id(F.col("cleaned_log"))).alias("id"),
        "file",
        (-F.col("line_no")).alias("place"),
        "cleaned_log",
        strip_blanks(F.col("line")).alias("raw_log"),
    )
    firsts = keyed.mapInArrow(_firsts(), keyed.schema)
    return (
        by_stretch(firsts)
        .groupBy("stretch", "id")
        .agg(F.min(F.struct("file", "place", "raw_log", "cleaned_log")).alias("first"))
        .select(F.lower(F.hex("id")).alias("record_id"), "first.cleaned_log", "first.raw_log", _stamp(created_at))
    )


def new_records(cleaned: DataFrame, history: DataFrame, created_at: dt.datetime | None = None) -> DataFrame:
    """Records for keys the history lacks, the first line of the batch standing for a key.

    The batch is reduced to one row per key before it meets the history; both sides are partitioned by the key once.
    """
    records = batch_records(cleaned, created_at)
    return records.join(history.select("cleaned_log"), "cleaned_log", "left_anti").select(records.columns)


def subtract_known(cleaned: DataFrame, history: DataFrame) -> DataFrame:
    """Cleaned lines whose key is not stored yet."""
    unknown = cleaned.join(history.select("cleaned_log"), "cleaned_log", "left_anti")
    return unknown.select("file", "line_no", "cleaned_log", "raw_log")


def history_counts(cleaned: DataFrame, history: DataFrame) -> DataFrame:
    """One row: lines processed, skipped as known, and new keys."""
    keys = cleaned.groupBy("cleaned_log").agg(F.count(F.lit(1)).alias("lines"))
    stored = history.select("cleaned_log").distinct().withColumn("is_stored", F.lit(True))
    is_new = F.col("is_stored").isNull()
    return keys.join(stored, "cleaned_log", "left").agg(
        F.coalesce(F.sum("lines"), F.lit(0)).alias("processed"),
        (F.coalesce(F.sum("lines"), F.lit(0)) - F.count_if(is_new)).alias("skipped"),
        F.count_if(is_new).alias("new"),
    )
