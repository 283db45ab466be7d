"""Clean-and-store for arriving lines: every micro-batch goes through the batch operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from lumberline.operators.history import line_records
from lumberline.sinks.history import append_new


def history_writer(lines: DataFrame, history_path: str) -> DataStreamWriter:
    """A stream writer that appends the unseen keys of each micro-batch of ``(file, line_no, line)``.

    A micro-batch reads the buckets of its keys only, and is in the history as a whole or not at all. One that is run
    again after a failure finds its keys stored and adds nothing, and so do streams that write to one history.
    """

    def store(batch: DataFrame, batch_id: int) -> None:
        append_new(line_records(batch), history_path, dealt=True)

    return lines.writeStream.foreachBatch(store)
