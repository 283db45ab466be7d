"""Concatenate and cut: all documents as one stream of ids, cut into windows of a fixed length.

Two passes: the first encodes each partition and counts its ids; running sums over one total per partition give every
document its place in the stream. The second cuts windows where rows of a partition follow each other; windows that a
stretch of rows covers only in part are boundary records, joined by window number. Nothing is cut off or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.llm.store import small, written
from lumberline.llm.tokens import ID, encode_documents

WINDOW = 2048
OUT_ID = np.dtype("<u4")
PIECE = "struct<doc_id:bigint, start:bigint, length:bigint, doc_tokens:bigint, offset:bigint>"
SEQUENCE = f"sequence_id bigint, n_tokens bigint, ids binary, pieces array<{PIECE}>"
PIECE_KIND = pa.struct([(name, pa.int64()) for name in ("doc_id", "start", "length", "doc_tokens", "offset")])


def placed(encoded: DataFrame) -> DataFrame:
    """Written ids with ``at``, the number of ids of all documents before: ``doc_id, at, n_tokens, ids``."""
    totals = encoded.groupBy("part").agg(F.max(F.col("part_start") + F.col("n_tokens")).alias("total"))
    earlier = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    bases = written(totals.select("part", F.coalesce(F.sum("total").over(earlier), F.lit(0)).cast("bigint").alias("base")), "bases")
    # One row per task: counted, so that the ids themselves need not be shuffled to meet it.
    return encoded.join(small(bases), "part").select("doc_id", (F.col("base") + F.col("part_start")).alias("at"), "n_tokens", "ids")


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary(), pa.list_(PIECE_KIND))
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["sequence_id", "n_tokens", "ids", "pieces"])


def _cutter(window: int):
    """Windows, or the parts of them, that consecutive rows cover."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        number, held, ids, pieces = -1, 0, [], []
        expected = -1
        for batch in batches:
            for doc, at, total, blob in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if at != expected and held:
                    out.append((number, held, b"".join(ids), pieces))
                    held, ids, pieces = 0, [], []
                expected = at + total
                done = 0
                while done < total:
                    place = at + done
                    if not held:
                        number = place // window
                    size = min(total - done, (number + 1) * window - place)
                    ids.append(np.frombuffer(blob, ID, size, done * ID.itemsize).astype(OUT_ID).tobytes())
                    pieces.append({"doc_id": doc, "start": done, "length": size, "doc_tokens": total, "offset": place % window})
                    held, done = held + size, done + size
                    if place + size == (number + 1) * window:
                        out.append((number, held, b"".join(ids), pieces))
                        held, ids, pieces = 0, [], []
                if len(out) >= 256:
                    yield _batch(out)
                    out = []
        if held:
            out.append((number, held, b"".join(ids), pieces))
        yield _batch(out)

    return run


def _join_parts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    """The parts of one window, at most its length together, in order of their offset."""
    rows = sorted(table.to_pylist(), key=lambda row: row["pieces"][0]["offset"])
    one = (key[0].as_py(), sum(r["n_tokens"] for r in rows), b"".join(r["ids"] for r in rows), [p for r in rows for p in r["pieces"]])
    return pa.Table.from_batches([_batch([one])])


def pack_placed(stream: DataFrame, window: int = WINDOW) -> DataFrame:
    """Sequences of a placed stream: ``sequence_id, n_tokens, ids, pieces``; the last one may be shorter."""
    cut = written(stream.mapInArrow(_cutter(window), SEQUENCE), "windows")
    whole = cut.where(F.col("n_tokens") == window)
    parts = cut.where(F.col("n_tokens") < window).groupBy("sequence_id").applyInArrow(_join_parts, SEQUENCE)
    return whole.unionByName(parts)


def pack(docs: DataFrame, path: str, end_id: int, window: int = WINDOW) -> DataFrame:
    """Pack whole documents, each with ``end_id`` after it, into sequences of ``window`` ids.

    Documents follow each other in the order of the tasks that read them. ``padded_length`` is the length that the
    sequence is to be padded to: the window, or its own length when that is a power of two; only the last sequence can
    be short. Null and empty texts are the end id alone; repeated rows are packed as often as they stand; no rows give
    no sequences; other columns are left out.
    """
    sequences = pack_placed(placed(written(encode_documents(docs, path, end_id), "ids")), window)
    n = F.col("n_tokens")
    own = n.bitwiseAND(n - 1) == 0
    return sequences.withColumn("padded_length", F.when(own, n).otherwise(F.lit(window).cast("bigint")))


def piece_rows(sequences: DataFrame) -> DataFrame:
    """A row per piece with the CRC of its ids: what tells whether every id of every document lies in one piece."""

    def with_crc(piece: Column) -> Column:
        size = OUT_ID.itemsize
        own = F.substring(F.col("ids"), (piece["offset"] * size + 1).cast("int"), (piece["length"] * size).cast("int"))
        return F.struct(piece.alias("piece"), F.crc32(own).alias("ids_crc32"))

    each = sequences.select("sequence_id", "padded_length", F.explode(F.transform("pieces", with_crc)).alias("own"))
    return each.select(
        "own.piece.doc_id", "own.piece.start", "own.piece.length", "own.ids_crc32", "own.piece.doc_tokens", "sequence_id", "own.piece.offset", "padded_length"
    )
