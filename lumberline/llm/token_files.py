"""Token-id files: canonical length-limited Huffman codes from global counts, in blocks that decode on their own.

A file holds whole documents in ascending order of their ids, in blocks of about a megabyte. A block has the documents'
ids and lengths, the coded bits, each document on a byte border, and the bit at which every 512th symbol of a document
starts. Any document, and any stretch of one, can be decoded without what stands before it.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumberline.llm import huffman
from lumberline.llm.store import create_file, open_file, shared_folder, written
from lumberline.llm.tokens import ID, ID_LIMIT, encode_documents

MAGIC = b"LLTK0001"
BLOCK_BYTES = 1 << 20
FILE_BYTES = 64 << 20
LEAST_FILE_BYTES = 2 << 20
HEAD = "<QQQ"
HEAD_BYTES = struct.calcsize(HEAD)
MANIFEST = "file bigint, name string, block bigint, block_at bigint, block_bytes bigint, block_tokens bigint, tokens_before bigint"


@dataclass(frozen=True)
class TokenFiles:
    """Written files: their shared folder, a row per block of them, and the code lengths."""

    folder: str
    manifest: DataFrame
    lengths: np.ndarray


def id_counts(encoded: DataFrame) -> np.ndarray:
    """How often each id occurs. A task sends a row per distinct id, so no more than the vocabulary meets anywhere."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(ID_LIMIT, np.int64)
        for batch in batches:
            total += np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), ID), minlength=ID_LIMIT)
        used = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(used), pa.array(total[used])], ["id", "n"])

    rows = encoded.select("ids").mapInArrow(run, "id bigint, n bigint").groupBy("id").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(ID_LIMIT, np.int64)
    for row in rows:
        counts[row["id"]] = row["n"]
    return counts


def _coded(encoded: DataFrame, lengths: np.ndarray, edges: list[int]) -> DataFrame:
    """Each document's bits and checkpoints, with the number of its file.

    ``edges`` are document ids between the files. Where one id fills several files, its rows are dealt to all of them.
    """
    codes = huffman.canonical_codes(lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.array(edges, np.int64)
        for batch in batches:
            ids = batch.column(0).fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
            low, high = np.searchsorted(edge, ids, "left"), np.searchsorted(edge, ids, "right")
            bits, marks, spread = [], [], []
            for value in batch.column(2):
                packed, starts = huffman.pack(np.frombuffer(value.as_buffer(), ID), codes, lengths)
                bits.append(packed)
                marks.append(starts.astype("<u8").tobytes())
                spread.append(zlib.crc32(packed))
            file = low + np.array(spread, np.int64) % (high - low + 1)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(file.astype(np.int32)), pa.array(bits, pa.binary()), pa.array(marks, pa.binary())],
                ["doc_id", "n_tokens", "file", "bits", "marks"],
            )

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id bigint, n_tokens bigint, file int, bits binary, marks binary")


def _writer(folder: str, lengths: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, rows, before = None, [], 0
        docs, sizes, nulls, bits, marks, held = [], [], [], [], [], 0
        file = at = 0

        def flush() -> None:
            nonlocal at, before, docs, sizes, nulls, bits, marks, held
            places = (np.cumsum([len(b) for b in bits]) - [len(b) for b in bits]).astype("<u8")
            index = zlib.compress(
                np.array(docs, "<i8").tobytes() + np.array(nulls, "u1").tobytes() + np.array(sizes, "<u8").tobytes() + places.tobytes() + b"".join(marks), 1
            )
            payload = b"".join(bits)
            stream.write(struct.pack(HEAD, len(docs), len(index), len(payload)) + index + payload)
            size = HEAD_BYTES + len(index) + len(payload)
            rows.append((file, name, len(rows), at, size, sum(sizes), before))
            at, before = at + size, before + sum(sizes)
            docs, sizes, nulls, bits, marks, held = [], [], [], [], [], 0

        for batch in batches:
            for doc, n, number, packed, starts in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if stream is None:
                    file = number
                    name, stream = create_file(folder, f"tokens-{number:06d}")
                    head = zlib.compress(lengths.tobytes(), 6)
                    stream.write(MAGIC + struct.pack("<Q", len(head)) + head)
                    at = len(MAGIC) + 8 + len(head)
                docs.append(doc or 0)
                nulls.append(doc is None)
                sizes.append(n)
                bits.append(packed)
                marks.append(starts)
                held += len(packed)
                if held >= BLOCK_BYTES:
                    flush()
        if stream is not None:
            if docs:
                flush()
            stream.close()
        columns = list(zip(*rows)) if rows else [[]] * 7
        kinds = [pa.int64(), pa.string(), *[pa.int64()] * 5]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in MANIFEST.split(", ")])

    return run


def write_token_files(encoded: DataFrame, file_bytes: int = FILE_BYTES) -> TokenFiles:
    """Write the encoded documents (see :func:`encode_documents`, already written) in ascending order of ``doc_id``.

    Null ids come first, rows of one id in any order. Bits, not texts or ids, are shuffled: once, to the file of each
    document. No file is larger than about ``file_bytes``, and a file is written by one task in bounded blocks.
    """
    spark = encoded.sparkSession
    counts = id_counts(encoded)
    lengths = huffman.code_lengths(counts)
    coded_bytes = int((counts * lengths).sum()) // 8
    files = max(-(-coded_bytes // file_bytes), min(spark.sparkContext.defaultParallelism, -(-coded_bytes // LEAST_FILE_BYTES)), 1)
    edges: list[int] = []
    if files > 1:
        points = [i / files for i in range(1, files)]
        found = encoded.agg(F.percentile_approx("doc_id", F.array(*map(F.lit, points)), F.lit(max(10_000, 20 * files)))).head()[0]
        edges = sorted(found or [])
    folder = shared_folder(spark, "tokens")
    coded = _coded(encoded, lengths, edges)
    placed = coded.repartitionById(files, F.col("file")).sortWithinPartitions(F.col("doc_id").asc_nulls_first())
    manifest = written(placed.mapInArrow(_writer(folder, lengths), MANIFEST), "token-blocks")
    return TokenFiles(folder, manifest, lengths)


def read_token_files(files: TokenFiles) -> DataFrame:
    """The documents of the files, block by block: ``doc_id, start, n_tokens, ids``.

    ``start`` counts the ids of all documents before: those of earlier files by a running sum over one row per file,
    those of earlier blocks as the manifest has them. ``ids`` are little-endian four-byte numbers.
    """
    spark = files.manifest.sparkSession
    totals = files.manifest.groupBy("file", "name").agg(F.sum("block_tokens").alias("tokens"))
    order = Window.orderBy("file", "name").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("file", "name", F.coalesce(F.sum("tokens").over(order), F.lit(0)).cast("bigint").alias("base"))
    blocks = files.manifest.join(bases, ["file", "name"]).select(
        "name", "block_at", "block_bytes", (F.col("base") + F.col("tokens_before")).alias("start")
    )
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    folder, lengths = files.folder, files.lengths

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = huffman.decode_table(lengths)
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(folder, row["name"]) as stream:
                    stream.seek(row["block_at"])
                    data = stream.read(row["block_bytes"])
                yield _block(data, row["start"], table)

    return blocks.repartition(tasks).mapInArrow(run, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def _block(data: bytes, start: int, table: tuple[np.ndarray, np.ndarray]) -> pa.RecordBatch:
    n, index_size, payload_size = struct.unpack_from(HEAD, data)
    index = zlib.decompress(data[HEAD_BYTES : HEAD_BYTES + index_size])
    payload = data[HEAD_BYTES + index_size : HEAD_BYTES + index_size + payload_size]
    docs = np.frombuffer(index, "<i8", n)
    nulls = np.frombuffer(index, "u1", n, 8 * n).astype(bool)
    sizes = np.frombuffer(index, "<u8", n, 9 * n).astype(np.int64)
    places = np.frombuffer(index, "<u8", n, 17 * n).astype(np.int64)
    marks = np.frombuffer(index, "<u8", -1, 25 * n).astype(np.int64)
    runs = -(-sizes // huffman.CHECKPOINT)
    doc_of_run = np.repeat(np.arange(n), runs)
    nth = np.arange(len(doc_of_run)) - np.repeat(np.cumsum(runs) - runs, runs)
    counts = np.minimum(huffman.CHECKPOINT, sizes[doc_of_run] - nth * huffman.CHECKPOINT)
    symbols = huffman.unpack(payload, marks + 8 * places[doc_of_run], counts, table).astype("<u4").tobytes()
    ends = np.cumsum(sizes)
    rows = [symbols[4 * (end - size) : 4 * end] for size, end in zip(sizes.tolist(), ends.tolist())]
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, mask=nulls), pa.array(start + ends - sizes), pa.array(sizes), pa.array(rows, pa.binary())],
        ["doc_id", "start", "n_tokens", "ids"],
    )


def token_files(docs: DataFrame, path: str, end_id: int) -> TokenFiles:
    """Encode whole texts once, keep the ids in the shared folder, and write them as coded files."""
    return write_token_files(written(encode_documents(docs, path, end_id), "ids"))
