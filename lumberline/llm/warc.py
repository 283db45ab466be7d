"""WARC archives in seekable Zstandard bundles.

Records are grouped into frames that decompress on their own. After the frames stands a seek table in the seekable
format of Zstandard: a skippable frame with the sizes of all frames, so a reader finds any frame from the end of the
file. An index table maps each record to its file, frame and place inside the frame.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.llm.store import create_file, open_file, shared_folder, small, written

# Bytes of records after which a frame ends, and bytes of compressed frames after which a file ends.
FRAME_BYTES = 256 << 10
BUNDLE_BYTES = 64 << 20

# Fixed values of the seekable format: skippable frame number 14, and the magic at the very end.
SKIPPABLE_MAGIC = 0x184D2A5E
SEEKABLE_MAGIC = 0x8F92EAB1

INDEX = "page_id bigint, name string, frame int, place int, record_bytes int"
RECORD = "page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint"
NAMESPACE = uuid.UUID(int=0x5C1F0)


@dataclass(frozen=True)
class Archives:
    """Written bundles: their shared folder, and a row per record."""

    folder: str
    index: DataFrame


def payload(html: Column) -> Column:
    """The html in UTF-8; null as empty."""
    return F.coalesce(html, F.lit("")).cast("binary")


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """``page_id, url, html, refers_to``: for a payload that the page of a larger id has too, that page's id.

    Payloads of fewer than ``min_bytes`` bytes are never compared. Only digests are grouped, with counts combined
    before the shuffle; only pages of a payload that occurs again are looked up.
    """
    size = F.length(payload(F.col("html")))
    keyed = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", "html", F.when(size >= min_bytes, F.sha1(payload(F.col("html")))).alias("sha")
    )
    groups = keyed.where("sha IS NOT NULL").groupBy("sha").agg(F.max("page_id").alias("keep"), F.count("*").alias("n"))
    again = written(groups.where("n > 1").select("sha", "keep"), "warc-again")
    older = F.col("keep") > F.coalesce("page_id", F.lit(-(1 << 63)).cast("bigint"))
    return keyed.join(small(again), "sha", "left").select("page_id", "url", "html", F.when(older, F.col("keep")).alias("refers_to"))


def record_urn(page_id: int | None) -> str:
    """A name for the record of a page, the same in every run."""
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, str(page_id))}>"


def _digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _one_line(text: str) -> str:
    return "".join(c if c.isprintable() else f"%{ord(c):02X}" for c in text)


def record(page_id: int | None, url: str | None, html: str | None, refers_to: int | None) -> bytes:
    """One WARC record: an HTTP answer with its payload, or for a revisit the head of the answer alone."""
    body = (html or "").encode()
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(body)}\r\n\r\n".encode()
    block = head if refers_to is not None else head + body
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if refers_to is not None else 'response'}",
        f"WARC-Record-ID: {record_urn(page_id)}",
        f"WARC-Page-ID: {'' if page_id is None else page_id}",
        f"WARC-Target-URI: {_one_line(url or '')}",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Payload-Digest: sha1:{_digest(body)}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {record_urn(refers_to)}",
            f"WARC-Refers-To-Page-ID: {refers_to}",
        ]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """The fields of a record, the fields of its HTTP head, and the payload that it holds."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) if ": " in line else (line.rstrip(":"), "") for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    answer, _, held = block.partition(b"\r\n\r\n")
    return fields, dict(line.split(": ", 1) for line in answer.decode().split("\r\n")[1:]), held


class Bundle:
    """A file being written: frames, then the seek table."""

    def __init__(self, folder: str) -> None:
        self.name, self.stream = create_file(folder, "bundle")
        self.packer = zstandard.ZstdCompressor(level=3, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.held: list[bytes] = []
        self.size = self.written = 0

    def add(self, data: bytes) -> tuple[int, int]:
        """Frame and place of the record."""
        place = self.size
        self.held.append(data)
        self.size += len(data)
        frame = len(self.frames)
        if self.size >= FRAME_BYTES:
            self.end_frame()
        return frame, place

    def end_frame(self) -> None:
        if self.held:
            packed = self.packer.compress(b"".join(self.held))
            self.stream.write(packed)
            self.frames.append((len(packed), self.size))
            self.written += len(packed)
            self.held, self.size = [], 0

    def close(self) -> None:
        self.end_frame()
        table = b"".join(struct.pack("<II", *sizes) for sizes in self.frames) + struct.pack("<IBI", len(self.frames), 0, SEEKABLE_MAGIC)
        self.stream.write(struct.pack("<II", SKIPPABLE_MAGIC, len(table)) + table)
        self.stream.close()


def seek_table(stream) -> list[tuple[int, int, int]]:
    """Start, packed size and size of each frame, from the end of the file."""
    end = stream.size()
    stream.seek(end - 9)
    count, _, magic = struct.unpack("<IBI", stream.read(9))
    if magic != SEEKABLE_MAGIC:
        raise ValueError("no seek table")
    stream.seek(end - 9 - 8 * count)
    sizes = list(struct.iter_unpack("<II", stream.read(8 * count)))
    frames, at = [], 0
    for packed, size in sizes:
        frames.append((at, packed, size))
        at += packed
    return frames


def write_archives(planned: DataFrame, bundle_bytes: int = BUNDLE_BYTES) -> Archives:
    """Write the planned records where they are read; the index names only files of tasks that ended well."""
    folder = shared_folder(planned.sparkSession, "warc")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle = None
        for batch in batches:
            rows = []
            for page, url, html, refers_to in zip(*(batch.column(i) for i in range(4))):
                bundle = bundle or Bundle(folder)
                data = record(page.as_py(), url.as_py(), html.as_py(), refers_to.as_py())
                rows.append((page.as_py(), bundle.name, *bundle.add(data), len(data)))
                if bundle.written >= bundle_bytes:
                    bundle.close()
                    bundle = None
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in INDEX.split(", ")])
        if bundle:
            bundle.close()

    return Archives(folder, written(planned.mapInArrow(run, INDEX), "warc-index"))


def read_archives(archives: Archives) -> DataFrame:
    """What each record of the bundles says: ``page_id, payload_bytes, payload_digest, record_type, refers_to``.

    Frames are dealt to tasks and read once each, at the place that the seek table of their file gives. A response's
    size and digest are taken from the payload it holds and compared with its fields; a revisit has both in its fields.
    """
    frames = archives.index.groupBy("name", "frame").agg(F.sort_array(F.collect_list(F.struct("place", "record_bytes"))).alias("records"))
    spark, folder = archives.index.sparkSession, archives.folder
    # The index is small beside what it points to, so its bytes must not decide how many tasks read.
    tasks = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened = (None, None, None)
        unpacker = zstandard.ZstdDecompressor()
        for batch in batches:
            rows = []
            for frame in batch.to_pylist():
                if opened[0] != frame["name"]:
                    stream = open_file(folder, frame["name"])
                    opened = (frame["name"], stream, seek_table(stream))
                at, packed, size = opened[2][frame["frame"]]
                opened[1].seek(at)
                data = unpacker.decompress(opened[1].read(packed), max_output_size=size)
                rows += [_said(data[r["place"] : r["place"] + r["record_bytes"]]) for r in frame["records"]]
            columns = list(zip(*rows)) if rows else [[]] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], [f.split()[0] for f in RECORD.split(", ")])

    return frames.repartition(tasks).sortWithinPartitions("name", "frame").mapInArrow(run, RECORD)


def _said(data: bytes) -> tuple[int | None, int, str, str, int | None]:
    fields, answer, held = parse_record(data)
    page = int(fields["WARC-Page-ID"]) if fields["WARC-Page-ID"] else None
    size, digest = int(answer["Content-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "revisit":
        return page, size, digest, "revisit", int(fields["WARC-Refers-To-Page-ID"])
    if len(held) != size or _digest(held) != digest:
        raise ValueError(f"the payload of record {fields['WARC-Record-ID']} is damaged")
    return page, size, digest, "response", None


def archive_pages(pages: DataFrame, min_bytes: int = 0) -> Archives:
    """Write a record per page: the page of the largest id is the response of equal payloads, the others revisit it.

    Null html is an empty payload. Of pages that share the largest id and the payload, each is a response. Pages
    without an id never are what others refer to. Repeated rows give a record each; other columns are left out.
    """
    return write_archives(plan_records(pages, min_bytes))
