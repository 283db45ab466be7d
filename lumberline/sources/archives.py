"""Zip and tar archives: their entries, what kind of archive they are, the log lines inside, and what could not be read.

Every text entry, and every archive that ends before its time, has a status: ``ok``, ``damaged`` (lines before the damage
are kept), ``encrypted`` or ``unsupported``. No entry ends the job.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumberline.operators.archives import archive_actions
from lumberline.runtime import measured, written
from lumberline.sources.lines import BOM_HEAD_BYTES, BOM_HEAD_CHARS

ARCHIVE_NAME = r"(?i)\.(zip|tar|tar\.(gz|bz2|xz|lz|lzma|z))$"
ENTRY_SCHEMA = "archive STRING, pos BIGINT, entry STRING, is_dir BOOLEAN"
UNPACKED_SCHEMA = "file STRING, line_no BIGINT, line STRING, archive STRING, entry STRING, status STRING, encoding STRING"


def _archive_files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where(F.col("path").rlike(ARCHIVE_NAME)).select(F.col("path").alias("archive"), "content")


def archive_entries(spark: SparkSession, path: str) -> DataFrame:
    """Entry names of every archive below ``path``, as far as it can be read; unreadable archives have none."""

    def listed(batches: Iterator) -> Iterator:
        import io
        import lzma
        import tarfile
        import zipfile
        import zlib

        import pandas as pd

        def names(archive: str, content: bytes):
            if archive.lower().endswith(".zip"):
                with zipfile.ZipFile(io.BytesIO(content)) as opened:
                    yield from ((info.filename, info.is_dir()) for info in opened.infolist())
            else:
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as opened:
                    yield from ((member.name, member.isdir()) for member in opened)

        for batch in batches:
            for archive, content in zip(batch["archive"], batch["content"]):
                found = []
                try:
                    found.extend(names(archive, bytes(content)))
                except (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, OSError, EOFError, NotImplementedError):
                    pass  # the names before the damage count; unpacking reports it
                yield pd.DataFrame(
                    [(archive, pos, entry, is_dir) for pos, (entry, is_dir) in enumerate(found)],
                    columns=["archive", "pos", "entry", "is_dir"],
                )

    return _archive_files(spark, path).mapInPandas(listed, ENTRY_SCHEMA)


@dataclass(frozen=True)
class Unpacked:
    """Lines ``(file, line_no, line)`` and a row ``(archive, entry, status, encoding, lines)`` for each entry looked at."""

    lines: DataFrame
    entries: DataFrame


def _unpacker(nested: bool, batch_lines: int):
    head_bytes, head_chars = BOM_HEAD_BYTES, BOM_HEAD_CHARS
    columns = [field.split()[0] for field in UNPACKED_SCHEMA.split(", ")]

    def unpacked(batches: Iterator) -> Iterator:
        import io
        import lzma
        import tarfile
        import zipfile
        import zlib

        import pandas as pd

        damage = (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, OSError, EOFError)

        class Rejoined(io.RawIOBase):
            """A stream with the bytes that were read from it already."""

            def __init__(self, head: bytes, stream) -> None:
                self.head, self.stream = head, stream

            def readable(self) -> bool:
                return True

            def readinto(self, target) -> int:
                part = self.head[: len(target)] or self.stream.read(len(target))
                self.head = self.head[len(target) :]
                target[: len(part)] = part
                return len(part)

        def is_archive(name: str) -> bool:
            return name.lower().endswith((".zip", ".tar", ".tar.gz", ".tar.bz2", ".tar.xz"))

        def unzipped(source):
            with zipfile.ZipFile(source) as opened:
                for info in opened.infolist():
                    if info.is_dir():
                        continue
                    if info.flag_bits & 1:
                        yield info.filename, "encrypted", None
                        continue
                    try:
                        stream = opened.open(info)
                    except NotImplementedError:
                        yield info.filename, "unsupported", None
                    except RuntimeError:
                        yield info.filename, "encrypted", None
                    except damage:
                        yield info.filename, "damaged", None
                    else:
                        with stream:
                            yield info.filename, "ok", stream

        def untarred(source):
            with tarfile.open(fileobj=source, mode="r:*") as opened:
                for member in opened:
                    if member.isfile():
                        # Without the buffer, which would read on beyond a break and lose what stands before it.
                        yield member.name, "ok", opened.extractfile(member).detach()
                # A broken header in the middle ends the list like the blocks of zeros at the end do.
                opened.fileobj.seek(opened.offset)
                if opened.fileobj.read(512).strip(b"\0"):
                    yield None, "damaged", None

        def members(name: str, source):
            lower = name.lower()
            try:
                yield from unzipped(source) if lower.endswith(".zip") else untarred(source)
            except NotImplementedError:
                yield None, "unsupported", None
            except damage:
                yield None, "unsupported" if lower.endswith((".z", ".lz")) else "damaged", None

        def texts(archive: str, source, only, depth: int):
            """Entries with their archive: those to be read as text, and what could not be opened."""
            for entry, status, stream in members(archive, source):
                if entry is not None and only is not None and entry != only:
                    continue
                wanted = entry is None or entry.lower().endswith((".log", ".txt"))
                inner = entry is not None and depth and is_archive(entry)
                if wanted or (inner and status != "ok"):
                    yield archive, entry, status, stream
                elif inner:
                    try:
                        content = io.BytesIO(stream.read())
                    except damage:
                        yield archive, entry, "damaged", None
                    else:
                        yield from texts(f"{archive}!{entry}", content, None, depth - 1)

        def beginning(stream) -> tuple[bytes, bool]:
            """The first bytes, and whether the stream breaks inside them: read in pieces, to keep those before."""
            head = b""
            try:
                while len(head) < head_bytes and (piece := stream.read(512)):
                    head += piece
            except damage:
                return head, True
            return head, False

        def encoding_of(head: bytes) -> str:
            if head[:2] in (b"\xff\xfe", b"\xfe\xff"):
                return "utf-16"
            return "utf-16-le" if "\0" in head.decode("utf-8", errors="replace")[:head_chars] else "utf-8"

        def frame(rows: list) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=columns).astype({"line_no": "Int64"})

        for batch in batches:
            for archive, content, only in zip(batch["archive"], batch["content"], batch["only_entry"]):
                rows: list = []
                for holder, entry, status, stream in texts(archive, io.BytesIO(bytes(content)), only, 1 if nested else 0):
                    file, encoding = f"{holder}!{entry}", None
                    if stream is not None:
                        try:
                            head, broken = beginning(stream)
                            encoding = encoding_of(head)
                            if broken:
                                status, stream = "damaged", io.BytesIO()
                            whole = io.BufferedReader(Rejoined(head, stream))
                            for number, line in enumerate(io.TextIOWrapper(whole, encoding=encoding, errors="replace"), start=1):
                                rows.append((file, number, line.removesuffix("\n"), None, None, None, None))
                                if len(rows) >= batch_lines:
                                    yield frame(rows)
                                    rows = []
                        except damage:
                            status = "damaged"  # what was readable before is kept
                    rows.append((file, None, None, holder, entry, status, encoding))
                if rows:
                    yield frame(rows)

    return unpacked


def _unpacked_rows(spark: SparkSession, path: str, nested: bool, batch_lines: int) -> DataFrame:
    actions = measured(archive_actions(archive_entries(spark, path)).select("archive", "action", "only_entry"))
    # An archive without a readable entry has no action: it is opened, and says why.
    chosen = _archive_files(spark, path).join(actions.small(), "archive", "left").where("action IS NULL OR action <> 'skip'")
    return chosen.select("archive", "content", "only_entry").mapInPandas(_unpacker(nested, batch_lines), UNPACKED_SCHEMA)


def archive_lines(spark: SparkSession, path: str, nested: bool = False, batch_lines: int = 10_000) -> DataFrame:
    """Numbered lines of the ``.log`` and ``.txt`` entries, ``file`` being ``archive!entry``.

    A test-result archive yields nothing, a bug report only its main text. Entries are streamed out of the archive
    in batches of lines. With ``nested``, archives inside archives are opened one level deep. UTF-16 entries are told by
    their mark or by a NUL among their first characters. :func:`unpack` also says what could not be read.
    """
    return _unpacked_rows(spark, path, nested, batch_lines).where("status IS NULL").select("file", "line_no", "line")


def unpack(spark: SparkSession, path: str, nested: bool = False, batch_lines: int = 10_000) -> Unpacked:
    """Lines as :func:`archive_lines`, and the status of each entry; the archives are opened once.

    ``entry`` is null for an archive that ends before its time or cannot be opened. ``lines`` counts the lines read.
    """
    rows = written(_unpacked_rows(spark, path, nested, batch_lines))
    lines = rows.where("status IS NULL").select("file", "line_no", "line")
    counts = lines.groupBy("file").agg(F.count(F.lit(1)).alias("lines"))
    entries = rows.where("status IS NOT NULL").join(counts, "file", "left")
    return Unpacked(lines, entries.select("archive", "entry", "status", "encoding", F.coalesce("lines", F.lit(0)).alias("lines")))
