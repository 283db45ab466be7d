"""Files in, files out: numbering, decoding, archives, sinks, the four jobs and the stream."""

from __future__ import annotations

import csv
import datetime as dt
import glob
import io
import json
import os
import random
import tarfile
import zipfile
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lumberline import runtime
from lumberline.operators import history as line_operators
from lumberline.operators.clean import clean
from lumberline.operators.history import batch_records, line_records
from lumberline.operators.patterns import combine_patterns, map_patterns, valid_patterns
from lumberline.plans import jobs
from lumberline.sinks import buckets, tables, text
from lumberline.sinks import history as store
from lumberline.sources import archives, history, lines, listing, modules
from lumberline.sources.kept_lines import keep_lines, kept_range, kept_range_errors
from lumberline.streaming.history import history_writer

NOON = dt.datetime(2024, 1, 2, 12, 0, 0)


def by_file(frame):
    found = {}
    for row in sorted(frame.collect(), key=lambda r: (r["file"], r["line_no"])):
        found.setdefault(os.path.basename(row["file"]), []).append((row["line_no"], row["line"]))
    return found


def unhinted(frame):
    """A measured table that Spark must shuffle."""
    cut = runtime.measured(frame)
    return runtime.Cut(cut.rows.hint("merge"), cut.size, cut.last_line)


def numbered(*texts):
    return list(enumerate(texts, start=1))


@pytest.mark.parametrize("split_bytes", ["128m", "64k", "7k"])
@pytest.mark.parametrize("offsets", ["broadcast", "shuffled"])
def test_line_numbers_do_not_depend_on_the_splits(spark, tmp_path, split_bytes, offsets, monkeypatch):
    if offsets == "shuffled":
        monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
        monkeypatch.setattr("lumberline.sources.lines.measured", unhinted)
    rng = random.Random(3)
    for name in ("a.log", "b.log"):
        with open(tmp_path / name, "w", newline="") as out:
            for n in range(1, 4001):
                out.write(f"{n}:" + "x" * rng.randrange(60) + rng.choice(["\n", "\r\n", "\r"]))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        read = lines.read_lines(spark, str(tmp_path))
        assert read.count() == 8000
        assert read.where(F.col("line_no") != F.substring_index("line", ":", 1).cast("bigint")).count() == 0
        assert read.where(F.col("file").endswith("a.log")).count() == 4000
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_lines_survive_other_splits_at_the_action(spark, tmp_path):
    with open(tmp_path / "my log 100%+[1]*.log", "w") as out:
        out.writelines(f"{n}: text\n" for n in range(1, 400_001))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1m")
    try:
        read = lines.read_lines(spark, str(tmp_path))
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300k")
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "7")
        with open(tmp_path / "my log 100%+[1]*.log", "a") as out:
            out.write("grown\n")
        assert read.count() == 400_000
        assert read.where(F.col("line_no") != F.substring_index("line", ":", 1).cast("bigint")).count() == 0
        assert read.select("file").distinct().first()["file"].endswith("/my log 100%+[1]*.log")
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")


def test_wide_files_of_any_name(spark, tmp_path):
    names = ["a b.txt", "50%25.txt", "x[1].txt", "s*r.txt", "c+d{e}.txt"]
    for name in names:
        (tmp_path / name).write_bytes(b"\xff\xfe" + f"in {name}".encode("utf-16-le"))
    (tmp_path / "late.txt").write_text("line\n" * 20_000 + "\x00end\n")
    read = by_file(lines.read_lines(spark, str(tmp_path)))
    assert {name: read[name] for name in names} == {name: [(1, f"in {name}")] for name in names}
    assert len(read["late.txt"]) == 20_001 and read["late.txt"][-1] == (20_001, "\x00end")


def test_a_late_nul_keeps_a_file_in_splits(spark, tmp_path):
    (tmp_path / "k.log").write_text("line\n" * 5000 + "\x00\n")
    plan = lines.read_lines(spark, str(tmp_path))._jdf.queryExecution().toString()
    assert "binaryFile" not in plan


def test_encodings(spark, tmp_path):
    plain = "one é\nzwei\r\n\r三"
    (tmp_path / "utf8.txt").write_bytes(plain.encode())
    (tmp_path / "le_bom.txt").write_bytes(b"\xff\xfe" + plain.encode("utf-16-le"))
    (tmp_path / "be_bom.txt").write_bytes(b"\xfe\xff" + plain.encode("utf-16-be"))
    (tmp_path / "le.txt").write_bytes(plain.encode("utf-16-le"))
    (tmp_path / "bad.txt").write_bytes(b"a\xffb\x0bc\n\nlast")
    (tmp_path / "late_nul.txt").write_bytes(b"x" * 5000 + b"\n\x00y\n")
    (tmp_path / "empty.txt").write_bytes(b"")
    read = by_file(lines.read_lines(spark, str(tmp_path)))
    for name in ("utf8.txt", "le_bom.txt", "be_bom.txt", "le.txt"):
        assert read[name] == numbered("one é", "zwei", "", "三")
    assert read["bad.txt"] == numbered("a�b\x0bc", "", "last")
    assert read["late_nul.txt"] == numbered("x" * 5000, "\x00y")
    assert "empty.txt" not in read
    assert by_file(lines.read_lines(spark, str(tmp_path), errors="ignore"))["bad.txt"][0] == (1, "ab\x0bc")
    assert by_file(lines.decode_files(spark, str(tmp_path))) == read
    with pytest.raises(ValueError):
        lines.read_lines(spark, str(tmp_path), errors="strict")


def wide_file(rng, size):
    """Text with all line ends and with characters whose bytes look like a line feed across their border."""
    some = ["a", "é", "三", "ਅ一", "一ਅ", "਀\u000d", "\n", "\r\n", "\r", "ਊ\u0000", "\U0001f600", "x" * 40, "਀Ā", "ċ਀"]
    return "".join(rng.choice(some) for _ in range(size))


@pytest.mark.parametrize("split_bytes", ["128m", "5001"])
def test_utf16_files_are_read_in_splits(spark, tmp_path, split_bytes):
    rng = random.Random(5)
    texts = {f"{n}.log": wide_file(rng, size) for n, size in enumerate([0, 1, 2, 3, 5, 50, 3000])}
    texts |= {"plain.log": "".join(f"{n}: Größe {n * n}\n" for n in range(3000)), "dos.log": "a\r\n\r\n\r\nb", "blank.log": "\n", "open.log": "x\r\r"}
    for name, body in texts.items():
        (tmp_path / f"le {name}").write_bytes(b"\xff\xfe" + body.encode("utf-16-le"))
        (tmp_path / f"be {name}").write_bytes(b"\xfe\xff" + body.encode("utf-16-be"))
    (tmp_path / "bare.log").write_bytes(texts["plain.log"].encode("utf-16-le"))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
    try:
        read = by_file(lines.read_lines(spark, str(tmp_path)))
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    for name, body in texts.items():
        unified = body.replace("\r\n", "\n").replace("\r", "\n")
        want = numbered(*(unified[:-1] if unified.endswith("\n") else unified).split("\n")) if body else None
        assert read.get(f"le {name}") == want, name
        assert read.get(f"be {name}") == want, name
    assert read["bare.log"] == numbered(*texts["plain.log"].splitlines())


def test_a_lost_byte_damages_one_utf16_line(spark, tmp_path, monkeypatch):
    monkeypatch.setattr("lumberline.sources.wide_lines.LINE_RECORDS", 50)
    halves = [[f"{n}: text" for n in range(k, k + 400)] for k in (0, 400)]
    raw = [("\n".join(half) + "\n").encode("utf-16-le") for half in halves]
    broken = raw[0][:21] + raw[0][22:], raw[1][:4007] + raw[1][4008:]
    (tmp_path / "a.log").write_bytes(b"\xff\xfe" + broken[0] + broken[1] + b"\x41")
    read = by_file(lines.read_lines(spark, str(tmp_path)))["a.log"]
    want = numbered(*halves[0], *halves[1])
    assert [n for n, _ in read] == list(range(1, 802))
    wrong = [n for (n, got), (_, text) in zip(read, want) if got != text]
    assert len(wrong) == 2 and read[800] == (801, "�")


def test_lines_of_a_text_column(spark):
    frame = spark.createDataFrame([(1, "a\n\rb\r\nc\x0bd\n"), (2, ""), (3, "\n\n"), (4, "x"), (5, None)], "id INT, t STRING")
    rows = lines.lines_from_table(frame, "id", "t").orderBy("file", "line_no").collect()
    got = [(r["file"], r["line_no"], r["line"]) for r in rows]
    assert got == [(1, 1, "a"), (1, 2, ""), (1, 3, "b"), (1, 4, "c\x0bd"), (3, 1, ""), (3, 2, ""), (4, 1, "x")]


def test_line_range(log):
    frame = log({"a": [str(n) for n in range(1, 41)], "b": ["1", "2"]})
    assert [r["line"] for r in lines.line_range(frame, 0, 40).orderBy("line_no").collect()] == [str(n) for n in range(1, 21)]
    assert {r["file"] for r in lines.line_range(frame, 2, 3).collect()} == {"a"}
    assert [r["message"] for r in lines.line_range_errors(frame, 2, 3).collect()] == ["file has 2 lines, requested 2-3"]
    for bad in ((-1, 3), (5, 4)):
        with pytest.raises(ValueError):
            lines.line_range(frame, *bad)


def test_kept_lines_open_only_the_parts_of_a_range(spark, log, tmp_path):
    frame = log({"a": [str(n) for n in range(1, 41)], "b": ["1", "2"], "c": ["x", None, ""]}).coalesce(1)
    path = str(tmp_path / "kept")
    keep_lines(frame, path, part_lines=5)
    for bounds in ((0, 40), (2, 3), (12, 14), (39, 60)):
        ours, plain = kept_range(spark, path, *bounds), lines.line_range(frame, *bounds)
        assert sorted(map(tuple, ours.collect()), key=repr) == sorted(map(tuple, plain.collect()), key=repr)
        ours, plain = kept_range_errors(spark, path, *bounds), lines.line_range_errors(frame, *bounds)
        assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, plain.collect()))
    named = kept_range(spark, path, 12, 14, files=["a"])
    assert sorted(r["line"] for r in named.collect()) == ["12", "13", "14"]
    assert len([f for f in named.inputFiles() if "/lines/" in f]) == 1
    assert len(spark.read.parquet(f"{path}/lines").inputFiles()) == 9
    assert kept_range(spark, path, 1, 2, files=["none"]).count() == 0
    for bad in ((-1, 3), (5, 4)):
        with pytest.raises(ValueError):
            kept_range(spark, path, *bad)


def test_kept_lines_without_lines_or_logs(spark, log, tmp_path):
    schema = "file STRING, line_no BIGINT, line STRING"
    keep_lines(spark.createDataFrame([], schema), str(tmp_path / "none"))
    assert kept_range(spark, str(tmp_path / "none"), 1, 1).count() == 0
    assert kept_range_errors(spark, str(tmp_path / "none"), 1, 1).count() == 0
    keep_lines(spark.createDataFrame([(None, 1, "x")], schema), str(tmp_path / "null"))
    assert kept_range(spark, str(tmp_path / "null"), 1, 1).count() == 0


def test_jobs_leave_no_raw_copies(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.log").write_text("one error here\nsecond line\n")
    (tmp_path / "in" / "w.log").write_bytes("wide error\n".encode("utf-16"))
    beside = Path(spark.sparkContext.getCheckpointDir().removeprefix("file:"))
    before = set(beside.glob("table-*"))
    jobs.keep_log_lines(spark, str(tmp_path / "in"), str(tmp_path / "kept"))
    assert sorted(r["line"] for r in kept_range(spark, str(tmp_path / "kept"), 1, 1).collect()) == ["one error here", "wide error"]
    jobs.error_lines_to_text(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    jobs.clean_and_store(spark, str(tmp_path / "in"), str(tmp_path / "history"), clean_path=str(tmp_path / "clean"))
    with pytest.raises(Exception):
        jobs.keep_log_lines(spark, str(tmp_path / "in"), str(tmp_path / "kept"))
    assert set(beside.glob("table-*")) == before


def test_listings(spark, tmp_path):
    for name in ("a.LOG", "d/b.txt", "d/e/c.bin", "d/e/keep_1.txt"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    found = listing.list_files(spark, str(tmp_path))
    assert {os.path.basename(r["path"]) for r in listing.log_files(found).collect()} == {"a.LOG", "b.txt", "keep_1.txt"}
    assert {os.path.basename(r["path"]) for r in listing.kept_by_name(found, "^keep|bin$").collect()} == {"c.bin", "keep_1.txt"}
    sets = [
        ("/ws/Amp_Wrapper/1/amp_logset", 1),
        ("/ws/amp_wraper/2/AMP_LOGSET", 3),
        ("/ws/other_wrapper/3/amp_logset", 9),
        ("/ws/audio_wrapper/audio_logset", 2),
    ]
    frame = spark.createDataFrame(sets, "path STRING, mtime INT")
    assert {r["module"]: r["path"] for r in listing.latest_logset(frame).collect()} == {
        "amp": "/ws/amp_wraper/2/AMP_LOGSET",
        "audio": "/ws/audio_wrapper/audio_logset",
    }


def zipped(entries: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as archive:
        for name, content in entries.items():
            archive.writestr(name, content)
    return out.getvalue()


def tarred(entries: dict[str, bytes], mode: str) -> bytes:
    out = io.BytesIO()
    with tarfile.open(fileobj=out, mode=mode) as archive:
        for name, content in entries.items():
            info = tarfile.TarInfo(name)
            info.size = len(content)
            archive.addfile(info, io.BytesIO(content))
    return out.getvalue()


def test_archives(spark, tmp_path):
    inner = zipped({"deep.log": b"deep\n"})
    (tmp_path / "x.zip").write_bytes(zipped({"d/": b"", "d/a.LOG": b"1\r\n2\xff", "b.bin": b"no", "in.zip": inner}))
    (tmp_path / "y.tar.gz").write_bytes(tarred({"c.txt": "é\n".encode() * 3}, "w:gz"))
    (tmp_path / "z.tar.xz").write_bytes(tarred({"c.txt": b"z"}, "w:xz"))
    (tmp_path / "bugreport-1.zip").write_bytes(zipped({"other.txt": b"o", "bugreport-1.txt": b"core"}))
    results = ["test_result.xml", "test_result.html", "test_result_failures_suite.html", "module_reports/", "report-log-files/"]
    (tmp_path / "cts.zip").write_bytes(zipped({**{name: b"" for name in results}, "a.log": b"skip"}))
    (tmp_path / "broken.zip").write_bytes(b"PK no zip")
    (tmp_path / "plain.log").write_text("not an archive")

    entries = archives.archive_entries(spark, str(tmp_path)).where(F.col("archive").endswith("x.zip")).orderBy("pos")
    assert [(r["entry"], r["is_dir"]) for r in entries.collect()] == [
        ("d/", True),
        ("d/a.LOG", False),
        ("b.bin", False),
        ("in.zip", False),
    ]

    def read(**options):
        found = {}
        for row in archives.archive_lines(spark, str(tmp_path), **options).orderBy("file", "line_no").collect():
            found.setdefault(row["file"].split(f"{tmp_path}/")[1], []).append(row["line"])
        return found

    expected = {
        "x.zip!d/a.LOG": ["1", "2�"],
        "y.tar.gz!c.txt": ["é"] * 3,
        "z.tar.xz!c.txt": ["z"],
        "bugreport-1.zip!bugreport-1.txt": ["core"],
    }
    assert read() == expected
    assert read(nested=True, batch_lines=1) == {**expected, "x.zip!in.zip!deep.log": ["deep"]}


def patched(archive: bytes, name: str, flags: int | None = None, method: int | None = None) -> bytes:
    """An entry's flags or compression method changed in both of its heads."""
    out = bytearray(archive)
    for sign, at, size in ((b"PK\x03\x04", 6, 30), (b"PK\x01\x02", 8, 46)):
        place = out.find(sign)
        while place >= 0:
            if out[place + size : place + size + len(name)] == name.encode():
                if flags is not None:
                    out[place + at : place + at + 2] = flags.to_bytes(2, "little")
                if method is not None:
                    out[place + at + 2 : place + at + 4] = method.to_bytes(2, "little")
            place = out.find(sign, place + 1)
    return bytes(out)


def test_what_archives_cannot_give_is_reported(spark, tmp_path):
    body = {"good.log": b"fine\n", "locked.log": b"secret", "odd.log": b"odd", "wide.txt": "żółw\nzwei\n".encode("utf-16"), "wide le.log": "a\nb".encode("utf-16-le")}
    mixed = patched(patched(zipped(body), "locked.log", flags=1), "odd.log", method=99)
    (tmp_path / "mixed.zip").write_bytes(mixed)
    noise = random.Random(2).randbytes(60_000).hex().encode()
    deflated = io.BytesIO()
    with zipfile.ZipFile(deflated, "w", zipfile.ZIP_DEFLATED) as archive:
        archive.writestr("bad.log", b"first\n" + noise)
        archive.writestr("after.log", b"still here")
    broken = bytearray(deflated.getvalue())
    broken[40_000:40_050] = b"\xff" * 50
    (tmp_path / "broken.zip").write_bytes(bytes(broken))
    (tmp_path / "no.zip").write_bytes(b"PK no zip")
    tar = tarred({"one.log": b"1\n", "two.log": b"2\n" * 5000, "three.log": b"3"}, "w")
    (tmp_path / "short.tar").write_bytes(tar[:6000])
    (tmp_path / "header.tar").write_bytes(tar[:1024] + b"x" * 512 + tar[1536:])
    (tmp_path / "cut.tar.gz").write_bytes(tarred({"z.log": noise}, "w:gz")[:20_000])
    (tmp_path / "old.tar.z").write_bytes(b"\x1f\x9d..")
    (tmp_path / "outer.zip").write_bytes(zipped({"in.zip": mixed, "in.tar": b"no tar"}))

    found = archives.unpack(spark, str(tmp_path), nested=True)
    short = lambda name: name.split(f"{tmp_path}/")[1]
    status = {(short(r["archive"]), r["entry"]): (r["status"], r["encoding"]) for r in found.entries.collect()}
    of_mixed = {"good.log": ("ok", "utf-8"), "locked.log": ("encrypted", None), "odd.log": ("unsupported", None), "wide.txt": ("ok", "utf-16"), "wide le.log": ("ok", "utf-16-le")}
    assert status == {
        **{("mixed.zip", n): s for n, s in of_mixed.items()},
        **{("outer.zip!in.zip", n): s for n, s in of_mixed.items()},
        ("outer.zip!in.tar", None): ("damaged", None),
        ("broken.zip", "bad.log"): ("damaged", "utf-8"),
        ("broken.zip", "after.log"): ("ok", "utf-8"),
        ("no.zip", None): ("damaged", None),
        ("short.tar", "one.log"): ("ok", "utf-8"),
        ("short.tar", "two.log"): ("damaged", "utf-8"),
        ("short.tar", None): ("damaged", None),
        ("header.tar", "one.log"): ("ok", "utf-8"),
        ("header.tar", None): ("damaged", None),
        ("cut.tar.gz", "z.log"): ("damaged", "utf-8"),
        ("cut.tar.gz", None): ("damaged", None),
        ("old.tar.z", None): ("unsupported", None),
    }
    lines = {}
    for row in found.lines.orderBy("file", "line_no").collect():
        lines.setdefault(short(row["file"]), []).append(row["line"])
    assert lines["mixed.zip!wide.txt"] == ["żółw", "zwei"] and lines["mixed.zip!wide le.log"] == ["a", "b"]
    assert lines["outer.zip!in.zip!good.log"] == ["fine"] and lines["broken.zip!after.log"] == ["still here"]
    assert lines["broken.zip!bad.log"][0] == "first" and len(lines["short.tar!two.log"]) > 1000
    counted = {(short(r["archive"]), r["entry"]): r["lines"] for r in found.entries.collect() if r["entry"]}
    assert all(n == len(lines.get(f"{a}!{e}", [])) for (a, e), n in counted.items())


def text_of(spark, path):
    """Rendered lines of bucketed output, log by log."""
    rows = sorted(buckets.read_text(spark, path).collect(), key=lambda r: (r["file"], r["line_no"]))
    return "".join(f"Line {r['line_no']}: {r['log']}\n" for r in rows)


def test_logs_of_any_depth_and_number_share_folders(spark, tmp_path):
    deep = "/" + "/".join(f"folder number {i} of a long path=with % signs" for i in range(16)) + "/a.log"
    names = [deep, "/a b/ü?.log", "x"] + [f"/logs/{i}.log" for i in range(300)]
    rows = [(name, n, f"line: {n}\tof {i}") for i, name in enumerate(names) for n in range(1, 4)]
    frame = spark.createDataFrame(rows, "file STRING, line_no BIGINT, raw_log STRING")
    runtime._checkpoint_folder(spark)
    folder = spark.sparkContext.getCheckpointDir().removeprefix("file:")
    tables_left = lambda: sorted(glob.glob(f"{folder}/table-*/part-*"))
    before = tables_left()
    text.write_rendered(frame, f"{tmp_path}/clean")
    assert len(os.listdir(f"{tmp_path}/clean/lines")) <= buckets.BUCKETS + 2
    assert sorted(map(tuple, buckets.read_text(spark, f"{tmp_path}/clean").collect())) == sorted(rows)
    one = buckets.read_text(spark, f"{tmp_path}/clean", deep)
    assert [tuple(r) for r in one.orderBy("line_no").collect()] == rows[:3]
    assert "PartitionFilters: [isnotnull(bucket" in one._jdf.queryExecution().executedPlan().toString()
    with pytest.raises(FileNotFoundError):
        buckets.read_text(spark, f"{tmp_path}/clean", "/no.log")
    logs = buckets.read_logs(spark, f"{tmp_path}/clean").collect()
    assert {r["file"]: r["records"] for r in logs} == {name: 3 for name in names}
    # A log's lines stand in order in the files of its bucket.
    for part in glob.glob(f"{tmp_path}/clean/lines/bucket=*/part-*"):
        seen = {}
        for line in open(part):
            key, value = line.rstrip("\n").split("\t", 1)
            seen.setdefault(key, []).append(value)
        assert all(values == sorted(values) for values in seen.values())

    mapping = spark.createDataFrame([(deep, 2, 'say "x", y', ""), (deep, None, "z\\", "r"), ("x", 1, "", "")], "file STRING, line_no BIGINT, log STRING, regex STRING")
    tables.write_mapping_csv(mapping, f"{tmp_path}/mapping")
    assert sorted(map(repr, buckets.read_mapping(spark, f"{tmp_path}/mapping").collect())) == sorted(map(repr, mapping.collect()))
    assert buckets.read_mapping(spark, f"{tmp_path}/mapping", "x").collect() == [("x", 1, "", "")]
    text.write_rendered(frame.limit(0), f"{tmp_path}/none")
    assert buckets.read_logs(spark, f"{tmp_path}/none").count() == 0
    assert tables_left() == before


def written(path, pattern="*"):
    return "".join(open(f).read() for f in sorted(glob.glob(f"{path}/**/part-{pattern}", recursive=True)))


def test_sinks(spark, log, tmp_path):
    cleaned = log(["b", "a"]).select("file", "line_no", F.col("line").alias("raw_log"))
    text.write_rendered(cleaned, f"{tmp_path}/clean")
    assert text_of(spark, f"{tmp_path}/clean") == "Line 1: b\nLine 2: a\n"

    combined = combine_patterns(spark.createDataFrame([("b",), ("a",), ("(",)], "pattern STRING"))
    text.write_pattern_lists(combined, f"{tmp_path}/patterns")
    assert written(f"{tmp_path}/patterns/valid") == "a\nb\n" and written(f"{tmp_path}/patterns/invalid") == "(\n"

    rows = spark.createDataFrame([("a", 2, 'say "x", y', ""), ("a", None, "z", "r")], "file STRING, line_no BIGINT, log STRING, regex STRING")
    tables.write_mapping_csv(rows, f"{tmp_path}/mapping")
    parsed = [r for f in glob.glob(f"{tmp_path}/mapping/lines/*/*.csv") for r in csv.reader(open(f))]
    assert sorted(tuple(r[1:]) for r in parsed)[:2] == [("", "z", "r"), ("2", 'say "x", y', "")]
    assert ["key", "line_no", "log", "regex"] in parsed

    records = spark.createDataFrame([("i", "k", "raw, x", NOON)], history.RECORD_SCHEMA)
    tables.write_records_csv(records, f"{tmp_path}/records")
    assert set(written(f"{tmp_path}/records").splitlines()) == {
        "Cleaned Log,Raw Log,Created At",
        'k,"raw, x",2024-01-02 12:00:00',
    }

    people = spark.createDataFrame([(2, "b"), (1, None)], "n INT, v STRING")
    text.write_markdown(people, f"{tmp_path}/table", ["n"])
    assert written(f"{tmp_path}/table") == "| n | v |\n| --- | --- |\n| 1 | None |\n| 2 | b |\n"


def test_old_history_without_timestamps(spark, tmp_path):
    old = spark.createDataFrame([("k", "raw")], "cleaned_log STRING, raw_log STRING")
    old.write.parquet(f"{tmp_path}/h")
    assert history.read_history(spark, f"{tmp_path}/h").collect() == [(None, "k", "raw", None)]
    assert history.read_history(spark, f"{tmp_path}/none").count() == 0


LOG = ["Audio underrun 1", "Audio underrun 2", "http://x", "Video ok", "", "fatal exception"]


def test_store_twice_adds_nothing_and_subtract_sees_the_rest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(LOG) + "\n")
    logs, stored = f"{tmp_path}/in", f"{tmp_path}/history"
    assert jobs.clean_and_store(spark, logs, stored, f"{tmp_path}/clean", f"{tmp_path}/new", NOON) == 4
    assert jobs.clean_and_store(spark, logs, stored, created_at=NOON) == 0
    kept = history.read_history(spark, stored).collect()
    assert {(r["cleaned_log"], r["raw_log"]) for r in kept} == {
        ("Audio underrun", "Audio underrun 2"),
        ("Video ok", "Video ok"),
        ("", ""),
        ("fatal exception", "fatal exception"),
    }
    assert {r["created_at"] for r in kept} == {NOON}
    assert text_of(spark, f"{tmp_path}/clean").splitlines()[:2] == ["Line 2: Audio underrun 2", "Line 4: Video ok"]

    (tmp_path / "next").mkdir()
    (tmp_path / "next/b.log").write_text("Video ok 9\nNew thing\n")
    jobs.subtract(spark, f"{tmp_path}/next", stored, f"{tmp_path}/unknown")
    assert text_of(spark, f"{tmp_path}/unknown") == "Line 2: New thing\n"

    jobs.crashes_to_json(spark, logs, f"{tmp_path}/crashes")
    found = [json.loads(line) for line in written(f"{tmp_path}/crashes", "*.json").splitlines()]
    assert [(c["start_line"], c["full_stack_trace"]) for c in found] == [(6, "fatal exception\n")]


def keys_of(spark, path):
    return sorted(r["cleaned_log"] for r in history.read_history(spark, path).collect())


def records_of(spark, keys):
    rows = spark.createDataFrame([("f", n, key, f"raw {key}") for n, key in enumerate(keys)], "file STRING, line_no BIGINT, cleaned_log STRING, raw_log STRING")
    return batch_records(rows, NOON)


def test_records_of_lines_are_those_of_cleaned_lines(spark, log):
    frame = log({"b": ["Video ok 1", "Audio 2", "http://x", " Video ok 3 ", ""], "a": ["Audio 4", "Audio 5", "", ""]})
    assert sorted(line_records(frame, NOON).collect()) == sorted(batch_records(clean(frame), NOON).collect())
    assert {r["raw_log"] for r in line_records(frame, NOON).collect()} == {"Video ok 3", "Audio 5", ""}


def test_a_frequent_key_is_combined_before_lines_are_moved(spark):
    """The last line of the first file stands for a key, whatever the type of file and the order of the rows."""
    rows = [("b" if n % 3 else "a", n // 3, f" Audio {n % 7} ") for n in range(600)] + [("c", 1, "Video")]
    frame = spark.createDataFrame(rows[::-1], "file STRING, line_no BIGINT, line STRING").coalesce(1)
    found = {r["cleaned_log"]: r["raw_log"] for r in line_records(frame, NOON).collect()}
    assert found == {"Audio": f"Audio {597 % 7}", "Video": "Video"}
    assert sorted(line_records(frame, NOON).collect()) == sorted(batch_records(clean(frame), NOON).collect())
    batch = pa.record_batch({"id": [b"x", b"y", b"x", b"x"], "file": [2, 1, 1, 1], "place": [-9, -1, -2, -3], "cleaned_log": ["k", "l", "k", "k"], "raw_log": list("abcd")})
    assert [b.column("raw_log").to_pylist() for b in line_operators._firsts()(iter([batch]))] == [["b", "d"]]


def test_an_append_of_lines_moves_them_once(spark, log, tmp_path, monkeypatch):
    monkeypatch.setattr(history, "FOLDER_RECORDS", 2)
    write, seen = store._write_batch, []

    def watched(moved, *args):
        seen.append((str(moved._jdf.queryExecution().executedPlan().toString()), args[1:]))
        return write(moved, *args)

    monkeypatch.setattr(store, "_write_batch", watched)
    words = [f"{a}{b}zq word" for a in "klmnopqrst" for b in "uvwxyz"]
    for lines in (words[:40], words):
        store.append_new(line_records(log({"f": lines}), NOON), f"{tmp_path}/h", dealt=True)
    assert [args for _, args in seen] == [(2, True), (2, True)]
    assert not any("hashpartitioning" in plan for plan, _ in seen)
    assert keys_of(spark, f"{tmp_path}/h") == sorted(words)
    live = history.live_commits(history.read_commits(spark, f"{tmp_path}/h"))
    assert [c.records for c in live] == [40, 20]
    stored = history.read_batches(spark, f"{tmp_path}/h", live)
    placed = stored.select("record_id", F.regexp_extract(F.input_file_name(), "bucket=([^/]+)/", 1).alias("folder")).collect()
    assert all(r["record_id"].startswith(r["folder"]) and len(r["folder"]) == 2 for r in placed)


def test_appends_at_once_leave_no_key_twice(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/h"
    publish, others = store._publish, [["b", "c"], ["d", "e"]]

    def overtaken(session, where, commit):
        if others:
            store.append_new(records_of(spark, others.pop()), path)
        return publish(session, where, commit)

    monkeypatch.setattr(store, "_publish", overtaken)
    added = store.append_new(records_of(spark, ["a", "b", "d"]), path)
    assert keys_of(spark, path) == ["a", "b", "c", "d", "e"]
    assert [c.version for c in history.read_commits(spark, path)] == [1, 2, 3] and added.records == 1
    assert sorted(r["cleaned_log"] for r in store.committed_records(spark, path, added).collect()) == ["a"]
    assert store.append_new(records_of(spark, ["a", "c"]), path).records == 0
    assert len(history.read_commits(spark, path)) == 3


def test_threads_append_to_one_history(spark, tmp_path):
    path = f"{tmp_path}/h"
    batches = [[f"k{n}" for n in range(k, k + 12)] for k in (0, 4, 8, 12)]
    with ThreadPoolExecutor(4) as pool:
        counts = list(pool.map(lambda keys: store.append_new(records_of(spark, keys), path).records, batches))
    assert keys_of(spark, path) == sorted({key for keys in batches for key in keys}) and sum(counts) == 24


def test_a_job_that_died_is_run_again(spark, tmp_path, monkeypatch):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(LOG) + "\n")

    def run():
        return jobs.clean_and_store(spark, f"{tmp_path}/in", f"{tmp_path}/h", f"{tmp_path}/clean", f"{tmp_path}/csv", NOON, token="job 1")

    def dies(*args):
        raise RuntimeError("killed")

    with monkeypatch.context() as broken:
        broken.setattr(store, "_publish", dies)
        with pytest.raises(RuntimeError, match="killed"):
            run()
    assert keys_of(spark, f"{tmp_path}/h") == []
    with monkeypatch.context() as broken:
        broken.setattr(jobs, "write_records_csv", dies)
        with pytest.raises(RuntimeError, match="killed"):
            run()
    assert run() == 4 and run() == 4
    assert len(keys_of(spark, f"{tmp_path}/h")) == 4
    assert len(spark.read.csv(f"{tmp_path}/csv", header=True).collect()) == 4
    assert jobs.clean_and_store(spark, f"{tmp_path}/in", f"{tmp_path}/h", created_at=NOON, token="job 2") == 0


@pytest.mark.parametrize("digits", [0, 1, 2])
def test_an_append_reads_its_buckets_only(spark, tmp_path, monkeypatch, digits):
    monkeypatch.setattr(history, "FOLDER_RECORDS", 300 // 16**digits + 1)
    path = f"{tmp_path}/h"
    store.append_new(records_of(spark, [f"key {n}" for n in range(300)]), path)
    live = history.live_commits(history.read_commits(spark, path))
    bucket = records_of(spark, ["key 7"]).select(history.bucket_of(F.col("record_id"))).first()[0]
    folders = {f.split("bucket=")[1].split("/")[0] for f in history.read_batches(spark, path, live).inputFiles()}
    assert len(folders) == 1 if digits == 0 else {len(folder) for folder in folders} == {digits}
    part = history.read_batches(spark, path, live, [bucket])
    assert {r["record_id"][:digits] for r in part.collect()} == {bucket[:digits]}
    pruned = part._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    assert "bucket" in pruned
    assert store.append_new(records_of(spark, ["key 7", "key 300"]), path).records == 1


def test_compaction_keeps_every_record(spark, tmp_path):
    path = f"{tmp_path}/h"
    spark.createDataFrame([("old", "raw")], "cleaned_log STRING, raw_log STRING").write.parquet(path)
    assert store.append_new(records_of(spark, ["old", "a"]), path).records == 1
    store.append_new(records_of(spark, ["b"]), path)
    assert keys_of(spark, path) == ["a", "b", "old"]
    store.compact(spark, path)
    live = history.live_commits(history.read_commits(spark, path))
    assert len(live) == 1 and keys_of(spark, path) == ["a", "b", "old"]
    assert store.append_new(records_of(spark, ["old", "b", "c"]), path).records == 1
    store.compact(spark, path)
    assert keys_of(spark, path) == ["a", "b", "c", "old"]
    spark.createDataFrame([("old", "raw")], "cleaned_log STRING, raw_log STRING").write.parquet(f"{tmp_path}/plain")
    store.compact(spark, f"{tmp_path}/plain")
    assert store.append_new(records_of(spark, ["old", "new"]), f"{tmp_path}/plain").records == 1
    assert keys_of(spark, f"{tmp_path}/plain") == ["new", "old"]


def test_filter_modules(spark, tmp_path):
    (tmp_path / "audio.txt").write_text("underrun\n\n  audio \n(\n")
    (tmp_path / "video.txt").write_text("Video\n")
    catalog_rows = [
        {"module_name": "audio-hal", "regex_file_path": f"{tmp_path}/audio.txt", "regex_file_path2": "unused"},
        {"module_name": "Audio_HAL", "regex_file_path": f"{tmp_path}/video.txt"},
        {"module_name": "video", "regex_file_path": f"{tmp_path}/video.txt"},
    ]
    (tmp_path / "catalog.json").write_text(json.dumps(catalog_rows, indent=1))
    catalog = modules.load_catalog(spark, f"{tmp_path}/catalog.json")
    assert [r["pos"] for r in catalog.orderBy("pos").collect()] == [0, 1, 2]
    frame = spark.createDataFrame([("a", n, line) for n, line in enumerate(LOG, start=1)], "file STRING, line_no BIGINT, line STRING")

    result = jobs.filter_modules(spark, frame, "AUDIO HAL", catalog)
    assert [(r["line_no"], r["regex"]) for r in result.mapping.collect()] == [(2, "audio")]
    assert result.stats.first().asDict() == {
        "lines_total": 1,
        "lines_with_match": 1,
        "rows_written": 1,
        "invalid_patterns": 1,
    }
    both = jobs.filter_modules(spark, frame, "video, audiohal,,video", catalog, 2)
    assert sorted((r["line_no"], r["regex"]) for r in both.mapping.collect()) == [(2, "audio"), (2, "underrun"), (4, "Video")]
    for request in ("nope", "video,nope"):
        with pytest.raises(jobs.UnknownModules, match="nope; known: Audio_HAL, audio-hal, video"):
            jobs.filter_modules(spark, frame, request, catalog)

    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.log").write_text("\n".join(LOG) + "\n")
    jobs.filter_modules_to_files(spark, f"{tmp_path}/in", "AUDIO HAL", catalog, f"{tmp_path}/out")
    assert text_of(spark, f"{tmp_path}/out/filtered") == "Line 2: Audio underrun 2\n"
    assert written(f"{tmp_path}/out/patterns/invalid") == "(\n"
    assert written(f"{tmp_path}/out/patterns/valid") == "audio\nunderrun\n"
    assert [tuple(r)[1:] for r in buckets.read_mapping(spark, f"{tmp_path}/out/mapping").collect()] == [(2, "Audio underrun 2", "audio")]
    jobs.error_lines_to_text(spark, f"{tmp_path}/in", f"{tmp_path}/errors")
    assert text_of(spark, f"{tmp_path}/errors").splitlines() == ["Line 1: Audio underrun 1", "Line 2: Audio underrun 2", "Line 6: fatal exception"]
    with pytest.raises(jobs.UnknownModules):
        jobs.filter_modules(spark, frame, " , ", catalog)


def test_stream_stores_each_key_once(spark, tmp_path):
    (tmp_path / "in").mkdir()
    schema = "file STRING, line_no BIGINT, line STRING"
    for name, texts in (("1", ["alpha 1", "beta"]), ("2", ["alpha 2", "gamma"])):
        rows = [(name, n, line) for n, line in enumerate(texts, start=1)]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{tmp_path}/in/{name}")
        stream = spark.readStream.schema(schema).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
        writer = history_writer(stream, f"{tmp_path}/history").option("checkpointLocation", f"{tmp_path}/state")
        writer.trigger(availableNow=True).start().awaitTermination(120)
    kept = history.read_history(spark, f"{tmp_path}/history").collect()
    assert sorted(r["raw_log"] for r in kept) == ["alpha 1", "beta", "gamma"]


def test_mapping_of_nothing(spark):
    nothing = spark.createDataFrame([], "file STRING, line_no BIGINT, log STRING")
    usable = valid_patterns(combine_patterns(spark.createDataFrame([("a",)], "pattern STRING")))
    assert map_patterns(nothing, usable).count() == 0
