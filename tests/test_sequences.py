"""Sequence operators against plain loops on random lines, with cells small enough to be crossed often."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from lumberline import runtime
from lumberline.functions.heads import log_info
from lumberline.operators import blocks, budget, crashes, files, kernel, search

WIDTHS = (3, 1 << 17)


def shuffled(frame):
    """Rows in no particular order over several partitions: results must depend on line numbers only."""
    return frame.repartition(5, F.rand(3))


def head(tid: int) -> str:
    return f"03-05 10:11:12.345  1200  {tid} E "


def crash_file(rng: random.Random, size: int) -> list[str]:
    pool = [
        lambda: head(rng.randrange(3)) + "AndroidRuntime: FATAL EXCEPTION: main",
        lambda: "fatal exception without a head",
        lambda: head(rng.randrange(3)) + f"AndroidRuntime: Process: app{rng.randrange(9)}, PID: {rng.randrange(99)}",
        lambda: head(rng.randrange(3)) + "AndroidRuntime: at x",
        lambda: "AndroidRuntime without a head",
        lambda: f"03-05 10:11:12.345 D/Svc( {rng.randrange(3)}): #00 pc 0001f /lib/a",
        lambda: f"03-05 10:11:12.345 D/Svc( {rng.randrange(3)}): #01 pc 0001f /lib/a",
        lambda: head(rng.randrange(3)) + "DEBUG : " + " ".join(["***"] * 16),
        lambda: head(rng.randrange(3)) + "DEBUG : pid: 12, tid: 13, name: b >>> proc <<<",
        lambda: head(rng.randrange(3)) + "DEBUG : #00 pc 0001f inside a dump",
        lambda: head(rng.randrange(3)) + "W/Err( 12): java.lang.IllegalStateException: bad",
        lambda: head(rng.randrange(3)) + "x:  at a.b.C(D.java:1)",
        lambda: "noise",
    ]
    weights = [2, 1, 3, 3, 1, 2, 3, 2, 2, 2, 2, 3, 6]
    return [rng.choices(pool, weights)[0]() for _ in range(size)]


STARTS = {
    "debug": lambda s: " ".join(["***"] * 16) in s,
    "runtime": lambda s: "fatal exception" in s.lower(),
    "native": lambda s: "#00 pc " in s,
    "java": lambda s: "java.lang.IllegalStateException" in s,
}
MEMBERS = {
    "debug": lambda s: "DEBUG" in s,
    "runtime": lambda s: "AndroidRuntime" in s,
    "native": lambda s: "#00 pc " in s or "#01 pc " in s,
    "java": lambda s: "  at a.b" in s,
}


def tid_of(line: str) -> str | None:
    if line.startswith("03-05 10:11:12.345  1200"):
        return line.split()[3]
    return line.split("(")[1].split(")")[0].strip() if line.startswith("03-05") else None


def expected_blocks(detector: str, lines: list[str]) -> set[tuple]:
    found, current, owner = [], None, None
    for number, line in enumerate(lines, start=1):
        if STARTS[detector](line):
            current, owner = [(number, line)], tid_of(line)
            found.append(current)
        elif current and MEMBERS[detector](line) and tid_of(line) == owner:
            current.append((number, line))
    return {(b[0][0], b[-1][0], "".join(text + "\n" for _, text in b)) for b in found}


@pytest.mark.parametrize("width", WIDTHS)
def test_block_detectors_are_what_a_loop_finds(log, width):
    rng = random.Random(11)
    texts = {f"f{n}": crash_file(rng, rng.randrange(1, 120)) for n in range(12)}
    found = crashes.extract_crashes(shuffled(log(texts)), tuple(STARTS), width=width).collect()
    for detector in STARTS:
        for file, lines in texts.items():
            got = [r for r in found if r["detector"] == detector and r["file_name"] == file]
            assert {(r["start_line"], r["end_line"], r["full_stack_trace"]) for r in got} == expected_blocks(detector, lines)
            assert len(got) == len(expected_blocks(detector, lines))


def test_only_oversize_traces_come_in_parts(log):
    member = head(1) + "AndroidRuntime: "
    lines = [member + "FATAL EXCEPTION"] + ["x"] * 9 + [member + "Process: p, PID: 3", member + "Process: q, PID: 4"]
    small = ["fatal exception"] + ["x"] * 20 + ["AndroidRuntime"]
    frame = log({"large": lines, "small": small})

    def found(**limits):
        rows = crashes.extract_crashes(frame, ("runtime",), width=4, **limits).orderBy("file_name", "trace_part").collect()
        return [(r["start_line"], r["end_line"], r["process_name"], r["pid"], r["trace_part"], r["full_stack_trace"]) for r in rows]

    def text(*kept):
        return "".join(line + "\n" for line in kept)

    whole = (1, 12, "p", "3", 0, text(lines[0], *lines[10:]))
    tail = (1, 22, "Unknown", "Unknown", 0, text(small[0], small[-1]))
    assert found() == [whole, tail]
    assert found(trace_bytes=60) == [
        (1, 12, "p", "3", 0, text(lines[0])),
        (1, 12, "p", "3", 1, text(lines[10])),
        (1, 12, "p", "3", 2, text(lines[11])),
        tail,
    ]
    assert [row[4] for row in found(trace_bytes=10_000)] == [0, 0]


def test_crash_attributes(log):
    ruler = " ".join(["***"] * 16)
    lines = {
        "debug": [head(5) + f"DEBUG : {ruler}", head(5) + "DEBUG : pid: 7, tid: 8, name: b  >>> /bin/x <<<"],
        "runtime": [
            head(6) + "FATAL EXCEPTION Process: no, PID: 1",
            head(6) + "AndroidRuntime: Process: com.a b, PID: 42",
            head(6) + "AndroidRuntime: Process: other, PID: 43",
        ],
        "null tid": ["fatal exception", "AndroidRuntime", head(6) + "AndroidRuntime"],
        "native": ["03-05 10:11:12.345 D/Feed_1( 4410): #00 pc 0c05a1b2  /opt/x"],
        "avc": ['tombstoned: avc: denied for pid=9 comm="init x"', "x/system/bin/tombstoned( 31): y", "tombstoned: z"],
    }
    found = crashes.extract_crashes(log(lines)).collect()
    by_file = {}
    for r in sorted(found, key=lambda r: (r["file_name"], r["start_line"])):
        by_file.setdefault(r["file_name"], []).append((r["detector"], r["process_name"], r["pid"], r["end_line"]))
    assert by_file["debug"] == [("debug", "/bin/x", "7", 2)]
    assert by_file["runtime"] == [("runtime", "com.a b", "42", 3)]
    assert by_file["null tid"] == [("runtime", "Unknown", "Unknown", 2)]
    assert by_file["native"] == [("native", "Feed_1", "4410", 1)]
    assert by_file["avc"] == [
        ("keywords", "init x", "9", 1),
        ("keywords", "Unknown", "31", 2),
        ("keywords", "Unknown", "Unknown", 3),
    ]


@pytest.mark.parametrize("width", WIDTHS)
def test_kernel_panic_looks_back_200_lines(log, width):
    def panic(distance, before="x", after=9):
        return [before, "Hardware name: b"] + ["n"] * (distance - 1) + ["Kernel panic"] + [f"t{i}" for i in range(after)]

    texts = {
        "near": panic(199, "[1] CPU: 0 PID: 248 Comm: renderer x"),
        "far": panic(200),
        "end": panic(3, "PID: 5", after=2),
        "first": ["Hardware name and Kernel panic"],
        "two": ["Hardware name", "Kernel panic", "Kernel panic"],
    }
    found = crashes.extract_crashes(shuffled(log(texts)), ("kernel_panic",), width=width).collect()
    got = {(r["file_name"], r["start_line"], r["end_line"], r["process_name"], r["pid"]) for r in found}
    assert got == {
        ("near", 2, 207, "renderer", "248"),
        ("end", 2, 7, "kernel", "unknown"),
        ("first", 1, 1, "kernel", "unknown"),
        ("two", 1, 3, "kernel", "unknown"),
    }
    assert len(found) == 5  # both panics of one file share a range
    near = next(r for r in found if r["file_name"] == "near")
    assert near["full_stack_trace"] == "".join(line + "\n" for line in texts["near"][1:207])
    assert near["crash_type"] == "kernel_panic"


@pytest.mark.parametrize("width", WIDTHS)
def test_kernel_blocks_are_what_a_loop_finds(log, width):
    rng = random.Random(5)
    pool = [
        "Internal ERROR: x",
        "Oops: 1",
        "modules LINKED in: a",
        "---[ end trace 1 ]---",
        "ffffff80: Modules linked in: dump",
        "ffffff80: Oops: dump",
        "ffffff8000000000 1",
        "kernel panic - Modules linked in: both",
        "noise",
        "noise",
    ]
    texts = {f"f{n}": [rng.choice(pool) for _ in range(rng.randrange(1, 60))] for n in range(20)}

    def expected(lines):
        found, inside, first = [], None, None
        for number, line in enumerate(lines, start=1):
            low = line.lower()
            if inside is None and any(mark in low for mark in ("kernel panic", "internal error", "oops:")):
                inside, first = [], number
            if inside is not None and not line.startswith("ffffff80"):
                inside.append(line + "\n")
                if "modules linked in:" in low or "---[ end trace" in low:
                    found.append((first, number, "".join(inside)))
                    inside = None
        return found

    got = kernel.kernel_blocks(shuffled(log(texts)), width=width).collect()
    for file, lines in texts.items():
        mine = sorted((r["start_line"], r["end_line"], r["block"]) for r in got if r["file"] == file)
        assert mine == expected(lines)


@pytest.mark.parametrize("width", WIDTHS)
@pytest.mark.parametrize("inclusive", [True, False])
def test_running_total(spark, width, inclusive):
    rng = random.Random(2)
    rows = [(f, n, rng.randrange(5)) for f in "ab" for n in sorted(rng.sample(range(1, 90), 40))]
    frame = spark.createDataFrame(rows, "file STRING, line_no BIGINT, v BIGINT").repartition(4)
    got = {
        (r["file"], r["line_no"]): r["total"]
        for r in blocks.running_total(frame, F.col("v"), "total", width=width, inclusive=inclusive).collect()
    }
    for file, line_no, value in rows:
        before = sum(v for f, n, v in rows if f == file and n < line_no)
        assert got[file, line_no] == before + (value if inclusive else 0)


@pytest.mark.parametrize("direction, up, down", [("both", 2, 2), ("up", 2, 0), ("down", 0, 2)])
def test_grep_with_context(log, direction, up, down):
    rng = random.Random(9)
    texts = {f: [rng.choice(["hit", "x", "y", "z"]) for _ in range(700)] for f in "ab"}
    got = {
        (r["file"], r["line_no"]): r["is_match"]
        for r in search.grep(shuffled(log(texts)), "^hit$", context=2, direction=direction).collect()
    }
    for file, lines in texts.items():
        for number in range(1, 701):
            near = range(max(1, number - down), min(700, number + up) + 1)
            assert ((file, number) in got) == any(lines[n - 1] == "hit" for n in near)
            if (file, number) in got:
                assert got[file, number] == (lines[number - 1] == "hit")


def test_ranges_too_large_to_broadcast_give_the_same(log, spark, monkeypatch):
    rng = random.Random(8)
    texts = {f: [rng.choice(["Oops: hit", "x", "Modules linked in:", "y"]) for _ in range(600)] for f in "ab"}
    frame = shuffled(log(texts))

    def results():
        near = search.grep(frame, "hit", context=2)
        inside = kernel.kernel_blocks(frame, width=50)
        return near, inside

    def plan(frame):
        return frame._jdf.queryExecution().executedPlan().toString()

    expected = [sorted(map(tuple, r.collect())) for r in results()]
    monkeypatch.setattr(runtime, "BROADCAST_BYTES", -1)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shuffled_results = results()
        assert [sorted(map(tuple, r.collect())) for r in shuffled_results] == expected
        for plan_text in (plan(r).split("== Initial Plan ==")[0] for r in shuffled_results):
            # What is broadcast is the bounded table of touched cells; it stands below the shuffle of the lines.
            assert plan_text.count("BroadcastHashJoin") == 1
            joined = plan_text[plan_text.index("SortMergeJoin") :]
            assert joined.index("Exchange hash") < joined.index("BroadcastHashJoin")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_wide_context_of_many_matches(log):
    lines = ["hit" if n % 3 == 0 else "x" for n in range(2000)] + ["x"] * 3000
    got = search.grep(shuffled(log(lines)), "hit", context=1000)
    rows = got.collect()
    assert sorted(r["line_no"] for r in rows) == list(range(1, 2999 + 1))
    assert {r["line_no"] for r in rows if r["is_match"]} == set(range(1, 2000, 3))


def test_ranges_of_a_cell_are_merged(spark):
    ranges = spark.createDataFrame([("a", s, s + 4) for s in range(0, 200, 2)] + [("a", 400, 420)], "file STRING, start_line BIGINT, end_line BIGINT")
    merged = sorted(tuple(r) for r in blocks._merged_cells(ranges, 100).collect())
    assert merged == [("a", 0, 0, 99), ("a", 1, 100, 199), ("a", 2, 200, 202), ("a", 4, 400, 420)]


def test_match_groups_keep_order_and_split_huge_files(log):
    found = search.grep(log([f" hit {n}" for n in range(1, 8)]), "hit")
    rows = search.match_groups(found, group_bytes=60).orderBy("part").collect()
    assert [r["match_lines"] for r in rows] == [
        [f"line {n}: hit {n}" for n in range(1, 6)],
        [f"line {n}: hit {n}" for n in range(6, 8)],
    ]
    assert search.match_groups(search.grep(log(["hit"] * 12), "hit")).count() == 1


def test_search_helpers(log):
    lines = log(["ok", "it FAILED", "x" * 20])
    assert [r["line_no"] for r in search.error_lines(lines).collect()] == [2]
    assert [r["line_no"] for r in search.error_lines(lines, ["ok"]).collect()] == [1]
    assert search.short_lines(lines, 9).count() == 2
    with pytest.raises(ValueError):
        search.grep(lines, "x", 1, "sideways")


def test_file_types(log, spark):
    logcat, kern, banner = head(1) + "x", "[  12.5@1] x", "Hello world, Now in BL33Z"
    three = "03-05 10:11:12.345 100 200 300 E x"  # three numbers: no logcat line for this purpose
    texts = {
        "19 logcat": [logcat] * 19,
        "20 logcat": ["  " + logcat] * 20,
        "kernel first": [kern] * 20 + [logcat] * 30,
        "logcat first": [logcat] * 20 + [kern] * 30,
        "banner first": [banner] + [logcat] * 30,
        "banner late": [logcat] * 20 + [banner],
        "banner on logcat line": [logcat + banner] * 3,
        "three numbers": [three] * 30,
        "nothing": [""],
    }
    got = {r["file"]: r["file_type"] for r in files.detect_file_types(shuffled(log(texts))).collect()}
    assert got == {
        "19 logcat": "unknown",
        "20 logcat": "logcat",
        "kernel first": "kernel",
        "logcat first": "logcat",
        "banner first": "kernel",
        "banner late": "logcat",
        "banner on logcat line": "unknown",
        "three numbers": "unknown",
        "nothing": "unknown",
    }
    many = spark.range(95).selectExpr("'f' || id AS file", "IF(id % 2 = 0, 'kernel', 'logcat') AS file_type")
    lists = files.files_by_type(many, per_list=10).collect()
    assert sorted(f for r in lists for f in r["files"]) == sorted(f"f{n}" for n in range(95))
    assert len(lists) > 4


@pytest.mark.parametrize("width", WIDTHS)
def test_budgets_are_what_loops_count(log, width):
    rng = random.Random(4)
    texts = {f"f{n}": ["x" * rng.choice([0, 0, 1, 3, 9, 30]) for _ in range(rng.randrange(1, 25))] for n in range(25)}
    frame = shuffled(log(texts))

    def prefix(lines, limit):
        kept, left = [], limit
        for line in lines:
            if len(line) + 1 > left:
                break
            left -= len(line) + 1
            kept.append(line)
        return kept or [lines[0][:limit]]

    def used(lines, limit, start, most):
        total = count = 0
        for line in lines[start:]:
            if total + len(line) > limit:
                return count + (len(line) > limit)
            total, count = total + len(line), count + 1
            if count >= most:
                break
        return count

    for limit in (1, 7, 20, 60):
        got = budget.truncate_lines(frame, limit, width=width).collect()
        for file, lines in texts.items():
            mine = [r["line"] for r in sorted(got, key=lambda r: r["line_no"]) if r["file"] == file]
            assert mine == prefix(lines, limit)
    for limit, start, most in ((5, 0, 3), (12, 2, 50), (40, 1, 4)):
        got = {r["file"]: r["used"] for r in budget.used_lines(frame, limit, start, most, width=width).collect()}
        assert got == {file: used(lines, limit, start, most) for file, lines in texts.items()}


def test_log_info(apply):
    probes = [
        "01-04 07:07:55.737 10031  1454  1455 E AndroidRuntime: FATAL EXCEPTION: main",
        "01-04 07:07:55.737  1454  1456 E",
        "12-30 16:47:12.862 W/System.err( 2985): x",
        "  12-30　16:47:12.862 W/a b( 7): x",
        "01-04 07:07:55.737  1454 E x",
        "",
    ]
    told = [(r["type"], r["thread_id"]) for r in apply(probes, log_info)]
    extended, brief = "Logcat (ThreadTime extended)", "Logcat (Brief/Process)"
    assert told == [(extended, "1455"), (extended, "1456"), (brief, "2985"), (brief, "7"), ("Unknown", None), ("Unknown", None)]
