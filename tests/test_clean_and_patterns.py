"""Dedup, history and pattern operators."""

from __future__ import annotations

import random
import re
import time
import warnings

import pytest
from pyspark.sql import functions as F

from lumberline.operators import archives, history, modules, patterns
from lumberline.operators.clean import clean


def test_last_line_of_a_key_wins(log):
    lines = ["Alpha one 1", "beta", "", "Alpha one 2", "http://only/url", "7", "alpha one"]
    got = {(r["line_no"], r["cleaned_log"], r["raw_log"]) for r in clean(log(lines)).collect()}
    assert got == {(4, "Alpha one", "Alpha one 2"), (2, "beta", "beta"), (6, "", "7"), (7, "alpha one", "alpha one")}


def test_url_only_and_empty_inputs_give_nothing(log, spark):
    assert clean(log(["http://a", "https://b"])).count() == 0
    assert clean(spark.createDataFrame([], "file STRING, line_no BIGINT, line STRING")).count() == 0


def test_cleaning_twice_changes_nothing(log):
    once = clean(log([f"word{n % 7} tail {n}" for n in range(50)]))
    again = clean(once.select("file", "line_no", F.col("raw_log").alias("line")))
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, once.collect()))


def test_known_duplicates_are_left_out(log, spark):
    known = spark.createDataFrame([("beta",)], "cleaned_log STRING")
    left = clean(log(["beta 1", "gamma"]), known)
    assert [r["cleaned_log"] for r in left.collect()] == ["gamma"]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("LeftAnti") < plan.index("Aggregate")


def test_new_records_take_the_first_line_of_the_batch(log, spark):
    cleaned = clean(log({"a": ["x", " same key "], "b": ["same key 2", "stored"]}))
    stored = spark.createDataFrame([("stored",), (None,)], "cleaned_log STRING")
    got = history.new_records(cleaned, stored).collect()
    assert {(r["cleaned_log"], r["raw_log"]) for r in got} == {("", "x"), ("key", "same key")}
    assert {r["cleaned_log"] for r in history.subtract_known(cleaned, stored).collect()} == {"", "key"}
    counts = history.history_counts(cleaned, stored).first()
    assert (counts["processed"], counts["skipped"], counts["new"]) == (4, 2, 2)


PATTERNS = ["Audio.*underrun", "audio", "[0-9]+$", "^Line", "b(ar|az)", "(", "  audio ", "", "[z-a]"]
LOGS = ["Audio has underrun 5", "audio ok", "plain", "BAZ 12", "Line up"]


def expected_mapping(usable, texts, most):
    rows = []
    for number, text in enumerate(texts, start=1):
        hits = [p for p in usable if re.search(p, text, re.IGNORECASE)][:most]
        rows += [(number, text, hit) for hit in hits or [""]]
    return sorted(rows)


@pytest.fixture(params=["one slice", "small slices", "no literals"])
def path(request, monkeypatch):
    if request.param == "small slices":
        monkeypatch.setattr(patterns, "SLICE_PATTERNS", 2)
    if request.param == "no literals":
        monkeypatch.setattr(patterns, "LEAST_LITERAL", 1000)


def test_patterns_by_every_path(spark, log, path):
    combined = patterns.combine_patterns(spark.createDataFrame([(p,) for p in PATTERNS], "pattern STRING"))
    usable = sorted(r["pattern"] for r in patterns.valid_patterns(combined).collect())
    assert usable == sorted(["Audio.*underrun", "audio", "[0-9]+$", "^Line", "b(ar|az)"])
    assert sorted(r["pattern"] for r in patterns.invalid_patterns(combined).collect()) == ["(", "[z-a]"]

    cleaned = log(LOGS).select("file", "line_no", F.col("line").alias("raw_log"))
    valid = patterns.valid_patterns(combined)
    kept = patterns.filter_lines(cleaned, valid.where("pattern <> '^Line'"))
    assert sorted(r["line_no"] for r in kept.collect()) == [1, 2, 4]
    assert patterns.filter_lines(cleaned, valid).count() == 5  # every rendered line starts with Line
    assert patterns.filter_lines(cleaned, valid.limit(0)).count() == 0

    filtered = cleaned.select("file", "line_no", F.col("raw_log").alias("log"))
    for most in (1, 2, 9):
        mapping = patterns.map_patterns(filtered, valid, most)
        assert sorted((r["line_no"], r["log"], r["regex"]) for r in mapping.collect()) == expected_mapping(usable, LOGS, most)
    nothing = patterns.map_patterns(filtered, valid.limit(0))
    assert {r["regex"] for r in nothing.collect()} == {""}
    stats = patterns.mapping_stats(patterns.map_patterns(filtered, valid, 2), combined).first()
    assert (stats["lines_total"], stats["lines_with_match"], stats["invalid_patterns"]) == (5, 4, 2)
    assert stats["rows_written"] == len(expected_mapping(usable, LOGS, 2))


def test_patterns_only_python_takes_are_matched_too(spark, log):
    combined = patterns.combine_patterns(spark.createDataFrame([("(?P<word>plain)",), ("b(?P<x>a)z",)], "pattern STRING"))
    filtered = log(LOGS).select("file", "line_no", F.col("line").alias("log"))
    mapping = patterns.map_patterns(filtered, patterns.valid_patterns(combined))
    assert {r["line_no"]: r["regex"] for r in mapping.collect() if r["regex"]} == {3: "(?P<word>plain)", 4: "b(?P<x>a)z"}


@pytest.mark.parametrize("others", [0, 1, 199, 200, 700])
def test_a_pattern_reads_the_same_in_any_list(spark, log, others):
    probes = ["[a&&b]q", "(?P<n>x)q", "[a-z&&[^b]]q", r"end\Z", "[]x]q", r"tab\vq", "d.t$", "plain"]
    texts = ["x & yq", "&q", "bq", "b]q", "xq", "end", "end ", "]q", "d\u2028t", "d\rt", "PLAIN", "tab\x0bq", "tab\x0cq"]
    frame = spark.createDataFrame([(p,) for p in probes + [f"nomatch{i}" for i in range(others)]], "pattern STRING")
    valid = patterns.valid_patterns(patterns.combine_patterns(frame))
    cleaned = log(texts).select("file", "line_no", F.col("line").alias("raw_log"))
    kept = {r["line_no"] for r in patterns.filter_lines(cleaned, valid).collect()}
    lines = {n: f"Line {n}: {text}" for n, text in enumerate(texts, start=1)}
    assert kept == {n for n, text in lines.items() if any(re.search(p, text) for p in probes)}
    mapping = patterns.map_patterns(cleaned.withColumnRenamed("raw_log", "log"), valid, 2)
    got = sorted((r["line_no"], r["log"], r["regex"]) for r in mapping.collect())
    with warnings.catch_warnings():
        warnings.simplefilter("ignore")
        assert got == expected_mapping(sorted(probes), texts, 2)


LETTER_CASES = [
    (r"a\w", "a\u0301"), (r"x\s", "x\x1c"), (r"x\S", "x\x1c"), (r"\101", "A"), (r"n\w", "n²"), (r"\ba\b", "a\u0301b"), ("ß", "ẞ"),
    (r"\.\w+$", ".\u0902"), ("kelvin", "\u212aelvin"), ("stop", "\u017ftop"), ("in", "\u0130n"), ("in", "\u0131n"), ("É", "é"), (r"\d+x", "٣x"),
    (r"a\sb", "a\u2003b"), (r"\bé", "né"), (r"[^\W\d_]+!", "日本!"), ("(?a:\\w+)é", "aé"), (r"\x41b", "AB"), ("K", "k"),
]


@pytest.mark.parametrize("others", [0, 200, 5000])
def test_letters_beyond_ascii_read_as_in_python(spark, log, others):
    wanted = sorted({p for p, _ in LETTER_CASES})
    texts = [t for _, t in LETTER_CASES]
    frame = spark.createDataFrame([(p,) for p in [*wanted, *(f"nomatch{i}" for i in range(others))]], "pattern STRING")
    lines = log(texts).select("file", "line_no", F.col("line").alias("raw_log"))
    for any_case in (True, False):
        flags = re.IGNORECASE if any_case else 0
        found = patterns._with_matches(lines, frame, F.col("raw_log"), 99, any_case).collect()
        assert {r["line_no"]: r["_found"] for r in found} == {
            n: [p for p in wanted if re.search(p, text, flags)] for n, text in enumerate(texts, start=1)
        }


SIGNS = ["a", "b", "K", "s", "ab", "(a|b)", "[ab]", "[^]a]", r"\w", r"\d", r"\.", ".", "a*", "b+", "a?", "{2}", "a{1,2}", "|", "x", r"\x41", "(?:ab)?", "ſ", "é", "^", "$", "(?=a)", "-", "k+", "S??", "(?#c)", r"\[", "[[]", "(?x) "]


def test_literals_are_in_every_match():
    pick = random.Random(6)
    texts = ["".join(pick.choice("abABkKsSſKxX.é -2{}[") for _ in range(pick.randint(0, 14))) for _ in range(300)]
    matches = 0
    for _ in range(6000):
        pattern = "".join(pick.choice(SIGNS) for _ in range(pick.randint(1, 7)))
        literals = patterns.required_literals(pattern)
        for flags in (0, re.IGNORECASE):
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    compiled = re.compile(pattern, flags)
            except re.error:
                continue
            for text in pick.sample(texts, 20) if literals else ():
                if compiled.search(text):
                    matches += 1
                    assert any(one in text.translate(patterns.ASCII_ALIKE).lower() for one in literals), (pattern, text)
    assert matches > 100
    assert patterns.required_literals("abc|def") == ["abc", "def"]
    assert patterns.required_literals(r"Audio\.(x|y)*underrun+") == ["underrun"]
    assert patterns.required_literals("ab|c") is None


def test_a_long_list_costs_little_more_than_a_short_one(spark, log):
    texts = [f"line {i} of service{i % 977} says value={i * 7919 % 10007}" for i in range(40_000)]
    lines = log(texts).withColumnRenamed("line", "log").repartition(8).cache()
    lines.count()
    spent = {}
    for size in (50, 5000, 50, 5000):
        frame = spark.createDataFrame([(rf"service{i}\b.*value=\d+",) for i in range(size)], "pattern STRING")
        mapping = patterns.map_patterns(lines, frame)
        began = time.perf_counter()
        mapping.write.format("noop").mode("overwrite").save()
        spent[size] = time.perf_counter() - began
    assert spent[5000] < 3 * spent[50] + 0.5
    lines.unpersist()


def test_a_long_pattern_list(spark, log):
    rng = random.Random(1)
    words = [f"w{rng.randrange(10**6)}x" for _ in range(450)]
    frame = patterns.combine_patterns(spark.createDataFrame([(w,) for w in words], "pattern STRING"))
    texts = [f"{a} and {b}" for a, b in zip(words[:60], words[60:120])] + ["none"]
    filtered = log(texts).select("file", "line_no", F.col("line").alias("log"))
    mapping = patterns.map_patterns(filtered, patterns.valid_patterns(frame), 2)
    got = sorted((r["line_no"], r["log"], r["regex"]) for r in mapping.collect())
    assert got == expected_mapping(sorted(set(words)), texts, 2)


def test_first_catalog_row_answers_for_a_module(spark):
    catalog = spark.createDataFrame(
        [(1, "audio_hal", "second"), (0, "Audio-Hal", "first"), (2, "amp", "third")],
        "pos INT, module_name STRING, regex_file_path STRING",
    )
    requests = spark.createDataFrame([(1, "AUDIO.HAL, nope,,amp")], "id INT, request STRING")
    wanted = modules.requested(requests, "id", "request")
    known = {r["module_name"]: r["regex_file_path"] for r in modules.resolve_modules(wanted, catalog).collect()}
    assert known == {"AUDIO.HAL": "first", "amp": "third"}
    assert [r["module_name"] for r in modules.unknown_modules(wanted, catalog).collect()] == ["nope"]
    assert modules.known_module_names(catalog).count() == 3


def test_archive_kinds(spark):
    complete = ["test_result.xml", "test_result.html", "test_result_failures_suite.html", "module_reports/", "report-log-files/"]
    entries = {
        "/in/result.zip": ["R\\" + name.upper() if name.endswith("l") else "R/" + name for name in complete],
        "/in/top.zip": complete,
        "/in/missing dir.zip": complete[:-1],
        "/in/dir as file.zip": complete[:-1] + ["report-log-files"],
        "/in/split.zip": ["a/" + n for n in complete[:3]] + ["b/" + n for n in complete[3:]],
        "/in/deep.zip": ["a/b/c/" + n for n in complete],
        "/in/Bugreport-1.ZIP": ["x/main-bugreport.txt", "bugreport-9.txt"],
        "/in/by entry.zip": ["fs/dumpstate_board.txt"],
        "/in/plain.zip": ["a.log", "a/bugreport-x.txt"],
    }
    rows = [(a, n, e) for a, names in entries.items() for n, e in enumerate(names)]
    frame = spark.createDataFrame(rows, "archive STRING, pos BIGINT, entry STRING").repartition(3)
    results = {r["archive"] for r in archives.test_result_archives(frame).where("is_test_result").collect()}
    assert results == {"/in/result.zip", "/in/top.zip"}
    actions = {r["archive"]: (r["action"], r["only_entry"]) for r in archives.archive_actions(frame).collect()}
    assert actions["/in/Bugreport-1.ZIP"] == ("core", "x/main-bugreport.txt")
    assert actions["/in/by entry.zip"] == ("skip", None)
    assert actions["/in/plain.zip"] == ("all", None)
    assert actions["/in/top.zip"] == ("skip", None)
    assert actions["/in/deep.zip"] == ("all", None)
