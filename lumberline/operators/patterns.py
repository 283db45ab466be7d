"""Pattern lists: combine them, filter lines by them, and tell which pattern matched a line.

Patterns mean what they mean to Python's ``re``, on every line and in any list: they are matched there, in one pass over
the lines. From each pattern the driver takes literal text that every match must hold; a worker finds all literals of
the list in a line with one automaton and tries only the patterns whose literals the line has, so a long list costs
little more than a short one. Lists beyond a bound are worked on in slices, one pass after the other in the same tasks.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.functions.text import render_line, strip_blanks

# Patterns that a worker holds at once.
SLICE_PATTERNS = 20_000

# A literal shorter than this is in too many lines to tell them apart.
LEAST_LITERAL = 2

# Characters beyond ASCII that equal an ASCII letter when case is ignored.
ASCII_ALIKE = {0x17F: "s", 0x212A: "k", 0x130: "i", 0x131: "i"}


class _Scan:
    """Reads a pattern from left to right and notes the literal text of its alternatives, as far as it is sure of it."""

    def __init__(self, pattern: str) -> None:
        self.pattern, self.at = pattern, 0
        self.best, self.run = "", ""
        self.done: list[str] = []

    def end_run(self) -> None:
        if len(self.run) > len(self.best):
            self.best = self.run
        self.run = ""

    def end_alternative(self) -> None:
        self.end_run()
        self.done.append(self.best)
        self.best = ""

    def skip_class(self) -> None:
        """Go behind a class of characters; a closing bracket at its beginning is one of them."""
        self.at += 1
        if self.pattern[self.at : self.at + 1] == "^":
            self.at += 1
        first = self.at
        while self.at < len(self.pattern) and (self.pattern[self.at] != "]" or self.at == first):
            self.at += 2 if self.pattern[self.at] == "\\" else 1
        self.at += 1

    def skip_group(self) -> None:
        """Go behind a group, with the groups inside it."""
        depth = 0
        while self.at < len(self.pattern):
            sign = self.pattern[self.at]
            if sign == "[":
                self.skip_class()
                continue
            if sign == "\\":
                self.at += 2
                continue
            depth += (sign == "(") - (sign == ")")
            self.at += 1
            if not depth:
                return

    def literal(self, sign: str) -> None:
        """A sign that stands for itself, unless what follows it may leave it out."""
        self.at += 1
        after = self.pattern[self.at : self.at + 1]
        if after and after in "*?{":
            self.end_run()
        elif after == "+":
            self.run += sign
            self.end_run()
        elif sign.isascii():
            self.run += sign
        else:
            self.end_run()

    def read(self) -> list[str]:
        while self.at < len(self.pattern):
            sign = self.pattern[self.at]
            if sign == "|":
                self.end_alternative()
                self.at += 1
            elif sign == "(":
                self.end_run()
                self.skip_group()
            elif sign == "[":
                self.end_run()
                self.skip_class()
            elif sign == "\\":
                escaped = self.pattern[self.at + 1 : self.at + 2]
                self.at += 1
                if escaped.isascii() and not escaped.isalnum():
                    self.literal(escaped)
                else:
                    # A class, a place, a number: what follows the letter may belong to it, so no run goes on here.
                    self.end_run()
                    self.at += 1
                    while self.at < len(self.pattern) and (self.pattern[self.at].isalnum() or self.pattern[self.at] == "{"):
                        if self.pattern[self.at] == "{":
                            self.at = max(self.pattern.find("}", self.at), self.at)
                        self.at += 1
                    if self.at < len(self.pattern) and self.pattern[self.at] in "*?{":
                        self.at += 1
            elif sign in ".^$*+?{}":
                self.end_run()
                if sign == "{":
                    # A repetition, or a brace that stands for itself: neither is used.
                    close = self.pattern.find("}", self.at)
                    self.at = close if close > 0 else self.at
                self.at += 1
            else:
                self.literal(sign)
        self.end_alternative()
        return self.done


def required_literals(pattern: str) -> list[str] | None:
    """Lower-case ASCII texts of which every match holds one, or None when the pattern promises no such text."""
    if re.search(r"\(\?[a-zA-Z]*x", pattern):
        return None  # blanks and comments of a verbose pattern are no text
    found = {text.lower() for text in _Scan(pattern).read()}
    return sorted(found) if min(map(len, found)) >= LEAST_LITERAL else None


def _accepted():
    @F.pandas_udf("boolean")
    def accepted(patterns: pd.Series) -> pd.Series:
        import re
        import warnings

        def compiles(pattern: str) -> bool:
            try:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    re.compile(pattern)
            except (re.error, OverflowError, RecursionError):
                return False
            return True

        return patterns.map(compiles).astype("bool")

    return accepted


def combine_patterns(patterns: DataFrame) -> DataFrame:
    """Distinct stripped patterns of all modules with their validity: ``(pattern, valid)``; rank is code-point order."""
    distinct = patterns.select(strip_blanks(F.col("pattern")).alias("pattern")).where("pattern <> ''").distinct()
    return distinct.withColumn("valid", _accepted()(F.col("pattern")))


def invalid_patterns(combined: DataFrame) -> DataFrame:
    return combined.where(~F.col("valid")).select("pattern")


def valid_patterns(combined: DataFrame) -> DataFrame:
    return combined.where("valid").select("pattern")


def _slices(patterns: DataFrame, size: int) -> Iterator[list[str]]:
    """The patterns in order, at most ``size`` at a time on the driver."""
    after = None
    while True:
        rest = patterns if after is None else patterns.where(F.col("pattern") > F.lit(after))
        found = [row["pattern"] for row in rest.orderBy("pattern").limit(size).collect()]
        if found:
            yield found
        if len(found) < size:
            return
        after = found[-1]


def _matcher(patterns: list[str], limit: int, any_case: bool):
    """Appends the patterns found in ``_text`` to ``_found``, up to ``limit`` in order."""
    literals = [required_literals(p) for p in patterns]
    alike = ASCII_ALIKE

    # Everything the workers need is in here, so that they need no copy of this package.
    def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import re
        import warnings

        always = [i for i, found in enumerate(literals) if found is None]
        holders: dict[str, list[int]] = {}
        for i, found in enumerate(literals):
            for text in found or ():
                holders.setdefault(text, []).append(i)
        try:
            import ahocorasick
        except ImportError:

            def held(text: str) -> Iterator[list[int]]:
                return (own for literal, own in holders.items() if literal in text)
        else:
            automaton = ahocorasick.Automaton()
            for literal, own in holders.items():
                automaton.add_word(literal, own)
            automaton.make_automaton()

            def held(text: str) -> Iterator[list[int]]:
                return (own for _, own in automaton.iter(text)) if holders else iter(())

        searches: dict[int, object] = {}

        def search(i: int):
            if i not in searches:
                with warnings.catch_warnings():
                    warnings.simplefilter("ignore")
                    searches[i] = re.compile(patterns[i], re.IGNORECASE if any_case else 0).search
            return searches[i]

        def extended(text: str | None, found: list[str]) -> list[str]:
            if text is None or len(found) >= limit:
                return found
            plain = text.lower() if text.isascii() else text.translate(alike).lower()
            candidates = set(always)
            for own in held(plain):
                candidates.update(own)
            hits = list(found)
            for i in sorted(candidates):
                if search(i)(text):
                    hits.append(patterns[i])
                    if len(hits) >= limit:
                        break
            return hits

        for batch in batches:
            texts, found = (batch.column(batch.schema.get_field_index(n)).to_pylist() for n in ("_text", "_found"))
            at = batch.schema.get_field_index("_found")
            column = pa.array([extended(t, f) for t, f in zip(texts, found)], batch.schema.field(at).type)
            yield batch.set_column(at, batch.schema.field(at), column)

    return match


def _with_matches(lines: DataFrame, patterns: DataFrame, text: Column, limit: int, any_case: bool) -> DataFrame:
    """Add ``_found``: the first ``limit`` patterns, in order, found in ``text``."""
    matched = lines.withColumn("_text", text).withColumn("_found", F.array().cast("array<string>"))
    for found in _slices(patterns, SLICE_PATTERNS):
        matched = matched.mapInArrow(_matcher(found, limit, any_case), matched.schema)
    return matched.drop("_text")


def filter_lines(cleaned: DataFrame, patterns: DataFrame) -> DataFrame:
    """Cleaned lines whose rendered form any valid pattern matches, case-sensitively: ``(file, line_no, log)``.

    Like all patterns of a list they mean what they mean to Python.
    """
    rendered = render_line(F.col("line_no"), F.col("raw_log"))
    kept = _with_matches(cleaned, patterns, rendered, 1, any_case=False).where(F.size("_found") > 0)
    return kept.select("file", "line_no", F.col("raw_log").alias("log"))


def map_patterns(filtered: DataFrame, patterns: DataFrame, max_patterns_per_line: int = 1) -> DataFrame:
    """Each line with the first patterns found in it, in any case; a line without match keeps an empty regex."""
    found = _with_matches(filtered, patterns, F.col("log"), max_patterns_per_line, any_case=True)
    return found.select("file", "line_no", "log", F.explode_outer("_found").alias("regex")).withColumn(
        "regex", F.coalesce("regex", F.lit(""))
    )


def mapping_stats(mapping: DataFrame, combined: DataFrame) -> DataFrame:
    """One row: distinct lines, lines with a match, rows, and patterns the regex engine refused."""
    per_line = mapping.groupBy("file", "line_no").agg(
        F.count(F.lit(1)).alias("rows"), F.bool_or(F.col("regex") != "").alias("matched")
    )
    counts = per_line.agg(
        F.count(F.lit(1)).alias("lines_total"),
        F.count_if("matched").alias("lines_with_match"),
        F.coalesce(F.sum("rows"), F.lit(0)).alias("rows_written"),
    )
    refused = combined.agg(F.count_if(~F.col("valid")).alias("invalid_patterns"))
    both = counts.unionByName(refused, allowMissingColumns=True)
    return both.agg(*[F.coalesce(F.sum(name), F.lit(0)).alias(name) for name in both.columns])
