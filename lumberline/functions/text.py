"""Line-level text functions: the two dedup keys, stripping, rendering, URL and keyword tests."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# English stop words that can remain once a line holds only runs of two or more letters.
STOP_WORDS = (
    "about above after again against ain all am an and any are aren as at be because been before being below "
    "between both but by can couldn did didn do does doesn doing don down during each few for from further had "
    "hadn has hasn have haven having he her here hers herself him himself his how if in into is isn it its itself "
    "just ll ma me mightn more most mustn my myself needn no nor not now of off on once only or other our ours "
    "ourselves out over own re same shan she should shouldn so some such than that the their theirs them "
    "themselves then there these they this those through to too under until up ve very was wasn we were weren "
    "what when where which while who whom why will with won wouldn you your yours yourself yourselves"
).split()

# The single letters that are stop words too.
STOP_LETTERS = "a d i m o s t y".split()

# Stems that mark a line as interesting, matched anywhere and in any case.
ERROR_STEMS = (
    "error fail exception panic fatal denied crash oops segfault abort corrupt not dropped err disconnected "
    "timeout permission"
).split()

# Blanks and word characters as Python's Unicode regexes see them, for the JVM's regex engine.
BLANK = r"[\s\x0b\x1c-\x1f\x85\p{Z}]"
WORD = r"[\p{L}\p{N}_]"

# What is cut from a line before its words are taken.
# The look-behind and the possessive runs keep long digit runs from being tried from every position.
LOG_HEAD = (
    rf"(?<![0-9-])[0-9-]++{BLANK}++[0-9:.]++{BLANK}++[0-9]++{BLANK}++[0-9]++{BLANK}++{WORD}(?:{BLANK}|$)"
)
NUMBERS = rf"=0x[a-fA-F0-9]+|0x[a-fA-F0-9]+|=[a-fA-F0-9]+|(?<!{WORD})[a-fA-F0-9]++(?!{WORD})"
URL_SCHEMES = ("http://", "rtsp://", "https://")

# Every character Python calls a blank; Spark's own trim knows only the space.
BLANKS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    + "".join(chr(c) for c in range(0x2000, 0x200B))
    + "\u1680\u2028\u2029\u202f\u205f\u3000"
)

MAX_LINE_CHARS = 100_000


def strip_blanks(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


# One parsed test instead of one literal call per word; the optimizer turns the list into a hash set.
KEEPS_WORD = "w -> length(w) > 1 AND lower(w) NOT IN (" + ", ".join(f"'{word}'" for word in STOP_WORDS) + ")"


def _meaningful(words: Column) -> Column:
    """Words of two or more letters that are no stop words, joined by one space, case kept."""
    return F.array_join(F.call_function("filter", words, F.expr(KEEPS_WORD)), " ")


KEEPS_ANY_WORD = (
    "w -> lower(w) NOT IN (" + ", ".join(f"'{word}'" for word in [*STOP_LETTERS, *STOP_WORDS]) + ")"
)


def without_stop_words(text: Column) -> Column:
    """All words of a text, numbers included, that are no stop words, joined by one space."""
    words = F.regexp_extract_all(text, F.lit(f"{WORD}+"), F.lit(0))
    return F.array_join(F.call_function("filter", words, F.expr(KEEPS_ANY_WORD)), " ")


# A hex word, or else a run of letters in group 1.
HEX_WORD_OR_LETTERS = rf"(?<!{WORD})[a-fA-F0-9]++(?!{WORD})|([a-zA-Z]{{2,}})"
# What a log head that starts inside a word looks like; any character beyond ASCII counts as part of a word here.
GLUED_HEAD = rf"[a-zA-Z_\x{{80}}-\x{{10FFFF}}][0-9-]++{BLANK}++[0-9:.]"


def cleaned_key(line: Column) -> Column:
    """The key two lines share when they differ only in head, numbers, symbols and stop words.

    Cutting heads and numbers can glue letters together only where a number follows ``=`` or ``0x`` or a head follows
    a letter. All other lines give the same words in one pass that skips hex words and takes the letter runs; heads
    hold no such run.
    """
    cut = F.regexp_replace(F.regexp_replace(line, LOG_HEAD, ""), NUMBERS, "")
    may_glue = line.contains("=") | line.contains("0x") | line.rlike(GLUED_HEAD)
    return (
        F.when(may_glue, _meaningful(F.split(cut, "[^a-zA-Z]+")))
        .when(line.isNotNull(), _meaningful(F.regexp_extract_all(line, F.lit(HEX_WORD_OR_LETTERS), F.lit(1))))
    )


def normalized_line(line: Column) -> Column:
    """A lighter key: hex addresses, numbers and symbols out, blanks collapsed."""
    text = F.regexp_replace(line, r"0x[0-9a-fA-F]+|[^a-zA-Z\s\x0b\x1c-\x1f\x85\p{Z}]", "")
    return F.trim(F.regexp_replace(text, f"{BLANK}+", " "))


def has_url(line: Column) -> Column:
    found = F.lit(False)
    for scheme in URL_SCHEMES:
        found = found | line.contains(scheme)
    return found


def matches_any_case(text: Column, pattern: str) -> Column:
    """Regex found in any case; the slower Unicode comparison is left to texts that are not ASCII."""
    is_wide = F.octet_length(text) != F.length(text)
    return text.rlike(f"(?i){pattern}") | (is_wide & text.rlike(f"(?iu){pattern}"))


def has_error_stem(line: Column, stems: tuple[str, ...] | list[str] = tuple(ERROR_STEMS)) -> Column:
    return matches_any_case(line, "|".join(stems))


def char_length(text: Column) -> Column:
    """Characters without line feeds."""
    return F.length(F.replace(text, F.lit("\n"), F.lit("")))


def is_short_line(line: Column, limit: int = MAX_LINE_CHARS) -> Column:
    return char_length(line) <= limit


def render_line(line_no: Column, text: Column, label: str = "Line") -> Column:
    return F.concat(F.lit(f"{label} "), line_no.cast("string"), F.lit(": "), text)


def parse_rendered(line: Column) -> Column:
    """``[M:] Line N: rest`` as a struct of N (NULL when absent) and the rest."""
    # The forms of a rendered line.
    numbered = r"(?s)^\s*\d+:\s*([^\n]*)$"
    body = F.when(line.rlike(numbered), F.regexp_extract(line, numbered, 1)).otherwise(line)
    labelled = r"(?s)^\s*Line\s+(\d+)\s*:\s*([^\n]*)$"
    number = F.regexp_extract(body, labelled, 1).try_cast("bigint")
    text = F.when(body.rlike(labelled), F.regexp_extract(body, labelled, 2)).otherwise(body)
    return F.struct(number.alias("line_no"), text.alias("log"))


def rendered_tail(line: Column) -> Column:
    """Text after the first colon of a rendered line, stripped; the whole line when it has no colon."""
    return strip_blanks(F.when(line.contains(":"), F.regexp_replace(line, r"(?s)^[^:]*:", "")).otherwise(line))


def truncate_chars(text: Column, limit: int) -> Column:
    return F.coalesce(F.substring(text, 1, limit), F.lit("")) if limit > 0 else F.lit("")


def truncate_whole_lines(text: Column, limit: int) -> Column:
    """Longest prefix of whole lines within ``limit`` characters; a first line that is too long is cut instead."""
    if limit <= 0:
        return F.lit("")
    unified = F.regexp_replace(F.coalesce(text, F.lit("")), r"\r\n?", "\n")
    head = F.substring(unified, 1, limit)
    whole = F.when(head.contains("\n"), F.regexp_replace(head, r"[^\n]*\z", "")).otherwise(head)
    return F.when(F.length(unified) <= limit, unified).otherwise(whole)
