"""Clean-up of chat answers held in a text column: code fences, think tags, fenced JSON."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumberline.functions.text import BLANKS, strip_blanks

# The fences of answers.
MARKDOWN_FENCE = r"^```markdown[^\n]*\n([\s\S]*?)\n?```\z"
JSON_FENCE = "```json"

# Strings and comments, which are kept as they are, or a comma that ends a list or an object.
FINAL_COMMA = (
    r'("(?:[^"\\]++|\\[\s\S])*+"' r"|'(?:[^'\\]++|\\[\s\S])*+'" r"|//[^\n]*+|/\*[\s\S]*?\*/)"
    r"|,(?=(?:\s|//[^\n]*\n|/\*[\s\S]*?\*/)*[}\]])"
)

# The same, words and numbers with their signs, and what stands between.
PIECES = (
    r'"(?:[^"\\]++|\\[\s\S])*+"?' r"|'(?:[^'\\]++|\\[\s\S])*+'?" r"|//[^\n]*+|/\*[\s\S]*?\*/"
    r"""|[\w$.+-]++|[^\w$.+\-"'/]++|/"""
)
# A sign, a point or a prefix that only lenient readers take, where a value begins or ends.
ODD_NUMBER = r"[+.](?:\d|I|N)|\d\.(?!\d)|0[xX]"
HEX_NUMBER = r"^[+-]?0[xX][0-9a-fA-F]{1,16}$"
POINT_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


def _strict_number(word: Column) -> Column:
    """A number as JSON writes it: without a plus sign, with digits on both sides of its point, to the base ten."""
    signed = F.regexp_replace(word, r"^\+", "")
    sign, digits = F.regexp_extract(signed, "^-?", 0), F.regexp_extract(signed, "[0-9a-fA-F]+$", 0)
    pointed = F.regexp_replace(F.regexp_replace(signed, r"^(-?)\.", "$10."), r"\.(?=$|[eE])", ".0")
    return (
        F.when(word.rlike(HEX_NUMBER), F.concat(sign, F.conv(digits, 16, 10)))
        .when(word.rlike(POINT_NUMBER), pointed)
        .when(word.isin("+Infinity", "+NaN"), signed)
        .otherwise(word)
    )


def _with_strict_numbers(body: Column) -> Column:
    """Numbers outside strings and comments as JSON writes them; a body without odd numbers is not taken apart."""
    pieces = F.regexp_extract_all(body, F.lit(PIECES), F.lit(0))
    strict = F.transform(pieces, lambda piece: F.when(piece.rlike(r"^[+.\d-]"), _strict_number(piece)).otherwise(piece))
    return F.when(body.rlike(ODD_NUMBER), F.array_join(strict, "")).otherwise(body)


def unfence_markdown(text: Column) -> Column:
    whole = strip_blanks(text)
    body = F.when(whole.rlike(MARKDOWN_FENCE), F.regexp_extract(whole, MARKDOWN_FENCE, 1)).otherwise(whole)
    return F.coalesce(strip_blanks(body), F.lit(""))


def _after(text: Column, marker: str) -> Column:
    """What follows the first ``marker``; NULL when it is absent."""
    at = F.instr(text, marker)
    return F.when(at > 0, F.substr(text, at + len(marker)))


def _before(text: Column, marker: str) -> Column:
    at = F.instr(text, marker)
    return F.when(at > 0, F.substr(text, F.lit(1), at - 1))


def think_content(text: Column) -> Column:
    return strip_blanks(_before(_after(text, "<think>"), "</think>"))


def without_think(text: Column) -> Column:
    return F.coalesce(_after(_after(text, "<think>"), "</think>"), text)


def fenced_json(text: Column) -> Column:
    """Body of the first JSON fence as a VARIANT, read leniently; NULL when absent or unreadable.

    Comments, single quotes, bare names, final commas and backslashes before any character are taken, and numbers with
    a plus sign, with a point at either end, or to the base 16 (up to 16 digits).
    """
    body = F.btrim(_before(_after(text, JSON_FENCE), "```"), F.lit(BLANKS))
    body = F.when(body.contains(","), F.regexp_replace(body, FINAL_COMMA, "$1")).otherwise(body)
    body = _with_strict_numbers(body)
    lenient = {
        "allowSingleQuotes": "true",
        "allowUnquotedFieldNames": "true",
        "allowComments": "true",
        "allowBackslashEscapingAnyCharacter": "true",
        "mode": "PERMISSIVE",
    }
    return F.from_json(body, "variant", lenient)
