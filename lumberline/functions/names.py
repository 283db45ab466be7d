"""Module names, requests and label lookups."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumberline.functions.text import strip_blanks


def module_key(name: Column) -> Column:
    """Lower-case letters and digits of a module name."""
    return F.regexp_replace(F.lower(F.coalesce(name, F.lit(""))), r"[^\p{L}\p{N}]", "")


def requested_modules(request: Column) -> Column:
    """Comma-separated request as a sorted array of distinct, non-blank names."""
    names = F.transform(F.split(request, ","), strip_blanks)
    return F.array_sort(F.array_distinct(F.filter(names, lambda n: n != "")))


def class_link(class_type: Column, links: Mapping[str, str]) -> Column:
    """Link registered for a class, empty when there is none."""
    if not links:
        return F.lit("")
    pairs = [F.lit(part) for pair in links.items() for part in pair]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), class_type), F.lit(""))
