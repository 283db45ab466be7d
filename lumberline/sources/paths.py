"""File paths as Spark gives and takes them."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def shown_path(uri: Column) -> Column:
    """A file's path as it is named in its folder; Spark gives it encoded as a URI."""
    return F.url_decode(F.replace(uri, F.lit("+"), F.lit("%2B")))


def literal_path(path: str) -> str:
    """The path with the signs of file patterns taken literally."""
    return re.sub(r"([\[\]{}*?\\])", r"\\\1", path)
