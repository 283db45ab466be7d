from __future__ import annotations

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from lumberline.runtime import build_session  # noqa: E402


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    session = build_session(
        "8",
        shuffle_partitions=4,
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=str(tmp_path_factory.mktemp("checkpoints")),
        spark__sql__warehouse__dir=str(tmp_path_factory.mktemp("warehouse")),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def log(spark):
    """Lines of text as a DataFrame; a dict holds several files."""

    def build(files):
        named = files if isinstance(files, dict) else {"a": files}
        rows = [(file, n, line) for file, lines in named.items() for n, line in enumerate(lines, start=1)]
        return spark.createDataFrame(rows, "file STRING, line_no BIGINT, line STRING")

    return build


@pytest.fixture(scope="session")
def apply(spark):
    """Evaluate a column expression on many strings, in order."""

    def run(values, expression):
        frame = spark.createDataFrame(list(enumerate(values)), "i INT, s STRING")
        rows = frame.select("i", expression(frame["s"]).alias("out")).collect()
        return [row["out"] for row in sorted(rows, key=lambda row: row["i"])]

    return run
