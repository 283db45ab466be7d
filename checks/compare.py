"""Run registered queries against their checking SQL: ``python -m checks.compare SF_DIR [query …]``."""

from __future__ import annotations

import glob
import os
import sys
import time

import duckdb
import pandas as pd

from checks.oracles import ORACLES
from checks.queries import QUERIES
from lumberline.runtime import build_session


def duckdb_tables(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.splitext(os.path.basename(path))[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def as_rows(frame: pd.DataFrame) -> list[tuple]:
    columns = sorted(frame.columns)
    plain = frame[columns].astype(object).where(frame[columns].notna(), None)
    return sorted((tuple(row) for row in plain.itertuples(index=False)), key=repr)


def mismatch(got: pd.DataFrame, want: pd.DataFrame) -> str | None:
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    left, right = as_rows(got), as_rows(want)
    if len(left) != len(right):
        return f"{len(left)} rows != {len(right)}"
    for a, b in zip(left, right):
        if a != b:
            return f"{a!r} != {b!r}"
    return None


TYPE_NAMES = {"int": "INTEGER", "bigint": "BIGINT", "string": "VARCHAR", "boolean": "BOOLEAN", "double": "DOUBLE"}


def type_differences(got: dict[str, str], relation: duckdb.DuckDBPyConnection) -> list[str]:
    want = {column[0]: str(column[1]) for column in relation.description}
    return [f"{n}: {t} / {want.get(n)}" for n, t in got.items() if TYPE_NAMES.get(t) != want.get(n)]


def main(sf_dir: str, names: list[str]) -> int:
    spark = build_session(spark__ui__showConsoleProgress="false")
    spark.sparkContext.setLogLevel("ERROR")
    con = duckdb_tables(sf_dir)
    failed = 0
    for name in names or QUERIES:
        began = time.time()
        got = QUERIES[name](spark, sf_dir)
        types = dict(got.dtypes)
        rows = got.toPandas()
        spent = time.time() - began
        relation = con.execute(ORACLES[name])
        different = type_differences(types, relation)
        want = relation.fetchdf()
        verdict = mismatch(rows, want)
        failed += verdict is not None
        print(f"{'FAIL' if verdict else 'ok  '} {name} {len(rows)} rows {spent:.2f}s", *different, (verdict or "")[:1500])
    print(f"{failed} failed")
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
