"""Conversations with several messages of one turn, and without an id, keep every message."""

from __future__ import annotations

import duckdb

from lumberline.llm import queries as q
from lumberline.llm.oracles import PREFERENCE_PAIRS

ROWS = [
    (1, 0, "user", "a"), (1, 0, "user", "b"), (1, 0, "user", "b"), (1, 1, "assistant", "x"), (1, 2, "user", "c"), (1, 3, "assistant", "y"),
    (1, 3, "assistant", "z"), (1, 3, "user", "d"), (2, 64, "user", "e"), (2, 64, "user", "f"), (2, 65, "assistant", "g"),
    (3, 0, "assistant", "h"), (3, 0, "assistant", "h"),
]
# The SQL leaves out conversations without an id and has null turns in part 0, so these are compared with plain values.
NO_ID = [(None, 0, "user", "p"), (None, 0, "user", "q"), (None, 1, "assistant", "r"), (None, 1, "assistant", "s")]


def pairs(spark, folder, rows):
    schema = "conv_id BIGINT, turn BIGINT, role STRING, text STRING"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{folder}/conversations.parquet")
    return sorted(map(tuple, q.op10_preference_pairs(spark, str(folder)).collect()))


def test_repeated_turns_against_sql(spark, tmp_path):
    got = pairs(spark, tmp_path, ROWS)
    with duckdb.connect() as tables:
        tables.execute("CREATE TABLE conversations (conv_id BIGINT, turn BIGINT, role VARCHAR, text VARCHAR)")
        tables.executemany("INSERT INTO conversations VALUES (?, ?, ?, ?)", ROWS)
        assert got == sorted(tables.execute(PREFERENCE_PAIRS).fetchall())


def test_conversation_without_id(spark, tmp_path):
    (row,) = pairs(spark, tmp_path, NO_ID)
    assert row[:4] == (None, 0, 2, "<|user|>\np<|end|>\n<|user|>\nq<|end|>\n")
    assert row[4] == "<|assistant|>\nr<|end|>\n<|assistant|>\ns<|end|>\n"
    assert row[6] == "<|assistant|>\n<|end|>\n" * 2


def test_several_turns_without_number(spark, tmp_path):
    first, second = pairs(spark, tmp_path, [(4, None, "user", "e"), (4, None, "user", "f"), (4, 1, "assistant", "g")])
    assert first[:6] == (4, -1, 2, "<|user|>\ne<|end|>\n<|user|>\nf<|end|>\n", "", "")
    assert second[:5] == (4, 0, 0, "", "<|assistant|>\ng<|end|>\n")
