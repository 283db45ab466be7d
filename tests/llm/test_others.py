"""Archives, search and preference pairs on odd rows, against brute force."""

from __future__ import annotations

import base64
import hashlib
import random
import struct

import numpy as np
import pytest
import zstandard

from lumberline.llm import preference, topk, warc
from lumberline.llm.store import open_file

# ---------------------------------------------------------------- WARC

PAGES = [
    (1, "http://a/1", "<p>same</p>"), (2, None, "<p>same</p>"), (9, "http://a/9\r\nX: y", "<p>same</p>"), (9, "u", "<p>same</p>"),
    (3, "u", None), (4, "u", ""), (5, "u", "é" * 300_000), (6, "u", "HTTP/1.1\r\n\r\nWARC/1.1\r\n"), (7, "u", "x"), (7, "u", "y"),
    (None, "u", "<p>same</p>"), (None, "u", "alone"),
]


@pytest.mark.parametrize("min_bytes", [0, 5])
def test_archives(spark, min_bytes):
    pages = spark.createDataFrame([(*row, 1, "x") for row in PAGES], "page_id BIGINT, url STRING, html STRING, frame INT, name STRING")
    archives = warc.write_archives(warc.plan_records(pages.repartition(3), min_bytes), bundle_bytes=200)
    got = sorted(map(tuple, warc.read_archives(archives).collect()), key=repr)
    groups = {}
    for page, _, html in PAGES:
        groups.setdefault(html or "", []).append(-1 if page is None else page)
    want = []
    for page, _, html in PAGES:
        data = (html or "").encode()
        latest = max(groups[html or ""])
        revisit = len(data) >= min_bytes and (-1 if page is None else page) < latest
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        want.append((page, len(data), digest, "revisit" if revisit else "response", latest if revisit else None))
    assert got == sorted(want, key=repr)


def test_bundles_are_plain_zstandard_with_a_seek_table(spark):
    pages = spark.createDataFrame([(i, f"http://a/{i}", f"<p>{i}</p>" * 9000) for i in range(40)], "page_id BIGINT, url STRING, html STRING")
    archives = warc.archive_pages(pages.coalesce(1))
    rows = archives.index.collect()
    assert len({r["frame"] for r in rows}) > 3
    for name in {r["name"] for r in rows}:
        with open_file(archives.folder, name) as stream:
            frames = warc.seek_table(stream)
            stream.seek(0)
            data = stream.read()
        magic, size = struct.unpack_from("<II", data, frames[-1][0] + frames[-1][1])
        assert magic == warc.SKIPPABLE_MAGIC and frames[-1][0] + frames[-1][1] + 8 + size == len(data)
        whole = b"".join(zstandard.ZstdDecompressor().decompress(data[at : at + packed], max_output_size=n) for at, packed, n in frames)
        # Every reader of Zstandard sees one stream of records.
        assert zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True).read() == whole
        assert whole.count(b"WARC/1.1\r\n") == sum(r["name"] == name for r in rows)


def test_no_pages(spark):
    pages = spark.createDataFrame([], "page_id BIGINT, url STRING, html STRING")
    assert warc.read_archives(warc.archive_pages(pages)).collect() == []


# ---------------------------------------------------------------- top-k


def brute_top(rows, k, every):
    usable = [
        (i, np.array([int(np.floor(256 * float(x))) for x in v], object))
        for i, v in rows
        if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)
    ]
    out = []
    for query in sorted({i for i, _ in usable if i % every == 0}):
        vector = min((v for i, v in usable if i == query), key=lambda v: list(v))
        scored = [(-sum(a * b for a, b in zip(vector, v)), i) for i, v in usable if i != query]
        out += [(query, rank, i, -score) for rank, (score, i) in enumerate(sorted(scored)[:k], start=1)]
    return out


@pytest.mark.parametrize("block,queries,scale", [(128, 4096, 1.0), (3, 2, 1.0), (3, 4096, 1e6)])
def test_top_k(spark, block, queries, scale, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK_ROWS", block)
    monkeypatch.setattr(topk, "QUERY_ROWS", queries)
    pick = random.Random(block)
    rows = [(i, [float(np.float32(pick.gauss(0, 1) * scale)) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, rows[5][1]) for i in range(12)]
    rows += [(300, None), (301, []), (310, [None] * 6), (311, [float("nan")] * 6), (312, [float("inf")] * 6), (320, [0.5, -0.5])]
    rows += [(None, [0.1] * 6), (7, rows[3][1]), (10, rows[4][1])]
    frame = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id BIGINT, embedding ARRAY<FLOAT>, rank INT, score INT")
    got = sorted(map(tuple, topk.top_k(frame.repartition(3), k=5, every=10).collect()))
    assert got == sorted(brute_top(rows, 5, 10))


def test_top_k_of_few(spark):
    schema = "vec_id BIGINT, embedding ARRAY<FLOAT>"
    assert topk.top_k(spark.createDataFrame([], schema)).collect() == []
    assert topk.top_k(spark.createDataFrame([(0, [1.0])], schema)).collect() == []
    got = topk.top_k(spark.createDataFrame([(0, [1.0]), (3, [0.5]), (2, [0.5])], schema)).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 2, 32768), (0, 2, 3, 32768)]


# ---------------------------------------------------------------- preference pairs


def turns(spark, rows):
    return spark.createDataFrame(
        [(*row, "x", 1) for row in rows], "pair_id BIGINT, side STRING, turn BIGINT, role STRING, text STRING, prompt STRING, part INT"
    )


def answers_of(text, spans):
    cut = [tuple(map(int, span.split("+"))) for span in spans.split(",") if span]
    return [text[a : a + n] for a, n in cut]


def test_common_beginning_is_rendered_once(spark):
    base = [(0, "system", "be kind"), (1, "user", "hi"), (2, "assistant", "hello")]
    rows = [(1, side, *t) for side in ("chosen", "rejected") for t in base]
    rows += [(1, "chosen", 3, "user", "é?"), (1, "chosen", 4, "assistant", "yes"), (1, "rejected", 3, "user", "é?")]
    rows += [(1, "rejected", 4, "assistant", "no"), (1, "rejected", 5, "user", "why"), (1, "rejected", 6, "assistant", None)]
    rows += [(1, "other", 0, "user", "left out")]
    (row,) = preference.format_preferences(turns(spark, rows + rows[:2])).collect()
    assert row["prompt_turns"] == 4 and row["part"] == 0
    assert row["prompt"] == "<|system|>\nbe kind<|end|>\n<|user|>\nhi<|end|>\n<|assistant|>\nhello<|end|>\n<|user|>\né?<|end|>\n"
    assert row["chosen"] == "<|assistant|>\nyes<|end|>\n"
    assert answers_of(row["chosen"], row["chosen_spans"]) == ["yes<|end|>\n"]
    assert row["rejected"] == "<|assistant|>\nno<|end|>\n<|user|>\nwhy<|end|>\n<|assistant|>\n<|end|>\n"
    assert answers_of(row["rejected"], row["rejected_spans"]) == ["no<|end|>\n", "<|end|>\n"]


def test_odd_pairs(spark):
    rows = [
        (1, "chosen", 0, "user", "a"),
        (2, "chosen", 0, "user", None), (2, "rejected", 0, "user", ""),
        (3, "chosen", 0, None, "a"), (3, "rejected", 0, None, "a"),
        (None, "chosen", 0, "assistant", "a"), (None, "rejected", 0, "assistant", "b"),
        (4, "chosen", None, "user", "first"), (4, "rejected", None, "user", "first"), (4, "chosen", 0, "assistant", "x"),
        (5, "chosen", 0, "user", "b"), (5, "chosen", 0, "user", "a"), (5, "rejected", 0, "user", "a"),
    ]
    got = {}
    for r in preference.format_preferences(turns(spark, rows)).collect():
        got.setdefault(r["pair_id"], []).append((r["part"], r["prompt"], r["chosen"], r["rejected"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        1: [(0, "", "<|user|>\na<|end|>\n", "")],
        2: [(0, "", "<|user|>\n<|end|>\n", "<|user|>\n<|end|>\n")],
        3: [(0, "<||>\na<|end|>\n", "", "")],
        None: [(0, "", "<|assistant|>\na<|end|>\n", "<|assistant|>\nb<|end|>\n")],
        4: [(-1, "<|user|>\nfirst<|end|>\n", "", ""), (0, "", "<|assistant|>\nx<|end|>\n", "")],
        5: [(0, "<|user|>\na<|end|>\n", "", "")],
    }
    assert preference.format_preferences(turns(spark, [])).collect() == []


@pytest.mark.parametrize("small", [100_000, 0])
def test_long_pairs_come_in_parts(spark, small, monkeypatch):
    monkeypatch.setattr(preference, "SMALL_ROWS", small)
    role = lambda n: "assistant" if n % 2 else "user"
    rows = [(7, side, n, role(n), f"{side if n >= 100 else 'same'} {n}") for side in ("chosen", "rejected") for n in range(300)]
    parts = sorted(preference.format_preferences(turns(spark, rows).repartition(5)).collect(), key=lambda r: r["part"])
    assert [r["part"] for r in parts] == [0, 1, 2, 3, 4]
    assert sum(r["prompt_turns"] for r in parts) == 100
    assert "".join(r["prompt"] for r in parts) == "".join(f"<|{role(n)}|>\nsame {n}<|end|>\n" for n in range(100))
    for side in ("chosen", "rejected"):
        assert "".join(r[side] for r in parts) == "".join(f"<|{role(n)}|>\n{side} {n}<|end|>\n" for n in range(100, 300))
        answers = [a for r in parts for a in answers_of(r[side], r[f"{side}_spans"])]
        assert answers == [f"{side} {n}<|end|>\n" for n in range(101, 300, 2)]


def test_pairs_of_repeated_answers(spark):
    rows = [
        (1, 0, "user", "q"), (1, 1, "assistant", "one"), (1, 2, "user", "r"), (1, 3, "assistant", "two"), (1, 4, "user", "bye"),
        (2, 0, "user", "q"), (2, 1, "assistant", None), (3, 0, "user", "alone"), (None, 0, "assistant", "x"),
    ]
    frame = spark.createDataFrame([(*r, "k") for r in rows], "conv_id BIGINT, turn BIGINT, role STRING, text STRING, old STRING")
    got = {}
    for r in preference.repeated_answer_pairs(frame).collect():
        got.setdefault((r["pair_id"], r["side"]), []).append((r["turn"], r["text"]))
    assert {k: sorted(v) for k, v in got.items()} == {
        (1, "chosen"): [(0, "q"), (1, "one"), (2, "r"), (3, "two")],
        (1, "rejected"): [(0, "q"), (1, "one"), (2, "r"), (3, "one")],
        (2, "chosen"): [(0, "q"), (1, None)],
        (2, "rejected"): [(0, "q"), (1, "")],
        (None, "chosen"): [(0, "x")],
        (None, "rejected"): [(0, "")],
    }
