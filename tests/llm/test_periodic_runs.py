"""Periodic runs against plain loops over all periods."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from lumberline.llm import periodic_runs
from lumberline.llm import queries as q

SF_DIR = "/root/testdata/sf0.001"


def plain_runs(words, least=24, times=3):
    """Every maximal stretch of every period, without those that have a smaller one."""
    out = []
    for p in range(1, len(words) // times + 1):
        i = 0
        while i + p < len(words):
            first = i
            while i + p < len(words) and words[i] == words[i + p]:
                i += 1
            length = i - first + p
            if i > first and length >= max(least, times * p):
                own = words[first : first + length]
                if not any(all(own[x] == own[x + d] for x in range(length - d)) for d in range(1, p)):
                    out.append((first, length, p))
            i += i == first
    return sorted(out, key=lambda r: (r[0], r[2]))


def random_words(pick):
    words = [pick.randrange(pick.choice([1, 2, 3, 30])) for _ in range(pick.choice([0, 1, 5, 30, 90]))]
    for _ in range(pick.randint(0, 3)):
        at = pick.randint(0, len(words))
        base = [pick.randrange(pick.choice([1, 2, 5, 50])) for _ in range(pick.choice([1, 2, 3, 7, 8, 9, 15, 16, 17, 33]))]
        times = pick.choice([2, 3, 4, 5])
        words[at:at] = (base * times)[: len(base) * times - pick.randint(0, len(base) - 1)]
    return words


@pytest.mark.parametrize("least, times", [(24, 3), (6, 3), (3, 3), (40, 4)])
def test_runs_of_many_documents_at_once(least, times):
    pick = random.Random(least)
    for _ in range(60):
        docs = [random_words(pick) for _ in range(pick.randint(1, 5))]
        offsets = np.concatenate([[0], np.cumsum([len(d) for d in docs])]).astype(np.int64)
        flat = np.array([w for d in docs for w in d], np.int64)
        got = [[] for _ in docs]
        for start, length, period in zip(*(a.tolist() for a in periodic_runs.runs_of(flat, offsets, least, times))):
            doc = int(np.searchsorted(offsets, start, "right")) - 1
            got[doc].append((start - int(offsets[doc]), length, period))
        assert got == [plain_runs(d, least, times) for d in docs]


def test_keys_too_large_for_one_sort():
    places = np.arange(1 << 12)
    keys = (places % 7) << 55
    names, found, codes = periodic_runs._named(keys, places, len(places))
    assert (names == places % 7).all()
    assert (np.diff(found)[np.diff(codes) == 0] > 0).all()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(periodic_runs, "SLICE_BYTES", 64)
    long = " x " * 9 + " ".join(["a", "b\x1c", "c"] * 2000) + " tail " + "z " * 24
    texts = [(1, None), (2, ""), (3, " \t\n\v\f\r"), (4, "z " * 23), (5, "z\n" * 24), (5, "z\n" * 24), (None, "Z z " * 40), (6, long), (None, "one"), (7, "日本 " * 30)]
    extra = spark.createDataFrame([(i, t, 3, "s", 5) for i, t in texts], "doc_id BIGINT, text STRING, runs INT, collapsed STRING, n_words INT")
    got = periodic_runs.periodic_runs(extra.repartition(3)).collect()
    want = []
    for doc, text in texts:
        words = (text or "").encode().split()
        runs = plain_runs(words) if len(words) < 5000 else [(9, 6000, 3), (6010, 24, 1)]
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=None)
        want.append((doc, len(words), runs, best, b" ".join(w for i, w in enumerate(words) if i not in gone).decode()))
    rows = [(r["doc_id"], r["n_words"], [tuple(x) for x in r["runs"]], r["strongest"] and tuple(r["strongest"]), r["collapsed"]) for r in got]
    assert sorted(rows, key=repr) == sorted(want, key=repr)
    assert periodic_runs.periodic_runs(extra.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic_runs.periodic_runs(extra, times=2)


def test_op12_whole_table(spark):
    docs = q.table(spark, SF_DIR, "documents").collect()
    got = {r["doc_id"]: r for r in q.op12_periodic_runs(spark, SF_DIR).collect()}
    assert len(got) == len(docs)
    planted = 0
    for doc in docs:
        words = (doc["text"] or "").encode().split()
        h = zlib.crc32(str(doc["doc_id"]).encode())
        if h % 10 == 0 and words:
            g = h // 10
            a = g % len(words)
            p = 1 + (len(words) - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(len(words))]
            planted += 1
        runs = plain_runs(words) if len(words) < 1500 else None
        row = got[doc["doc_id"]]
        if runs is None:
            continue
        gone = {i for s, n, p in runs for i in range(s + p, s + n)}
        best = max(runs, key=lambda r: (Fraction(r[1], r[2]), -r[0], -r[2]), default=(None, None, None))
        assert (row["n_runs"], row["start"], row["length"], row["period"]) == (len(runs), *best)
        assert row["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert row["runs_sha256"] == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert row["collapsed_sha256"] == hashlib.sha256(b" ".join(w for i, w in enumerate(words) if i not in gone)).hexdigest()
    assert planted > 5
