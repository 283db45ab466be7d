"""The audit of sources against plain dictionaries; its SQL is compared in test_sql."""

from __future__ import annotations

import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lumberline.llm import source_terms
from lumberline.llm.chunks import text_array

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
COLUMNS = "lang STRING, source STRING, text STRING, term INT, n STRING, value DOUBLE, number INT, half INT"


def terms_of(text):
    return ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t) for t in TERM.findall(text or "")]


def plain_audit(rows, least=3, top=200):
    counts, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        counts[lang, source].update(terms_of(text))
        documents[lang].update(set(terms_of(text)))
    out = []
    for lang, source in groups:
        kept = [t for t, n in documents[lang].items() if n >= least]
        p = lambda own: {t: 1 + 10**9 * (own[t] + 1) // (sum(own[k] for k in kept) + len(kept)) for t in kept}  # noqa: E731, B023
        mine = p(counts[lang, source])
        whole = p(sum((counts[g] for g in groups if g[0] == lang), Counter()))
        pairs = []
        for other_lang, other in groups:
            if other_lang == lang and other != source:
                theirs = p(counts[lang, other])
                pairs.append((other, sum((mine[t] - theirs[t]) ** 2 // theirs[t] for t in kept)))
        terms = [(t, (mine[t] - whole[t]) ** 2 // whole[t]) for t in kept if counts[lang, source][t] and mine[t] > whole[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda r: (-r[1], r[0].encode()))
            out += [(lang, source, part, item, value, i + 1) for i, (item, value) in enumerate(found) if part == "pair" or i < top]
    return sorted(out)


@pytest.mark.parametrize("seed", range(30))
def test_multikey_quicksort(seed):
    pick = random.Random(seed)
    alphabet = pick.choice(["ab ", "abAB é1.日本xyzxyzxyz", "a", "aaaaaaaab "])
    texts = ["".join(pick.choice(alphabet) for _ in range(pick.choice([0, 1, 9, 60, 300]))) for _ in range(pick.randint(0, 7))]
    column = text_array(pa.array(["before", *texts])).slice(1)
    offsets = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, 8)
    pointers = source_terms.Pointers(np.frombuffer(column.buffers()[2], np.uint8), offsets)
    order, runs = source_terms.multikey_sorted(pointers)
    terms = pointers.terms(order).to_pylist()
    want = sorted((t.encode(), d) for d, text in enumerate(texts) for t in terms_of(text))
    assert [(t.encode(), int(d)) for t, d in zip(terms, pointers.texts[order])] == want
    assert runs.tolist() == [i for i, (t, _) in enumerate(want) if i == 0 or want[i - 1][0] != t]


def random_rows(pick):
    words = ["alpha", "Alpha", "beta", "gammagammagamma", "gammagammagammb", "délta", "日本", "x", "zz9zz", "one-two", "", " q"]
    rows = []
    for _ in range(90):
        text = pick.choice([None, "", " ".join(pick.choices(words, k=pick.randint(1, 12)))])
        rows.append((pick.choice(["en", "de", "EN", None, ""]), pick.choice(["a", "b", "c", None, "é"]), text))
    # A language without kept terms, a source without terms, repeated rows, a long text.
    rows += [("xx", "p", "once"), ("xx", "q", "twice twice"), ("en", "none", "1 2 3"), ("en", "a", "Beta beta")] + [("de", "b", "same words here")] * 4
    return rows + [("de", "long", "".join(f"w{chr(97 + i % 26)}x{chr(97 + i % 7)} " for i in range(9000)) + "y" * 5000)]


@pytest.mark.parametrize("size", [1 << 23, 300])
def test_audit(spark, size, monkeypatch):
    monkeypatch.setattr(source_terms, "SLICE_BYTES", size)
    monkeypatch.setattr(source_terms, "HELD_PAIRS", 1 << 20 if size > 300 else 6)
    rows = random_rows(random.Random(size))
    docs = spark.createDataFrame([(*r, 1, "n", 0.5, 7, 8) for r in rows], COLUMNS)
    got = source_terms.audit(docs.repartition(5))
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == plain_audit(rows)
    assert source_terms.audit(docs, least_documents=1, top=2).where("part = 'term'").agg({"rank": "max"}).head()[0] == 2


def test_nothing_to_audit(spark):
    docs = spark.createDataFrame([], COLUMNS)
    assert source_terms.audit(docs).collect() == []
    one = spark.createDataFrame([("en", "a", "x x x", 1, "n", 0.5, 7, 8)], COLUMNS)
    assert source_terms.audit(one).collect() == []
