"""The mix against plain loops: quotients one by one, words one by one."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from fractions import Fraction
from functools import partial

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumberline.llm import mixing
from lumberline.llm import queries as q

SF_DIR = "/root/testdata/sf0.001"


def plain_seats(shares, most, seats):
    out = [0] * len(shares)
    for _ in range(min(seats, sum(m for s, m in zip(shares, most) if s > 0))):
        best = max((i for i in range(len(shares)) if out[i] < most[i] and shares[i] > 0), key=lambda i: (shares[i] / (2 * out[i] + 1), -i))
        out[best] += 1
    return out


def plain_targets(sizes, weights, repeats):
    """Water-filling in fractions, one source after the other."""
    out = [None] * len(sizes)
    while True:
        left = sum(sizes) - sum(t for t in out if t is not None)
        weight = sum(w for w, t in zip(weights, out) if t is None)
        share = [t if t is not None else Fraction(w * left, weight) for w, t in zip(weights, out)]
        over = [i for i, s in enumerate(share) if s > repeats * sizes[i]]
        if not over:
            return [float(s) for s in share]
        for i in over:
            out[i] = Fraction(repeats * sizes[i])


def scrambled(x):
    mask = (1 << 64) - 1
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & mask
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & mask
    return x ^ (x >> 31)


def plain_times(blocks, quota, seed, source, shard):
    mask = (1 << 64) - 1
    base = scrambled((scrambled((seed + source) & mask) + shard) & mask)
    order = sorted(range(blocks), key=lambda b: scrambled((base + (b + 1) * 0x9E3779B97F4A7C15) & mask))
    times = [quota // blocks] * blocks
    for b in order[: quota % blocks]:
        times[b] += 1
    return times


def test_apportionment():
    pick = random.Random(3)
    for _ in range(150):
        n = pick.randint(1, 9)
        shares = [pick.choice([0, 0.5, 1, 1, 2, 7, 1000, pick.random() * 50]) for _ in range(n)]
        most = [pick.choice([0, 1, 3, 500]) for _ in range(n)]
        seats = pick.randint(0, 300)
        assert mixing.apportioned(np.array(shares), np.array(most), seats).tolist() == plain_seats(shares, most, seats)


def test_targets():
    pick = random.Random(4)
    for _ in range(100):
        sizes = [pick.choice([0, 1, 5, 100, 10_000]) for _ in range(pick.randint(1, 8))]
        weights = mixing.repeating((5, 2, 1), sizes)
        assert mixing.targets(sizes, weights, 3) == pytest.approx(plain_targets(sizes, weights, 3))
    assert mixing.targets([], [], 3) == []


def plain_mix(shards, seats_of, block_words, repeats):
    """Rows of each shard: words of each document taken, one word at a time."""
    out = []
    for (source, shard), (docs, quota) in shards.items():
        total = sum(size for _, size in docs)
        blocks = max(1, (total + block_words // 2) // block_words)
        times = plain_times(blocks, quota, mixing.SEED, source, shard)
        block_of = [b for b in range(blocks) for _ in range(b * total // blocks, (b + 1) * total // blocks)]
        at = 0
        for doc, size in docs:
            out.append((doc, size, sum(times[block_of[i]] for i in range(at, at + size))))
            at += size
    return out


def odd_rows(pick):
    rows = [(i, pick.choice(["s1", "s2", "ä", None, ""]), " ".join("w" * pick.randint(0, 90))) for i in range(120)]
    rows += [(500, "s1", "same text here")] * 2100 + [(None, None, "a b"), (None, None, None), (7, "s2", ""), (7, "s2", "x y\x1cz")]
    return rows + [(900, "big", "one two " * 4000), (901, "none", None), (902, "none", " \n\t")]


def test_against_plain_loops(spark):
    rows = odd_rows(random.Random(8))
    docs = spark.createDataFrame([(a, b, c, 1, 2.0, "k") for a, b, c in rows], "doc_id BIGINT, source STRING, text STRING, size INT, target DOUBLE, key STRING")
    block_words, shard_words = 5, 400
    weigh = partial(mixing.repeating, (5, 2, 1))
    got = mixing.mix(docs.repartition(4), weigh, block_words=block_words, shard_words=shard_words).collect()

    names = sorted({b for _, b, _ in rows}, key=lambda s: (s is None, s or ""))
    sizes = [sum(len((c or "").encode().split()) for _, b, c in rows if b == name) for name in names]
    wanted = plain_targets(sizes, weigh(names), 3)
    keys = docs.select(F.xxhash64("doc_id", F.coalesce("text", F.lit("")), F.lit(mixing.SEED)).alias("key"), "doc_id", "source", "text").collect()
    counted = Counter((r["source"], r["key"], r["doc_id"], len((r["text"] or "").encode().split())) for r in keys)
    bundles = [(*k, b, min(mixing.BUNDLE, n - b * mixing.BUNDLE)) for k, n in counted.items() for b in range(-(-n // mixing.BUNDLE)) if k[3]]
    hashed = spark.createDataFrame([(b[1], b[4]) for b in bundles], "key BIGINT, bundle BIGINT").select(F.xxhash64("key", "bundle")).collect()
    shards = defaultdict(list)
    for (source, key, doc, size, bundle, n), (h,) in zip(bundles, hashed):
        i = names.index(source)
        shards[i, h % max(1, -(-sizes[i] // shard_words))].append((key, doc is not None, doc or 0, size, bundle, n, doc))
    blocks = {s: max(1, (sum(r[3] * r[5] for r in own) + block_words // 2) // block_words) for s, own in shards.items()}
    most = [sum(3 * b for (i, _), b in blocks.items() if i == n) for n in range(len(names))]
    seats = plain_seats([t / block_words for t in wanted], most, round(sum(wanted) / block_words))
    planned = {}
    for i in range(len(names)):
        own = sorted(s for s in shards if s[0] == i)
        quotas = plain_seats([sum(r[3] * r[5] for r in shards[s]) / block_words for s in own], [3 * blocks[s] for s in own], seats[i])
        for s, quota in zip(own, quotas):
            planned[s] = ([(r[6], r[3]) for r in sorted(shards[s]) for _ in range(r[5])], quota)
    want = plain_mix(planned, seats, block_words, 3) + [(doc, 0, 0) for (_, _, doc, size), n in counted.items() if not size for _ in range(n)]
    assert Counter((r["doc_id"], r["size"], r["taken"]) for r in got) == Counter(want)
    target_of = dict(zip(names, wanted))
    size_of = dict(zip(names, sizes))
    for r in got:
        assert r["target"] == pytest.approx(target_of[r["source"]]) and r["source_size"] == size_of[r["source"]]
        assert sum(s["length"] * s["times"] for s in r["spans"]) == r["taken"] <= 3 * r["size"]
        assert all(0 <= s["start"] and s["start"] + s["length"] <= r["size"] and 1 <= s["times"] <= 3 for s in r["spans"])
    again = mixing.mix(docs.orderBy(F.desc("text")).repartition(7), weigh, block_words=block_words, shard_words=shard_words).collect()
    assert Counter(map(repr, again)) == Counter(map(repr, got))


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a", None), (2, None, "")], "doc_id BIGINT, source STRING, text STRING")
    weigh = partial(mixing.repeating, (5, 2, 1))
    assert mixing.mix(docs.limit(0), weigh).collect() == []
    assert {(r["doc_id"], r["size"], r["target"], r["taken"]) for r in mixing.mix(docs, weigh).collect()} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}


def test_op11_whole_table(spark):
    docs = {r["doc_id"]: r for r in q.table(spark, SF_DIR, "documents").collect()}
    got = q.op11_mix_sources(spark, SF_DIR).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    names = sorted({r["source"] for r in docs.values()}, key=lambda s: (s is None, s or ""))
    taken, sizes, target = Counter(), Counter(), {}
    for r in got:
        source = docs[r["doc_id"]]["source"]
        assert r["size"] == len((docs[r["doc_id"]]["text"] or "").encode().split())
        assert 0 <= r["taken"] <= 3 * r["size"]
        taken[source] += r["taken"]
        sizes[source] += r["size"]
        target[source] = r["target"]
    assert [target[n] for n in names] == pytest.approx(plain_targets([sizes[n] for n in names], [(5, 2, 1)[i % 3] for i in range(len(names))], 3))
    for n in names:
        assert abs(taken[n] - target[n]) <= 0.01 * target[n] + 1
    assert sorted(map(tuple, q.op11_mix_sources(spark, SF_DIR).collect())) == sorted(map(tuple, got))
