"""Dedup, quality, language model and the pipeline against brute force."""

from __future__ import annotations

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from lumberline.llm import components, elias_fano, exact_dedup, language_model, quality, simhash
from lumberline.llm import queries as q

SF_DIR = "/root/testdata/sf0.001"
TEXTS = [None, "", "A b", "a B", "a  b", "É", "é", "x" * 5000, "X" * 5000, "one two three four", "One two three FOUR", "a\x1cb c", "\t\n"]


def low(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def documents(spark, rows):
    extra = [(i, t, "en", 7, "s", "k", 1) for i, t in rows]
    return spark.createDataFrame(extra, "doc_id BIGINT, text STRING, lang STRING, size INT, sha STRING, keep_id STRING, n INT")


# ---------------------------------------------------------------- exact dedup


@pytest.mark.parametrize("hash_all", [True, False])
def test_exact_groups(spark, hash_all, monkeypatch):
    pick = random.Random(5)
    rows = [(i, pick.choice(TEXTS)) for i in range(60)] + [(100 + i, f"only {i}") for i in range(20)]
    rows += [(7, "A b"), (59, "same"), (59, "SAME"), (None, "a b"), (None, None), (3, "x"), (3, "y")]
    if not hash_all:
        monkeypatch.setattr(exact_dedup, "SMALL_ROWS", 0)
    got = exact_dedup.exact_groups(documents(spark, rows).repartition(5), hash_all=hash_all).collect()
    groups = {}
    for i, text in rows:
        groups.setdefault(low(text), []).append(i)
    largest = {t: max(ids, key=lambda i: -1 if i is None else i) for t, ids in groups.items()}
    want = []
    for i, text in rows:
        t = low(text)
        sha = hashlib.sha256(t.encode()).hexdigest()
        want.append((i, largest[t], len(groups[t]), sha))
    key = lambda r: repr(r)
    if hash_all:
        assert sorted([(r["doc_id"], r["keep_id"], r["group_size"], r["text_sha256"]) for r in got], key=key) == sorted(want, key=key)
    else:
        assert sorted([(r["doc_id"], r["keep_id"], r["group_size"]) for r in got], key=key) == sorted([w[:3] for w in want], key=key)
    assert sum(r["kept"] for r in got) == len(groups)
    assert all(r["doc_id"] == r["keep_id"] for r in got if r["kept"])


def test_drop_copies(spark):
    rows = [(1, "A b"), (2, "a b"), (2, "a b"), (5, "c"), (5, "d"), (None, None), (9, ""), (4, "É"), (6, "é")]
    docs = documents(spark, rows)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect()) == [(2, "a b"), (4, "É"), (5, "c"), (5, "d"), (6, "é"), (9, "")]
    assert exact_dedup.drop_copies(documents(spark, [])).collect() == []
    assert exact_dedup.exact_groups(documents(spark, [])).collect() == []


# ---------------------------------------------------------------- SimHash


def plain_fingerprint(text, size=3):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in low(text)).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(nodes, linked):
    root = {n: n for n in nodes}

    def top(n):
        while root[n] != n:
            n = root[n]
        return n

    for i, a in enumerate(nodes):
        for b in nodes[:i]:
            if linked(a, b):
                x, y = top(a), top(b)
                root[max(x, y)] = min(x, y)
    return {n: top(n) for n in nodes}


def test_fingerprints():
    for text in [t for t in TEXTS if t is not None] + ["a b c d e " * 40, "x y", "Word " * 3]:
        assert simhash.fingerprint(text.encode()) == plain_fingerprint(text)
    long = " ".join(str(i % 977) for i in range(simhash.BLOCK + 50))
    assert simhash.fingerprint(long.encode()) == plain_fingerprint(long)


@pytest.mark.parametrize("hot", [1024, 2])
def test_near_links(spark, hot, monkeypatch):
    monkeypatch.setattr(simhash, "HOT_HALF", hot)
    pick = random.Random(hot)
    values = set()
    for _ in range(25):
        base = pick.getrandbits(64)
        values.add(base)
        for _ in range(6):
            near = base
            for bit in pick.sample(range(64), pick.randrange(1, 6)):
                near ^= 1 << bit
            values.add(near)
    signed = [int(np.uint64(v).astype(np.int64)) for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fp BIGINT")
    got = {(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in simhash.near_links(nodes).collect()}
    bits = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    assert got == {(min(a, b), max(a, b)) for a in signed for b in signed if a != b and bits(a, b) <= 3}


@pytest.mark.parametrize("links", [[], [(1, 2)], [(i, i + 1) for i in range(40)], [(0, i) for i in range(1, 30)]])
def test_components(spark, links):
    pick = random.Random(2)
    links = links + ([(100 + pick.randrange(60), 100 + pick.randrange(60)) for _ in range(45)] if links else [])
    got = {r["node"]: r["root"] for r in components.components(spark.createDataFrame(links, "a BIGINT, b BIGINT")).collect()}
    pairs = {frozenset(link) for link in links}
    nodes = sorted({n for a, b in links if a != b for n in (a, b)})
    assert got == components_of(nodes, lambda a, b: frozenset((a, b)) in pairs)


def test_op6_whole_table(spark):
    got = {r["doc_id"]: r for r in q.op6_simhash(spark, SF_DIR).collect()}
    texts = {r["doc_id"]: r["text"] for r in q.table(spark, SF_DIR, "documents").collect()}
    prints = {i: plain_fingerprint(t) for i, t in texts.items()}
    root = components_of(sorted(texts), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in got.items()} == {i: (f"{prints[i]:016x}", root[i]) for i in texts}


def test_near_duplicates_of_odd_rows(spark):
    rows = [(9, None), (4, ""), (6, " \t"), (2, "a b c d"), (2, "a b c d"), (None, "A B C D"), (8, "z")]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or -1, r["component_id"]) for r in got) == [(-1, 2), (2, 2), (2, 2), (4, 4), (6, 4), (8, 8), (9, 4)]
    assert simhash.near_duplicates(documents(spark, [])).collect() == []
    docs = documents(spark, rows)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [2, 4, 8]
    assert simhash.keep_one(documents(spark, [])).collect() == []


@pytest.mark.parametrize("small", [100_000, 0])
def test_another_text_of_a_repeated_id_stays(spark, small, monkeypatch):
    monkeypatch.setattr("lumberline.llm.store.SMALL_ROWS", small)
    near = " ".join(f"w{i}" for i in range(400))
    rows = [(3, near), (7, near.upper()), (7, "quite another text of some words"), (None, near), (None, "a third one here"), (8, None), (9, "")]
    names = "doc_id BIGINT, text STRING, row INT, key INT, key2 INT, gone_doc_id INT, _gone STRING, least STRING, fingerprint STRING"
    docs = spark.createDataFrame([(*r, 1, 2, 3, 4, "g", "l", "f") for r in rows], names)
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    want = [(3, near), (7, "quite another text of some words"), (None, "a third one here"), (8, None)]
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=repr) == sorted(want, key=repr)
    assert {tuple(r)[2:] for r in kept.collect()} == {(1, 2, 3, 4, "g", "l", "f")}


@pytest.mark.parametrize("small", [100_000, 0])
def test_names_of_columns_do_not_clash(spark, small, monkeypatch):
    monkeypatch.setattr(exact_dedup, "SMALL_ROWS", small)
    names = ["row", "id", "own", "size", "head", "sha", "touched", "gone_id", "gone_sha", "key_size", "_own", "_size", "_gone", "keep_id", "n", "odd `name`.x"]
    rows = [(1, "A b"), (2, "a b"), (2, "a b"), (3, None), (4, ""), (5, "c")]
    schema = "doc_id BIGINT, text STRING, " + ", ".join("`{}` STRING".format(n.replace("`", "``")) for n in names)
    docs = spark.createDataFrame([(*r, *names) for r in rows], schema)
    kept = exact_dedup.drop_copies(docs)
    assert kept.columns == docs.columns
    assert sorted(tuple(r) for r in kept.collect()) == [(2, "a b", *names), (4, "", *names), (5, "c", *names)]


def test_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr("lumberline.llm.store.BUNDLE", 7)
    rows = [(1, "x")] * 23 + [(2, "X")] * 8 + [(None, "y")] * 2
    got = exact_dedup.exact_groups(documents(spark, rows)).collect()
    assert sorted((r["doc_id"] or 0, r["group_size"]) for r in got) == [(0, 2)] * 2 + [(1, 31)] * 23 + [(2, 31)] * 8
    assert sum(r["kept"] for r in got) == 2


# ---------------------------------------------------------------- quality


def test_quality_of_held_out_documents(spark):
    got = q.op1_quality(spark, "/root/testdata/sf0.01").collect()
    labels = {r["doc_id"]: r["quality"] for r in q.table(spark, "/root/testdata/sf0.01", "labels").collect()}
    assert len(got) == q.table(spark, "/root/testdata/sf0.01", "documents").count()
    for row in got:
        assert row["held_out"] == (zlib.crc32(str(row["doc_id"]).encode()) % 3 == 1)
        assert 0 <= row["score"] <= 1 and row["predicted"] == (row["score"] >= 0.5)
    held = [r for r in got if r["held_out"] and r["doc_id"] in labels]
    right = sum(r["predicted"] == labels[r["doc_id"]] for r in held) / len(held)
    assert right > 0.9


def plain_features(text):
    """Buckets and values of a text, n-gram by n-gram."""
    mask = (1 << 64) - 1
    a, b, c = (int(m) for m in quality.MIX)
    tokens = quality.TOKEN.findall(text or "")
    word = [xxhash.xxh64_intdigest(t.lower()) for t in tokens]
    shape = [xxhash.xxh64_intdigest(quality._shape(t), 1) for t in tokens]
    shape = [0x5BD1E995 if i and word[i] == word[i - 1] else s for i, s in enumerate(shape)]
    grams = [w * a for w in word] + [(v * a + w) * b for v, w in zip(word, word[1:])]
    grams += [s * c for s in shape] + [(s * b + t) * c for s, t in zip(shape, shape[1:])]
    grams += [((s * b + t) * a + u) * c for s, t, u in zip(shape, shape[1:], shape[2:])]
    counts = Counter((g & mask) >> 44 for g in grams)
    norm = math.sqrt(sum(n * n for n in counts.values()) + 1e-9)
    return {**{k: n / norm for k, n in counts.items()}, quality.BUCKETS: 1.0}


def plain_leader(samples):
    """Follow-the-regularised-leader over dictionaries, one coordinate at a time."""
    z, n = Counter(), Counter()

    def weight(i):
        l1 = 0 if i == quality.BUCKETS else quality.L1
        if abs(z[i]) <= l1:
            return 0.0
        return -(z[i] - math.copysign(l1, z[i])) / ((quality.BETA + math.sqrt(n[i])) / quality.ALPHA + quality.L2)

    def probability(values):
        return 1 / (1 + math.exp(-sum(weight(i) * x for i, x in values.items())))

    for text, label in samples:
        values = plain_features(text)
        error = probability(values) - label
        old = {i: weight(i) for i in values}
        for i, x in values.items():
            g = error * x
            z[i] += g - (math.sqrt(n[i] + g * g) - math.sqrt(n[i])) / quality.ALPHA * old[i]
            n[i] += g * g
    return weight, probability


def test_training_against_a_plain_loop(spark):
    docs = q.table(spark, SF_DIR, "documents").where("doc_id < 120")
    known = quality.known_labels(q.table(spark, SF_DIR, "labels"), "quality", ~quality.in_fold("doc_id", 3, 1))
    model = quality.train(docs, known)
    sample = docs.join(known, "doc_id").orderBy(F.xxhash64("doc_id"), "text", "label").collect()
    assert len(sample) > 20
    weight, probability = plain_leader([(r["text"], r["label"]) for r in sample])
    used = {i for r in sample for i in plain_features(r["text"])}
    assert set(np.flatnonzero(model.weights).tolist()) <= used
    for i in used:
        assert float(model.weights[i]) == pytest.approx(weight(i), rel=1e-5, abs=1e-6)
    for row in quality.score(docs, model).collect():
        assert row["score"] == pytest.approx(probability(plain_features(row["text"])), abs=1e-5)


def test_quality_of_odd_rows(spark):
    docs = documents(spark, [(i, t) for i, t in enumerate(TEXTS)])
    labels = spark.createDataFrame([(0, 1), (1, 0), (1, None), (3, 0), (3, 1), (None, 1)], "doc_id BIGINT, quality INT")
    known = quality.known_labels(labels, "quality", F.lit(True))
    assert sorted((r["doc_id"], r["label"]) for r in known.collect()) == [(0, 1), (1, 0), (3, 1)]
    model = quality.train(docs, known)
    scored = quality.score(docs.withColumn("score", F.lit("old")), model)
    rows = {r["doc_id"]: r for r in scored.collect()}
    assert rows[0]["score"] == rows[1]["score"] and 0 < rows[0]["score"] < 1
    assert rows[7]["lang"] == "en" and rows[7]["text"] == TEXTS[7]
    nothing = quality.train(docs, known.limit(0))
    assert {r["score"] for r in quality.score(docs, nothing).collect()} == {0.5}
    assert quality.score(docs.limit(0), model).collect() == []


# ---------------------------------------------------------------- language model


def test_rising_sequences():
    pick = np.random.default_rng(1)
    for size, top in [(0, 1), (1, 1), (1, 1 << 40), (700, 900), (5000, 1 << 44), (3000, 3001)]:
        values = np.unique(pick.integers(0, top, size)) if size else np.zeros(0, np.int64)
        rising = elias_fano.Rising.from_arrays(elias_fano.Rising.of(values).arrays())
        assert rising.get(np.arange(len(values))).tolist() == values.tolist()
        asked = np.concatenate([values, values + 1, pick.integers(0, top + 5, 200)])
        place, same = rising.successor(asked)
        assert same.tolist() == np.isin(asked, values).tolist()
        assert place[same].tolist() == np.searchsorted(values, asked[same]).tolist()
    repeated = np.repeat(np.arange(0, 400, 4), 7)
    assert elias_fano.Rising.of(repeated).get(np.arange(len(repeated))).tolist() == repeated.tolist()


def words_of(text):
    return "".join(" " if c in "\t\n\v\f\r" else c for c in low(text)).split(" ")


def brute_scores(texts, held_out, order):
    """N-gram scores by plain dictionaries and exact numbers."""
    tokens = {i: [w for w in words_of(t) if w] + ["\n"] for i, t in texts.items()}
    counts = Counter(w for i, ws in tokens.items() if not held_out(i) for w in ws)
    n, v = sum(counts.values()), len(counts)
    after = {}
    for i, ws in tokens.items():
        if held_out(i):
            continue
        line = ["\n", *ws]
        for at in range(1, len(line)):
            for size in range(1, order):
                if at - size >= 0:
                    after.setdefault(tuple(line[at - size : at]), Counter())[line[at]] += 1

    def probability(context, word):
        if not context:
            left = 0.75 * v / (v + 1)
            return (max(counts[word] - 0.75, 0) + left) / n
        lower = probability(context[1:], word)
        seen = after.get(context)
        if not seen:
            return lower
        total = sum(seen.values())
        return max(seen[word] - 0.75, 0) / total + 0.75 * len(seen) / total * lower

    out = {}
    for i, ws in tokens.items():
        line = ["\n", *ws]
        score = sum(math.log10(probability(tuple(line[max(0, at - order + 1) : at]), line[at])) for at in range(1, len(line)))
        base = sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws)
        out[i] = (len(ws), sum(counts[w] > 0 for w in ws), n, base, score)
    return out


@pytest.mark.parametrize("order,tokens", [(2, 1 << 21), (2, 40), (3, 1 << 21), (3, 60)])
def test_scores(spark, order, tokens, monkeypatch):
    pick = random.Random(order)
    texts = {i: t for i, t in enumerate(TEXTS)}
    for i in range(20, 120):
        texts[i] = " ".join(pick.choice(["a", "b", "The", "the", "cat", "sat", "é"] + [f"w{pick.randrange(60)}"]) for _ in range(pick.randrange(30)))
    monkeypatch.setattr(language_model, "FILE_TOKENS", tokens)
    docs = documents(spark, list(texts.items())).repartition(4)
    got = language_model.score_texts(docs, F.col("doc_id") % 4 == 1, order=order).collect()
    want = brute_scores(texts, lambda i: i % 4 == 1, order)
    assert len(got) == len(texts)
    for row in got:
        n_tokens, known, train, base, score = want[row["doc_id"]]
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n_tokens, known, train)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        # Each token's logarithm is rounded by half a step at most in each factor.
        assert abs(row["score"] - score) <= n_tokens * order * 16 / 255 / 2 + 1e-6


def test_scores_without_training_texts(spark):
    docs = documents(spark, [(1, "a"), (2, None)])
    got = language_model.score_texts(docs, F.lit(True)).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"]) for r in got) == [(1, 2, 0, 0), (2, 1, 0, 0)]
    assert language_model.score_texts(docs.limit(0), F.lit(False)).collect() == []


def test_a_pair_travels_with_one_byte_of_its_lower_order(spark, monkeypatch):
    found, write = [], language_model.written

    def watched(df, name, *args):
        table = write(df, name, *args)
        if name == "ngram-runs":
            found.extend(table.collect())
        return table

    monkeypatch.setattr(language_model, "written", watched)
    docs = spark.createDataFrame([(n, " ".join(f"w{(n * k) % 17}" for k in range(40))) for n in range(30)], "doc_id bigint, text string")
    assert len(language_model.score_texts(docs, F.lit(False), order=3).collect()) == 30
    assert len(found) >= 2
    for row in found:
        keys = language_model._unpack(row["keys"], "<u8")
        assert len(language_model._unpack(row["more"], "u1")) == len(keys)


def test_op7_whole_table(spark):
    got = q.op7_language_model(spark, SF_DIR).collect()
    texts = {r["doc_id"]: r["text"] for r in q.table(spark, SF_DIR, "documents").collect()}
    held = lambda i: zlib.crc32(str(i).encode()) % 7 == 2
    want = brute_scores(texts, held, 3)
    assert len(got) == len(texts)
    for row in got:
        n_tokens, known, train, base, score = want[row["doc_id"]]
        assert row["held_out"] == held(row["doc_id"])
        assert (row["n_tokens"], row["n_known"], row["train_tokens"]) == (n_tokens, known, train)
        assert row["base_score"] == pytest.approx(base, rel=1e-9)
        assert abs(row["score"] - score) <= n_tokens * 3 * 16 / 255 / 2 + 1e-6
    assert sum(r["score"] for r in got if r["held_out"]) > sum(r["base_score"] for r in got if r["held_out"])


# ---------------------------------------------------------------- pipeline


def test_stages_keep_columns_of_any_name(spark):
    docs = q.table(spark, SF_DIR, "documents").withColumns({n: F.lit(n) for n in ("quality", "_quality", "score", "row", "key", "id", "own")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        kept = stage(spark, docs, SF_DIR)
        assert kept.columns == docs.columns
        assert {tuple(r)[5:] for r in kept.collect()} == {("quality", "_quality", "score", "row", "key", "id", "own")}
        assert stage(spark, docs.limit(0), SF_DIR).collect() == []


def test_pipeline(spark):
    docs = q.table(spark, SF_DIR, "documents")
    kept = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = kept.toPandas()
        kept = corpus_pipeline.written(stage(spark, kept, SF_DIR), name)
        assert kept.columns == docs.columns
        after = kept.toPandas()
        assert 0 < len(after) <= len(before)
        rows = {r["doc_id"]: tuple(r) for _, r in before.iterrows()}
        assert all(rows[r["doc_id"]] == tuple(r) for _, r in after.iterrows())
        if name == "exact_dedup":
            groups = before.assign(t=before["text"].map(low)).groupby("t")["doc_id"].max()
            assert sorted(after["doc_id"]) == sorted(groups)
        if name == "simhash_near_dedup":
            prints = {r["doc_id"]: plain_fingerprint(r["text"]) for _, r in before.iterrows()}
            root = components_of(sorted(prints), lambda a, b: (prints[a] ^ prints[b]).bit_count() <= 3)
            assert sorted(after["doc_id"]) == sorted(set(root.values()))
    pieces = corpus_pipeline.run(spark, SF_DIR).toPandas()
    assert sorted(set(pieces["doc_id"])) == sorted(after["doc_id"])
