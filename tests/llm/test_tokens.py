"""Token operators against the libraries, id by id, and against plain loops."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumberline.llm import chunks, huffman, packing, pieces, token_files, tokens
from lumberline.llm import queries as q

WORDS, PIECES = q.tokenizer_path(q.WORD_FILE), q.tokenizer_path(q.PIECE_FILE)
ODD = [
    "", None, " ", "  ", "\n", " a", "a ", "a  b", "▁", "▁▁a ▁b", "\n\n a\n b", "\t x\r\ny", "日本語 テスト", "á é é", "👍🏽 x",
    "a" * 25, "=" * 70 + "  " + "-" * 33, "x" * 3000, "ab" * 900, "\x00a\x1cb", "ﬁ İ ǅ ΑΣ ς", "don't we'll I'M,", "H̱x", "a.,b .",
    "<|startoftext|>foo<|endoftext|>", "x y z", "A" * 60 + " " * 50 + "b",
]


def documents(spark, texts):
    rows = [(i, text, "en", "x") for i, text in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id BIGINT, text STRING, ids STRING, part STRING")


@pytest.fixture(scope="module")
def word_encoder():
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS)
    return lambda text: whole.encode(text or "", add_special_tokens=False).ids


@pytest.fixture(scope="module")
def piece_model():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=PIECES)


texts = st.lists(st.text(st.sampled_from("ab ▁\n.,é'stveAB!1ĉ日👍İthé"), max_size=40), max_size=8)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_words_as_the_library(texts):
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(WORDS) if not hasattr(test_words_as_the_library, "whole") else test_words_as_the_library.whole
    test_words_as_the_library.whole = whole
    got = [ids.tolist() for ids in tokens.encode_texts(pa.array(texts, pa.string()), WORDS)]
    assert got == [whole.encode(text, add_special_tokens=False).ids for text in texts]


def test_odd_texts_as_the_libraries(word_encoder, piece_model):
    assert [ids.tolist() for ids in tokens.encode_texts(pa.array(ODD), WORDS)] == [word_encoder(text) for text in ODD]
    got = list(pieces.encode_pieces(pa.array(ODD), PIECES))
    want = [piece_model.encode(text or "", add_bos=True, add_eos=True) for text in ODD]
    assert [ids.tolist() for ids in got] == want
    assert [text.decode() for text in pieces.model(PIECES).decode(got)] == [piece_model.decode(ids) for ids in want]


@settings(max_examples=150, deadline=None)
@given(texts)
def test_pieces_as_the_library(texts):
    import sentencepiece

    library = getattr(test_pieces_as_the_library, "library", None) or sentencepiece.SentencePieceProcessor(model_file=PIECES)
    test_pieces_as_the_library.library = library
    got = [ids.tolist() for ids in pieces.encode_pieces(pa.array(texts, pa.string()), PIECES)]
    assert got == [library.encode(text, add_bos=True, add_eos=True) for text in texts]


def test_merge_rounds_stop_for_better_pairs():
    """With ranks in no order at all, the rounds still give what merging one pair at a time gives."""
    pick = random.Random(3)
    for _ in range(40):
        names = {"a", "b"}
        while len(names) < 14:
            names.add(pick.choice(sorted(names)) + pick.choice(sorted(names)))
        names = sorted(n for n in names if len(n) <= 6)
        scores = {n: pick.randrange(6) for n in names}
        model = object.__new__(pieces.PieceModel)
        ids = {n: i for i, n in enumerate(names)}
        keys, ranks, results = [], [], []
        for n in names:
            for cut in range(1, len(n)):
                if n[:cut] in ids and n[cut:] in ids:
                    keys.append((ids[n[:cut]] << 32) | ids[n[cut:]])
                    ranks.append(scores[n])
                    results.append(ids[n])
        model.size = len(names)
        model.pairs = pieces.PairTable(np.array(keys, np.int64), np.array(ranks, np.int64), np.array(results, np.int64))
        model.first = len(names) + np.arange(0x110000)
        model.first[ord("a")], model.first[ord("b")] = ids["a"], ids["b"]
        words = ["".join(pick.choice("ab") for _ in range(pick.randrange(1, 25))) for _ in range(30)]
        flat, counts = model.merge(words)
        ends = np.cumsum(counts)
        for word, n, end in zip(words, counts, ends):
            symbols = list(word)
            while True:
                best = min(
                    ((scores[x + y], i) for i, (x, y) in enumerate(zip(symbols, symbols[1:])) if x + y in scores), default=None
                )
                if best is None:
                    break
                symbols[best[1] : best[1] + 2] = [symbols[best[1]] + symbols[best[1] + 1]]
            assert [names[s] for s in flat[end - n : end]] == symbols


def test_letters_of_all_kinds(word_encoder):
    pick = random.Random(4)
    letters = [*"aäÄÖßéÉ×÷İıŁłƝȺȾDžǅµªº\u0301\u0341AZz.,'0!日ſK\u00a0\u1680øŉǰ", "the", "Straße", "CAFÉ", "Ⱥbc", "x" * 60, *" " * 8]
    texts = ["".join(pick.choices(letters, k=pick.choice([1, 5, 30, 200]))) for _ in range(3000)]
    want = [word_encoder(text) for text in texts]
    assert [ids.tolist() for ids in tokens.encode_texts(pa.array(texts), WORDS)] == want


def test_long_texts_are_cut_between_chunks(word_encoder):
    text = " ".join(f"word{i} it's, é{i}." for i in range(400))
    values = chunks.chunk_values(
        chunks.text_array(pa.array([text, "b", None])), chunks.blank_lines, tokens.encoder(WORDS).numbers, limit=500
    )
    assert [v.tolist() for v in values] == [word_encoder(text), word_encoder("b"), []]


def test_caches_stay_bounded():
    cache = chunks.TwoGenerations(5)
    for i in range(100):
        key = str(i)
        assert chunks.cached(cache, [key, "0"], lambda keys: [k.encode() for k in keys]) == [key.encode(), b"0"]
        assert len(cache.young) <= 5 and len(cache.old) <= 5


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 40), min_size=0, max_size=1500), st.integers(0, 5))
def test_codes_round_trip(symbols, spread):
    symbols = np.array(symbols, np.int64) ** (spread + 1) % 1000
    counts = np.bincount(symbols, minlength=1000)
    lengths = huffman.code_lengths(counts)
    assert lengths.max(initial=0) <= huffman.MAX_BITS
    assert (lengths > 0).tolist() == (counts > 0).tolist()
    packed, marks = huffman.pack(symbols, huffman.canonical_codes(lengths), lengths)
    runs = np.minimum(huffman.CHECKPOINT, len(symbols) - huffman.CHECKPOINT * np.arange(len(marks)))
    assert huffman.unpack(packed, marks, runs, huffman.decode_table(lengths)).tolist() == symbols.tolist()


def test_code_lengths_are_limited_and_best():
    fibonacci = [1, 1]
    while len(fibonacci) < 30:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    lengths = huffman.code_lengths(np.array(fibonacci))
    assert lengths.max() == huffman.MAX_BITS
    assert sum(2.0 ** -int(x) for x in lengths) == 1
    even = huffman.code_lengths(np.array([5, 5, 5, 5]))
    assert even.tolist() == [2, 2, 2, 2]


def test_token_files(spark, word_encoder):
    texts = [*ODD, *["the cat"] * 40, " ".join(f"w{i}" for i in range(2000))]
    got = token_files.read_token_files(
        token_files.write_token_files(
            packing.written(tokens.encode_documents(documents(spark, texts).repartition(5), WORDS, 2), "ids"), file_bytes=700
        )
    ).collect()
    start = 0
    assert len(got) == len(texts)
    for row in sorted(got, key=lambda row: row["doc_id"]):
        ids = [*word_encoder(texts[row["doc_id"]]), 2]
        assert (row["start"], row["n_tokens"]) == (start, len(ids))
        assert np.frombuffer(row["ids"], "<u4").tolist() == ids
        start += len(ids)


def test_token_files_with_null_and_repeated_ids(spark):
    rows = [(7, "a b")] * 30 + [(None, "c")] * 3 + [(1, "d"), (9, None)]
    docs = spark.createDataFrame(rows, "doc_id BIGINT, text STRING")
    encoded = packing.written(tokens.encode_documents(docs.repartition(3), WORDS, 2), "ids")
    got = token_files.read_token_files(token_files.write_token_files(encoded, file_bytes=8)).collect()
    got.sort(key=lambda row: row["start"])
    assert [row["doc_id"] for row in got] == [None] * 3 + [1] + [7] * 30 + [9]
    assert np.cumsum([0] + [row["n_tokens"] for row in got])[:-1].tolist() == [row["start"] for row in got]


def test_op2_whole_table(spark, word_encoder):
    got = q.op2_token_files(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in q.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    start = 0
    assert len(got) == len(texts)
    for row in sorted(got, key=lambda row: row["doc_id"]):
        ids = np.array([*word_encoder(texts[row["doc_id"]]), 2], "<u4")
        assert row.asDict() == {"doc_id": row["doc_id"], "start": start, "n_tokens": len(ids), "ids_crc32": zlib.crc32(ids.tobytes())}
        start += len(ids)


def test_op3_whole_table(spark, piece_model):
    got = q.op3_piece_round_trip(spark, "/root/testdata/sf0.001").collect()
    texts = {r["doc_id"]: r["text"] for r in q.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    assert len(got) == len(texts)
    for row in got:
        ids = piece_model.encode(texts[row["doc_id"]] or "", add_bos=True, add_eos=True)
        assert row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(piece_model.decode(ids).encode()).hexdigest()


def check_pieces(rows, texts, encode, window):
    """Every id of every document lies in one piece; sequences have no gaps; all but the last are full."""
    by_doc, by_sequence = {}, {}
    for row in rows:
        by_doc.setdefault(row["doc_id"], []).append(row)
        by_sequence.setdefault(row["sequence_id"], []).append(row)
    assert by_doc.keys() == texts.keys()
    for doc, parts in by_doc.items():
        ids = np.array([*encode(texts[doc]), 1], "<u4")
        at = 0
        for row in sorted(parts, key=lambda row: row["start"]):
            assert row["start"] == at and row["doc_tokens"] == len(ids)
            assert row["ids_crc32"] == zlib.crc32(ids[at : at + row["length"]].tobytes())
            at += row["length"]
        assert at == len(ids)
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    for number, parts in by_sequence.items():
        at = 0
        for row in sorted(parts, key=lambda row: row["offset"]):
            assert row["offset"] == at
            at += row["length"]
        assert at == window or number == len(by_sequence) - 1
        assert {row["padded_length"] for row in parts} == {at if at & (at - 1) == 0 else window}


@pytest.mark.parametrize("window", [8, 1024])
def test_packing(spark, word_encoder, window):
    texts = dict(enumerate([*ODD, *["the cat"] * 40, " ".join(f"w{i}" for i in range(700))]))
    docs = documents(spark, list(texts.values())).repartition(6)
    rows = packing.piece_rows(packing.pack(docs, WORDS, 1, window)).collect()
    check_pieces(rows, texts, word_encoder, window)


def test_op8_whole_table(spark, word_encoder):
    texts = {r["doc_id"]: r["text"] for r in q.table(spark, "/root/testdata/sf0.001", "documents").collect()}
    check_pieces(q.op8_concatenate_and_cut(spark, "/root/testdata/sf0.001").collect(), texts, word_encoder, 2048)


def test_no_rows(spark):
    docs = documents(spark, []).select("doc_id", "text")
    assert packing.piece_rows(packing.pack(docs, WORDS, 1)).collect() == []
    assert token_files.read_token_files(token_files.token_files(docs, WORDS, 2)).collect() == []
    assert pieces.encode_and_decode(docs, PIECES).collect() == []


def test_merged_words_are_placed_without_sorting_their_symbols(monkeypatch):
    """Words become ready in different rounds and come out in their own order, those without symbols too."""
    table = pieces.PairTable(np.array([(1 << 32) | 2, (5 << 32) | 3]), np.array([0, 1]), np.array([5, 6]))
    symbols, sizes = np.array([1, 2, 3, 4, 1, 2, 9, 8, 1, 2, 3, 7]), np.array([3, 0, 1, 2, 2, 4])
    monkeypatch.setattr(np, "argsort", None)
    flat, counts = pieces.MergeRounds(table).merge_symbols(symbols, sizes)
    assert flat.tolist() == [6, 4, 5, 9, 8, 6, 7] and counts.tolist() == [1, 0, 1, 1, 2, 2]
    flat, counts = pieces.MergeRounds(table).merge_symbols(np.zeros(0, np.int64), np.zeros(2, np.int64))
    assert flat.tolist() == [] and counts.tolist() == [0, 0]


def test_stems_are_merged_once(monkeypatch):
    """A stem that an earlier slice held is not merged again."""
    merged, merge = [], pieces.MergeRounds.merge_symbols
    monkeypatch.setattr(pieces.MergeRounds, "merge_symbols", lambda self, symbols, sizes: merged.extend(sizes) or merge(self, symbols, sizes))
    encode, words = tokens.WordEncoder(WORDS), pa.array(["the", "Straße,", "the.", "x" * 17, "it's"])
    first = encode.numbers(words)
    assert sorted(merged) == [3, 7, 17]
    again = encode.numbers(words)
    # Only what is longer than a remembered stem comes back.
    assert sorted(merged) == [3, 7, 17, 17]
    assert [a.tolist() for a in again] == [a.tolist() for a in first]


def test_the_table_of_stems_stays_bounded(word_encoder):
    encode = tokens.WordEncoder(WORDS)
    merged, merge = [], encode.stems.merge
    encode.stems = tokens.StemIds(lambda data, sizes: merged.extend(sizes.tolist()) or merge(data, sizes), entries=40)
    pick = random.Random(9)
    often = [f"{'abcdefgh'[: n % 8 + 1]}{'é' * (n // 8)}xyz" for n in range(16)]
    for _ in range(60):
        rare = ["".join(pick.choices("aeiouñstr", k=pick.randrange(1, 30))) for _ in range(20)]
        words = list(dict.fromkeys([w for pair in zip(often, rare) for w in pair] + ["Q" * 16, "Q" * 17, "q" * 15, "it's"]))
        ids, counts = encode.numbers(pa.array(words))
        assert [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])] == [word_encoder(w) for w in words]
        assert len(encode.stems.low) <= 40 and len(encode.stems.flat) <= 40 * tokens.STEM_BYTES
    # Only what was asked again outlives a full table.
    count = len(merged)
    encode.numbers(pa.array(often))
    assert len(merged) == count


@pytest.mark.parametrize("size", [1, 60, 1 << 21])
def test_rows_handed_on_in_parts_keep_their_places(spark, word_encoder, monkeypatch, size):
    monkeypatch.setattr(tokens, "ROW_BYTES", size)
    texts = [*ODD, *["the cat"] * 20]
    rows = packing.written(tokens.encode_documents(documents(spark, texts).coalesce(1), WORDS, 2), "ids").collect()
    assert sorted(row["doc_id"] for row in rows) == list(range(len(texts)))
    place = 0
    for row in sorted(rows, key=lambda row: row["part_start"]):
        ids = [*word_encoder(texts[row["doc_id"]]), 2]
        assert (row["part"], row["part_start"], row["n_tokens"]) == (0, place, len(ids))
        assert np.frombuffer(row["ids"], "<u2").tolist() == ids
        place += len(ids)


@pytest.mark.parametrize("query", [q.op2_token_files, q.op8_concatenate_and_cut])
def test_sums_of_ids_need_no_worker_of_their_own(spark, query):
    """One Python worker a task: the CRC of ids is Spark's own, so no second worker keeps an encoder in memory."""
    plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") + plan.count("FlatMapGroupsInArrow") == 1
