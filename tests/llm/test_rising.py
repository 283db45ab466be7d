"""Elias-Fano sequences and packed runs against numpy on whole arrays."""

from __future__ import annotations

import numpy as np
import pytest

from lumberline.llm import elias_fano, language_model
from lumberline.llm.elias_fano import Rising


@pytest.mark.parametrize("size,step", [(0, 1), (1, 5), (3, 1), (700, 1), (5000, 0), (4000, 3), (3000, 10**6)])
@pytest.mark.parametrize("shape", ["even", "repeats", "gaps"])
def test_places_and_numbers(size, step, shape):
    rng = np.random.default_rng(size + step)
    values = np.cumsum(rng.integers(0, step + 1, size)).astype(np.int64)
    if shape == "repeats" and size > 600:
        # Rows of ones over many words of bits, in the middle and at the end.
        values = np.sort(np.concatenate([values, np.full(500, values[size // 2]), np.full(300, values[-1] + 5000)]))
    if shape == "gaps":
        values = np.sort(values * (np.cumsum(rng.integers(0, 2, size)) // 7 + 1))
    rising = Rising.from_arrays(Rising.of(values).arrays())
    top = int(values[-1]) if size else 3
    asked = np.concatenate([values, values + 1, rng.integers(0, top + 10, 500), [0, top + 1, top * 3 + 99, 1 << 40]])
    place, same = rising.successor(asked)
    assert (place == np.searchsorted(values, asked)).all()
    assert (same == np.isin(asked, values)).all()
    assert (rising.get(np.arange(len(values))) == values).all()


def test_steps_of_any_numbers():
    rng = np.random.default_rng(3)
    for values in (rng.integers(0, 1 << 64, 1000, np.uint64), np.array([0, 2**64 - 1, 0, 2**63, 1], np.uint64), np.zeros(0, np.uint64)):
        steps = language_model._unpack(language_model._pack(language_model._steps(values)), "<u8") if len(values) else values
        assert (language_model._from_steps(steps) == values).all()


def test_a_pair_is_found_by_one_search(tmp_path, monkeypatch):
    """Children are told by their pair's number: a lookup reads no pointers and no number before a parent's children."""
    rng = np.random.default_rng(7)
    distinct, width = 5000, 5001
    model = language_model.Model(tmp_path.as_uri(), 10**6, distinct)
    pairs = np.unique(np.concatenate([rng.integers(300 * width, 900 * width, 4000), 400 * width + np.arange(0, distinct, 3)])).astype(np.uint64)
    counts, lower = rng.integers(1, 9, len(pairs)), rng.integers(40, 90, len(pairs)).astype(np.uint8)
    name = language_model._save_level(model, 3, pairs, lower, counts, {}, True)
    searches, select = [], elias_fano._select
    monkeypatch.setattr(elias_fano, "_select", lambda *args: searches.append(1) or select(*args))
    asked = np.unique(np.concatenate([pairs, pairs + np.uint64(1), np.array([0, 250 * width, 10**9], np.uint64)]))
    nodes, logs = language_model._look_up(language_model.load(model.folder, name), asked, width)
    # One for the bucket of each pair, one more to the end of long buckets.
    assert len(searches) <= 2
    place = {pair: i for i, pair in enumerate(pairs.tolist())}
    assert nodes.tolist() == [place.get(pair, -1) for pair in asked.tolist()]
    tokens, words = {}, {}
    for pair, n in zip(pairs.tolist(), counts.tolist()):
        tokens[pair // width] = tokens.get(pair // width, 0) + n
        words[pair // width] = words.get(pair // width, 0) + 1
    for pair, log in zip(asked.tolist(), logs.tolist()):
        parent = pair // width
        unseen = 0.75 * words[parent] / tokens[parent] if parent in words else 1.0
        i = place.get(pair)
        exact = unseen if i is None else (counts[i] - 0.75) / tokens[parent] + unseen * 10.0 ** language_model.unquantised(lower[i])
        assert log == language_model.unquantised(language_model.quantised(np.log10(exact)))


def test_encoded_words_bring_their_counts(tmp_path, monkeypatch):
    """A batch is encoded without a second look-up or a sort of all its tokens."""
    import pyarrow as pa

    seen = {"a": 5, "b": 2, "\n": 3}
    hashes = language_model._hashes(list(seen))
    order = np.argsort(hashes["first"])
    arrays = {"first": hashes["first"][order], "second": hashes["second"][order], "counts": np.array(list(seen.values()))[order]}
    name = language_model.save(tmp_path.as_uri(), "words", arrays)
    model = language_model.Model(tmp_path.as_uri(), 10, 3, [language_model.Level([name], np.zeros(1, np.int64), np.zeros(0, np.uint64))])
    monkeypatch.setattr(language_model.Model, "counts", None)

    class Docs:
        def mapInArrow(self, run, schema):
            return run

    batch = pa.record_batch({"doc_id": [1, 2, 3], "held_out": [False] * 3, "text": ["a  B a x", None, "b\ta"]})
    (got,) = language_model._encode(Docs(), model)(iter([batch]))
    ids = dict(zip(np.array(list(seen))[order].tolist(), range(3))) | {"x": model.unknown}
    texts = [["a", "b", "a", "x", "\n"], ["\n"], ["b", "a", "\n"]]
    assert [np.frombuffer(value, "<u4").tolist() for value in got["ids"].to_pylist()] == [[ids[w] for w in words] for words in texts]
    assert got["n_tokens"].to_pylist() == [5, 1, 3] and got["n_known"].to_pylist() == [4, 1, 3]
    want = [sum(np.log10((seen.get(w, 0) + 1) / 14) for w in words) for words in texts]
    assert got["base_score"].to_pylist() == pytest.approx(want, rel=1e-12)
