"""Periodic runs of words, found by a dictionary of basic factors.

For every power-of-two length a factor of a document gets a name; equal factors have equal names. Where the same factor
occurs again within twice its length, the distance is a proposed period; proposals at neighbouring places are one
arithmetic progression and are kept once. Every proposal is extended to both sides by the names, longest factors first,
and runs that several lengths propose are kept once, with their smallest period. All documents of a slice are worked on
together in numpy arrays; a factor that occurs once in its document gets no name, so longer lengths look at few places.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.chunks import slices, text_array
from lumberline.llm.store import ship_package

LEAST, TIMES = 24, 3

# Bytes of text whose documents are named together.
SLICE_BYTES = 2 << 20

RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
ROWS = {"doc_id": pa.int64(), "n_words": pa.int64(), "runs": pa.list_(RUN), "strongest": RUN, "collapsed": pa.large_string()}
RUN_TYPE = "struct<start:bigint, length:bigint, period:bigint>"
SCHEMA = f"doc_id bigint, n_words bigint, runs array<{RUN_TYPE}>, strongest {RUN_TYPE}, collapsed string"


def _named(keys: np.ndarray, places: np.ndarray, total: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each key that occurs at two places or more: names by place (-1: none), those places by key, their keys.

    ``places`` rise; the places of a key come out in rising order.
    """
    names = np.full(total, -1, np.int32)
    bits = max(1, (total - 1).bit_length())
    if len(keys) and int(keys.max()).bit_length() + bits < 63:
        # One plain sort of key and place together is several times faster than a stable one of the keys.
        both = np.sort((keys << bits) | places)
        keys, places = both >> bits, both & ((1 << bits) - 1)
    else:
        order = np.argsort(keys, kind="stable")
        keys, places = keys[order], places[order]
    same = keys[1:] == keys[:-1]
    again = np.concatenate([same, [False]]) | np.concatenate([[False], same]) if len(keys) else np.zeros(0, bool)
    keys, places = keys[again], places[again]
    code = np.cumsum(np.concatenate([[0], keys[1:] != keys[:-1]])) if len(keys) else keys
    names[places] = code
    return names, places, code


class Factors:
    """Names of the factors of lengths 1, 2, 4, … of several documents that stand one after the other.

    ``ends`` has, for each place, where its document ends, ``begins`` where it begins. Names go up to the length at
    which no factor occurs twice in a document.
    """

    def __init__(self, words: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> None:
        self.begins, self.ends = begins, ends
        total = len(words)
        places = np.arange(total)
        width = int(words.max()) + 1 if total else 1
        # A word of another document is another word.
        names, found, codes = _named(begins * width + words, places, total)
        self.levels, self.sorted = [names], [(found, codes)]
        while len(found):
            size = 1 << (len(self.levels) - 1)
            places = np.sort(found)
            places = places[places + 2 * size <= ends[places]]
            places = places[names[places + size] >= 0]
            width = int(codes[-1]) + 1
            names, found, codes = _named(names[places].astype(np.int64) * width + names[places + size], places, total)
            self.levels.append(names)
            self.sorted.append((found, codes))

    def proposals(self, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Places and periods. A run has its period at the least length that is not shorter than the period.

        A run of at least ``least`` words and three periods holds a factor of that length and its next occurrence, one
        period on; up to half of ``least`` one length serves all periods.
        """
        first = max(0, (least // 2).bit_length() - 1)
        at, period = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for level in range(first, len(self.levels)):
            size = 1 << level
            places, codes = self.sorted[level]
            step = places[1:] - places[:-1]
            # Periods of up to half the length were proposed by the length before.
            near = (codes[1:] == codes[:-1]) & (step <= 2 * size) & (step > (0 if level == first else size // 2))
            start, distance = places[:-1][near], step[near]
            order = np.lexsort((start, distance))
            start, distance = start[order], distance[order]
            new = np.ones(len(start), bool)
            new[1:] = (distance[1:] != distance[:-1]) | (start[1:] != start[:-1] + 1)
            at.append(start[new])
            period.append(distance[new])
        return np.concatenate(at), np.concatenate(period)

    def reach(self, left: np.ndarray, right: np.ndarray, back: bool) -> np.ndarray:
        """How many words from ``left`` and ``right`` on are the same, or before them if ``back``."""
        out = np.zeros(len(left), np.int64)
        room = left - self.begins[np.minimum(left, len(self.begins) - 1)] if back else self.ends[left] - right
        for level in range(len(self.levels) - 1, -1, -1):
            size, names = 1 << level, self.levels[level]
            fits = np.flatnonzero(room - out >= size)
            if back:
                a, b = left[fits] - out[fits] - size, right[fits] - out[fits] - size
            else:
                a, b = left[fits] + out[fits], right[fits] + out[fits]
            out[fits[(names[a] == names[b]) & (names[a] >= 0)]] += size
        return out


def runs_of(words: np.ndarray, offsets: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All runs of the documents ``words[offsets[d]:offsets[d + 1]]``: place of the start, length and period, in order."""
    sizes = np.diff(offsets)
    factors = Factors(words, np.repeat(offsets[:-1], sizes), np.repeat(offsets[1:], sizes))
    place, period = factors.proposals(least)
    if not len(place):
        return place, period, period
    before, after = factors.reach(place, place + period, True), factors.reach(place, place + period, False)
    start, length = place - before, before + after + period
    long = length >= np.maximum(least, times * period)
    start, length, period = start[long], length[long], period[long]
    order = np.lexsort((period, length, start))
    start, length, period = start[order], length[order], period[order]
    # A stretch with several periods is one run with the smallest.
    new = np.ones(len(start), bool)
    new[1:] = (start[1:] != start[:-1]) | (length[1:] != length[:-1])
    start, length, period = start[new], length[new], period[new]
    order = np.lexsort((period, start))
    return start[order], length[order], period[order]


def strongest(runs: list[tuple[int, int, int]]) -> tuple[int, int, int] | None:
    """The run of the greatest exact length by period, of equal ones that of the least start, then period."""
    return min(runs, key=lambda run: (-Fraction(run[1], run[2]), run[0], run[2]), default=None)


def _spaced(texts: pa.Array) -> pa.Array:
    for blank in "\t\n\v\f\r":
        texts = pc.replace_substring(texts, blank, " ")
    return texts


def _coded(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The words of all texts as numbers, and where each text's words begin."""
    lists = pc.split_pattern(_spaced(texts), " ")
    coded = lists.values.dictionary_encode()
    real = np.array(pc.binary_length(coded.dictionary)) > 0
    codes = coded.indices.to_numpy().astype(np.int64)
    kept = real[codes] if len(codes) else np.zeros(0, bool)
    before = np.concatenate([[0], np.cumsum(kept)])
    return codes[kept], before[lists.offsets.to_numpy()]


def _rows(ids: list[int | None], texts: pa.Array, least: int, times: int, places: Callable[[int | None, int], np.ndarray | None] | None) -> pa.RecordBatch:
    words, offsets = _coded(texts)
    moved = {}
    if places is not None:
        for d, doc in enumerate(ids):
            taken = places(doc, int(offsets[d + 1] - offsets[d]))
            if taken is not None:
                moved[d] = taken
                words[offsets[d] : offsets[d + 1]] = words[offsets[d] : offsets[d + 1]][taken]
    start, length, period = runs_of(words, offsets, least, times)
    doc = np.searchsorted(offsets, start, "right") - 1
    runs: list[list[tuple[int, int, int]]] = [[] for _ in ids]
    for d, s, n, p in zip(doc.tolist(), (start - offsets[doc]).tolist(), length.tolist(), period.tolist()):
        runs[d].append((s, n, p))
    best, collapsed = [], []
    for d, text in enumerate(texts.cast(pa.large_binary())):
        own = text.as_py().split()
        if d in moved:
            own = [own[i] for i in moved[d].tolist()]
        if runs[d]:
            # Marks where a stretch of repetitions begins and ends; a word stays where none is open.
            edges = np.zeros(len(own) + 1, np.int64)
            for s, n, p in runs[d]:
                edges[s + p] += 1
                edges[s + n] -= 1
            own = [own[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
        best.append(strongest(runs[d]))
        collapsed.append(b" ".join(own))
    record = lambda run: run and dict(zip(("start", "length", "period"), run))
    columns = [
        pa.array(ids, pa.int64()),
        pa.array(np.diff(offsets)),
        pa.array([[record(run) for run in each] for each in runs], ROWS["runs"]),
        pa.array([record(run) for run in best], RUN),
        pa.array(collapsed, pa.large_binary()).cast(pa.large_string()),
    ]
    return pa.RecordBatch.from_arrays(columns, list(ROWS))


def periodic_runs(
    docs: DataFrame,
    id_column: str = "doc_id",
    text_column: str = "text",
    least: int = LEAST,
    times: int = TIMES,
    places: Callable[[int | None, int], np.ndarray | None] | None = None,
) -> DataFrame:
    """A row per document: ``doc_id, n_words, runs, strongest, collapsed``.

    A run is a stretch of words with smallest period q (words q apart are the same) of at least ``least`` words and
    ``times`` periods that no neighbouring word extends. ``runs`` lists them by start, then period; ``strongest`` is the
    one of the greatest length by period, null without runs; ``collapsed`` is the text without the words that a run
    repeats, one space between words. Words are what stands between the six ASCII blanks. ``places`` may give, for an id
    and a number of words, the places from which the words are taken instead. Null and empty texts have no words.
    Repeated rows are repeated; other columns are left out; no rows give no rows. A document is worked on in one task,
    in about 4 bytes for each word and power of two up to its longest repeated factor.
    """
    if times < 3 or least < 2:
        raise ValueError("runs repeat three times and have two words at least")
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, at = batch.column(0), 0
            for part in slices(text_array(batch.column(1)), SLICE_BYTES):
                yield _rows(ids.slice(at, len(part)).to_pylist(), part, least, times, places)
                at += len(part)

    return docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(run, SCHEMA)
