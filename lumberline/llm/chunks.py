"""Texts as runs of chunks: each distinct chunk of a slice is worked on once, and the results are gathered by code.

Tokenizing, hashing and looking up words cost the same for every repetition of a word. Here a slice of a column is
split by blanks in Arrow, coded by distinct chunk, each distinct chunk is turned into a short byte string of numbers,
and numpy expands the codes to the numbers of every text. Slices are bounded in bytes; a text longer than a slice is
cut between chunks, and its numbers are joined again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20

# Entries of each of the two generations of a cache.
CACHE_ENTRIES = 150_000


class TwoGenerations:
    """A bounded dictionary: when the young half is full it becomes the old one, and what is used again moves back."""

    def __init__(self, entries: int = CACHE_ENTRIES) -> None:
        self.entries, self.young, self.old = entries, {}, {}

    def keep(self, values: dict[str, bytes]) -> None:
        if len(self.young) + len(values) > self.entries:
            self.old, self.young = self.young, {}
        self.young.update(values if len(values) <= self.entries else islice(values.items(), self.entries))


def cached(cache: TwoGenerations, keys: list[str], compute: Callable[[list[str]], list[bytes]]) -> list[bytes]:
    """The value of each key, computed together for the keys that the cache doesn't hold."""
    found = list(map(cache.young.get, keys))
    missing = [key for key, value in zip(keys, found) if value is None]
    if missing:
        old = cache.old.get
        known = {key: value for key in missing if (value := old(key)) is not None}
        names = [key for key in dict.fromkeys(missing) if key not in known]
        known.update(zip(names, compute(names)))
        found = [known[key] if value is None else value for key, value in zip(keys, found)]
        cache.keep(known)
    return found


def text_array(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """One array of strings, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column.cast(pa.large_string()), "")


def slices(texts: pa.Array, limit: int = SLICE_BYTES) -> Iterator[pa.Array]:
    """Runs of consecutive texts of at most ``limit`` bytes together; a longer text is a slice of its own."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))
    first = 0
    while first < len(texts):
        before = int(ends[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield texts.slice(first, last - first)
        first = last


def _cut(text: pa.Array, limit: int) -> pa.Array:
    """One long prepared text cut at blanks into parts of about ``limit`` bytes."""
    whole = memoryview(text.cast(pa.large_binary())[0].as_buffer())
    parts, first = [], 0
    while len(whole) - first > limit:
        tail = bytes(whole[first : first + limit])
        at = tail.rfind(b" ")
        if at < 0:
            rest = bytes(whole[first + limit :]).find(b" ")
            if rest < 0:
                break
            at = limit + rest
        parts.append(bytes(whole[first : first + at]))
        first += at + 1
    parts.append(bytes(whole[first:]))
    return pa.array(parts, pa.large_binary()).cast(pa.large_string())


def gathered(table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The stretches of the table that begin at ``starts``, one after the other."""
    ends = np.cumsum(lengths)
    total = int(ends[-1]) if len(ends) else 0
    return table[np.arange(total) + np.repeat(starts - (ends - lengths), lengths)]


def expand(codes: np.ndarray, table: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of each code in turn, and where those of each code end; code ``i`` has ``sizes[i]`` of the table."""
    lengths = sizes[codes]
    return gathered(table, (np.cumsum(sizes) - sizes)[codes], lengths), np.cumsum(lengths)


def flat_blobs(blobs: list[bytes], kind: np.dtype) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of all blobs in one array, and how many each has."""
    return np.frombuffer(b"".join(blobs), kind), np.fromiter(map(len, blobs), np.int64, len(blobs)) // kind.itemsize


def strings_of(texts: pa.Array) -> list[str]:
    """Python strings of an array without nulls, by way of numpy, which is several times faster than one by one."""
    return texts.to_numpy(zero_copy_only=False).tolist()


def _values(prepared: pa.Array, numbers_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    lists = pc.split_pattern(prepared, " ")
    coded = lists.values.dictionary_encode()
    flat, ends = expand(coded.indices.to_numpy(), *numbers_of(coded.dictionary))
    bounds = np.concatenate([[0], ends])[lists.offsets.to_numpy()]
    return [flat[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def chunk_values(
    texts: pa.Array, prepare: Callable[[pa.Array], pa.Array], numbers_of: Callable[[pa.Array], tuple[np.ndarray, np.ndarray]], limit: int = SLICE_BYTES
) -> Iterator[np.ndarray]:
    """For each text the numbers of its chunks in order. ``prepare`` puts blanks between the chunks of a slice.

    ``numbers_of`` gets distinct chunks and gives the numbers of all of them in one array, and how many each has.
    """
    pool = pa.default_memory_pool()
    for part in slices(texts, limit):
        # Arrow keeps what the last slice freed; a worker's share of an executor is small.
        pool.release_unused()
        prepared = prepare(part)
        if len(part) == 1 and pc.binary_length(prepared)[0].as_py() > 2 * limit:
            cuts = _cut(prepared, limit)
            yield np.concatenate([_values(cuts.slice(i, 1), numbers_of)[0] for i in range(len(cuts))])
        else:
            yield from _values(prepared, numbers_of)


def row_values(
    texts: pa.Array,
    prepare: Callable[[pa.Array], pa.Array],
    blobs_of: Callable[[list[str]], list[bytes]],
    kind: np.dtype,
    limit: int = SLICE_BYTES,
) -> Iterator[np.ndarray]:
    """As :func:`chunk_values`, from a byte string of numbers for each chunk."""
    return chunk_values(texts, prepare, lambda chunks: flat_blobs(blobs_of(strings_of(chunks)), kind), limit)


def blank_lines(texts: pa.Array) -> pa.Array:
    """Line feeds as blanks."""
    return pc.replace_substring(texts, "\n", " ")
