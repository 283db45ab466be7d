"""Token ids of whole texts with a word-level BPE file of the tokenizers library, each distinct word encoded once."""

from __future__ import annotations

import json
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.chunks import TwoGenerations, blank_lines, cached, chunk_values, flat_blobs, gathered, strings_of, text_array
from lumberline.llm.pieces import MergeRounds, PairTable

# Ids are kept in two bytes; a vocabulary beyond that is refused, not cut.
ID = np.dtype("<u2")
ID_LIMIT = 1 << 16

# Bytes of text that are encoded together, and bytes of ids after which a task hands its rows on.
ENCODE_BYTES = 2 << 20
ROW_BYTES = 2 << 20

# Chunks of each generation whose ids the library gave and that are remembered.
ODD_CHUNKS = 75_000

# Bytes beyond which a word goes to the library.
LONG_WORD = 48

# Bytes of the longest stem that is remembered, and how many stems are.
STEM_BYTES = 16
STEM_ENTRIES = 1 << 18

# Latin letters up to U+024F as UTF-8: ASCII letters, and two bytes of which the first is one of these. Their lower-case
# form is one letter whatever stands beside them, and they compose with nothing.
LATIN_LEADS = range(0xC3, 0xCA)
# No letters (multiplication and division sign), and the capital whose lower-case form is two characters.
NOT_LATIN = ("×", "÷", "İ")
STRANGE = np.array([not (chr(b).isalpha() if b < 128 else b < 0xC0 or b in LATIN_LEADS) for b in range(256)])


def _strange(data: np.ndarray) -> np.ndarray:
    """Marks the bytes of UTF-8 text that are not part of a Latin letter."""
    out = STRANGE[data]
    for sign in NOT_LATIN:
        lead, last = sign.encode()
        out[:-1] |= (data[:-1] == lead) & (data[1:] == last)
    return out


def _byte_letters() -> dict[int, int]:
    """The printable stand-ins that byte-level BPE files use for bytes, as a table for ``str.translate``."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    others = [b for b in range(256) if b not in set(kept)]
    return {b: b for b in kept} | {b: 256 + i for i, b in enumerate(others)}


class WordMerges(MergeRounds):
    """The merges of a byte-level BPE file whose words end with a marked symbol."""

    def __init__(self, model: dict) -> None:
        ids, suffix = model["vocab"], model["end_of_word_suffix"]
        made = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([(ids[a] << 32) | ids[b] for a, b in made], np.int64)
        # A pair that is listed twice has the rank of its last place.
        last = len(made) - 1 - np.unique(keys[::-1], return_index=True)[1]
        results = np.array([ids[a + b] for a, b in made], np.int64)
        super().__init__(PairTable(keys[last], last, results[last]))
        letters = {b: chr(c) for b, c in _byte_letters().items()}
        self.inner = np.array([ids[letters[b]] for b in range(256)], np.int64)
        self.final = np.array([ids[letters[b] + suffix] for b in range(256)], np.int64)

    def merge(self, data: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words of bytes, flat, and how many each has; no word is empty."""
        symbols = self.inner[data]
        lasts = np.cumsum(sizes) - 1
        symbols[lasts] = self.final[data[lasts]]
        return self.merge_symbols(symbols, sizes)


class StemIds:
    """The ids of stems that were merged before, in an open table that the stems of a slice are looked up in together.

    A stem of at most 16 bytes is two numbers of eight; no letter is a zero byte, so the numbers tell all stems apart.
    When the table is full, stems that were asked again since the last time stay, half of the table at most.
    """

    FACTORS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

    def __init__(self, merge: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]], entries: int = STEM_ENTRIES) -> None:
        self.merge, self.entries, self.bits = merge, entries, max(1, (2 * entries - 1).bit_length())
        self.slots = np.full(1 << self.bits, -1, np.int32)
        self.low, self.high = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        self.first, self.size, self.flat = np.zeros(0, np.int32), np.zeros(0, np.uint8), np.zeros(0, ID)
        self.asked = np.zeros(0, bool)

    def _slot(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        mixed = (low ^ (high * self.FACTORS[1])) * self.FACTORS[0]
        return ((mixed ^ (mixed >> np.uint64(32))) * self.FACTORS[1] >> np.uint64(64 - self.bits)).view(np.int64)

    def _find(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """The entry of each stem, or -1."""
        slot = self._slot(low, high)
        found = self.slots[slot]
        open_ = np.flatnonzero(found >= 0)
        while len(open_):
            at = found[open_]
            open_ = open_[(at >= 0) & ((self.low[at] != low[open_]) | (self.high[at] != high[open_]))]
            slot[open_] = (slot[open_] + 1) & ((1 << self.bits) - 1)
            found[open_] = self.slots[slot[open_]]
            open_ = open_[found[open_] >= 0]
        return found

    def _insert(self, entry: np.ndarray) -> None:
        slot = self._slot(self.low[entry], self.high[entry])
        while len(entry):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = entry[free]
            left = self.slots[slot] != entry
            entry, slot = entry[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _keep(self, entry: np.ndarray) -> None:
        """Only these entries stay."""
        size = self.size[entry].astype(np.int64)
        self.flat = gathered(self.flat, self.first[entry], size)
        self.first = (np.cumsum(size) - size).astype(np.int32)
        self.low, self.high, self.size = self.low[entry], self.high[entry], self.size[entry]
        self.asked = np.zeros(len(entry), bool)
        self.slots.fill(-1)
        self._insert(np.arange(len(entry)))

    def numbers(self, letters: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and where in it each stem's begin and how many they are; no stem is empty."""
        starts = np.cumsum(sizes) - sizes
        padded = np.concatenate([letters, np.zeros(STEM_BYTES, np.uint8)])
        eight = np.ndarray((len(letters) + 9,), "<u8", padded, strides=(1,))
        low = eight[starts] & self.MASKS[np.minimum(sizes, 8)]
        high = eight[starts + 8] & self.MASKS[np.clip(sizes - 8, 0, 8)]
        found = np.where(sizes <= STEM_BYTES, self._find(low, high), -1)
        missed, known = np.flatnonzero(found < 0), np.flatnonzero(found >= 0)
        flat, counts = self.merge(gathered(letters, starts[missed], sizes[missed]), sizes[missed])
        flat, places = flat.astype(ID), np.cumsum(counts) - counts
        first, size = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
        first[known], size[known] = self.first[found[known]], self.size[found[known]]
        first[missed], size[missed] = len(self.flat) + places, counts
        ids = np.concatenate([self.flat, flat])
        self.asked[found[known]] = True
        # What is short is remembered; it begins after all that was.
        short = sizes[missed] <= STEM_BYTES
        new, own = missed[short], counts[short]
        before = len(self.low)
        self.first = np.concatenate([self.first, (len(self.flat) + np.cumsum(own) - own).astype(np.int32)])
        self.flat = ids if len(new) == len(missed) else np.concatenate([self.flat, gathered(flat, places[short], own)])
        self.low, self.high = np.concatenate([self.low, low[new]]), np.concatenate([self.high, high[new]])
        self.size = np.concatenate([self.size, own.astype(np.uint8)])
        self.asked = np.concatenate([self.asked, np.zeros(len(new), bool)])
        if len(self.low) <= self.entries:
            self._insert(np.arange(before, len(self.low)))
        else:
            self._keep(np.flatnonzero(self.asked)[-(self.entries // 2) :])
        return ids, first, size


class WordEncoder:
    """Encodes chunks between blanks. Blanks and line feeds separate tokens in such files, so chunks are independent.

    A chunk of Latin letters is one word for the file's splitting rule and goes straight to the merges, all such words of
    a slice together, as bytes, but for those that were merged lately; a full stop or comma at its end is a token of its
    own. Other chunks, and very long words, which would keep all rounds waiting, are encoded by the library, and their ids
    are kept for the next slice.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        if self.whole.get_vocab_size() > ID_LIMIT:
            raise ValueError("the vocabulary needs ids of more than two bytes")
        self.merges = WordMerges(json.loads(self.whole.to_str())["model"])
        self.stems = StemIds(self.merges.merge)
        self.cache = TwoGenerations(ODD_CHUNKS)
        self.marks = {mark: int(np.frombuffer(self._whole([mark])[0], ID)[0]) for mark in ".,"}

    def _whole(self, chunks: list[str]) -> list[bytes]:
        return [array("H", e.ids).tobytes() for e in self.whole.encode_batch_fast(chunks, add_special_tokens=False)]

    def numbers(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of distinct chunks, flat, and how many each has."""
        chunks = chunks.cast(pa.large_string())
        offsets = np.frombuffer(chunks.buffers()[1], np.int64, len(chunks) + 1, 8 * chunks.offset)
        data = chunks.buffers()[2]
        data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(1, np.uint8)
        starts, sizes = offsets[:-1], np.diff(offsets)
        before = np.concatenate([[0], np.cumsum(_strange(data))])
        end = np.where(sizes > 1, data[np.maximum(offsets[1:] - 1, 0)], 0)
        marked = (end == ord(".")) | (end == ord(","))
        sizes = sizes - marked
        plain = (sizes > 0) & (sizes <= LONG_WORD) & (before[starts + sizes] == before[starts])
        marked &= plain
        # Each word once, with and without its mark.
        words, own = np.flatnonzero(plain), sizes[plain]
        bounds = np.concatenate([[0], np.cumsum(own)])
        stems = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(bounds.tobytes()), pa.py_buffer(gathered(data, starts[plain], own).tobytes()))
        stems = stems.dictionary_encode()
        lowered = pc.utf8_lower(stems.dictionary)
        stem_ends = np.frombuffer(lowered.buffers()[1], np.int64, len(lowered) + 1)
        letters = np.frombuffer(lowered.buffers()[2], np.uint8, int(stem_ends[-1])) if len(words) else np.zeros(0, np.uint8)
        flat, stem_first, counts = self.stems.numbers(letters, np.diff(stem_ends))
        code = stems.indices.to_numpy()
        others = np.flatnonzero(~plain)
        rest, rest_counts = flat_blobs(cached(self.cache, strings_of(chunks.take(pa.array(others))), self._whole), ID)
        # Where each chunk's ids begin in the two arrays, one behind the other.
        first, size = np.zeros(len(chunks), np.int64), np.zeros(len(chunks), np.int64)
        first[words], size[words] = stem_first[code], counts[code]
        first[others], size[others] = len(flat) + np.cumsum(rest_counts) - rest_counts, rest_counts
        total = size + marked
        ends = np.cumsum(total)
        out = np.empty(int(ends[-1]) if len(ends) else 0, ID)
        place = np.ones(len(out), bool)
        place[ends[marked] - 1] = False
        out[place] = gathered(np.concatenate([flat, rest]), first, size)
        out[~place] = np.where(end[marked] == ord("."), self.marks["."], self.marks[","])
        return out, total


def prepare(texts: pa.Array) -> pa.Array:
    """Line feeds as blanks, and A-Z in lower case where no mark may join a letter: a joined capital can differ."""
    spaced = blank_lines(texts)
    return spaced if pc.any(pc.match_substring_regex(spaced, "\\p{M}")).as_py() else pc.ascii_lower(spaced)


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per Python worker: its cache serves all tasks that the worker runs."""
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


def encode_texts(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each text."""
    return chunk_values(text_array(texts), prepare, encoder(path).numbers, ENCODE_BYTES)


def encode_documents(docs: DataFrame, path: str, end_id: int, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The ids of each document with ``end_id`` after them: ``doc_id, part, part_start, n_tokens, ids``.

    ``part`` is the task and ``part_start`` the number of ids before the document in that task: an order of all
    documents that needs no shuffle. It holds once the result is written. ``ids`` are little-endian two-byte numbers.
    Null texts count as empty; repeated rows are kept; other columns of ``docs`` are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], ID).tobytes()
        part, start = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows, held, first = [], 0, 0
            for last, ids in enumerate(encode_texts(batch.column(1), path), 1):
                rows.append(ids.tobytes() + end)
                held += len(rows[-1])
                if held < ROW_BYTES and last < batch.num_rows:
                    continue
                sizes = np.fromiter(map(len, rows), np.int64, len(rows)) // ID.itemsize
                starts = start + np.cumsum(sizes) - sizes
                start += int(sizes.sum())
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(np.full(len(rows), part, np.int64)),
                        pa.array(starts),
                        pa.array(sizes),
                        pa.array(rows, pa.binary()),
                    ],
                    ["doc_id", "part", "part_start", "n_tokens", "ids"],
                )
                rows, held, first = [], 0, last

    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, part bigint, part_start bigint, n_tokens bigint, ids binary")
