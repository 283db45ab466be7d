"""SentencePiece BPE with byte fallback, encoded by vectorised merge rounds and decoded from a table of piece bytes.

The symbols of all words of a slice stand in one flat array. A round finds each word's lowest pair rank, merges its
pairs of that rank from the left, and compacts the array; words without a pair left drop out. Within a round a word
stops after a merge that makes a pair of the same or a better rank, because merging one pair at a time would take that
new pair first. So the result is that of merging one pair at a time, however the ranks of the pieces are ordered.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.chunks import TwoGenerations, cached, gathered, row_values, text_array

# The sign that stands for a blank in pieces.
BLANK = "▁"
ID = np.dtype("<u4")
NONE = np.int64(1) << 40

# Ids decoded together.
DECODE_IDS = 1 << 20


class PairTable:
    """Rank and result of pairs of symbols, in an open table that whole arrays of pairs are looked up in."""

    BITS = 20
    FACTOR = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, keys: np.ndarray, ranks: np.ndarray, results: np.ndarray) -> None:
        if len(keys) > 1 << (self.BITS - 1):
            raise ValueError("too many pairs for the table")
        self.keys, self.ranks, self.results = (np.append(a, end) for a, end in ((keys, -1), (ranks, NONE), (results, -1)))
        self.slots = np.full(1 << self.BITS, -1, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(keys)
        while len(rest):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rest[free]
            left = self.slots[slot] != rest
            rest, slot = rest[left], (slot[left] + 1) & ((1 << self.BITS) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * self.FACTOR) >> np.uint64(64 - self.BITS)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of each pair; the rank NONE where there is no such piece."""
        keys = (left << 32) | right
        slot = self._slot(keys)
        found = self.slots[slot]
        open_ = np.flatnonzero((found >= 0) & (self.keys[found] != keys))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & ((1 << self.BITS) - 1)
            found[open_] = self.slots[slot[open_]]
            at = found[open_]
            open_ = open_[(at >= 0) & (self.keys[at] != keys[open_])]
        return self.ranks[found], self.results[found]


class MergeRounds:
    """Merges of pairs of symbols by rank, for many words at once."""

    def __init__(self, pairs: PairTable) -> None:
        self.pairs = pairs

    def merge_symbols(self, symbol: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The symbols after all merges, flat, and how many each word has; ``sizes`` has how many it begins with."""
        word = np.repeat(np.arange(len(sizes)), sizes)
        done_symbols, done_words, done_sizes = [], [], []
        rank = result = None
        while len(symbol):
            if rank is None:
                rank, result = self._ranks(symbol, word)
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            span = np.diff(np.append(starts, len(word)))
            lowest = np.minimum.reduceat(rank, starts)
            open_ = lowest < NONE
            if not open_.all():
                # Words without a pair are ready.
                live = np.repeat(open_, span)
                done_symbols.append(symbol[~live])
                done_words.append(word[starts[~open_]])
                done_sizes.append(span[~open_])
                symbol, word, rank, result = symbol[live], word[live], rank[live], result[live]
                span, lowest = span[open_], lowest[open_]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, span))
            owner = word[at]
            # Only where a word has several pairs of its lowest rank can they overlap or make a better one.
            again = owner[1:] == owner[:-1]
            if again.any():
                several = np.append(again, False)
                several[1:] |= again
                kept = self._until_better(symbol, word, rank, result, self._leftmost(at[several], owner[several]))
                at = np.sort(np.concatenate([at[~several], kept]))
            symbol[at] = result[at]
            keep = np.ones(len(symbol), bool)
            keep[at + 1] = False
            # Only the pairs that a merged symbol takes part in are looked up again.
            new_at = (np.cumsum(keep) - 1)[at]
            symbol, word, rank, result = symbol[keep], word[keep], rank[keep], result[keep]
            touched = np.zeros(len(symbol), bool)
            touched[new_at] = touched[np.maximum(new_at - 1, 0)] = True
            changed = np.flatnonzero(touched)
            rank[changed], result[changed] = self._ranks_at(symbol, word, changed)
        if not done_symbols:
            return np.zeros(0, np.int64), np.zeros(len(sizes), np.int64)
        # The symbols of a word stand together, in the order in which the words became ready.
        words, own = np.concatenate(done_words), np.concatenate(done_sizes)
        first, size = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        first[words], size[words] = np.cumsum(own) - own, own
        return gathered(np.concatenate(done_symbols), first, size), size

    def _ranks(self, symbol: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._ranks_at(symbol, word, np.arange(len(symbol)))

    def _ranks_at(self, symbol: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that start at the places; a word's last symbol starts none."""
        right = np.minimum(at + 1, len(symbol) - 1)
        rank, result = self.pairs.look_up(symbol[at], symbol[right])
        return np.where((right > at) & (word[right] == word[at]), rank, NONE), result

    @staticmethod
    def _leftmost(at: np.ndarray, owner: np.ndarray) -> np.ndarray:
        """Of pairs that overlap in a row, every second one from the left; ``owner`` has the word of each pair."""
        follows = np.zeros(len(at), bool)
        follows[1:] = (at[1:] == at[:-1] + 1) & (owner[1:] == owner[:-1])
        place = np.arange(len(at))
        first = np.maximum.accumulate(np.where(follows, 0, place))
        return at[(place - first) % 2 == 0]

    def _until_better(self, symbol, word, rank, result, at: np.ndarray) -> np.ndarray:
        """Keep a word's merges up to the first one that makes a pair of the same or a better rank."""
        repeated = np.concatenate([[False], word[at[1:]] == word[at[:-1]]])
        if not repeated.any():
            return at
        made = result[at]
        # The left neighbour may itself be a symbol that this round has just merged; the right one is not merged yet.
        left_at = at - 1
        left_merged = np.concatenate([[False], (at[1:] - at[:-1]) == 2])
        left = np.where(left_merged, np.concatenate([[0], made[:-1]]), symbol[np.maximum(left_at, 0)])
        left_word = word[np.maximum(np.where(left_merged, at - 2, left_at), 0)]
        has_left = (left_at >= 0) & (left_word == word[at])
        right_at = np.minimum(at + 2, len(symbol) - 1)
        has_right = (at + 2 < len(symbol)) & (word[right_at] == word[at])
        best = np.minimum(
            np.where(has_left, self.pairs.look_up(left, made)[0], NONE), np.where(has_right, self.pairs.look_up(made, symbol[right_at])[0], NONE)
        )
        better = best <= rank[at]
        if not better.any():
            return at
        # A merge is kept if no earlier merge of its word was followed by a better pair.
        earlier = np.cumsum(better) - better
        first = np.flatnonzero(~repeated)
        base = np.repeat(earlier[first], np.diff(np.append(first, len(at))))
        return at[earlier == base]


class PieceModel(MergeRounds):
    """The pieces of a model file, their ranks, and the pairs that make them."""

    def __init__(self, path: str) -> None:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        names = [model.id_to_piece(i) for i in range(size)]
        self.begin, self.end, self.unknown = model.bos_id(), model.eos_id(), model.unk_id()
        normal = [
            i for i in range(size) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))
        ]
        if any(model.is_unused(i) for i in range(size)):
            raise ValueError("models with unused pieces are split again after merging; that is not supported")
        self.bytes = np.zeros(256, np.int64)
        found = 0
        for i in range(size):
            if model.is_byte(i):
                self.bytes[int(names[i][3:-1], 16)] = i
                found += 1
        if found != 256:
            raise ValueError("the model needs a piece for every byte")
        ids = {names[i]: i for i in normal}
        if any(BLANK in name.lstrip(BLANK) for name in ids):
            raise ValueError("a piece goes on beyond a blank, so words can't be merged apart")
        if any("\n" in name for name in ids if len(name) > 1):
            raise ValueError("a piece holds a line feed beside other characters")
        # Ranks: the better score first; pieces of one score share a rank, and of those the leftmost is merged first.
        scores = np.array([model.get_score(i) for i in normal])
        rank_of = dict(zip(normal, np.unique(-scores, return_inverse=True)[1].tolist()))
        self.size = size
        keys, results, ranks = [], [], []
        for name, i in ids.items():
            for cut in range(1, len(name)):
                left, right = self._symbol(ids, name[:cut]), self._symbol(ids, name[cut:])
                if left is not None and right is not None:
                    keys.append((left << 32) | right)
                    results.append(i)
                    ranks.append(rank_of[i])
        super().__init__(PairTable(np.array(keys, np.int64), np.array(ranks, np.int64), np.array(results, np.int64)))
        # The symbol of each character: its piece, or a number of its own beyond all ids.
        self.first = self.size + np.arange(0x110000, dtype=np.int64)
        for name, i in ids.items():
            if len(name) == 1:
                self.first[ord(name)] = i
        # The text of each piece in bytes, to decode with.
        texts = [
            bytes([int(names[i][3:-1], 16)]) if model.is_byte(i)
            else b"" if model.is_control(i)
            else model.decode([self.unknown]).encode() if model.is_unknown(i)
            else names[i].replace(BLANK, " ").encode()
            for i in range(size)
        ]
        self.text_sizes = np.fromiter(map(len, texts), np.int64, size)
        self.text_starts = np.cumsum(self.text_sizes) - self.text_sizes
        self.text_bytes = np.frombuffer(b"".join(texts), np.uint8)
        self.cache = TwoGenerations()

    def _symbol(self, ids: dict[str, int], text: str) -> int | None:
        """The number of a symbol: a piece's id, or for a lone character without a piece its code point beyond all ids."""
        if text in ids:
            return ids[text]
        return self.size + ord(text) if len(text) == 1 else None

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The symbols of the words after all merges, flat, and how many each word has."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        return self.merge_symbols(self.first[points], np.fromiter(map(len, words), np.int64, len(words)))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of each word: merged pieces, and the bytes of characters that have no piece."""
        symbols, counts = self.merge(words)
        ends = np.cumsum(counts)
        foreign = np.flatnonzero(symbols >= self.size)
        if not len(foreign):
            flat = symbols.astype(ID).tobytes()
            return [flat[4 * (e - n) : 4 * e] for n, e in zip(counts.tolist(), ends.tolist())]
        # Foreign characters become the ids of their bytes.
        spelled = {s: self.bytes[list(chr(s - self.size).encode())].astype(ID).tobytes() for s in set(symbols[foreign].tolist())}
        extra = np.zeros(len(symbols) + 1, np.int64)
        parts, last = [], 0
        for i, s in zip(foreign.tolist(), symbols[foreign].tolist()):
            parts += [symbols[last:i].astype(ID).tobytes(), spelled[s]]
            extra[i + 1] = len(spelled[s]) // ID.itemsize - 1
            last = i + 1
        flat = b"".join([*parts, symbols[last:].astype(ID).tobytes()])
        moved = np.cumsum(extra)
        bounds = np.concatenate([[0], ends])
        bounds = (4 * (bounds + moved[bounds])).tolist()
        return [flat[a:b] for a, b in zip(bounds, bounds[1:])]

    def blobs(self, words: list[str]) -> list[bytes]:
        return cached(self.cache, words, self.encode_words)

    def decode(self, rows: list[np.ndarray]) -> list[bytes]:
        """The texts of rows of ids in UTF-8: pieces and bytes in order, without the blank put before each text."""
        ids = np.concatenate(rows) if rows else np.zeros(0, np.int64)
        sizes = self.text_sizes[ids]
        ends = np.cumsum(sizes)
        at = np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(self.text_starts[ids] - (ends - sizes), sizes)
        text = self.text_bytes[at].tobytes()
        bounds = np.concatenate([[0], ends])[np.cumsum([0, *map(len, rows)])].tolist()
        return [text[a + (text[a : a + 1] == b" ") * (b > a) : b] for a, b in zip(bounds, bounds[1:])]


def separated(texts: pa.Array) -> pa.Array:
    """Blanks between the words of each text: before each run of blank signs, and around line feeds, no piece goes on."""
    signs = pc.replace_substring(texts, " ", BLANK)
    sign, none = pa.scalar(BLANK, pa.large_string()), pa.scalar("", pa.large_string())
    filled = pc.if_else(pc.equal(pc.binary_length(texts), 0), none, pc.binary_join_element_wise(sign, signs, none))
    runs = pc.replace_substring_regex(filled, f"({BLANK}+)", " \\1")
    return pc.replace_substring(runs, "\n", " \n ")


_models: dict[str, PieceModel] = {}


def model(path: str) -> PieceModel:
    """One model per Python worker."""
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode_pieces(texts: pa.Array, path: str) -> Iterator[np.ndarray]:
    """The ids of each whole text, with begin and end ids."""
    pieces = model(path)
    begin, end = np.array([pieces.begin], ID), np.array([pieces.end], ID)
    for ids in row_values(text_array(texts), separated, pieces.blobs, ID):
        yield np.concatenate([begin, ids, end])


def encode_and_decode(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Whole texts as ids and as text decoded from them: ``doc_id, n_tokens, ids, decoded``.

    ``ids`` are little-endian four-byte numbers. A null text counts as empty and has the begin and end ids alone;
    repeated rows stay; no rows give no rows; other columns are left out. No shuffle: each text is worked on where it
    is read, in slices of bounded size.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, texts, held = [], [], 0
            for ids in encode_pieces(batch.column(1), path):
                rows.append(ids)
                held += len(ids)
                if held > DECODE_IDS:
                    texts += model(path).decode(rows[len(texts) :])
                    held = 0
            texts += model(path).decode(rows[len(texts) :])
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(ids) for ids in rows], pa.int64()),
                    pa.array([ids.tobytes() for ids in rows], pa.binary()),
                    pa.array([text.decode("utf-8", "replace") for text in texts], pa.string()),
                ],
                ["doc_id", "n_tokens", "ids", "decoded"],
            )

    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, n_tokens bigint, ids binary, decoded string")
