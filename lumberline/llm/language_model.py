"""N-gram language model in an Elias-Fano trie, trained and asked by Spark tasks.

Level 1 is the vocabulary: hashes of words in order, with counts. A node of a further level is a pair (parent, word):
the parent is a node of the level before, its children stand together in order of their words. A level is cut into files
by ranges of such pairs that hold about equally many tokens, so a very frequent context fills several files and no task
gets more than its share. A file has, for its parents, a quantised weight for unseen words, and for its children one
rising sequence of pairs as numbers, counted from the file's first parent, and a quantised smoothed probability. The high
bits of that sequence are the pointers from parents to children, its low bits tell children apart. Tasks map the files
into memory; a lookup is one search in the sequence, and only words that it doesn't find ask for the parent's weight.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.llm.chunks import chunk_values, slices, strings_of, text_array
from lumberline.llm.elias_fano import Rising
from lumberline.llm.store import create_file, discard, local_path, open_file, shared_folder, written

# What is taken from each count and given to words not seen after a context.
DISCOUNT = 0.75

# Tokens of a file of a level, and tokens after which a task hands its counts on.
FILE_TOKENS = 2 << 20
TASK_TOKENS = 4 << 20

# Tokens that are looked up together.
BATCH_TOKENS = 1 << 20

# Quantised logarithms: 255 steps of equal width from 1 down to the lowest.
LOWEST = -16.0
STEPS = 255

# Stands for the end of a text; words never hold blanks.
END = "\n"
HASH = np.dtype([("first", "<u8"), ("second", "<u8")])
ID = np.dtype("<u4")
RUN = "bucket bigint, keys binary, more binary, counts binary"
SHARD = "bucket bigint, name string, nodes bigint, tokens bigint"


def quantised(log10: np.ndarray) -> np.ndarray:
    return np.clip(np.rint(log10 / LOWEST * STEPS), 0, STEPS).astype(np.uint8)


# The logarithm of each code.
LOGS = np.arange(STEPS + 1) / STEPS * LOWEST


def unquantised(codes: np.ndarray) -> np.ndarray:
    return LOGS[codes]


# ---------------------------------------------------------------- files of arrays


def save(folder: str, prefix: str, arrays: dict[str, np.ndarray]) -> str:
    """A file of arrays, each on a border of 64 bytes after a head that names them."""
    places, at = {}, 0
    for name, array in arrays.items():
        places[name] = [at, len(array), array.dtype.str]
        at += -(-array.nbytes // 64) * 64
    head = json.dumps(places).encode()
    head = len(head).to_bytes(8, "little") + head
    name, stream = create_file(folder, prefix)
    with stream:
        stream.write(head + b"\0" * (-len(head) % 64))
        for array in arrays.values():
            stream.write(array.tobytes() + b"\0" * (-array.nbytes % 64))
    return name


_maps: dict[tuple[str, str], dict[str, np.ndarray]] = {}


def load(folder: str, name: str) -> dict[str, np.ndarray]:
    """The arrays of a file, mapped into memory where the store has paths, else read; once per Python worker."""
    if (folder, name) not in _maps:
        path = local_path(folder, name)
        if path is not None:
            data = np.memmap(path, np.uint8, "r")
        else:
            with open_file(folder, name) as stream:
                data = np.frombuffer(stream.read(), np.uint8)
        size = int.from_bytes(data[:8].tobytes(), "little")
        start = -(-(8 + size) // 64) * 64
        _maps[folder, name] = {
            key: np.asarray(data[start + at : start + at + count * np.dtype(kind).itemsize]).view(kind)
            for key, (at, count, kind) in json.loads(data[8 : 8 + size].tobytes()).items()
        }
    return _maps[folder, name]


# ---------------------------------------------------------------- runs: counts on their way to a bucket


def _pack(values: np.ndarray) -> bytes:
    """Compressed by the place of bytes: the high bytes of small numbers and differences are long runs of zeros."""
    planes = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize).T
    return zstandard.ZstdCompressor(level=1).compress(planes.tobytes())


def _unpack(data: bytes, kind: str) -> np.ndarray:
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data), np.uint8)
    size = np.dtype(kind).itemsize
    return np.ascontiguousarray(planes.reshape(size, -1).T).reshape(-1).view(kind)


def _steps(values: np.ndarray) -> np.ndarray:
    """Differences, rising and falling ones as small numbers."""
    step = np.diff(values, prepend=values.dtype.type(0)).view(np.int64)
    return (step << 1) ^ (step >> 63)


def _from_steps(steps: np.ndarray) -> np.ndarray:
    return np.cumsum((steps >> np.uint64(1)) ^ (np.uint64(0) - (steps & np.uint64(1))), dtype=np.uint64)


def _narrow(counts: np.ndarray) -> np.ndarray:
    """Counts in four bytes where they fit."""
    return counts.astype("<u4") if not len(counts) or int(counts.max()) < 1 << 32 else counts


def _runs(bucket: np.ndarray, keys: np.ndarray, more: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """A row for each bucket with its keys, in order, what goes with them, and their counts.

    Keys travel as differences, and so do numbers of eight bytes that go with them; bytes as they are.
    """
    starts = np.flatnonzero(np.diff(bucket, prepend=-1)) if len(bucket) else np.zeros(0, np.int64)
    ends = np.append(starts[1:], len(bucket))
    rows = [
        (int(bucket[a]), _pack(np.diff(keys[a:b], prepend=keys.dtype.type(0))), _pack(_steps(more[a:b]) if more.itemsize == 8 else more[a:b]), _pack(counts[a:b]))
        for a, b in zip(starts.tolist(), ends.tolist())
    ]
    kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
    columns = list(zip(*rows)) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], ["bucket", "keys", "more", "counts"])


def _runs_of(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, what goes with them (numbers of the kind) and counts of all runs of a bucket, one after the other."""
    rows = table.to_pylist()
    keys = [np.cumsum(_unpack(r["keys"], "<u8"), dtype=np.uint64) for r in rows]
    more = [_unpack(r["more"], kind) for r in rows]
    return np.concatenate(keys), np.concatenate(list(map(_from_steps, more)) if kind == "<u8" else more), np.concatenate(
        [_unpack(r["counts"], "<i8") for r in rows]
    )


def _merged(keys: np.ndarray, more: np.ndarray, counts: np.ndarray, both: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry per key (per key and ``more`` if ``both``) with the sum of its counts, in order."""
    order = np.argsort(keys, kind="stable")
    ordered, beside = keys[order], more[order]
    new = ordered[1:] != ordered[:-1]
    if both and (~new & (beside[1:] != beside[:-1])).any():
        # Rare: two hashes that are equal in their first half.
        order = np.lexsort((more, keys))
        ordered, beside = keys[order], more[order]
        new = (ordered[1:] != ordered[:-1]) | (beside[1:] != beside[:-1])
    keys, more, counts = ordered, beside, counts[order]
    first = np.flatnonzero(np.concatenate([np.ones(min(1, len(keys)), bool), new]))
    return keys[first], more[first], np.add.reduceat(counts, first) if len(first) else counts


# ---------------------------------------------------------------- level 1: the vocabulary


def blank_separated(texts: pa.Array) -> pa.Array:
    """A-Z in lower case, and every blank of the five other kinds as a space."""
    lower = pc.ascii_lower(texts)
    for blank in "\t\n\v\f\r":
        lower = pc.replace_substring(lower, blank, " ")
    return lower


def _hashes(words: list[str] | list[bytes]) -> np.ndarray:
    """Hashes of words as strings or as their UTF-8, which Arrow gives faster."""
    return np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, words)), HASH)


def _bucket_of(first: np.ndarray, buckets: int) -> np.ndarray:
    """Buckets of equal stretches of the first hash."""
    return ((first >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _word_runs(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        firsts, seconds, counts, held, texts_seen = [], [], [], 0, 0

        def merged():
            return _merged(np.concatenate(firsts), np.concatenate(seconds), np.concatenate(counts), True)

        def out() -> pa.RecordBatch:
            a, b, c = merged()
            return _runs(_bucket_of(a, buckets), a, b, c)

        for batch in batches:
            texts_seen += batch.num_rows
            for part in slices(text_array(batch.column(0))):
                coded = pc.split_pattern(blank_separated(part), " ").values.dictionary_encode()
                hashes = _hashes(strings_of(coded.dictionary.cast(pa.large_binary())))
                number = np.bincount(coded.indices.to_numpy(), minlength=len(hashes)).astype(np.int64)
                real = np.array(pc.binary_length(coded.dictionary)) > 0
                firsts.append(hashes["first"][real])
                seconds.append(hashes["second"][real])
                counts.append(number[real])
                held += len(hashes)
                if held > TASK_TOKENS:
                    a, b, c = merged()
                    firsts, seconds, counts, held = [a], [b], [c], len(a)
                    if held > TASK_TOKENS // 2:
                        yield out()
                        firsts, seconds, counts, held = [], [], [], 0
        if texts_seen:
            end = _hashes([END])
            firsts.append(end["first"])
            seconds.append(end["second"])
            counts.append(np.array([texts_seen], np.int64))
        if firsts:
            yield out()

    return run


def _shard_row(bucket: int, name: str, nodes: int, tokens: int) -> pa.Table:
    return pa.table({"bucket": [bucket], "name": [name], "nodes": pa.array([nodes], pa.int64()), "tokens": pa.array([tokens], pa.int64())})


@dataclass(frozen=True)
class Level:
    """The files of a level: names, the nodes before each, and the first key of each (hash stretches at level 1).

    A parent that a border of files cuts has its words in several of them; ``cut_unseen`` has its weight of unseen words
    for all its files, also for those where it has no word. There are no more such parents than files.
    """

    names: list[str]
    before: np.ndarray
    first_keys: np.ndarray
    cut_parents: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    cut_unseen: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint8))


@dataclass(frozen=True)
class Model:
    """Shared folder, levels, tokens and distinct tokens of the training texts."""

    folder: str
    tokens: int
    distinct: int
    levels: list[Level] = field(default_factory=list)

    def with_level(self, level: Level) -> Model:
        return Model(self.folder, self.tokens, self.distinct, [*self.levels, level])

    @property
    def unknown(self) -> int:
        """The id of every word that training never saw."""
        return self.distinct

    def word_ids(self, words: list[str] | list[bytes]) -> np.ndarray:
        return self.known_words(words)[0]

    def known_words(self, words: list[str] | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of words and their training counts; 0 for words that training never saw."""
        hashes = _hashes(words)
        level = self.levels[0]
        ids, counts = np.full(len(words), self.unknown, np.int64), np.zeros(len(words), np.int64)
        if not len(level.names) or not len(words):
            return ids, counts
        # In the order of their hashes, so that neighbours are looked for in one place.
        order = np.argsort(hashes["first"])
        bucket = _bucket_of(hashes["first"][order], len(level.names))
        for part in np.split(order, np.flatnonzero(np.diff(bucket)) + 1):
            b = _bucket_of(hashes["first"][part[:1]], len(level.names))[0]
            if not level.names[b]:
                continue
            arrays = load(self.folder, level.names[b])
            known, second = arrays["first"], arrays["second"]
            at = np.searchsorted(known, hashes["first"][part])
            open_ = np.flatnonzero(at < len(known))
            # Words of one first hash stand together and are told apart by the second.
            while len(open_):
                same = known[at[open_]] == hashes["first"][part[open_]]
                hit = same & (second[at[open_]] == hashes["second"][part[open_]])
                ids[part[open_[hit]]] = level.before[b] + at[open_[hit]]
                counts[part[open_[hit]]] = arrays["counts"][at[open_[hit]]]
                open_ = open_[same & ~hit]
                at[open_] += 1
                open_ = open_[at[open_] < len(known)]
        return ids, counts

    def counts(self, ids: np.ndarray) -> np.ndarray:
        """Training counts of word ids; 0 for the unknown one."""
        out = np.zeros(len(ids), np.int64)
        level = self.levels[0]
        shard = np.searchsorted(level.before, ids, "right") - 1
        order = np.argsort(shard, kind="stable")
        order = order[ids[order] < self.distinct]
        if len(order):
            for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                s = shard[part[0]]
                out[part] = load(self.folder, level.names[s])["counts"][ids[part] - level.before[s]]
        return out

    def unigram_log10(self, counts: np.ndarray) -> np.ndarray:
        """Discounted counts, and what was taken from them shared by all words and one more."""
        if not self.tokens:
            return np.zeros(len(counts))
        left = DISCOUNT * self.distinct / (self.distinct + 1)
        return np.log10((np.maximum(counts - DISCOUNT, 0) + left) / self.tokens)

    def keys(self, parents: np.ndarray, words: np.ndarray) -> np.ndarray:
        """Pairs as single numbers in the same order."""
        return parents.astype(np.uint64) * np.uint64(self.distinct + 1) + words.astype(np.uint64)

    def find(self, depth: int, parents: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node of each pair at the level, or -1, and log10 of its probability, or of the parent's weight of unseen words.

        Pairs are asked once each and in order, file by file.
        """
        level = self.levels[depth - 1]
        asked = self.keys(parents, words)
        order = np.argsort(asked)
        asked = asked[order]
        new = _first_of_each(asked)
        keys = asked[new]
        nodes, logs = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
        if len(level.names):
            cuts = np.searchsorted(keys, level.first_keys[1:]).tolist()
            for s, (a, b) in enumerate(zip([0, *cuts], [*cuts, len(keys)])):
                if a < b:
                    found, logs[a:b] = _look_up(load(self.folder, level.names[s]), keys[a:b], self.distinct + 1)
                    nodes[a:b] = np.where(found >= 0, level.before[s] + found, -1)
        if len(level.cut_parents):
            missed = np.flatnonzero(nodes < 0)
            parent = (keys[missed] // np.uint64(self.distinct + 1)).astype(np.int64)
            at = np.minimum(np.searchsorted(level.cut_parents, parent), len(level.cut_parents) - 1)
            cut = level.cut_parents[at] == parent
            logs[missed[cut]] = unquantised(level.cut_unseen[at[cut]])
        each = np.cumsum(new) - 1
        all_nodes, all_logs = np.empty(len(order), np.int64), np.empty(len(order))
        all_nodes[order], all_logs[order] = nodes[each], logs[each]
        return all_nodes, all_logs


def _first_of_each(ordered: np.ndarray) -> np.ndarray:
    """Marks the first of equal numbers that stand together."""
    new = np.ones(len(ordered), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    return new


def _rising(arrays: dict[str, np.ndarray], name: str) -> Rising:
    if f"{name}#" not in arrays:
        arrays[f"{name}#"] = Rising.from_arrays([arrays[f"{name}{i}"] for i in range(4)])
    return arrays[f"{name}#"]


def _look_up(arrays: dict[str, np.ndarray], keys: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in the file of keys in order, or -1, and log10 of the probability or of the unseen weight."""
    nodes, logs = np.full(len(keys), -1, np.int64), np.zeros(len(keys))
    start, end = (np.uint64(n) * np.uint64(width) for n in (arrays["span"][0], arrays["span"][1] + 1))
    a, b = np.searchsorted(keys, np.array([start, end], np.uint64)).tolist()
    pairs = (keys[a:b] - start).view(np.int64)
    place, same = _rising(arrays, "children").successor(pairs)
    hit, missed = np.flatnonzero(same), np.flatnonzero(~same)
    nodes[a + hit] = place[hit]
    logs[a + hit] = unquantised(arrays["probability"][place[hit]])
    logs[a + missed] = unquantised(arrays["unseen"][pairs[missed] // width])
    return nodes, logs


# ---------------------------------------------------------------- building


def _shards(rows: DataFrame) -> list:
    """The table of a level's files: one row per file of millions of tokens."""
    return sorted(rows.collect(), key=lambda r: r["bucket"])


def build_vocabulary(texts: DataFrame, folder: str, buckets: int) -> Model:
    """Level 1 from a column of texts."""
    runs = texts.mapInArrow(_word_runs(buckets), RUN)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        first, second, counts = _merged(*_runs_of(table, "<u8"), True)
        name = save(folder, "words", {"first": first, "second": second, "counts": _narrow(counts)})
        return _shard_row(key[0].as_py(), name, len(first), int(counts.sum()))

    found = _shards(written(runs.groupBy("bucket").applyInArrow(merge, SHARD), "word-shards"))
    names, sizes = [""] * buckets, np.zeros(buckets, np.int64)
    for row in found:
        names[row["bucket"]], sizes[row["bucket"]] = row["name"], row["nodes"]
    level = Level(names, np.cumsum(sizes) - sizes, np.zeros(0, np.uint64))
    return Model(folder, sum(r["tokens"] for r in found), int(sizes.sum()), [level])


def _token_ends(arrays: dict[str, np.ndarray]) -> np.ndarray:
    """Running sums of the tokens of a file's nodes: from the counts of the vocabulary, else kept as they rise."""
    if "counts" in arrays:
        return np.cumsum(arrays["counts"], dtype=np.int64)
    ends = _rising(arrays, "ends")
    return ends.get(np.arange(ends.size))


def _edges(model: Model, spark, depth: int) -> np.ndarray:
    """Keys that cut the next level into files of about ``FILE_TOKENS`` tokens, from the counts of the parents.

    A parent of more tokens than a file is cut by stretches of word ids, which are in the order of hashes.
    """
    width, step = model.distinct + 1, FILE_TOKENS
    level = model.levels[depth - 1]
    rows = [(i, name, int(level.before[i])) for i, name in enumerate(level.names) if name]
    if not rows:
        return np.zeros(0, np.uint64)
    folder = model.folder
    shards = spark.createDataFrame(rows, "shard bigint, name string, base bigint")

    def totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sums = [int(_token_ends(load(folder, name))[-1]) for name in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sums, pa.int64())], ["shard", "tokens"])

    tokens = dict(shards.mapInArrow(totals, "shard bigint, tokens bigint").collect())
    before, at = {}, 0
    for shard in sorted(tokens):
        before[shard] = at
        at += tokens[shard]

    def edges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for shard, name, base in zip(*(c.to_pylist() for c in batch.columns)):
                ends = before[shard] + _token_ends(load(folder, name))
                points = np.arange(-(-before[shard] // step) * step, int(ends[-1]), step)
                node = np.searchsorted(ends, points, "right")
                start = np.where(node > 0, ends[node - 1], before[shard])
                share = (points - start) / (ends[node] - start)
                out += [(base + int(n)) * width + int(s * width) for n, s in zip(node, share)]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.uint64()).cast(pa.int64())], ["key"])

    found = [r["key"] for r in shards.mapInArrow(edges, "key bigint").collect()]
    return np.unique(np.array([0, *found], np.uint64))


def _contexts(model: Model, depth: int, ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """For each token the quantised probability of its node at level ``depth`` - 1, and the node of the ``depth`` - 1 tokens before it, or -1.

    A text's first token has the end of a text before it, and nothing before that. Level 1 has its probabilities in the
    counts of words, which the words themselves lead to: they are left 0 here.
    """
    nodes, probability = ids, np.zeros(len(ids), np.uint8)
    for d in range(1, depth):
        if d > 1:
            nodes, logs = _nodes(model, d, parents, ids)
            probability = quantised(logs)
        parents = np.concatenate([[-1], nodes[:-1]])
        parents[starts] = end if d == 1 else -1
        parents = np.where(parents == model.unknown, -1, parents) if d == 1 else parents
    return probability, parents


def _nodes(model: Model, depth: int, parents: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    nodes, logs = np.full(len(ids), -1, np.int64), np.zeros(len(ids))
    asked = np.flatnonzero((parents >= 0) & (ids != model.unknown))
    nodes[asked], logs[asked] = model.find(depth, parents[asked], ids[asked])
    return nodes, logs


def _id_batches(batches: Iterator[pa.RecordBatch], column: int, limit: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Rows of about ``limit`` tokens with their ids in one array, and where each row's ids start."""
    for batch in batches:
        sizes = np.array(pc.binary_length(batch.column(column)), np.int64) // ID.itemsize
        ends = np.cumsum(sizes)
        first = 0
        while first < batch.num_rows:
            before = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, before + limit, "right")))
            part = batch.slice(first, last - first)
            ids = np.frombuffer(b"".join(part.column(column).to_pylist()), ID).astype(np.int64)
            yield part, ids, (ends - sizes)[first:last] - before
            first = last


def build_level(model: Model, encoded: DataFrame, end: int, last: bool) -> Model:
    """The next level from the ids of the training texts."""
    depth, folder = len(model.levels) + 1, model.folder
    edges = _edges(model, encoded.sparkSession, depth - 1)
    width = model.distinct + 1
    if depth > 2 and int(model.levels[-1].before[-1] + width) * width >= 1 << 63 or width**2 >= 1 << 63:
        raise ValueError("a pair of parent and word needs more than 63 bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, keys, more, counts = 0, [], [], []

        def out() -> pa.RecordBatch:
            a, b, c = _merged(np.concatenate(keys), np.concatenate(more), np.concatenate(counts), False)
            return _runs(np.searchsorted(edges, a, "right") - 1, a, b, c)

        for _, ids, starts in _id_batches(batches, 0, BATCH_TOKENS):
            lower, parents = _contexts(model, depth, ids, starts, end)
            known = np.flatnonzero(parents >= 0)
            key = model.keys(parents[known], ids[known])
            order = np.argsort(key)
            key = key[order]
            first = np.flatnonzero(_first_of_each(key))
            keys.append(key[first])
            # All that the lower order adds to a node is its probability, a byte; its node need not travel.
            more.append(lower[known[order[first]]])
            counts.append(np.diff(np.append(first, len(key))))
            held += len(first)
            if held > TASK_TOKENS:
                yield out()
                held, keys, more, counts = 0, [], [], []
        if held:
            yield out()

    runs = written(encoded.select("ids").mapInArrow(run, RUN), "ngram-runs")
    shared = _cut_parents(runs, edges, width)

    def merge(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        pairs, lower, counts = _merged(*_runs_of(table, "u1"), False)
        bucket = key[0].as_py()
        return _shard_row(bucket, _save_level(model, depth, pairs, lower, counts, shared, last), len(pairs), int(counts.sum()))

    found = _shards(written(runs.groupBy("bucket").applyInArrow(merge, SHARD), "ngram-shards"))
    discard(runs)
    sizes = np.array([r["nodes"] for r in found], np.int64)
    firsts = np.array([edges[r["bucket"]] for r in found], np.uint64)
    cut = np.array(sorted(shared), np.int64)
    unseen = quantised(np.log10([DISCOUNT * shared[p][1] / shared[p][0] for p in cut.tolist()])) if len(cut) else np.zeros(0, np.uint8)
    return model.with_level(Level([r["name"] for r in found], np.cumsum(sizes) - sizes, firsts, cut, unseen))


def _cut_parents(runs: DataFrame, edges: np.ndarray, width: int) -> dict[int, tuple[int, int]]:
    """Tokens and distinct words after each parent that a border of files cuts: at most two parents of a file."""
    cut = np.unique(edges // np.uint64(width))

    def ends(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        keys, _, counts = _runs_of(table, "u1")
        parent = keys // np.uint64(width)
        own = np.isin(parent, cut)
        keys, parent, counts = keys[own], parent[own], counts[own]
        rows = [(int(p), int(counts[parent == p].sum()), len(np.unique(keys[parent == p]))) for p in np.unique(parent)]
        columns = list(zip(*rows)) if rows else [[]] * 3
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("parent", "tokens", "words"), columns)})

    def own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(batch.num_rows):
                row = pa.Table.from_batches([batch.slice(at, 1)])
                keys, more, counts = _runs_of(row, "u1")
                there = np.isin(keys // np.uint64(width), cut)
                if there.any():
                    yield _runs(np.full(int(there.sum()), row["bucket"][0].as_py(), np.int64), keys[there], more[there], counts[there])

    # Only counts of cut parents are moved.
    parts = runs.mapInArrow(own, RUN).groupBy("bucket").applyInArrow(ends, "parent bigint, tokens bigint, words bigint")
    summed = parts.groupBy("parent").agg(F.sum("tokens").alias("tokens"), F.sum("words").alias("words"))
    return {r["parent"]: (r["tokens"], r["words"]) for r in summed.collect()}


def _save_level(model: Model, depth: int, pairs: np.ndarray, lower: np.ndarray, counts: np.ndarray, shared: dict, last: bool) -> str:
    width = np.uint64(model.distinct + 1)
    parent, word = (pairs // width).astype(np.int64), (pairs % width).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], parent[1:] != parent[:-1]]))
    sizes = np.diff(np.append(first, len(parent)))
    tokens, words = np.add.reduceat(counts, first), sizes.copy()
    for i in {0, len(first) - 1}:
        tokens[i], words[i] = shared.get(int(parent[first[i]]), (tokens[i], words[i]))
    unseen = DISCOUNT * words / tokens
    lower_log = model.unigram_log10(model.counts(word)) if depth == 2 else unquantised(lower)
    each = np.repeat(np.arange(len(first)), sizes)
    probability = np.maximum(counts - DISCOUNT, 0) / tokens[each] + unseen[each] * 10.0**lower_log
    span = int(parent[-1]) - int(parent[0]) + 1
    weights = np.zeros(span, np.uint8)
    weights[parent[first] - parent[0]] = quantised(np.log10(unseen))
    arrays = {"span": np.array([parent[0], parent[-1]], np.int64), "unseen": weights, "probability": quantised(np.log10(probability))}
    rising = {"children": pairs - np.uint64(parent[0]) * width}
    if not last:
        # What cuts the next level into files.
        rising["ends"] = np.cumsum(counts)
    for name, values in rising.items():
        arrays |= {f"{name}{i}": array for i, array in enumerate(Rising.of(values).arrays())}
    return save(model.folder, f"level{depth}", arrays)


# ---------------------------------------------------------------- texts in, scores out

ENCODED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, ids binary"


def _encode(docs: DataFrame, model: Model) -> DataFrame:
    """Word ids of each text with the end after them, and what the counts alone say of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, held = [model.known_words([])], 0

            def places(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
                """Where the batch keeps the id and the count of each word."""
                nonlocal held
                real = pc.binary_length(words).to_numpy(zero_copy_only=False) > 0
                at = held + np.flatnonzero(real)
                found.append(model.known_words(strings_of(words.cast(pa.large_binary()))))
                held += len(words)
                return at, real.astype(np.int64)

            rows = list(chunk_values(text_array(batch.column(2)), blank_separated, places))
            # The end stands behind all words.
            rows = [np.append(row, held) for row in rows]
            sizes = np.array([len(r) for r in rows], np.int64)
            found.append(model.known_words([END]))
            ids, counts = (np.concatenate(column) for column in zip(*found))
            logs = np.log10((counts + 1) / (model.tokens + model.distinct + 1))
            starts = np.cumsum(sizes) - sizes
            flat = np.concatenate(rows) if rows else np.zeros(0, np.int64)
            known = np.add.reduceat((counts > 0).astype(np.int64)[flat], starts) if rows else sizes
            base = np.add.reduceat(logs[flat], starts) if rows else np.zeros(0)
            ids = ids.astype(ID)[flat].tobytes()
            columns = [batch.column(0), batch.column(1), pa.array(sizes), pa.array(known), pa.array(base)]
            ends = (starts + sizes) * ID.itemsize
            rows = [ids[a:b] for a, b in zip((starts * ID.itemsize).tolist(), ends.tolist())]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, pa.binary())], [f.split()[0] for f in ENCODED.split(", ")])

    return docs.mapInArrow(run, ENCODED)


def _score(encoded: DataFrame, model: Model) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = int(model.word_ids([END])[0])
        for part, ids, starts in _id_batches(batches, 5, BATCH_TOKENS):
            logs, nodes = np.zeros(len(ids)), ids
            for depth in range(2, len(model.levels) + 1):
                parents = np.concatenate([[-1], nodes[:-1]])
                parents[starts] = end if depth == 2 else -1
                if depth == 2:
                    parents = np.where(parents == model.unknown, -1, parents)
                nodes = np.full(len(ids), -1, np.int64)
                asked = np.flatnonzero(parents >= 0)
                found, log = model.find(depth, parents[asked], ids[asked])
                nodes[asked] = found
                # Seen after this context: the kept probability; else the weight of unseen words times the lower order.
                logs[asked] = np.where(found >= 0, log, log + logs[asked])
                if depth == 2:
                    # Only words that are not seen after the one before go down to the counts.
                    alone = np.flatnonzero(nodes < 0)
                    distinct, code = np.unique(ids[alone], return_inverse=True)
                    logs[alone] += model.unigram_log10(model.counts(distinct))[code]
            score = np.add.reduceat(logs, starts) if len(starts) else np.zeros(0)
            columns = [*part.columns[:5], pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, [*part.schema.names[:5], "score"])

    return encoded.mapInArrow(run, ENCODED.replace("ids binary", "score double"))


def score_texts(docs: DataFrame, held_out: Column, order: int = 2, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Train on the rows that are not held out and score all whole texts.

    ``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score``, logarithms to base 10. Words are runs
    without blanks with A-Z in lower case; each text has one end after them. Null and empty texts are the end alone.
    Repeated rows count and are scored as often as they stand; other columns are left out. Without training texts
    every token is unknown, and both scores are 0.
    """
    if order < 2:
        raise ValueError("the order is 2 at least")
    spark = docs.sparkSession
    chosen = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_column).alias("text")
    )
    buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
    model = build_vocabulary(chosen.where(~F.col("held_out")).select("text"), shared_folder(spark, "language-model"), buckets)
    encoded = written(_encode(chosen, model), "word-ids")
    training = encoded.where(~F.col("held_out"))
    if model.tokens:
        end = int(model.word_ids([END])[0])
        for depth in range(2, order + 1):
            model = build_level(model, training, end, depth == order)
    scored = _score(encoded, model)
    return scored.withColumn("train_tokens", F.lit(model.tokens).cast("bigint")).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )
