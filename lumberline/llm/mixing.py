"""Mixing sources to target weights: Sainte-Laguë apportionment of equal blocks, then a seeded choice of blocks.

Every source has a target in words. Its documents lie in shards of a few million words, in an order given by hashes, and
a shard is cut into blocks of about equally many words. Blocks go to the sources by highest quotients (target divided by
1, 3, 5, …), the blocks of a source to its shards in the same way, so each shard has a whole number of blocks as its
quota. A shard takes all its blocks as often as the quota allows and a seeded choice of them once more. Where a block
ends inside a document, the document is taken in part: spans of words say which.

One row per source, and one for each of at most ``SHARDS`` shards and one more per source, meet on the driver as
numbers; rows of documents never do.
"""

from __future__ import annotations

import heapq
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumberline.llm.chunks import text_array
from lumberline.llm.store import each_copy, ship_package, written

# Words of a shard, about: what one task orders and cuts. Beyond 2^20 shards of the least size, shards grow instead.
SHARD_WORDS = 1 << 17
SHARDS = 1 << 20

# Words of a block at most, and blocks that the smallest target is worth at least while blocks have more than a word.
BLOCK_WORDS = 256
LEAST_BLOCKS = 256

# Rows that are alike in everything are dealt to shards in bundles of so many.
BUNDLE = 1024

SEED = 20_240_607
BLANK = np.array([b == 0x20 or 0x09 <= b <= 0x0D for b in range(256)])
SPANS = "array<struct<start:bigint, length:bigint, times:int>>"
SPAN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("times", pa.int32())])


def repeating(weights: tuple[int, ...], sources: list[str | None]) -> list[int]:
    """The weights over and over, for the sources in their order."""
    return [weights[i % len(weights)] for i in range(len(sources))]


def targets(sizes: list[int], weights: list[int], repeats: int) -> list[float]:
    """Shares of all words by weight; none above ``repeats`` times the source's size, what is above goes to the others.

    Whole numbers decide what is above, so the outcome does not depend on rounding.
    """
    out = [0.0] * len(sizes)
    open_ = [i for i, weight in enumerate(weights) if weight > 0]
    left = sum(sizes)
    while open_:
        weight = sum(weights[i] for i in open_)
        full = [i for i in open_ if weights[i] * left > repeats * sizes[i] * weight]
        if not full:
            for i in open_:
                out[i] = weights[i] * left / weight
            break
        for i in full:
            out[i] = float(repeats * sizes[i])
        left -= sum(repeats * sizes[i] for i in full)
        open_ = [i for i in open_ if i not in set(full)]
    return out


def apportioned(shares: np.ndarray, most: np.ndarray, seats: int) -> np.ndarray:
    """Sainte-Laguë: each seat goes to the highest quotient ``share / (2 seats so far + 1)`` of those below their most.

    Equal quotients go to the first. A divisor just above the final one gives nearly all seats at once; quotients, one
    after the other, give the rest.
    """
    shares = np.asarray(shares, np.float64)
    most = np.where(shares > 0, most, 0).astype(np.int64)
    seats = min(int(seats), int(most.sum()))
    if seats <= 0:
        return np.zeros(len(shares), np.int64)

    def given(divisor: float) -> np.ndarray:
        # A little less than half, so that rounding never gives a seat too early.
        return np.minimum(most, np.floor(shares / divisor * (1 - 1e-12) + (0.5 - 1e-9)).astype(np.int64)).clip(0)

    low, high = 0.0, 2.0 * float(shares.max()) + 1.0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if float((shares / middle).max()) < 2**62 and int(given(middle).sum()) <= seats:
            high = middle
        else:
            low = middle
    out = given(high)
    queue = [(-shares[i] / (2 * int(out[i]) + 1), i) for i in np.flatnonzero(out < most).tolist()]
    heapq.heapify(queue)
    for _ in range(seats - int(out.sum())):
        _, i = heapq.heappop(queue)
        out[i] += 1
        if out[i] < most[i]:
            heapq.heappush(queue, (-shares[i] / (2 * int(out[i]) + 1), i))
    return out


def _scrambled(values: np.ndarray) -> np.ndarray:
    """Well mixed numbers of 64 bits (the finalizer of splitmix64)."""
    values = (values ^ (values >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    values = (values ^ (values >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return values ^ (values >> np.uint64(31))


def times_of_blocks(blocks: int, quota: int, seed: int, source: int, shard: int) -> np.ndarray:
    """How often each block of a shard is taken: all as often as the quota allows, and a seeded choice once more."""
    times = np.full(blocks, quota // blocks, np.int64)
    base = _scrambled(_scrambled(np.array([seed], np.uint64) + np.uint64(source)) + np.uint64(shard))
    drawn = _scrambled(base + np.arange(1, blocks + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    times[np.argsort(drawn, kind="stable")[: quota % blocks]] += 1
    return times


@dataclass(frozen=True)
class Taken:
    """What a shard takes of each of its documents: words, and spans of words with how often they are taken."""

    words: np.ndarray
    spans: list[list[dict[str, int]]]


def taken_of_shard(sizes: np.ndarray, blocks: int, times: np.ndarray) -> Taken:
    """Documents of ``sizes`` words in their order, cut into ``blocks`` of equal length."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    # Whole numbers of Python where the product is too large for 64 bits.
    edges = np.array([i * total // blocks for i in range(blocks + 1)], np.int64) if total * blocks >= 1 << 62 else np.arange(blocks + 1) * total // blocks
    before = np.concatenate([[0], np.cumsum(np.diff(edges) * times)])

    def upto(place: np.ndarray) -> np.ndarray:
        block = np.minimum(np.searchsorted(edges, place, "right") - 1, blocks - 1)
        return before[block] + (place - edges[block]) * times[block]

    starts = ends - sizes
    words = upto(ends) - upto(starts)
    # Neighbouring blocks that are taken equally often are one stretch.
    new = np.concatenate([[True], times[1:] != times[:-1]])
    bounds, often = np.append(edges[:-1][new], total), times[new]
    first, last = np.searchsorted(bounds, starts, "right") - 1, np.searchsorted(bounds, ends, "left")
    spans = []
    for start, end, a, b in zip(starts.tolist(), ends.tolist(), first.tolist(), last.tolist()):
        own = []
        for i in range(a, b):
            low, high = max(start, int(bounds[i])), min(end, int(bounds[i + 1]))
            if high > low and often[i]:
                own.append({"start": low - start, "length": high - low, "times": int(often[i])})
        spans.append(own)
    return Taken(words, spans)


def word_counts(docs: DataFrame, names: dict[str, str], text: str) -> DataFrame:
    """The named columns and ``size``, the words of the text: what stands between the six ASCII blanks; null has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = text_array(batch.column(batch.num_columns - 1))
            offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
            data = texts.buffers()[2]
            filled = ~BLANK[np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]]] if data is not None else np.zeros(0, bool)
            begins = filled.copy()
            begins[1:] &= ~filled[:-1]
            at = offsets - offsets[0]
            first = at[:-1][at[:-1] < len(filled)]
            begins[first] = filled[first]
            before = np.concatenate([[0], np.cumsum(begins)])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(np.diff(before[at]), pa.int64())], [*batch.schema.names[:-1], "size"])

    chosen = docs.select(*[F.expr(sql).alias(name) for name, sql in names.items()], F.col(text).cast("string").alias("text"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in chosen.schema.fields[:-1])
    return chosen.mapInArrow(run, f"{schema}, size bigint")


def _number(frame: DataFrame, columns: list[str]) -> list[np.ndarray]:
    table = frame.select(*columns).toArrow()
    return [table[c].to_numpy() for c in columns]


def mix(
    docs: DataFrame,
    weigh: Callable[[list[str | None]], list[int]],
    repeats: int = 3,
    seed: int = SEED,
    id_column: str = "doc_id",
    source_column: str = "source",
    text_column: str = "text",
    block_words: int | None = None,
    shard_words: int | None = None,
) -> DataFrame:
    """A row per document: ``doc_id, source, size, source_size, target, taken, spans``.

    ``weigh`` gets the sources in order of their code points, null last, and gives a whole weight for each. They share
    the number of all words by weight (see :func:`targets`); ``taken`` counts the words the mix takes of the document,
    repeats counted, ``spans`` says which and how often: never more than ``repeats`` times. The sum over a source comes
    near its target: within a block, as far as blocks are equal. A block has ``block_words`` words, or by default at most
    256 and so few that the smallest target is worth 256 of them.

    Null and empty texts have no words, and nothing is taken of them; null ids and sources are values like any other.
    Rows alike in id, source and text are each taken; which of them gets which part is all the same. The outcome depends
    on the rows and the seed alone, not on their order or partitions. Other columns are left out; no rows give no rows.
    """
    spark = docs.sparkSession
    ship_package(spark)
    # The hash orders documents and tells equal ids with different texts apart.
    hashed = docs.select(
        F.col(id_column).cast("bigint").alias("doc_id"),
        F.col(source_column).cast("string").alias("source"),
        F.xxhash64(F.col(id_column).cast("bigint"), F.coalesce(F.col(text_column), F.lit("")), F.lit(seed)).alias("key"),
        F.col(text_column).alias("text"),
    )
    sized = word_counts(hashed, {"doc_id": "doc_id", "source": "source", "key": "key"}, "text")
    rows = written(sized.groupBy("doc_id", "source", "key", "size").agg(F.count("*").alias("copies")), "mix-sizes")

    found = sorted(
        ((r["source"], r["size"]) for r in rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("size")).collect()),
        key=lambda r: (r[0] is None, r[0] or ""),
    )
    sizes = [size for _, size in found]
    wanted = targets(sizes, weigh([source for source, _ in found]), repeats)
    if block_words is None:
        least = min((t for t in wanted if t > 0), default=0)
        block_words = int(min(BLOCK_WORDS, max(1, least // LEAST_BLOCKS)))
    shard_words = shard_words or max(SHARD_WORDS, -(-sum(sizes) // SHARDS))
    sources = spark.createDataFrame(
        [(i, source, size, target, max(1, -(-size // shard_words))) for i, ((source, size), target) in enumerate(zip(found, wanted))],
        "number bigint, source string, source_size bigint, target double, shards bigint",
    )
    sources = F.broadcast(sources) if len(found) <= 100_000 else sources
    named = rows.join(sources, rows["source"].eqNullSafe(sources["source"])).drop(rows["source"])

    # Alike rows go to the shards in bundles, so that a document that is repeated any number of times fills no shard.
    bundles = named.where("size > 0").withColumn("bundle", F.explode(F.sequence(F.lit(0).cast("bigint"), F.expr(f"(copies - 1) div {BUNDLE}"))))
    bundles = bundles.withColumn("n", F.least(F.lit(BUNDLE).cast("bigint"), F.col("copies") - F.col("bundle") * BUNDLE))
    dealt = bundles.withColumn("shard", F.pmod(F.xxhash64("key", "bundle"), F.col("shards"))).drop("copies", "shards")
    shard_sizes = dealt.groupBy("number", "shard").agg(F.sum(F.col("size") * F.col("n")).alias("words"))
    number, shard, words = _number(written(shard_sizes, "mix-shards"), ["number", "shard", "words"])
    order = np.lexsort((shard, number))
    number, shard, words = number[order], shard[order], words[order]
    blocks = np.maximum(1, (words + block_words // 2) // block_words)
    most = np.zeros(len(found), np.int64)
    np.add.at(most, number, repeats * blocks)
    # Targets in blocks of the very size that the source's blocks have.
    seats = apportioned(np.array(wanted) / block_words, most, round(sum(wanted) / block_words))
    quota = np.zeros(len(number), np.int64)
    for i in np.unique(number).tolist():
        own = np.flatnonzero(number == i)
        quota[own] = apportioned(words[own] / block_words, repeats * blocks[own], int(seats[i]))
    plan = spark.createDataFrame(
        pa.table({"number": number, "shard": shard, "blocks": blocks, "quota": quota}), "number bigint, shard bigint, blocks bigint, quota bigint"
    )
    planned = dealt.join(F.broadcast(plan) if len(number) <= 100_000 else plan, ["number", "shard"])
    out_schema = f"doc_id bigint, source string, size bigint, source_size bigint, target double, taken bigint, spans {SPANS}"

    def cut(shard_rows: pa.Table) -> pa.Table:
        return _cut_shard(seed, shard_rows)

    some = planned.drop("shards").groupBy("number", "shard").applyInArrow(cut, out_schema)
    none = each_copy(named.where("size = 0"), "copies")
    none = none.select("doc_id", "source", "size", "source_size", "target", F.lit(0).cast("bigint").alias("taken"), F.array().cast(SPANS).alias("spans"))
    return some.unionByName(none)


def _cut_shard(seed: int, table: pa.Table) -> pa.Table:
    table = table.sort_by([("key", "ascending"), ("doc_id", "ascending"), ("size", "ascending"), ("bundle", "ascending")])
    first = table.slice(0, 1).to_pylist()[0]
    each = np.repeat(np.arange(table.num_rows), table["n"].to_numpy())
    sizes = table["size"].to_numpy()[each]
    taken = taken_of_shard(sizes, first["blocks"], times_of_blocks(first["blocks"], first["quota"], seed, first["number"], first["shard"]))
    kept = table.select(["doc_id", "source", "size", "source_size", "target"]).take(pa.array(each))
    return kept.append_column("taken", pa.array(taken.words, pa.int64())).append_column("spans", pa.array(taken.spans, pa.list_(SPAN)))
