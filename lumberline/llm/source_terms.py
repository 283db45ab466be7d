"""Source divergence audit: how the terms of each source differ from those of other sources and of the whole language.

A task lays a pointer to the start of each term of its texts over the Arrow buffer, cut into slices, and sorts the
pointers of a slice by multikey quicksort: eight bytes of the terms are compared at a time, the pointers of a segment
are parted into less, equal and greater than a pivot, and only the equal ones go on with the next eight bytes. All
segments of a slice are parted together in numpy. Runs of equal terms give counts by source and numbers of documents;
Spark adds them up, keeps the terms of enough documents, and compares the sources. All arithmetic is in whole numbers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumberline.llm.chunks import slices, text_array
from lumberline.llm.store import ship_package, small, written

# Documents of a language that a term must occur in, and terms that a source reports.
LEAST_DOCUMENTS = 3
TOP_TERMS = 200
SCALE = 1_000_000_000

SLICE_BYTES = 4 << 20

# Pairs of sources whose sums a task holds before it hands them on.
HELD_PAIRS = 1 << 20

# Bytes of a term: ASCII letters and everything beyond ASCII.
IN_TERM = np.array([b >= 128 or chr(b).isalpha() for b in range(256)])
COUNTS = "lang string, source string, term string, n bigint, documents bigint"

# The first 0 to 8 bytes of a big-endian number of eight.
MASKS = np.array([(1 << 64) - (1 << (64 - 8 * k)) for k in range(9)], np.uint64)


class Pointers:
    """Starts and lengths of the terms in a buffer of bytes, and which text each is in."""

    def __init__(self, buffer: np.ndarray, offsets: np.ndarray) -> None:
        """``offsets`` are where the texts begin, and where the last ends."""
        buffer = buffer[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        inside = IN_TERM[buffer]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        # Texts stand side by side without a border: a term ends with its text.
        borders = offsets[:-1][offsets[:-1] < len(buffer)]
        begins[borders] = inside[borders]
        self.starts = np.flatnonzero(begins)
        stops = inside.copy()
        stops[:-1] &= ~inside[1:]
        lasts = offsets[1:][offsets[1:] > 0] - 1
        stops[lasts] = inside[lasts]
        self.lengths = np.flatnonzero(stops) + 1 - self.starts
        self.texts = np.searchsorted(offsets, self.starts, "right") - 1
        lowered = buffer | (((buffer >= 65) & (buffer <= 90)).view(np.uint8) << 5)
        self.buffer = np.concatenate([lowered, np.zeros(16, np.uint8)])
        self.windows = np.lib.stride_tricks.sliding_window_view(self.buffer, 8)

    def slice_at(self, pointers: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """Eight bytes of each term from ``depth`` on as a number; zero bytes behind its end."""
        rest = np.clip(self.lengths[pointers] - depth, 0, 8)
        found = self.windows[self.starts[pointers] + np.minimum(depth, self.lengths[pointers])]
        return found.reshape(-1).view(">u8").astype(np.uint64) & MASKS[rest]

    def terms(self, pointers: np.ndarray) -> pa.Array:
        """The terms themselves."""
        sizes = self.lengths[pointers]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.buffer[np.arange(total) + np.repeat(self.starts[pointers] - (ends - sizes), sizes)]
        offsets = pa.py_buffer(np.concatenate([[0], ends]).astype(np.int64).tobytes())
        return pa.LargeStringArray.from_buffers(len(sizes), offsets, pa.py_buffer(flat.tobytes()))


def multikey_sorted(pointers: Pointers) -> tuple[np.ndarray, np.ndarray]:
    """The pointers in the order of their terms' bytes, and where each run of equal terms begins.

    Pointers of equal terms stay in the order of the text. A round parts every open segment once, so a term takes part
    in about as many rounds as a quicksort compares it, and drops out when its segment is a run.
    """
    total = len(pointers.starts)
    order = np.arange(total)
    first_of_run = np.zeros(total + 1, bool)
    first_of_run[[0, total]] = True
    # Open places, the number of each one's segment, where segments begin in ``open_``, and their depth.
    open_ = np.arange(total)
    begins = np.zeros(min(total, 1), np.int64)
    depths = np.zeros(len(begins), np.int64)
    keys = pointers.slice_at(order, np.zeros(total, np.int64)) if total else np.zeros(0, np.uint64)
    while len(open_):
        sizes = np.diff(np.append(begins, len(open_)))
        low, middle, high = keys[begins], keys[begins + sizes // 2], keys[begins + sizes - 1]
        pivot = np.maximum(np.minimum(low, middle), np.minimum(np.maximum(low, middle), high))
        of_open = np.repeat(pivot, sizes)
        less, greater = keys < of_open, keys > of_open
        # Stable places of the three parts, each segment in its own stretch.
        before_less = np.concatenate([[0], np.cumsum(less)])
        before_greater = np.concatenate([[0], np.cumsum(greater)])
        ends = begins + sizes
        n_less = before_less[ends] - before_less[begins]
        n_greater = before_greater[ends] - before_greater[begins]
        n_equal = sizes - n_less - n_greater
        rank_less = before_less[:-1] - np.repeat(before_less[begins], sizes)
        rank_greater = before_greater[:-1] - np.repeat(before_greater[begins], sizes)
        rank = np.arange(len(open_)) - np.repeat(begins, sizes)
        target = np.where(less, rank_less, np.where(greater, np.repeat(n_less + n_equal, sizes) + rank_greater, np.repeat(n_less, sizes) + rank - rank_less - rank_greater))
        target += np.repeat(begins, sizes)
        moved = np.empty(len(open_), np.int64)
        moved[target] = order[open_]
        order[open_] = moved
        sorted_keys = np.empty_like(keys)
        sorted_keys[target] = keys
        # The parts as new segments: less, equal, greater of each.
        parts = np.stack([n_less, n_equal, n_greater], axis=1).reshape(-1)
        part_begins = np.cumsum(parts) - parts
        first_of_run[open_[part_begins[parts > 0]]] = True
        depth = np.stack([depths, depths + 8, depths], axis=1).reshape(-1)
        # Equal ones whose eight bytes end with a zero are whole terms; single ones need no more comparing.
        ended = np.zeros(len(parts), bool)
        ended[1::3] = pivot & np.uint64(0xFF) == 0
        goes_on = (parts > 1) & ~ended
        is_equal = np.zeros(len(parts), bool)
        is_equal[1::3] = True
        stays = np.repeat(goes_on, parts)
        deeper = np.repeat(is_equal & goes_on, parts)[stays]
        sizes, depths = parts[goes_on], depth[goes_on]
        open_, keys = open_[stays], sorted_keys[stays]
        begins = np.cumsum(sizes) - sizes
        if deeper.any():
            keys[deeper] = pointers.slice_at(order[open_[deeper]], np.repeat(depths, sizes)[deeper])
    return order, np.flatnonzero(first_of_run[:-1])


def _counted(texts: pa.Array, group: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Terms with their group, number of occurrences and number of texts; a row for each term and group of the slice."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64, len(texts) + 1, 8 * texts.offset)
    data = texts.buffers()[2]
    pointers = Pointers(np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8), offsets)
    order, runs = multikey_sorted(pointers)
    run = np.repeat(np.arange(len(runs)), np.diff(np.append(runs, len(order))))
    text = pointers.texts[order]
    new_text = np.ones(len(order), bool)
    new_text[1:] = (run[1:] != run[:-1]) | (text[1:] != text[:-1])
    width = int(group.max()) + 1 if len(group) else 1
    keys, back = np.unique(run * width + group[text], return_inverse=True)
    return pointers.terms(order[runs]).take(pa.array(keys // width)), keys % width, np.bincount(back, minlength=len(keys)), np.bincount(
        back[new_text], minlength=len(keys)
    )


def _pieces(text: pa.Array, limit: int) -> Iterator[pa.Array]:
    """One long text cut where no term is cut."""
    whole = np.frombuffer(text.cast(pa.large_binary())[0].as_buffer(), np.uint8)
    first = 0
    while first < len(whole):
        last = min(len(whole), first + limit)
        if last < len(whole):
            outside = np.flatnonzero(~IN_TERM[whole[first:last]])
            if len(outside):
                last = first + int(outside[-1]) + 1
            else:
                beyond = np.flatnonzero(~IN_TERM[whole[last:]])
                last = last + int(beyond[0]) if len(beyond) else len(whole)
        yield pa.array([whole[first:last].tobytes()], pa.large_binary()).cast(pa.large_string())
        first = last


def term_counts(docs: DataFrame, lang_column: str = "lang", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """``lang, source, term, n, documents``: occurrences of each term in the texts of a source, and texts that have it.

    Terms are runs of ASCII letters and of characters beyond ASCII, with A-Z in lower case. Null counts as empty in all
    three columns; every row is a text of its own; other columns are left out. What travels is a row for each term and
    source of a slice of text, added up in each task before the shuffle.
    """
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = pa.StructArray.from_arrays([text_array(batch.column(i)) for i in (0, 1)], ["lang", "source"])
            langs, sources = (pc.struct_field(both, i).dictionary_encode() for i in (0, 1))
            pair = langs.indices.to_numpy().astype(np.int64) * max(1, len(sources.dictionary)) + sources.indices.to_numpy()
            pairs, group = np.unique(pair, return_inverse=True)
            lang_of = langs.dictionary.take(pa.array(pairs // max(1, len(sources.dictionary))))
            source_of = sources.dictionary.take(pa.array(pairs % max(1, len(sources.dictionary))))
            at = 0
            for part in slices(text_array(batch.column(2)), SLICE_BYTES):
                # What Arrow keeps of the last slice would count to this worker's share of an executor.
                pa.default_memory_pool().release_unused()
                own = group[at : at + len(part)]
                at += len(part)
                if len(part) == 1 and pc.binary_length(part)[0].as_py() > 2 * SLICE_BYTES:
                    found = [_counted(piece, own) for piece in _pieces(part, SLICE_BYTES)]
                    whole = pa.table({"term": pa.concat_arrays([f[0] for f in found]), "n": np.concatenate([f[2] for f in found])})
                    summed = whole.group_by("term").aggregate([("n", "sum")])
                    terms, n = summed["term"].combine_chunks(), summed["n_sum"].to_numpy()
                    groups, texts = np.full(len(terms), own[0]), np.ones(len(terms), np.int64)
                else:
                    terms, groups, n, texts = _counted(part, own)
                taken = pa.array(groups)
                columns = [lang_of.take(taken), source_of.take(taken), terms, pa.array(n, pa.int64()), pa.array(texts, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in COUNTS.split(", ")])

    chosen = docs.select(F.col(lang_column).cast("string"), F.col(source_column).cast("string"), F.col(text_column).cast("string"))
    rows = chosen.mapInArrow(run, COUNTS)
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def _share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (count + 1) / (total + terms)), exact; null where there are no terms."""
    top = (count + 1).cast("decimal(19,0)") * F.lit(SCALE).cast("decimal(10,0)")
    below = F.when(terms > 0, (total + terms).cast("decimal(19,0)"))
    return F.call_function("div", top, below) + F.lit(1).cast("bigint")


def _distance(p: Column, q: Column) -> Column:
    """floor((p - q)² / q) of whole numbers; the square of numbers up to a thousand million fits."""
    return F.call_function("div", (p - q) * (p - q), q)


def _common(parts: DataFrame) -> DataFrame:
    """``a, b, value`` of :func:`_pair_values`, from rows that have all sources of a term: what the term adds where both have it.

    All ordered pairs of the sources of a term are laid out and added up inside a task: rows that leave it are pairs of
    sources, never pairs of texts.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def summed() -> tuple[np.ndarray, np.ndarray]:
            keys = np.concatenate([k for k, _ in held])
            values = np.concatenate([v for _, v in held])
            found, back = np.unique(keys, return_inverse=True)
            out = np.zeros(len(found), np.int64)
            np.add.at(out, back, values)
            return found, out

        def out() -> pa.RecordBatch:
            keys, values = summed()
            return pa.RecordBatch.from_arrays([pa.array(keys >> 31), pa.array(keys & 0x7FFFFFFF), pa.array(values)], ["a", "b", "value"])

        for batch in batches:
            lists = batch.column(0)
            flat, offsets = lists.values, lists.offsets.to_numpy().astype(np.int64)
            group, p, unseen = (flat.field(i).to_numpy(zero_copy_only=False) for i in range(3))
            first = 0
            sizes = np.diff(offsets)
            squares = np.cumsum(sizes * sizes)
            while first < len(sizes):
                # Terms of about a million pairs together; one term of more sources than that is taken alone.
                done = squares[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(squares, done + HELD_PAIRS, "right")))
                own = sizes[first:last]
                each = np.repeat(np.arange(offsets[first], offsets[last]), np.repeat(own, own))
                start = np.repeat(offsets[first:last], own * own)
                ends = np.cumsum(own * own)
                nth = np.arange(int(ends[-1])) - np.repeat(ends - own * own, own * own)
                other = start + nth % np.repeat(own, own * own)
                apart = each != other
                a, b = each[apart], other[apart]
                value = (p[a] - p[b]) ** 2 // p[b] - (p[a] - unseen[b]) ** 2 // unseen[b] - (unseen[a] - p[b]) ** 2 // p[b]
                value += (unseen[a] - unseen[b]) ** 2 // unseen[b]
                held.append(((group[a] << 31) | group[b], value))
                if sum(len(k) for k, _ in held) > 2 * HELD_PAIRS:
                    held = [summed()]
                    if len(held[0][0]) > HELD_PAIRS:
                        yield out()
                        held = []
                first = last
        if held:
            yield out()

    return parts.mapInArrow(run, "a bigint, b bigint, value bigint")


def _pair_values(kept: DataFrame, groups: DataFrame) -> DataFrame:
    """``lang, source, item, value``: the sum over all kept terms of the language, for each ordered pair of sources.

    A term that neither source has adds the same as any other such term. So the sum is that value for every term, and
    what terms of one source change (by distinct count, not by term), and what terms of both change beyond that.
    """
    sides = groups.select("lang", "source", "number", "unseen", "terms")
    a = sides.select("lang", "source", F.col("number").alias("a"), F.col("unseen").alias("pa"), "terms")
    b = sides.select("lang", F.col("source").alias("item"), F.col("number").alias("b"), F.col("unseen").alias("pb"))
    pairs = a.join(b, "lang").where(F.col("a") != F.col("b"))
    base = pairs.select("a", "b", F.coalesce(F.col("terms") * _distance(F.col("pa"), F.col("pb")), F.lit(0)).alias("value"))
    shares = kept.groupBy("lang", "number", "p").agg(F.count("*").alias("many"), F.first("unseen").alias("unseen"))
    shares = written(shares, "share-counts")
    others = sides.select("lang", F.col("number").alias("other"), F.col("unseen").alias("po")).where("po IS NOT NULL")
    met = shares.join(small(written(others, "audit-others")), "lang").where(F.col("number") != F.col("other"))
    as_first = F.col("many") * (_distance(F.col("p"), F.col("po")) - _distance(F.col("unseen"), F.col("po")))
    as_second = F.col("many") * (_distance(F.col("po"), F.col("p")) - _distance(F.col("po"), F.col("unseen")))
    single = met.select(
        F.explode(
            F.array(
                F.struct(F.col("number").alias("a"), F.col("other").alias("b"), as_first.alias("value")),
                F.struct(F.col("other").alias("a"), F.col("number").alias("b"), as_second.alias("value")),
            )
        ).alias("r")
    ).select("r.*")
    by_term = kept.groupBy("lang", "term").agg(F.collect_list(F.struct("number", "p", "unseen")).alias("sources"))
    both = _common(by_term.where(F.size("sources") > 1).select("sources"))
    summed = base.unionByName(single).unionByName(both).groupBy("a", "b").agg(F.sum("value").alias("value"))
    named = pairs.select("a", "b", "lang", "source", "item")
    return named.join(summed, ["a", "b"]).select("lang", "source", "item", "value")


def audit(
    docs: DataFrame,
    lang_column: str = "lang",
    source_column: str = "source",
    text_column: str = "text",
    least_documents: int = LEAST_DOCUMENTS,
    top: int = TOP_TERMS,
) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source of a language differs.

    A language keeps the V terms of at least ``least_documents`` of its texts. A source gives each kept term of its
    language the share p = 1 + floor(10⁹ (count + 1) / (N + V)), N its occurrences of kept terms; a language likewise.
    Part ``pair`` ranks the other sources of the language by the sum of floor((p - q)² / q) over all kept terms, q the
    other's shares (0 if nothing is kept). Part ``term`` ranks the terms that the source has with p above the language's
    share q, up to ``top``. Ranks start at 1; equal values go by the item's bytes. Null languages, sources and texts
    count as empty; sources without terms take part; repeated rows are texts of their own; other columns are left out;
    no rows give no rows.
    """
    spark = docs.sparkSession
    named = docs.select(F.coalesce(F.col(lang_column).cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col(source_column).cast("string"), F.lit("")).alias("source"))
    counts = written(term_counts(docs, lang_column, source_column, text_column), "term-counts")
    totals = counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("documents").alias("documents"))
    # Rows of a term meet its total where the total was made: one shuffle by language and term serves both.
    kept = written(counts.join(totals.where(F.col("documents") >= least_documents).drop("documents"), ["lang", "term"]).select("lang", "source", "term", "n", "lang_n"), "kept-terms")
    of_group = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    of_lang = kept.select("lang", "term", "lang_n").distinct().groupBy("lang").agg(F.sum("lang_n").alias("lang_total"), F.count("*").alias("terms"))
    groups = named.distinct().join(of_group, ["lang", "source"], "left").join(of_lang, "lang", "left")
    zero = F.lit(0).cast("bigint")
    groups = groups.select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("total", "terms", "lang_total")])
    order = Window.partitionBy("half").orderBy("lang", "source")
    # A number for each source: its place among those of the same half of hashes, and the half.
    groups = groups.withColumn("half", F.pmod(F.xxhash64("lang", "source"), F.lit(64))).withColumn("number", F.row_number().over(order).cast("bigint") * 64 + F.col("half"))
    groups = written(groups.withColumn("unseen", _share(zero, F.col("total"), F.col("terms"))).drop("half"), "audit-groups")
    shared = kept.join(small(groups), ["lang", "source"])
    p = _share(F.col("n"), F.col("total"), F.col("terms"))
    q = _share(F.col("lang_n"), F.col("lang_total"), F.col("terms"))
    shared = shared.select("lang", "source", "term", "number", "unseen", p.alias("p"), q.alias("q"))
    above = shared.where("p > q").select("lang", "source", F.col("term").alias("item"), _distance(F.col("p"), F.col("q")).alias("value"))
    ranked = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    terms = above.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= top)
    pairs = written(_pair_values(shared, groups), "audit-pairs").withColumn("rank", F.row_number().over(ranked))
    columns = lambda part: ["lang", "source", F.lit(part).alias("part"), "item", "value", "rank"]
    return pairs.select(*columns("pair")).unionByName(terms.select(*columns("term")))
