"""Exact top-k search by block-at-a-time pruning.

Vectors become whole numbers and stand in blocks of a fixed number of rows that lie close together: the forward index.
A block has the least and greatest number of each dimension, so for a query the sum of the greater products bounds every
score in the block. A query takes blocks from the highest bound down and stops at the first bound below its k-th score.
It starts with the k-th score of its own block, so most blocks are never scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lumberline.llm.store import create_file, open_file, shared_folder, written

SCALE = 256
BLOCK_ROWS = 128

# Queries that a task holds at a time.
QUERY_ROWS = 4096

# Products are exact in floats as long as their sums stay below this; larger ones are summed as whole numbers.
EXACT = float(1 << 52)

BLOCK = "block bigint, dims int, ids binary, vectors binary"
QUERY = "query_id bigint, dims int, floor bigint, vector binary"
HIT = "query_id bigint, vec_id bigint, score bigint"
HIT_NAMES = ["query_id", "vec_id", "score"]


def whole_numbers(embeddings: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``vec_id, vector`` with each component as floor(256 * x); rows without a whole finite vector take no part."""
    value = F.col(vector_column)
    finite = F.forall(value, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    numbers = F.transform(value, lambda x: F.floor(x.cast("double") * SCALE).cast("bigint"))
    return embeddings.where(value.isNotNull() & F.col(id_column).isNotNull() & finite).select(
        F.col(id_column).cast("bigint").alias("vec_id"), numbers.alias("vector")
    )


def _matrix(rows: list[np.ndarray], dims: int) -> np.ndarray:
    """Rows of equal length; a missing component counts as zero."""
    out = np.zeros((len(rows), dims), np.int64)
    for i, row in enumerate(rows):
        out[i, : len(row)] = row
    return out


def _products(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of all rows of both, exact."""
    most = float(np.abs(left).max(initial=0)) * float(np.abs(right).max(initial=0)) * max(1, left.shape[1])
    if most < EXACT:
        return (left.astype(np.float64) @ right.T.astype(np.float64)).astype(np.int64)
    return left @ right.T


def _fit(matrix: np.ndarray, dims: int) -> np.ndarray:
    return matrix if matrix.shape[1] == dims else np.pad(matrix, ((0, 0), (0, dims - matrix.shape[1])))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, the smaller id first where scores are equal."""
    return np.lexsort((ids, -scores))[:k]


def forward_index(vectors: DataFrame) -> DataFrame:
    """Blocks of vectors that lie close together, written: each a matrix and the ids of its rows.

    Vectors are ordered by the signs of their components relative to the middle, as a key of 62 signs, and dealt to
    tasks by ranges of it; rows of one key are dealt by their id, so that no key is too many for a task.
    """
    signs = F.aggregate(
        F.slice(F.col("vector"), 1, 62), F.lit(0).cast("bigint"), lambda acc, x: F.shiftleft(acc, 1) + F.when(x >= 0, 1).otherwise(0)
    )
    ordered = vectors.withColumn("place", signs).repartitionByRange("place", "vec_id").sortWithinPartitions("place", "vec_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int] = []
        rows: list[np.ndarray] = []

        def block() -> pa.RecordBatch:
            dims = max(map(len, rows))
            packed = [np.array(ids, "<i8").tobytes()], [_matrix(rows, dims).astype("<i8").tobytes()]
            columns = [pa.array([ids[0]], pa.int64()), pa.array([dims], pa.int32()), *(pa.array(p, pa.binary()) for p in packed)]
            return pa.RecordBatch.from_arrays(columns, ["block", "dims", "ids", "vectors"])

        for batch in batches:
            flat, bounds = batch.column(1).values.to_numpy(zero_copy_only=False), batch.column(1).offsets.to_numpy()
            for i, vec_id in enumerate(batch.column(0).to_pylist()):
                ids.append(vec_id)
                rows.append(flat[bounds[i] : bounds[i + 1]])
                if len(ids) == BLOCK_ROWS:
                    yield block()
                    ids, rows = [], []
        if ids:
            yield block()

    return written(ordered.select("vec_id", "vector").mapInArrow(run, BLOCK), "vector-blocks")


def _unpacked(row: dict) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(row["ids"], "<i8")
    return ids, np.frombuffer(row["vectors"], "<i8").reshape(len(ids), row["dims"])


def _queries(blocks: DataFrame, every: int, k: int) -> DataFrame:
    """The rows whose id ``every`` divides, with the k-th score in their own block as the first floor."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for block in batch.to_pylist():
                ids, matrix = _unpacked(block)
                asked = np.flatnonzero(ids % every == 0)
                scores = _products(matrix[asked], matrix)
                for i, own in zip(asked, scores):
                    others = np.sort(own[ids != ids[i]])[::-1]
                    floor = int(others[k - 1]) if len(others) >= k else np.iinfo(np.int64).min
                    rows.append((int(ids[i]), block["dims"], floor, matrix[i].astype("<i8").tobytes()))
            columns = list(zip(*rows)) if rows else [[]] * 4
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], [f.split()[0] for f in QUERY.split(", ")])

    return blocks.mapInArrow(run, QUERY)


def _query_files(queries: DataFrame) -> tuple[str, list[str]]:
    """Files of at most QUERY_ROWS queries each in the shared folder, and their names."""
    folder = shared_folder(queries.sparkSession, "query-files")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, QUERY_ROWS):
                name, stream = create_file(folder, "queries")
                part = batch.slice(first, QUERY_ROWS)
                with stream, pa.ipc.new_stream(stream, part.schema) as out:
                    out.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([name])], ["name"])

    files = max(1, -(-queries.count() // QUERY_ROWS))
    names = written(queries.repartition(files).mapInArrow(run, "name string"), "query-names")
    return folder, sorted(row["name"] for row in names.collect())


def _search(blocks: list[tuple[np.ndarray, np.ndarray]], queries: list[dict], k: int) -> Iterator[tuple[int, int, int]]:
    """The k best rows of these blocks for each query, as far as they can be among the k best of all."""
    dims = max([m.shape[1] for _, m in blocks] + [q["dims"] for q in queries])
    asked = _matrix([np.frombuffer(q["vector"], "<i8") for q in queries], dims)
    low = np.stack([_fit(m, dims).min(0) for _, m in blocks])
    high = np.stack([_fit(m, dims).max(0) for _, m in blocks])
    # The greatest sum that a row of the block can reach: each component times the better end of its range.
    bounds = _products(np.maximum(asked, 0), high) + _products(np.minimum(asked, 0), low)
    floors = np.array([q["floor"] for q in queries], np.int64)
    matrices = [_fit(m, dims) for _, m in blocks]
    for i, query in enumerate(queries):
        floor = floors[i]
        found_ids, found = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for b in np.argsort(-bounds[i], kind="stable"):
            if bounds[i, b] < floor:
                break
            ids = blocks[b][0]
            scores = _products(asked[i : i + 1], matrices[b])[0]
            kept = (scores >= floor) & (ids != query["query_id"])
            if kept.any():
                all_ids, all_scores = np.concatenate([found_ids, ids[kept]]), np.concatenate([found, scores[kept]])
                best = _best(all_ids, all_scores, k)
                found_ids, found = all_ids[best], all_scores[best]
                if len(found) == k:
                    floor = max(floor, found[-1])
        yield from zip([query["query_id"]] * len(found), found_ids.tolist(), found.tolist())


def top_k(embeddings: DataFrame, k: int = 5, every: int = 50, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id ``every`` divides its k best others by inner product.

    Equal scores go to the smaller id; a query with fewer others gets them all. Null vectors and vectors with a null or
    non-finite component take no part; a missing dimension counts as zero. A row of the query's own id is never its
    candidate. Of rows that repeat an id each is a candidate, and one query is asked for the id: the first vector in
    order. Other columns are left out; no rows give no rows.
    """
    vectors = whole_numbers(embeddings, id_column, vector_column)
    blocks = forward_index(vectors)
    asked = written(_queries(blocks, every, k).groupBy("query_id").agg(F.min(F.struct("vector", "dims", "floor")).alias("q")), "queries")
    folder, names = _query_files(asked.select("query_id", "q.dims", "q.floor", "q.vector"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # A task's share of the forward index, bounded by the size of its split; queries pass by file after file.
        held = [_unpacked(row) for batch in batches for row in batch.to_pylist()]
        if not held:
            return
        for name in names:
            with open_file(folder, name) as stream, pa.ipc.open_stream(stream) as reader:
                queries = reader.read_all().to_pylist()
            rows = list(_search(held, queries, k))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], HIT_NAMES)

    hits = blocks.mapInArrow(run, HIT)
    order = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return hits.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
