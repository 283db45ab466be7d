"""Quality classifier: logistic regression over hashed word n-grams, trained by follow-the-regularised-leader updates.

Features are n-grams of words and of word shapes (capitals, digits, marks, a word said again), hashed to a fixed number
of buckets. Training reads a bounded sample of labelled documents in one pass of one task; the weights, whose number is
fixed, are broadcast; scoring is a sparse dot product per document where the document is read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lumberline.llm.chunks import blank_lines, row_values, text_array

# Buckets of the hashed features, and the bias after them.
BUCKETS = 1 << 20

# Labelled documents to train on: those of the smallest hashes of their ids.
TRAIN_ROWS = 12_000

ALPHA, BETA, L1, L2 = 0.3, 1.0, 0.4, 1.0

TOKEN = re.compile(r"\w+|[^\w\s]+")
PAIR = np.dtype([("word", "<u8"), ("shape", "<u8")])
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9))


@dataclass(frozen=True)
class Classifier:
    """Weights of the buckets and, last, the bias."""

    weights: np.ndarray


def _shape(token: str) -> str:
    """The kind of a token: its case and length class, or the marks themselves."""
    if not (token[0].isalnum() or token[0] == "_"):
        return token[:8]
    size = "1" if len(token) == 1 else "s" if len(token) < 4 else "m" if len(token) < 10 else "l" if len(token) < 25 else "x"
    if token.isdigit():
        return "9" + size
    if token.isupper():
        return "A" + size
    if token[0].isupper():
        return "Aa" + size
    return ("a" if token.isalpha() else "a9") + size


def _tokens(chunks: list[str]) -> list[bytes]:
    out = []
    for chunk in chunks:
        found = TOKEN.findall(chunk)
        pairs = np.empty(len(found), PAIR)
        pairs["word"] = [xxhash.xxh64_intdigest(t.lower()) for t in found]
        pairs["shape"] = [xxhash.xxh64_intdigest(_shape(t), 1) for t in found]
        out.append(pairs.tobytes())
    return out


def features(pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and values of a document: n-gram counts over the root of their number, so that length matters little."""
    word, shape = pairs["word"], pairs["shape"].copy()
    # A word said again right away has a shape of its own.
    shape[1:][(word[1:] == word[:-1])] = np.uint64(0x5BD1E995)
    grams = [
        word * MIX[0],
        (word[:-1] * MIX[0] + word[1:]) * MIX[1],
        shape * MIX[2],
        (shape[:-1] * MIX[1] + shape[1:]) * MIX[2],
        ((shape[:-2] * MIX[1] + shape[1:-1]) * MIX[0] + shape[2:]) * MIX[2],
    ]
    buckets = (np.concatenate(grams) >> np.uint64(44)).astype(np.int64)
    index, counts = np.unique(buckets, return_counts=True)
    values = counts / np.sqrt((counts.astype(np.float64) ** 2).sum() + 1e-9)
    return np.append(index, BUCKETS), np.append(values, 1.0)


def document_features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Features of each whole text."""
    for pairs in row_values(text_array(texts), blank_lines, _tokens, PAIR):
        yield features(pairs)


class Leader:
    """The per-coordinate state of follow-the-regularised-leader with L1 and L2 terms."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros(BUCKETS + 1), np.zeros(BUCKETS + 1)

    def weights(self, index: np.ndarray) -> np.ndarray:
        z, n = self.z[index], self.n[index]
        l1 = np.where(index == BUCKETS, 0.0, L1)
        kept = np.abs(z) > l1
        return np.where(kept, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2), 0.0)

    def update(self, index: np.ndarray, values: np.ndarray, label: int) -> None:
        weights = self.weights(index)
        gradient = (_probability(float(weights @ values)) - label) * values
        n = self.n[index]
        sigma = (np.sqrt(n + gradient**2) - np.sqrt(n)) / ALPHA
        self.z[index] += gradient - sigma * weights
        self.n[index] = n + gradient**2


def _probability(score: float) -> float:
    return 1 / (1 + np.exp(-min(max(score, -30.0), 30.0)))


def in_fold(id_column: str, folds: int, fold: int) -> Column:
    """Whether crc32 of the id's text leaves the remainder; an id that is null is in no fold."""
    crc = F.crc32(F.col(id_column).cast("string").cast("binary"))
    return F.coalesce(F.pmod(crc, F.lit(folds)) == fold, F.lit(False))


def known_labels(labels: DataFrame, label: str, wanted: Column) -> DataFrame:
    """``doc_id, label`` of the rows that may be learnt; of several labels of a document the largest counts."""
    known = labels.where(wanted).where(F.col(label).isNotNull() & F.col("doc_id").isNotNull())
    return known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))


def train(docs: DataFrame, known: DataFrame, rows: int = TRAIN_ROWS) -> Classifier:
    """Weights from the texts of ``docs`` and their labels ``known(doc_id, label)``, at most ``rows`` of these.

    The sample has the labels of the smallest hashes of their ids, all when there are no more than ``rows``. It is
    drawn from the narrow labels and broadcast, so no text is shuffled but those of the sample, which meet in one task
    that holds the state of the buckets and one batch of documents. Labels of absent documents teach nothing.
    """
    order = F.xxhash64("doc_id")
    chosen = known.orderBy(order, "doc_id").limit(rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select(order.alias("order"), "text", "label").repartition(1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Leader()
        for batch in batches:
            for (index, values), label in zip(document_features(batch.column(1)), batch.column(2).to_pylist()):
                state.update(index, values, label)
        weights = state.weights(np.arange(BUCKETS + 1)).astype("<f4")
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    ordered = sample.sortWithinPartitions("order", "text", "label")
    found = ordered.mapInArrow(run, "weights binary").collect()
    weights = np.frombuffer(found[0]["weights"], "<f4") if found else np.zeros(BUCKETS + 1, "<f4")
    return Classifier(weights)


def score(docs: DataFrame, classifier: Classifier, text_column: str = "text", name: str = "score") -> DataFrame:
    """``docs`` with the probability of label 1 in ``name``: a sparse dot product per whole text.

    A null or empty text has the score of the bias alone. Repeated rows get equal scores; all columns stay. A column
    that is called ``name`` already is replaced.
    """
    kept = docs.drop(name)
    weights = docs.sparkSession.sparkContext.broadcast(classifier.weights)
    at = kept.columns.index(text_column)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = weights.value
        for batch in batches:
            scores = [_probability(float(table[i] @ v)) for i, v in document_features(batch.column(at))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(scores, pa.float64())], [*batch.schema.names, name])

    schema = T.StructType([*kept.schema.fields, T.StructField(name, T.DoubleType())])
    return kept.mapInArrow(run, schema)
