"""SimHash near-dedup by multi-index hashing.

A document's fingerprint has a bit for each bit that is set in over half of its shingle hashes. Two fingerprints that
differ in at most three bits differ in at most one bit in one of their halves; so each half is a table, a fingerprint
asks both tables for its own half and for those one bit away, and complete distances decide. Documents of one
fingerprint are one node; links between nodes join components.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.llm.components import components
from lumberline.llm.store import rows_with, ship_package, small, written

SHINGLE = 3
SEED = 42
DISTANCE = 3

# Shingles whose bits are counted together.
BLOCK = 1 << 16

# A half that more fingerprints share than this is looked up by the bytes of the other half as well.
HOT_HALF = 1024


def fingerprint(text: bytes, size: int = SHINGLE) -> int:
    """The fingerprint of one text: words are runs without blanks, A-Z count as a-z, shingles repeat as they stand."""
    words = text.lower().split()
    if not words:
        return 0
    count = max(1, len(words) - size + 1)
    hashed = partial(xxhash.xxh64_intdigest, seed=SEED)
    totals = np.zeros(64, np.int64)
    for first in range(0, count, BLOCK):
        last = min(count, first + BLOCK)
        part = words[first : last + size - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(size)))) if count > 1 or len(words) == size else [b" ".join(words)]
        hashes = np.fromiter(map(hashed, shingles), np.uint64, last - first)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        totals += bits.sum(axis=0, dtype=np.uint32)
    over = 2 * totals > count
    return int(np.packbits(over, bitorder="little").view(np.uint64)[0])


def text_keys(text: Column) -> tuple[Column, Column]:
    """128 bits that tell texts apart, null as empty: two hashes of the same text from different seeds."""
    whole = F.coalesce(text, F.lit(""))
    return F.xxhash64(whole), F.xxhash64(F.lit(SEED), whole)


def fingerprints(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, key, key2, fingerprint`` of each whole text, the fingerprint as a signed number of 64 bits; null as empty."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(3).cast(pa.large_binary())
            found = np.array([fingerprint(t.as_py() or b"", size) for t in texts], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(found)], ["doc_id", "key", "key2", "fingerprint"])

    first, second = text_keys(F.col(text_column))
    chosen = docs.select(F.col(id_column).cast("bigint").alias("doc_id"), first.alias("key"), second.alias("key2"), F.col(text_column).alias("text"))
    return chosen.mapInArrow(run, "doc_id bigint, key bigint, key2 bigint, fingerprint bigint")


def _half(value: Column, which: int) -> Column:
    part = F.shiftrightunsigned(value, 32) if which else value
    return part.bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))


def _halves(nodes: DataFrame) -> DataFrame:
    """Both halves of each fingerprint: ``fp, half, value, other``."""
    rows = [
        F.struct(F.lit(i).alias("half"), _half(F.col("fp"), i).alias("value"), _half(F.col("fp"), 1 - i).alias("other")) for i in (0, 1)
    ]
    return nodes.select("fp", F.explode(F.array(*rows)).alias("h")).select("fp", "h.*")


def _ball(halves: DataFrame) -> DataFrame:
    """Each half and those with one more bit set: of two halves one bit apart, the one without the bit finds the other."""
    value = F.col("value")
    masks = F.array(*[F.lit(1 << bit).cast("bigint") for bit in range(32)])
    near = F.transform(F.filter(masks, lambda m: value.bitwiseAND(m) == 0), lambda m: value.bitwiseOR(m))
    return halves.withColumn("value", F.explode(F.concat(F.array(value), near)))


def _byte_keys(other: Column) -> Column:
    """The four bytes of a half, each with its place."""
    return F.array(
        *[F.shiftrightunsigned(other, 8 * i).bitwiseAND(F.lit(255).cast("bigint")) + F.lit(256 * i).cast("bigint") for i in range(4)]
    )


def _links(probes: DataFrame, table: DataFrame, keys: list[str]) -> DataFrame:
    near = F.bit_count(F.col("probe").bitwiseXOR(F.col("fp"))) <= DISTANCE
    asked = probes.withColumnRenamed("fp", "probe")
    found = asked.join(table, keys).where(near & (F.col("probe") != F.col("fp")))
    return found.select(F.col("probe").alias("a"), F.col("fp").alias("b"))


def near_links(nodes: DataFrame) -> DataFrame:
    """Links ``a, b`` between distinct fingerprints ``fp`` that differ in at most three bits.

    Where very many fingerprints share a half, their other halves differ in at most three bits of four bytes, so a byte
    is the same: those are looked up by half and byte, which leaves no link out and compares far fewer.
    """
    halves = written(_halves(nodes), "halves")
    hot = written(halves.groupBy("half", "value").agg(F.count("*").alias("n")).where(F.col("n") > HOT_HALF).select("half", "value"), "hot-halves")
    probes = _ball(halves).select("fp", "half", "value", "other")
    table = halves.select("fp", "half", "value", "other")
    if hot.isEmpty():
        return _links(probes.drop("other"), table.drop("other"), ["half", "value"])
    keys = ["half", "value"]
    cold = _links(probes.join(hot, keys, "left_anti").drop("other"), table.join(hot, keys, "left_anti").drop("other"), keys)
    by_byte = [
        side.join(hot, keys, "left_semi").select("fp", "half", "value", F.explode(_byte_keys(F.col("other"))).alias("byte"))
        for side in (probes, table)
    ]
    return cold.unionByName(_links(*by_byte, [*keys, "byte"]))


def _grouped(prints: DataFrame) -> DataFrame:
    """Written ``fingerprint, least``: the least ``(no id, id, key, key2)`` of all texts that links of at most three bits reach."""
    key = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "key", "key2")
    nodes = written(prints.groupBy("fingerprint").agg(F.min(key).alias("least")).withColumnRenamed("fingerprint", "fp"), "nodes")
    roots = components(near_links(nodes.select("fp")))
    rooted = written(nodes.join(roots, nodes.fp == roots.node).select("fp", "least", "root"), "rooted")
    least = rooted.groupBy("root").agg(F.min("least").alias("least"))
    linked = rooted.drop("least").join(least, "root").select("fp", "least")
    alone = nodes.join(rooted.select("fp"), "fp", "left_anti").select("fp", "least")
    return written(linked.unionByName(alone).withColumnRenamed("fp", "fingerprint"), "components")


def near_duplicates(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for each row: the least id that links of at most three bits reach.

    Null and empty texts have the fingerprint zero and are linked like any other. Rows of one fingerprint are one node,
    so copies are never paired. A null id is never the least id unless all of a component are null. Repeated rows stay;
    other columns are left out; no rows give no rows.
    """
    prints = written(fingerprints(docs, id_column, text_column, size), "fingerprints")
    named = _grouped(prints).select("fingerprint", F.col("least.doc_id").alias("component_id"))
    return prints.join(named, "fingerprint").select("doc_id", "fingerprint", "component_id")


def hex_digits(value: Column) -> Column:
    """A signed number of 64 bits as 16 lower-case digits."""
    return F.lower(F.lpad(F.hex(value), 16, "0"))


def keep_one(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", size: int = SHINGLE) -> DataFrame:
    """One row of each component of :func:`near_duplicates`, with all its columns, whatever their names.

    The row of the least id stays, a null id last, then of the least text hashes; of rows alike in id and text, one.
    Rows are told apart by id and text, so another text of a repeated id is not touched. Null and empty texts are one
    component together with every text whose fingerprint is near zero. No rows give no rows.
    """
    prints = written(fingerprints(docs, id_column, text_column, size), "fingerprints")
    one = ["doc_id", "key", "key2"]
    counted = prints.groupBy("fingerprint", *one).agg(F.count("*").alias("n")).join(_grouped(prints), "fingerprint")
    stays = F.lit(True)
    for name in one:
        stays = stays & F.col(name).eqNullSafe(F.col(f"least.{name}"))
    # Texts that stay in one row; all others are gone but for those.
    decided = written(counted.select(*[F.col(c).alias(f"gone_{c}") for c in one], stays.alias("stays"), "n").where("NOT stays OR n > 1"), "near-gone")
    gone, again = decided.where("NOT stays").drop("stays", "n"), decided.where("stays").drop("stays", "n")
    first, second = text_keys(F.col(text_column))
    rows = rows_with(docs, doc_id=F.col(id_column).cast("bigint"), key=first, key2=second)
    same = F.lit(True)
    for name in one:
        same = same & F.col(name).eqNullSafe(F.col(f"gone_{name}"))
    left = rows.join(small(gone), same, "left_anti")
    if not again.isEmpty():
        once = left.join(small(again), same, "left_semi").dropDuplicates(one)
        left = left.join(small(again), same, "left_anti").unionByName(once)
    return left.select("row.*")
