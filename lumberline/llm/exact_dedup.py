"""Exact dedup by progressive refinement: length, then a hash of the beginning, then a hash of the whole text.

Only built-in functions. Each level groups narrow rows with map-side counts and goes on with the keys that occur more
than once: beginnings are hashed of texts whose length another has, whole texts of those whose length and beginning
another has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumberline.llm.store import SMALL_ROWS, each_copy, rows_with, ship_package, written

# Characters of a text that its second key looks at.
PREFIX = 256

CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normalized(text: Column) -> Column:
    """The text with A-Z in lower case and nothing else changed; null as empty."""
    text = F.coalesce(text, F.lit(""))
    # lower() is much faster than translate() and does the same on texts of single-byte characters.
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, CAPITALS, SMALL))


def _small(df: DataFrame) -> DataFrame:
    """Marked for broadcast when it was counted below the bound; otherwise Spark joins by shuffle and splits hot keys."""
    return F.broadcast(df) if df.count() <= SMALL_ROWS else df


def _size(text_column: str) -> Column:
    return F.octet_length(F.coalesce(F.col(text_column), F.lit("")))


def _head(text_column: str) -> Column:
    return F.xxhash64(normalized(F.substring(F.col(text_column), 1, PREFIX)))


def refine(docs: DataFrame, text_column: str) -> DataFrame:
    """The keys ``size, head`` that more than one row of ``docs`` has, written: what the whole texts are hashed for."""
    ship_package(docs.sparkSession)
    sized = docs.select(_size(text_column).alias("size"), F.col(text_column).alias("beginning"))
    lengths = written(sized.groupBy("size").agg(F.count("*").alias("n")).where("n > 1").select("size"), "dedup-lengths")
    headed = sized.join(_small(lengths), "size", "left_semi").select("size", _head("beginning").alias("head"))
    return written(headed.groupBy("size", "head").agg(F.count("*").alias("n")).where("n > 1").select("size", "head"), "dedup-survivors")


def exact_rows(docs: DataFrame, id_column: str, text_column: str, hash_all: bool) -> DataFrame:
    """A row per id and text: ``doc_id, keep_id, group_size, n, sha, size, head``; ``n`` rows of ``docs`` have both."""
    survivors = refine(docs, text_column)
    rows = docs.select(
        F.col(id_column).alias("doc_id"),
        _size(text_column).alias("size"),
        _head(text_column).alias("head"),
        normalized(F.col(text_column)).alias("whole"),
    )
    found = survivors.withColumn("again", F.lit(True))
    sha = F.sha2(F.col("whole").cast("binary"), 256)
    many = found.count() > SMALL_ROWS
    if many or hash_all:
        # Hash where the texts are read, so that the join moves narrow rows.
        hashed = rows.withColumn("sha", sha).drop("whole").join(found if many else F.broadcast(found), ["size", "head"], "left")
        if not hash_all:
            hashed = hashed.withColumn("sha", F.when(F.col("again"), F.col("sha")))
    else:
        hashed = rows.join(F.broadcast(found), ["size", "head"], "left").withColumn("sha", F.when(F.col("again"), sha))
    # Rows of one id and text are counted together: this spreads the largest groups over all tasks.
    single = F.coalesce(F.col("again"), F.lit(False)).alias("again")
    counted = written(
        hashed.select("doc_id", "size", "head", "sha", single).groupBy("doc_id", "size", "head", "sha", "again").agg(F.count("*").alias("n")),
        "dedup-rows",
    )
    groups = counted.where("again").groupBy("sha").agg(F.max("doc_id").alias("keep_id"), F.sum("n").alias("group_size"))
    repeated = written(groups.where("group_size > 1"), "dedup-groups")
    marked = counted.join(_small(repeated), "sha", "left")
    keep = F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id"))
    return marked.select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("bigint")).alias("group_size"), "n", "sha", "size", "head"
    )


def exact_groups(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", hash_all: bool = False) -> DataFrame:
    """A row per document: ``doc_id, keep_id, group_size, kept, text_sha256``.

    Texts are equal when they are identical after lower-casing A-Z; null counts as empty. Of equal texts the row with
    the largest id stays; a null id is the smallest, and of repeated rows of that id one stays. ``text_sha256`` is the
    hash of the normalised text, null for texts that no other can equal unless ``hash_all``. Other columns are left
    out. No rows give no rows.
    """
    counted = exact_rows(docs, id_column, text_column, hash_all)
    each = each_copy(counted, "n")
    kept = F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)
    return each.select("doc_id", "keep_id", "group_size", kept.alias("kept"), F.col("sha").alias("text_sha256"))


def drop_copies(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns, whatever their names; see :func:`exact_groups` for which."""
    counted = exact_rows(docs, id_column, text_column, hash_all=False)
    of_group = counted.where("group_size > 1")
    stays = F.col("doc_id").eqNullSafe(F.col("keep_id"))
    gone = written(of_group.where(~stays).select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha")), "dedup-gone")
    again = written(of_group.where(stays & (F.col("n") > 1)).select(F.col("doc_id").alias("gone_id"), F.col("sha").alias("gone_sha")), "dedup-again")
    # Only texts whose length and beginning a group has are hashed again.
    keys = written(of_group.select(F.col("size").alias("key_size"), F.col("head").alias("key_head")).distinct(), "dedup-touched")
    text = F.col(text_column)
    rows = rows_with(docs, id=F.col(id_column), text=text)
    own = F.sha2(normalized(F.col("text")).cast("binary"), 256)
    if keys.count() <= SMALL_ROWS:
        found = F.broadcast(keys.withColumn("touched", F.lit(True)))
        marked = rows.join(found, (_size("text") == F.col("key_size")) & (_head("text") == F.col("key_head")), "left")
        hashed = marked.select("row", "id", F.when(F.col("touched"), own).alias("own"))
    else:
        hashed = rows.select("row", "id", own.alias("own"))
    same = F.col("id").eqNullSafe(F.col("gone_id")) & (F.col("own") == F.col("gone_sha"))
    left = hashed.join(_small(gone), same, "left_anti")
    if not again.isEmpty():
        once = left.join(_small(again), same, "left_semi").dropDuplicates(["id", "own"])
        left = left.join(_small(again), same, "left_anti").unionByName(once)
    return left.select("row.*")
