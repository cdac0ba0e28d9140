"""Exact duplicates by deterministic block naming.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered; a block's
number is its name. Then the names of adjacent pairs are sorted and numbered in the same way, level by level,
until each document has one name. Equal names mean equal texts: numbers are given to distinct contents, never
to hashes. A hash of the block only carries the name back to where the block occurs; hashes shared by different
blocks are found and joined by content instead.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepflow.llm.common import fold, written

BLOCK_BYTES = 4096

#: Names are number * LEVELS + level, so that names of different levels never meet.
LEVELS = 64


def numbered(distinct: DataFrame, keys: list[str], level: int) -> DataFrame:
    """Names for distinct keys: sorted where the aggregation has dealt them, then numbered."""
    return distinct.sortWithinPartitions(*keys).withColumn(
        "name", F.monotonically_increasing_id() * LEVELS + level
    )


def name_blocks(cut: DataFrame, block_hash: Callable[[Column], Column]) -> DataFrame:
    """Add ``name`` to rows with ``block``, and drop the block."""
    hashed = cut.withColumn("h", block_hash(F.col("block")))
    distinct = hashed.select("h", "block").distinct()
    names = written(numbered(distinct, ["block"], 0).select("h", "name"), "block-names")
    shared = written(names.groupBy("h").count().filter("count > 1").select("h"), "shared-hashes")
    if shared.isEmpty():
        return hashed.drop("block").join(names, "h").drop("h")
    by_hash = hashed.drop("block").join(names.join(shared, "h", "left_anti"), "h").drop("h")
    open_blocks = hashed.join(shared, "h", "left_semi")
    contents = written(
        numbered(open_blocks.select("block").distinct(), ["block"], LEVELS - 1), "contents"
    )
    return by_hash.unionByName(open_blocks.join(contents, "block").drop("h", "block"))


def document_names(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_bytes: int = BLOCK_BYTES,
    block_hash: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per distinct (id, text): doc_id, sha (binary), copies, name (equal iff the folded texts are)."""
    text = fold(F.col(text_col)).cast("binary")
    base = docs.select(
        F.col(id_col).alias("doc_id"),
        text.alias("data"),
        F.unhex(F.sha2(text, 256)).alias("sha"),
        F.greatest(F.lit(1), F.ceil(F.octet_length(text) / block_bytes)).cast("int").alias("left_over"),
    )
    cut = base.select(
        "doc_id",
        "sha",
        "left_over",
        F.posexplode(
            F.transform(
                F.sequence(F.lit(0), F.col("left_over") - 1),
                lambda i: F.substring(F.col("data"), i * block_bytes + 1, F.lit(block_bytes)),
            )
        ).alias("pos", "block"),
    )
    rows = name_blocks(cut, block_hash)
    merged = rows.groupBy("doc_id", "sha", "left_over", "pos").agg(
        F.max("name").alias("name"), F.count("*").alias("copies")
    )
    rows = written(merged, "names")
    done = rows.filter("left_over = 1")
    level = 0
    while True:
        rows = rows.filter("left_over > 1")
        if rows.isEmpty():
            break
        level += 1
        pairs = written(
            rows.groupBy(
                "doc_id", "sha", F.ceil(F.col("left_over") / 2).cast("int").alias("left_over"),
                F.shiftright("pos", 1).alias("pos"),
            ).agg(
                F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("first"),
                F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(-1)).alias("second"),
                F.max("copies").alias("copies"),
            ),
            "pairs",
        )
        names = written(
            numbered(pairs.select("first", "second").distinct(), ["first", "second"], level), "pair-names"
        )
        rows = written(pairs.join(names, ["first", "second"]).drop("first", "second"), "names")
        done = done.unionByName(rows.filter("left_over = 1"))
    return done.select("doc_id", "sha", "copies", "name")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, keep_id, group_size, kept, text_sha256, name.

    Texts are equal when they are identical after lower-casing A-Z; the row with the largest id stays. Null and
    empty texts form one group. Rows with a null id lose against any other id. Of rows that repeat the kept id
    and text, one is kept. An empty table gives an empty result; other columns of ``docs`` are not looked at.
    """
    named = written(document_names(docs, id_col, text_col, **options), "document-names")
    groups = written(
        named.groupBy("name").agg(F.max("doc_id").alias("keep_id"), F.sum("copies").alias("group_size")),
        "groups",
    )
    return (
        named.join(groups, "name")
        .select(
            "doc_id", "keep_id", "group_size", "name", "sha",
            F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))).alias("copy"),
        )
        .select(
            "doc_id",
            "keep_id",
            "group_size",
            (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("copy") == 1)).alias("kept"),
            F.lower(F.hex("sha")).alias("text_sha256"),
            "name",
        )
    )


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The kept rows of ``docs`` with all their columns; of fully equal (id, text) rows, the smallest row stays."""
    named = written(document_names(docs, id_col, text_col, **options), "document-names")
    groups = written(named.groupBy("name").agg(F.max("doc_id").alias("keep_id")), "groups")
    keep = written(
        named.join(groups, "name")
        .filter(F.col("doc_id").eqNullSafe(F.col("keep_id")))
        .select(F.col("doc_id").alias("__id"), F.col("sha").alias("__sha"), "copies"),
        "keep",
    )
    sha = F.unhex(F.sha2(fold(F.col(text_col)).cast("binary"), 256))
    rows = docs.withColumn("__sha_here", sha).join(
        keep,
        F.col(id_col).eqNullSafe(F.col("__id")) & (F.col("__sha_here") == F.col("__sha")),
        "left_semi",
    )
    if keep.filter("copies > 1").isEmpty():
        return rows.drop("__sha_here")
    whole = F.struct(*[F.col(c) for c in docs.columns])
    return rows.groupBy(id_col, "__sha_here").agg(F.min(whole).alias("row")).select("row.*")
