"""Benchmark decontamination by spaced seeds. SQL functions only.

A seed is a hash of some of the words of a short stretch: a fixed mask tells which, the others are ignored, so that
a seed survives a substituted word. Seeds of all masks at all places of the documents are joined with those of the
benchmark. Around each hit, document and item are laid side by side and their words compared: a document is
contaminated when, within ``WINDOW`` words in a row (or the whole item, if that is shorter), at least four fifths
are the same. The masks are chosen so that every pattern of substitutions this allows leaves a seed untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepflow.llm.common import written
from prepflow.llm.pii import let

#: Places of a stretch that a seed looks at.
MASKS = ((0, 1, 2, 4, 5), (0, 1, 3, 5, 6), (0, 1, 2, 5, 6))

WINDOW = 13
LEAST_WORDS = 8

#: Seeds of a benchmark that are broadcast at most; a seed takes 8 bytes. Beyond it the join is dealt by seed.
BROADCAST_SEEDS = 1_000_000


def plain_words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def numbers(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def seeds(hashes: Column, mask: tuple[int, ...]) -> Column:
    """Hash of the masked words from each place on; empty for texts shorter than the mask."""
    name = F.lit(MASKS.index(mask))
    return F.when(
        F.size(hashes) > mask[-1],
        F.transform(
            F.sequence(F.lit(0), F.size(hashes) - 1 - mask[-1]),
            lambda i: F.xxhash64(name, *[F.get(hashes, i + k) for k in mask]),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def placed_seeds(hashes: Column) -> Column:
    """Array of (seed, place) of all masks."""
    return F.concat(
        *[
            F.transform(seeds(hashes, mask), lambda seed, i: F.struct(seed.alias("seed"), i.alias("place")))
            for mask in MASKS
        ]
    )


def known_seeds(rows: DataFrame, sought: DataFrame, few: bool, how: str) -> DataFrame:
    return rows.join(F.broadcast(sought) if few else sought, "seed", how)


def need(n: Column) -> Column:
    """How many of a window's words must be the same: four fifths, rounded up."""
    return F.floor((F.least(n, F.lit(WINDOW)) * 4 + 4) / 5).cast("int")


def leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id", item_text_col: str = "text", broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """(doc_id, crc, items): contaminated documents by id and checksum of the text, with the sorted items found.

    Items with equal words are looked for once.
    """
    items = written(
        benchmark.filter(F.col(item_col).isNotNull())
        .select(F.col(item_col).alias("item"), numbers(plain_words(F.col(item_text_col))).alias("item_words"))
        .filter(F.size("item_words") >= LEAST_WORDS)
        .groupBy("item_words")
        .agg(F.min("item").alias("item"), F.sort_array(F.collect_set("item")).alias("alike")),
        "items",
    )
    item_seeds = written(
        items.select("item", F.explode(placed_seeds(F.col("item_words"))).alias("s")).select(
            "item", F.col("s.seed").alias("seed"), F.col("s.place").alias("item_place")
        ),
        "item-seeds",
    )
    few = item_seeds.count() <= broadcast_seeds
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"), F.crc32(text.cast("binary")).alias("crc"))
    all_seeds = let(numbers(plain_words(F.col("text"))), lambda h: F.flatten(F.array(*[seeds(h, m) for m in MASKS])))
    touched = written(
        known_seeds(
            rows.select("doc_id", "crc", F.explode(all_seeds).alias("seed")),
            item_seeds.select("seed").distinct(),
            few,
            "left_semi",
        )
        .select(F.col("doc_id").alias("of"), F.col("crc").alias("of_crc"))
        .distinct(),
        "touched",
    )
    near = rows.join(
        touched, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("crc") == F.col("of_crc")), "left_semi"
    ).select("doc_id", "crc", numbers(plain_words(F.col("text"))).alias("words"))
    # Rows that repeat an id and text are looked at once.
    near = written(near.groupBy("doc_id", "crc").agg(F.max("words").alias("words")), "near-texts")
    hits = known_seeds(
        near.select("doc_id", "crc", F.explode(placed_seeds(F.col("words"))).alias("s")).select(
            "doc_id", "crc", F.col("s.seed").alias("seed"), F.col("s.place").alias("place")
        ),
        item_seeds,
        few,
        "inner",
    )
    lines = written(
        hits.select("doc_id", "crc", "item", (F.col("place") - F.col("item_place")).alias("shift")).distinct(), "lines"
    )
    same = F.filter(
        F.sequence(F.lit(0), F.size("item_words") - 1),
        lambda i: (i + F.col("shift") >= 0)
        & (F.get(F.col("words"), F.greatest(F.lit(0), i + F.col("shift"))) == F.get(F.col("item_words"), i)),
    )
    window, least = F.least(F.size("item_words"), F.lit(WINDOW)), need(F.size("item_words"))
    dense = F.exists(
        F.sequence(F.lit(0), F.greatest(F.lit(0), F.size("same") - F.col("least"))),
        lambda i: F.get(F.col("same"), i + F.col("least") - 1) - F.get(F.col("same"), i) < F.col("window"),
    )
    found = (
        lines.alias("l")
        .join(near.alias("n"), F.col("l.doc_id").eqNullSafe(F.col("n.doc_id")) & (F.col("l.crc") == F.col("n.crc")))
        .select("l.doc_id", "l.crc", "item", "shift", "words")
        .join(items, "item")
        .select("doc_id", "crc", "alike", same.alias("same"), window.alias("window"), least.alias("least"))
        .filter((F.size("same") >= F.col("least")) & dense)
    )
    return found.groupBy("doc_id", "crc").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_set("alike")))).alias("items")
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per row of ``docs``: doc_id, contaminated, items (sorted ids of the items found in it).

    Words are lower-cased runs of letters and digits. Items of fewer than LEAST_WORDS words, without text or without
    id are not looked for. Null and empty texts are clean. Repeated rows give repeated rows; an empty table gives an
    empty result and an empty benchmark clean rows; other columns are not looked at.
    """
    found = written(leaks(docs, benchmark, id_col, text_col, **options), "leaks").select(
        F.col("doc_id").alias("of"), F.col("crc").alias("of_crc"), "items"
    )
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.crc32(text.cast("binary")).alias("crc"))
    return rows.join(found, F.col("doc_id").eqNullSafe(F.col("of")) & (F.col("crc") == F.col("of_crc")), "left").select(
        "doc_id",
        F.col("items").isNotNull().alias("contaminated"),
        F.coalesce("items", F.array().cast(found.schema["items"].dataType)).alias("items"),
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The clean rows of ``docs`` with all their columns."""
    found = written(leaks(docs, benchmark, id_col, text_col, **options), "leaks").select(
        F.col("doc_id").alias("__of"), F.col("crc").alias("__of_crc")
    )
    crc = F.crc32(F.coalesce(F.col(text_col), F.lit("")).cast("binary"))
    return docs.join(found, F.col(id_col).eqNullSafe(F.col("__of")) & (crc == F.col("__of_crc")), "left_anti")
