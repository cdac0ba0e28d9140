"""Helpers shared by the text operators: folding, words, splits, written tables."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

import prepflow.llm
from prepflow.session import scratch_path

# Functions of this subpackage travel with the task, so that executors need no copy of the library.
cloudpickle.register_pickle_by_value(prepflow.llm)

#: The letters that folding changes.
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"

#: Fixed value: draws the ids of samples.
SAMPLE_SEED = 5

#: 64-bit numbers in the largest filter that is broadcast (8 MB of bits), and the seed of its hash (a fixed value).
MARK_WORDS = 1 << 20
MARK_SEED = 17

#: Fixed value: characters between words.
BLANKS = r"[\x20\x09-\x0D]+"


def fold(text: Column) -> Column:
    """Lower-case A-Z only; null counts as empty.

    Texts of single-byte characters take the fast built-in, others are translated.
    """
    text = F.coalesce(text, F.lit(""))
    return F.when(F.char_length(text) == F.octet_length(text), F.lower(text)).otherwise(
        F.translate(text, UPPER, LOWER)
    )


def words(text: Column) -> Column:
    """Array of the maximal runs without blanks; empty for null or blank texts."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANKS), lambda w: w != "")


def word_count(text: Column) -> Column:
    """Number of words without building them: starts of runs."""
    return F.coalesce(F.size(words(text)).cast("long"), F.lit(0).cast("long"))


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def text_key(id_col: str, text_col: str) -> Column:
    """64 bits that name a row by its id and text."""
    return F.xxhash64(F.col(id_col), F.coalesce(F.col(text_col), F.lit("")))


def written(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared scratch folder and give a reader of it.

    Cuts the lineage in a way that outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def maybe_in(docs: DataFrame, ids: DataFrame, id_col: str, mark: str) -> DataFrame:
    """Add a boolean column: false only for rows whose id is not in the one column of ``ids``.

    A Bloom filter of one hash: ids set bits of at most ``MARK_WORDS`` 64-bit numbers, which are broadcast. It saves
    moving the texts of rows that a join would leave out; the join itself stays with the caller. Null ids are false.
    """
    size = min(MARK_WORDS, max(1, -(-ids.count() // 4)))
    spot = F.pmod(F.xxhash64(F.col(id_col).cast(ids.schema[0].dataType), F.lit(MARK_SEED)), F.lit(64 * size))
    bits = written(
        ids.select(F.col(ids.columns[0]).alias(id_col))
        .filter(F.col(id_col).isNotNull())
        .select(F.floor(spot / 64).alias("__word"), F.pmod(spot, F.lit(64)).cast("int").alias("__bit"))
        .groupBy("__word")
        .agg(F.bit_or(F.expr("shiftleft(1L, __bit)")).alias("__bits")),
        "marks",
    )
    marked = docs.withColumn("__word", F.floor(spot / 64)).withColumn("__bit", F.pmod(spot, F.lit(64)).cast("int"))
    return (
        marked.join(F.broadcast(bits), "__word", "left")
        .withColumn(mark, F.coalesce(F.expr("shiftright(__bits, __bit) & 1L") == 1, F.lit(False)))
        .select(*docs.columns, mark)
    )


def map_texts(
    docs: DataFrame,
    make: Callable[[], Callable[[str | None], tuple]],
    columns: list[tuple[str, pa.DataType]],
    schema: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    many: bool = False,
) -> DataFrame:
    """Apply a function of one whole text to every row; gives doc_id and the named columns.

    With ``many`` the function takes a list of texts and gives a list of results.

    ``make`` is called once per task, for what is costly to build. Rows are handed over in slices, so that a task
    holds the results of few documents besides the Arrow batch it reads.
    """
    out = StructType([StructField("doc_id", docs.select(id_col).schema[0].dataType), *StructType.fromDDL(schema).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fn = make()
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, len(ids), 1000):
                some = [t.as_py() for t in texts.slice(at, 1000)]
                some = fn(some) if many else [fn(t) for t in some]
                arrays = [pa.array(list(x), type=kind) for x, (_, kind) in zip(zip(*some), columns)]
                yield pa.RecordBatch.from_arrays([ids.slice(at, 1000), *arrays], ["doc_id", *[n for n, _ in columns]])

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, out)


def sample_ids(labelled: DataFrame, label_col: str, per_label: int, id_col: str = "doc_id") -> DataFrame:
    """At most ``per_label`` ids of each label as (doc_id, label), the same on every run.

    Ids are dealt into ``per_label`` buckets by a hash and the one with the smallest second hash of each is taken,
    wherever it stands in the order of ids, so that one partial aggregation draws the sample. Rows with a null id or
    label are left out.
    """
    first = F.min(F.struct(F.xxhash64(id_col, F.lit(SAMPLE_SEED)).alias("hash"), F.col(id_col).alias("id")))
    return (
        labelled.filter(F.col(id_col).isNotNull() & F.col(label_col).isNotNull())
        .groupBy(F.col(label_col).alias("label"), F.pmod(F.xxhash64(id_col), F.lit(per_label)).alias("bucket"))
        .agg(first.alias("first"))
        .select(F.col("first.id").alias("doc_id"), "label")
    )


def sampled_texts(docs: DataFrame, ids: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, label, text) of sampled ids; the ids are bounded by their sample, so they are broadcast.

    Of rows that repeat an id, one is used.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "label").agg(F.min("text").alias("text"))


def code_points(text: str | None) -> np.ndarray:
    return np.frombuffer((text or "").encode("utf-32-le"), np.uint32)


def mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer: spreads every input bit over the number."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))
