"""Vector codes by product quantisation, trained with active-entry Lloyd rounds.

Vectors are scaled to integers (``floor(1024 * x)``) and cut into ``PARTS`` equal consecutive parts. Each part
position has its own codebook of at most ``ENTRIES`` entries; a part's code is the index of its nearest entry
(squared Euclidean distance, the lower index on ties).

Training is Lloyd's algorithm, with one saving: a part remembers its entry and the exact distance to it. When that
entry did not move in the last update, every entry that did not move either is still no closer than before, so only
the moved entries are compared against the stored distance; parts whose entry moved scan the whole codebook again.
Both ways give the assignment a full scan gives, ties to the lower index included.

Rows and their parts stay on the executors; each round writes its assignments to the shared scratch folder (lineage
cut, lost executors recompute one round only). Only the codebooks and the per-entry sums pass the driver: at most
``PARTS * ENTRIES * width`` numbers, whatever the size of the table, so they are broadcast.

Edge cases: rows whose vector is null or holds a null, NaN or infinite component are dropped. All kept vectors must
have one length, divisible by ``PARTS`` (else ``ValueError``); components beyond +-2^24 after scaling are refused
too, so that squared distances of a part stay exact in 64 bits. Fewer than ``ENTRIES`` kept rows give as many
entries as rows. Repeated vec_ids are separate rows; among equal vec_ids the initial entries are taken in the order
of the vectors. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prepflow.llm.common import written

#: Fixed values of the contract.
SCALE = 1024
PARTS = 4
ENTRIES = 256
ROUNDS = 4

#: Largest scaled component accepted: 16 components of 2^25 squared stay far below 2^63.
LARGEST = 1 << 24


def finite(vector: Column) -> Column:
    """A vector that is there and whose components are all finite numbers."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vector.isNotNull() & ~bad


def scaled(embeddings: DataFrame, id_col: str, vector_col: str, label_col: str | None) -> DataFrame:
    """(vec_id, label, v) with integer components; bad rows dropped."""
    label = F.col(label_col) if label_col else F.lit(None).cast("int")
    return embeddings.filter(finite(F.col(vector_col))).select(
        F.col(id_col).alias("vec_id"),
        label.alias("label"),
        F.transform(F.col(vector_col), lambda x: F.floor(x.cast("double") * SCALE)).alias("v"),
    )


def distances(parts: np.ndarray, book: np.ndarray) -> np.ndarray:
    """Squared distances of every part (rows) to every entry (columns), exact in int64."""
    return (
        (parts * parts).sum(axis=1)[:, None] - 2 * parts @ book.T + (book * book).sum(axis=1)[None, :]
    )


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    d = distances(parts, book)
    best = d.argmin(axis=1)  # first of equal minima: the lower index
    return best, d[np.arange(len(parts)), best]


def reassign(
    parts: np.ndarray, entry: np.ndarray, dist: np.ndarray, book: np.ndarray, moved: np.ndarray
) -> tuple[np.ndarray, np.ndarray]:
    """Assignment after an update, scanning fully only where the assigned entry moved."""
    entry, dist = entry.copy(), dist.copy()
    rescan = moved[entry]
    if rescan.any():
        entry[rescan], dist[rescan] = nearest(parts[rescan], book)
    stay = ~rescan
    moved_ix = np.flatnonzero(moved)
    if stay.any() and len(moved_ix):
        d = distances(parts[stay], book[moved_ix])
        pick = d.argmin(axis=1)
        cand, cand_d = moved_ix[pick], d[np.arange(len(pick)), pick]
        old, old_d = entry[stay], dist[stay]
        better = (cand_d < old_d) | ((cand_d == old_d) & (cand < old))
        entry[stay] = np.where(better, cand, old)
        dist[stay] = np.where(better, cand_d, old_d)
    return entry, dist


def initial_books(rows: DataFrame, width: int) -> list[np.ndarray]:
    """Part p of the vectors of the ``ENTRIES`` smallest vec_ids, ascending (a bounded top-k)."""
    first = rows.orderBy(F.col("vec_id").asc_nulls_last(), "v").limit(ENTRIES).select("v").collect()
    vectors = np.array([r.v for r in first], dtype=np.int64).reshape(len(first), PARTS * width)
    return [vectors[:, p * width : (p + 1) * width].copy() for p in range(PARTS)]


def lloyd_step(state: DataFrame, books: list[np.ndarray], moved: list[np.ndarray] | None, width: int) -> DataFrame:
    """New (entry, dist) of every row: a full scan the first time, active entries afterwards."""
    schema = state.schema
    spark = state.sparkSession
    shared = spark.sparkContext.broadcast((books, moved))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        books_, moved_ = shared.value
        for batch in batches:
            if batch.empty:
                continue
            v = np.stack(batch["v"].to_numpy()).astype(np.int64)
            entries, dists = [], []
            for p in range(PARTS):
                part = v[:, p * width : (p + 1) * width]
                if moved_ is None:
                    e, d = nearest(part, books_[p])
                else:
                    old_e = np.stack(batch["entry"].to_numpy())[:, p].astype(np.int64)
                    old_d = np.stack(batch["dist"].to_numpy())[:, p].astype(np.int64)
                    e, d = reassign(part, old_e, old_d, books_[p], moved_[p])
                entries.append(e)
                dists.append(d)
            out = batch.copy()
            out["entry"] = list(np.stack(entries, axis=1).astype(np.int32))
            out["dist"] = list(np.stack(dists, axis=1).astype(np.int64))
            yield out

    return state.mapInPandas(run, schema)


def entry_sums(state: DataFrame, width: int) -> DataFrame:
    """Per (part, entry): count and the sums of its parts' components, pre-aggregated in each task."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts = np.zeros((PARTS, ENTRIES), dtype=np.int64)
        sums = np.zeros((PARTS, ENTRIES, width), dtype=np.int64)
        for batch in batches:
            if batch.empty:
                continue
            v = np.stack(batch["v"].to_numpy()).astype(np.int64)
            e = np.stack(batch["entry"].to_numpy()).astype(np.int64)
            for p in range(PARTS):
                np.add.at(counts[p], e[:, p], 1)
                np.add.at(sums[p], e[:, p], v[:, p * width : (p + 1) * width])
        used = np.argwhere(counts > 0)
        yield pd.DataFrame(
            {
                "part": used[:, 0].astype(np.int32),
                "entry": used[:, 1].astype(np.int32),
                "n": counts[used[:, 0], used[:, 1]],
                "sums": list(sums[used[:, 0], used[:, 1]]),
            }
        )

    partial = state.select("v", "entry").mapInPandas(
        run, "part int, entry int, n long, sums array<long>"
    )
    return partial.groupBy("part", "entry").agg(
        F.sum("n").alias("n"),
        F.array(*[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(width)]).alias("sums"),
    )


def updated(books: list[np.ndarray], sums: list) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Entries replaced by floor(sum / count) of their parts; unused entries stay."""
    new = [b.copy() for b in books]
    for row in sums:
        total = [int(s) for s in row.sums]
        new[row.part][row.entry] = [t // row.n for t in total]  # floor division: rounds down
    moved = [np.any(n != b, axis=1) for n, b in zip(new, books)]
    return new, moved


def books_digest(books: list[np.ndarray]) -> str:
    text = ",".join(str(int(x)) for b in books for entry in b for x in entry)
    return hashlib.sha256(text.encode()).hexdigest()


def quantize(
    embeddings: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str | None = "label",
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Codes of all finite vectors and the trained codebooks.

    Gives (vec_id, label, code array<int>, error long) per kept row, and the codebooks as ``PARTS`` integer arrays.
    """
    rows = written(scaled(embeddings, id_col, vector_col, label_col), "pq-rows")
    shape = rows.agg(
        F.min(F.size("v")).alias("lo"),
        F.max(F.size("v")).alias("hi"),
        F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: F.greatest(a, F.abs(x)))).alias("big"),
    ).first()
    if shape.lo is None:
        empty = rows.select("vec_id", "label", F.array().cast("array<int>").alias("code"), F.lit(0).cast("long").alias("error"))
        return empty.limit(0), []
    if shape.lo != shape.hi or shape.lo % PARTS:
        raise ValueError(f"vectors of lengths {shape.lo} to {shape.hi}; one length divisible by {PARTS} is needed")
    if shape.big is not None and shape.big > LARGEST:
        raise ValueError(f"a scaled component reaches {shape.big}, beyond {LARGEST}")
    width = shape.lo // PARTS
    books = initial_books(rows, width)
    state = rows.withColumn("entry", F.array().cast("array<int>")).withColumn("dist", F.array().cast("array<long>"))
    moved = None
    for _ in range(rounds):
        state = written(lloyd_step(state, books, moved, width), "pq-round")
        books, moved = updated(books, entry_sums(state, width).collect())
    final = written(lloyd_step(state, books, moved, width), "pq-final")
    return (
        final.select(
            "vec_id",
            "label",
            F.col("entry").alias("code"),
            F.aggregate("dist", F.lit(0).cast("long"), lambda a, x: a + x).alias("error"),
        ),
        books,
    )


def coded(embeddings: DataFrame, **kwargs) -> DataFrame:
    """Per kept row: vec_id, code (two lowercase hex digits a part), error, label_error, codebooks_sha256.

    ``label_error`` sums ``error`` over rows of the same label (nulls form one group), by one aggregation that is
    joined back null-safely.
    """
    codes, books = quantize(embeddings, **kwargs)
    per_label = codes.groupBy("label").agg(F.sum("error").alias("label_error"))
    joined = codes.join(per_label, codes["label"].eqNullSafe(per_label["label"]), "left").drop(per_label["label"])
    return joined.select(
        "vec_id",
        F.array_join(F.transform("code", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))), "").alias("code"),
        "error",
        F.col("label_error").cast("long").alias("label_error"),
        F.lit(books_digest(books)).alias("codebooks_sha256"),
    )
