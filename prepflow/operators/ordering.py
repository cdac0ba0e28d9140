"""Order: sorting, row numbers, running totals, samples, row batches.

Spark tables have no implicit row order, so whatever depends on order takes an
``order_by`` list: column names, or ``(name, "desc")`` pairs.

Global positions never use a window without a key.  The table is range-sorted
once and written to the shared scratch folder; each file is then one sorted
slice, the scan's row index is the position within the slice, and slice sizes
(read from the Parquet footers) give the offset.  The written table is the same
for every reader and survives the loss of any executor.
"""

from __future__ import annotations

import random
from collections.abc import Sequence
from typing import Any, NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from prepflow.schema import col, cols, input_bytes, name_list, require_batch, require_columns
from prepflow.session import scratch_path

OrderBy = Sequence[str | tuple[str, str]]

# Up to this many rows a top-n is merged from per-task candidates in one task;
# beyond it rows are numbered in slices and filtered.
TOP_N_LIMIT = 10_000

# Sorted slices of about this many bytes of input; more slices than the session's
# shuffle partitions are made when the input is large enough to call for them.
SLICE_BYTES = 256 << 20
MAX_SLICES = 100_000

# Identical rows are counted and numbered in runs of this length; the runs of a
# much-repeated row are spread over tasks before they are unfolded.
COPY_RUN = 100_000

SLICE, POSITION = "__slice", "__position"
TIE, COPY = "__tie", "__copy"


def order_names(order_by: OrderBy) -> list[str]:
    return [o if isinstance(o, str) else o[0] for o in order_by]


def is_descending(rule: str | tuple[str, str]) -> bool:
    return not isinstance(rule, str) and rule[1].lower() == "desc"


def order_columns(order_by: OrderBy, reverse: bool = False) -> list[Column]:
    """Sort columns with nulls first in both directions; reversed, nulls come last."""
    out = []
    for rule in order_by:
        column = col(rule if isinstance(rule, str) else rule[0])
        down = is_descending(rule)
        if reverse:
            out.append(column.asc_nulls_last() if down else column.desc_nulls_last())
        else:
            out.append(column.desc_nulls_first() if down else column.asc_nulls_first())
    return out


def required_order(df: DataFrame, order_by: OrderBy | str | None, operator: str) -> list:
    rules = name_list(order_by) if isinstance(order_by, str) else list(order_by or [])
    if not rules:
        raise ValueError(f"{operator}: order_by is needed, tables have no order of their own")
    require_columns(df, order_names(rules), operator)
    require_batch(df, operator)
    return rules


def row_hash(df: DataFrame) -> Column:
    """Hash of the whole row, used to break ties of the order."""
    parts = [
        F.to_json(col(f.name)) if has_map(f.dataType) else col(f.name) for f in df.schema.fields
    ]
    return F.xxhash64(*parts)


class Place(NamedTuple):
    """Sort key of one row as a single value; ``down`` says that high values come first."""

    key: Column
    down: bool

    def pick(self, what: Column, first: bool) -> Column:
        """Aggregate: ``what`` of the first or last row, combining before the shuffle."""
        return F.min_by(what, self.key) if first != self.down else F.max_by(what, self.key)


def one_way(order_by: OrderBy) -> bool:
    """Do all order columns have the same direction?"""
    return len({is_descending(o) for o in order_by}) <= 1


def place_of(df: DataFrame, order_by: OrderBy, tie_columns: Sequence[str]) -> Place:
    """Place of a row by the order columns, ties broken by a hash of ``tie_columns``.

    A struct sorts one way only, so all order columns must have one direction.
    Nulls come first either way.
    """
    if not one_way(order_by):
        raise ValueError("all order columns must have the same direction here")
    down = any(is_descending(o) for o in order_by)
    fields = []
    for i, name in enumerate(order_names(order_by)):
        fields += [col(name).isNull().alias(f"n{i}")] if down else []
        fields.append(col(name).alias(f"o{i}"))
    tie = row_hash(df.select(*cols(tie_columns)))
    return Place(F.struct(*fields, tie.alias(TIE)), down)


def has_map(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(has_map(f.dataType) for f in kind.fields)
    if isinstance(kind, T.ArrayType):
        return has_map(kind.elementType)
    return isinstance(kind, (T.MapType, T.VariantType))


def sort_rules(
    rules: Sequence[dict[str, str]] = (), column: str = "", descending: bool = False
) -> list[tuple[str, str]]:
    """Order list of ``{column, order}`` rules or of the single-column form."""
    if not rules and column:
        rules = [{"column": column, "order": "desc" if descending else "asc"}]
    return [(r["column"], r.get("order", "asc")) for r in rules if r.get("column")]


def sort_rows(
    df: DataFrame,
    rules: Sequence[dict[str, str]] = (),
    column: str = "",
    descending: bool = False,
) -> DataFrame:
    """Sort by several columns, nulls first in both directions; unknown columns are skipped."""
    known = [r for r in sort_rules(rules, column, descending) if r[0] in df.columns]
    if not known:
        return df
    require_batch(df, "sort")
    return df.orderBy(*order_columns(known))


def numbered_copies(df: DataFrame) -> DataFrame:
    """Append a hash of the row and a number that tells its identical copies apart.

    Copies are counted with a partial count per task, so a row that makes up much
    of the table shuffles as one row per task.  Long runs are unfolded in pieces
    that are spread over all tasks.
    """
    columns = df.columns
    counted = df.groupBy(*cols(columns)).agg(F.count(F.lit(1)).alias("__n"))
    counted = counted.select(*cols(columns), row_hash(df).alias(TIE), "__n")

    def unfold(first: Column, length: Column) -> list[Column]:
        return [*cols(columns), col(TIE), F.explode(F.sequence(first, first + length - 1)).alias(COPY)]

    zero = F.lit(0).cast("bigint")
    few = counted.filter(F.col("__n") <= COPY_RUN).select(*unfold(zero, F.col("__n")))
    runs = counted.filter(F.col("__n") > COPY_RUN).withColumn(
        "__run", F.explode(F.sequence(zero, F.expr(f"(__n - 1) div {COPY_RUN}")))
    )
    first = F.col("__run") * COPY_RUN
    many = runs.repartition(TIE, "__run").select(
        *unfold(first, F.least(F.lit(COPY_RUN).cast("bigint"), F.col("__n") - first))
    )
    return few.unionByName(many)


def range_sorted(df: DataFrame, order: list[Column]) -> DataFrame:
    """Global sort with enough range partitions for the size of the table."""
    size = input_bytes(df)
    needed = min(MAX_SLICES, -(-size // SLICE_BYTES)) if size else 0
    if needed <= int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        return df.orderBy(*order)
    return df.repartitionByRange(needed, *order).sortWithinPartitions(*order)


def sorted_slices(df: DataFrame, order_by: OrderBy, unique_order: bool = False) -> DataFrame:
    """Write ``df`` in sorted slices; read it back with slice number and position.

    ``unique_order`` states that no two rows share the same order values.
    Otherwise ties are broken by a hash of the row and a copy number, so that
    neither a frequent order value nor a frequent row ends up in one slice.
    Runs one job.
    """
    spark = df.sparkSession
    order = order_columns(order_by)
    if unique_order:
        ordered = range_sorted(df, order)
    else:
        ordered = range_sorted(numbered_copies(df), [*order, col(TIE), col(COPY)]).select(*cols(df.columns))
    path = scratch_path(spark, "slices")
    ordered.write.option("maxRecordsPerFile", 0).parquet(path)
    file_name = F.col("_metadata.file_name")  # part-<slice>-<job>-c000...
    return (
        spark.read.schema(ordered.schema)
        .parquet(path)
        .select(
            *cols(df.columns),
            F.substring_index(F.substring(file_name, 6, 20), "-", 1).cast("int").alias(SLICE),
            F.col("_metadata.row_index").alias(POSITION),
        )
    )


def slice_offsets(slices: DataFrame, amount: Column) -> DataFrame:
    """Sum of ``amount`` over all earlier slices, one row per slice.

    The per-slice sums are one row per written file, a number set by the
    partition count and not by the data; they are summed up on the driver and
    handed back as a small local table.
    """
    sums = slices.groupBy(SLICE).agg(amount.alias("amount"))
    before, rows = None, []
    for row in sorted(sums.collect(), key=lambda r: r[SLICE]):
        if before is None:
            # A zero of the sums' own type: a first sum of NaN or infinity must not spread to the rows before it.
            before = type(row["amount"])(0)
        rows.append((row[SLICE], before))
        before = before + row["amount"]
    schema = T.StructType([T.StructField(SLICE, T.IntegerType()), T.StructField("__before", sums.schema["amount"].dataType)])
    return slices.sparkSession.createDataFrame(rows, schema)


def number_rows(
    df: DataFrame, order_by: OrderBy, name: str, start: int = 0, unique_order: bool = False
) -> DataFrame:
    """Append a gap-free bigint row number in the given order."""
    slices = sorted_slices(df, order_by, unique_order)
    offsets = slice_offsets(slices, F.count(F.lit(1)))
    return slices.join(F.broadcast(offsets), SLICE).select(
        *cols(c for c in df.columns if c != name),
        (F.col("__before") + F.col(POSITION) + F.lit(start).cast("bigint")).alias(name),
    )


def running_total(
    df: DataFrame,
    value: str,
    order_by: OrderBy,
    name: str,
    unique_order: bool = False,
    before: str | None = None,
) -> DataFrame:
    """Append the running sum of ``value`` in the given order, and under ``before`` the sum up to the row before."""
    slices = sorted_slices(df, order_by, unique_order)
    offsets = slice_offsets(slices, F.coalesce(F.sum(col(value)), F.lit(0)))
    within = Window.partitionBy(SLICE).orderBy(POSITION).rowsBetween(Window.unboundedPreceding, 0)
    earlier = within.rowsBetween(Window.unboundedPreceding, -1)
    total = lambda window: F.coalesce(F.sum(col(value)).over(window), F.lit(0))
    summed = slices.withColumn("__sum", total(within))
    extra = []
    if before:
        summed = summed.withColumn("__earlier", total(earlier))
        extra = [(F.col("__before") + F.col("__earlier")).alias(before)]
    return summed.join(F.broadcast(offsets), SLICE).select(
        *cols(c for c in df.columns if c not in (name, before)),
        (F.col("__before") + F.col("__sum")).alias(name),
        *extra,
    )


def record_id(
    df: DataFrame,
    column_name: str = "RecordID",
    starting_value: Any = 1,
    order_by: OrderBy | None = None,
    unique_order: bool = False,
) -> DataFrame:
    """Put a sequential bigint column first; an existing column of that name is replaced."""
    order = required_order(df, order_by, "record_id")
    try:
        start = int(starting_value)
    except (TypeError, ValueError):
        start = 1
    name = column_name or "RecordID"
    work = name
    if name in order_names(order):
        work = "__record_id"
    numbered = number_rows(df, order, work, start, unique_order)
    return numbered.select(col(work).alias(name), *cols(c for c in df.columns if c != name))


def sample_rows(
    df: DataFrame,
    sample_type: str = "first",
    n_records: int = 100,
    order_by: OrderBy | None = None,
    seed: int | None = None,
    unique_order: bool = False,
) -> DataFrame:
    """First, last or random ``n_records`` rows; all rows when there are fewer.

    A random sample is exact in size and without replacement.  The same seed draws
    the same rows at every size and partitioning.
    """
    n = int(n_records)
    if n <= 0:
        return df.limit(0)
    require_batch(df, "sample")
    if sample_type == "random":
        seed = random.getrandbits(62) if seed is None else seed
        drawn = numbered_copies(df).withColumn("__draw", F.xxhash64(F.lit(seed), TIE, COPY))
        if n <= TOP_N_LIMIT:
            return drawn.orderBy("__draw", TIE, COPY).limit(n).select(*cols(df.columns))
        return large_random_sample(df, drawn, n)
    if sample_type not in ("first", "last"):
        return df
    order = required_order(df, order_by, "sample")
    if n <= TOP_N_LIMIT:
        tie = [] if unique_order else [row_hash(df)]
        if sample_type == "first":
            return df.orderBy(*order_columns(order), *tie).limit(n)
        ends = df.orderBy(*order_columns(order, reverse=True), *tie).limit(n)
        return ends.orderBy(*order_columns(order))
    numbered = number_rows(df, order, "__row", unique_order=unique_order)
    if sample_type == "first":
        wanted = F.col("__row") < n
    else:
        wanted = F.col("__row") >= numbered.agg(F.max("__row")).scalar() - (n - 1)
    return numbered.filter(wanted).drop("__row")


def large_random_sample(df: DataFrame, drawn: DataFrame, n: int) -> DataFrame:
    """Rows with the lowest draws, a hash of row, copy number and seed.

    A shuffle on ``rand()`` could change when a lost task is repeated; the hash
    cannot.  Only about n rows, those below a cut that follows from the row
    count, are sorted; should the cut turn out too low, all rows are.
    """
    share = (n + 8 * n**0.5 + 100) / max(df.count(), 1)
    below = drawn
    if share < 1:
        below = drawn.filter(F.col("__draw") < int((2 * share - 1) * 2**63))
    for candidates in (below, drawn):
        numbered = number_rows(candidates, ["__draw", TIE, COPY], "__row", unique_order=True)
        if candidates is drawn or numbered.count() >= n:
            break
    return numbered.filter(F.col("__row") < n).select(*cols(df.columns))


def top_k(df: DataFrame, rules: Sequence[dict[str, str]], n_records: int) -> DataFrame:
    """Sort, then first n: one top-n step."""
    return sample_rows(df, "first", n_records, order_by=sort_rules(rules))


def chunk_rows(
    df: DataFrame,
    chunk_size: int = 10,
    columns_to_chunk: Sequence[str] | str = (),
    row_separator: str = "\n",
    order_by: OrderBy | None = None,
    unique_order: bool = False,
) -> DataFrame:
    """Join every ``chunk_size`` consecutive rows of each chosen column into one text.

    Gives ``Chunk_ID`` from 0, the joined columns (nulls left out) and
    ``Rows_in_Chunk``.  A separator may be spelled with ``\\n`` escapes.
    """
    chosen = [c for c in name_list(columns_to_chunk) if c in df.columns]
    if not chosen:
        return df
    size = int(chunk_size)
    if size <= 0:
        raise ValueError("chunk_rows: chunk_size must be greater than 0")
    order = required_order(df, order_by, "chunk_rows")
    separator = row_separator.replace("\\n", "\n")
    needed = list(dict.fromkeys([*chosen, *order_names(order)]))
    numbered = number_rows(df.select(*cols(needed)), order, "__row", unique_order=unique_order)
    texts = [col(c).cast("string").alias(f"t{i}") for i, c in enumerate(chosen)]
    chunks = numbered.groupBy(F.expr(f"__row div {size}").alias("Chunk_ID")).agg(
        F.array_sort(F.collect_list(F.struct("__row", *texts))).alias("__rows"),
        F.count(F.lit(1)).alias("Rows_in_Chunk"),
    )
    return chunks.select(
        "Chunk_ID",
        *(F.array_join(F.col(f"__rows.t{i}"), separator).alias(c) for i, c in enumerate(chosen)),
        "Rows_in_Chunk",
    )
