"""Stacking tables and removing duplicates."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window, functions as F

from prepflow.operators.ordering import (
    OrderBy,
    one_way,
    order_columns,
    place_of,
    required_order,
    row_hash,
)
from prepflow.schema import SchemaError, cols, col, name_list, require_batch, require_columns


def union_tables(tables: Sequence[DataFrame] | DataFrame, how: str = "diagonal") -> DataFrame:
    """Stack tables, keeping duplicates.

    ``diagonal`` matches by name and fills missing columns with null; a name
    must have one type everywhere.  ``vertical`` wants equal names, order and
    types.
    """
    frames = [tables] if isinstance(tables, DataFrame) else list(tables)
    if not frames:
        raise ValueError("union: no tables")
    if how == "vertical":
        for frame in frames[1:]:
            if frame.dtypes != frames[0].dtypes:
                raise SchemaError("union: a vertical union needs equal names, order and types")
        return reduce(DataFrame.union, frames)
    if how != "diagonal":
        raise ValueError(f"union: unknown mode {how!r}")
    known: dict[str, str] = {}
    for name, kind in (pair for frame in frames for pair in frame.dtypes):
        if known.setdefault(name, kind) != kind:
            raise SchemaError(f"union: {name!r} is {known[name]} in one table and {kind} in another")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def unique_rows(
    df: DataFrame,
    columns: Sequence[str] | str = (),
    keep: str = "first",
    order_by: OrderBy | None = None,
) -> DataFrame:
    """One row per key set (all columns when none are named).

    ``keep`` is ``first`` or ``last`` in ``order_by``, ``any``, or ``none`` to
    drop every key set that occurs more than once.  All forms combine before the
    shuffle, so a key with many rows sends at most one row per task.
    """
    keys = name_list(columns) or list(df.columns)
    require_columns(df, keys, "unique")
    require_batch(df, "unique")
    if keep == "any":
        return df.dropDuplicates(keys)
    whole = F.struct(*cols(df.columns))
    if keep == "none":
        counted = df.groupBy(*key_columns(keys)).agg(
            F.count(F.lit(1)).alias("__n"), F.any_value(whole).alias("__row")
        )
        return counted.filter(F.col("__n") == 1).select("__row.*")
    if keep not in ("first", "last"):
        raise ValueError(f"unique: unknown choice {keep!r}")
    if set(keys) == set(df.columns):
        return df.distinct()
    order = required_order(df, order_by, "unique")
    first = keep == "first"
    if one_way(order):
        best = place_of(df, order, df.columns).pick(whole, first)
        return df.groupBy(*key_columns(keys)).agg(best.alias("__row")).select("__row.*")
    # Mixed directions need a window; its limit also keeps one row per key and task.
    ranked = Window.partitionBy(*cols(keys)).orderBy(*order_columns(order, reverse=not first), row_hash(df))
    best = df.withColumn("__rank", F.row_number().over(ranked)).filter("__rank = 1")
    return best.drop("__rank")


def key_columns(keys: list[str]) -> list:
    """Group keys under private names; the kept row brings its own columns."""
    return [col(k).alias(f"__k{i}") for i, k in enumerate(keys)]
