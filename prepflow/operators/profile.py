"""Looking at a table: preview and column profile."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prepflow.operators.ordering import sort_rows
from prepflow.schema import SEMANTIC_KEY, col, require_batch, semantic_types

PREVIEW_ROWS = 1000


class Preview(NamedTuple):
    """First rows of a table with its schema and size; rows stay a DataFrame."""

    rows: DataFrame
    columns: list[dict[str, str | None]]
    row_count: int
    column_count: int


def browse(df: DataFrame) -> DataFrame:
    """The table itself."""
    return df


def preview(
    df: DataFrame, n: int = PREVIEW_ROWS, column: str = "", descending: bool = False
) -> Preview:
    """Schema, sizes and the first ``n`` rows, sorted by ``column`` over the whole table if given."""
    require_batch(df, "preview")
    tags = semantic_types(df)
    described = [
        {"name": f.name, "type": f.dataType.simpleString(), SEMANTIC_KEY: tags.get(f.name)}
        for f in df.schema.fields
    ]
    first = sort_rows(df, column=column, descending=descending).limit(n)
    return Preview(first, described, df.count(), len(df.columns))


def column_profile(df: DataFrame, approx: bool = False) -> DataFrame:
    """One row per column: type, semantic tag, non-null, null and distinct counts, min and max.

    Exactly, each column is counted by value on its own: the scan reads that
    column only, equal values combine before the shuffle, and all figures follow
    from the counts.  ``approx`` estimates distinct values in a single pass over
    all columns, without a shuffle of values.
    """
    require_batch(df, "column_profile")
    if approx:
        return sketched_profile(df)
    parts = []
    for field in df.schema.fields:
        value = F.col("v")
        counts = df.select(col(field.name).alias("v")).groupBy("v").agg(F.count(F.lit(1)).alias("n"))
        sortable = not isinstance(field.dataType, (T.MapType, T.VariantType))
        parts.append(
            counts.agg(
                total(F.when(value.isNotNull(), F.col("n"))).alias("non_null"),
                total(F.when(value.isNull(), F.col("n"))).alias("nulls"),
                F.count(value).alias("distinct_values"),
                extreme(F.min, value, sortable).alias("min_value"),
                extreme(F.max, value, sortable).alias("max_value"),
            ).select(*labels(df, field), "*")
        )
    return reduce(DataFrame.union, parts)


def labels(df: DataFrame, field: T.StructField) -> list[Column]:
    return [
        F.lit(field.name).alias("column"),
        F.lit(field.dataType.simpleString()).alias("type"),
        F.lit(semantic_types(df).get(field.name)).cast("string").alias("semantic_type"),
    ]


def total(counts: Column) -> Column:
    return F.coalesce(F.sum(counts), F.lit(0).cast("bigint"))


def extreme(pick, value: Column, sortable: bool) -> Column:
    return pick(value).cast("string") if sortable else F.lit(None).cast("string")


def sketched_profile(df: DataFrame) -> DataFrame:
    aggregates, entries = [F.count(F.lit(1)).alias("__rows")], []
    for i, field in enumerate(df.schema.fields):
        this = col(field.name)
        sortable = not isinstance(field.dataType, (T.MapType, T.VariantType))
        aggregates += [
            F.count(this).alias(f"n{i}"),
            (F.approx_count_distinct(this) if sortable else F.lit(None).cast("bigint")).alias(f"d{i}"),
            extreme(F.min, this, sortable).alias(f"lo{i}"),
            extreme(F.max, this, sortable).alias(f"hi{i}"),
        ]
        entries.append(
            F.struct(
                *labels(df, field),
                F.col(f"n{i}").alias("non_null"),
                (F.col("__rows") - F.col(f"n{i}")).alias("nulls"),
                F.col(f"d{i}").alias("distinct_values"),
                F.col(f"lo{i}").alias("min_value"),
                F.col(f"hi{i}").alias("max_value"),
            )
        )
    return df.agg(*aggregates).select(F.inline(F.array(*entries)))
