"""Column operators: select, formula, regular-expression extraction, prompt text."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, functions as F, types as T

from prepflow.functions.expressions import formula_sql, java_pattern
from prepflow.schema import col, data_type, require_columns, safe_cast

UNPLACED = 999_999


def select_columns(df: DataFrame, columns: Sequence[dict[str, Any]] = ()) -> DataFrame:
    """Keep, order, rename and cast columns.

    Each entry is ``{name, keep=True, rename, type, order_index}``.  Names the
    table does not have are passed over; entries without a position come last in
    the order given.  No entries at all leave the table unchanged, and entries
    that keep nothing leave no columns.
    """
    if not columns:
        return df
    out = []
    for entry in sorted(columns, key=lambda e: e.get("order_index", UNPLACED)):
        name = entry.get("name")
        if not name or not entry.get("keep", True) or name not in df.columns:
            continue
        column = col(name)
        if entry.get("type"):
            column = safe_cast(column, data_type(df, name), entry["type"])
        out.append(column.alias(entry.get("rename") or name))
    return df.select(*out)


def formula(df: DataFrame, output_column: str = "NewColumn", expression: str = "") -> DataFrame:
    """Add or overwrite one column from a text expression over ``[Column]`` references.

    The text is Spark SQL otherwise: all SQL functions, literals and window
    expressions may be used.
    """
    if not expression or not output_column:
        return df
    return df.withColumn(output_column, F.expr(formula_sql(expression, df.schema)))


def regex_extract(
    df: DataFrame,
    column: str = "",
    pattern: str = "",
    output_columns: Sequence[dict[str, str]] = (),
    empty_is_null: bool = False,
) -> DataFrame:
    """Write capture group i+1 of the first match into the i-th output column.

    Entries are ``{name, type}``; an entry without a name still uses up its
    group.  Rows without a match get null.  Spark reports a group that took no
    part in the match as empty text; ``empty_is_null`` turns that into null.
    """
    if not column or not pattern or not output_columns:
        return df
    require_columns(df, [column], "regex")
    source = col(column).cast("string")
    pattern = java_pattern(pattern)
    matched = source.rlike(pattern)
    out = {}
    for group, entry in enumerate(output_columns, start=1):
        if not entry.get("name"):
            continue
        text = F.when(matched, F.regexp_extract(source, pattern, group))
        if empty_is_null:
            text = F.nullif(text, F.lit(""))
        out[entry["name"]] = safe_cast(text, T.StringType(), entry.get("type"))
    return df.withColumns(out) if out else df


def prompt_text(
    df: DataFrame,
    input_column: str,
    template: str = "Extract the sentiment from: {Input}",
    output_column: str = "Prompt",
) -> DataFrame:
    """Fill ``{Input}`` and ``{<column name>}`` of a template with the row's value."""
    if not input_column or input_column not in df.columns:
        return df
    value = F.coalesce(col(input_column).cast("string"), F.lit("None"))
    text = F.replace(F.lit(template), F.lit("{Input}"), value)
    text = F.replace(text, F.lit("{" + input_column + "}"), value)
    return df.withColumn(output_column, text)
