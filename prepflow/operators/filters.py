"""Two-way filters: every filter splits a table into a true and a false part."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prepflow.functions.expressions import java_pattern, predicate
from prepflow.schema import FLOAT_TYPES, INTEGER_TYPES, col, data_type, require_columns

# Words that count as true when a boolean column is compared with text.
TRUE_WORDS = {"true", "1", "yes", "t"}

NULL_TESTS = {"is_null", "is_not_null"}
COMPARISONS = {
    "==": Column.__eq__,
    "!=": Column.__ne__,
    ">": Column.__gt__,
    ">=": Column.__ge__,
    "<": Column.__lt__,
    "<=": Column.__le__,
}

Split = dict[str, DataFrame]


def filter_split(df: DataFrame, condition: Column, persist: bool = False) -> Split:
    """Rows where ``condition`` holds, and all others (false or null).

    The true part filters on the bare condition so that it can be pushed into
    the scan; only the false part needs the null test.  ``persist`` keeps the
    input when both parts are going to be read.
    """
    if persist:
        df = df.persist()
    return {
        "true": df.filter(condition),
        "false": df.filter(~F.coalesce(condition, F.lit(False))),
    }


def keep_all(df: DataFrame) -> Split:
    """Everything true, nothing false, same schema on both sides."""
    return {"true": df, "false": df.filter(F.lit(False))}


#: How a text is read for a column, by Spark type; any other type compares as text.
PARSERS: dict[type[T.DataType], Callable[[Any], Any]] = {
    **dict.fromkeys(INTEGER_TYPES, int),
    **dict.fromkeys(FLOAT_TYPES, float),
    T.DecimalType: lambda text: Decimal(str(text)),
    T.BooleanType: lambda text: str(text).lower() in TRUE_WORDS,
    T.DateType: lambda text: datetime.strptime(str(text), "%Y-%m-%d").date(),
    **dict.fromkeys((T.TimestampType, T.TimestampNTZType), lambda text: datetime.fromisoformat(str(text))),
}


def typed_value(kind: T.DataType, text: Any) -> Any:
    """The Python value of ``text`` for a column of type ``kind``; bad text raises."""
    return PARSERS.get(type(kind), str)(text)


def typed_literal(kind: T.DataType, value: Any) -> Column:
    """Literal of exactly the column's type, so a comparison needs no cast of the column."""
    if isinstance(value, (datetime, date)):
        return F.lit(value.isoformat()).cast(kind)
    return F.lit(value)


def column_condition(
    df: DataFrame, column: str, operator: str, value: Any = "", literal: bool = False
) -> Column:
    """Condition for one column; ``literal`` makes contains a plain substring test."""
    require_columns(df, [column], "filter")
    this = col(column)
    if operator == "is_null":
        return this.isNull()
    if operator == "is_not_null":
        return this.isNotNull()

    kind = data_type(df, column)
    try:
        typed = typed_value(kind, value)
    except Exception as bad:
        raise ValueError(
            f"filter: {value!r} is not a valid value for {column!r} of type {kind.simpleString()}"
        ) from bad
    if operator in COMPARISONS:
        return COMPARISONS[operator](this, typed_literal(kind, typed))

    text = this if isinstance(kind, T.StringType) else this.cast("string")
    wanted = str(typed)
    if operator in ("contains", "not_contains"):
        found = text.contains(wanted) if literal else text.rlike(java_pattern(wanted))
        return found if operator == "contains" else ~found
    if operator == "starts_with":
        return text.startswith(wanted)
    if operator == "ends_with":
        return text.endswith(wanted)
    raise ValueError(f"filter: unsupported operator {operator!r}")


def filter_column(
    df: DataFrame,
    column: str = "",
    operator: str = "==",
    value: Any = "",
    literal: bool = False,
    persist: bool = False,
) -> Split:
    """Split by one column test; no column or a blank value keeps everything."""
    if not column:
        return keep_all(df)
    require_columns(df, [column], "filter")
    if operator not in NULL_TESTS and not str(value).strip():
        return keep_all(df)
    return filter_split(df, column_condition(df, column, operator, value, literal), persist)


def filter_text(df: DataFrame, expression: str = "", persist: bool = False) -> Split:
    """Split by a text predicate such as ``[Age] > 30 AND [Dept] CONTAINS "Sal"``."""
    if not expression.strip():
        return keep_all(df)
    return filter_split(df, F.expr(predicate(expression, df.schema)), persist)
