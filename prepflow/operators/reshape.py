"""Long to wide and wide to long."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prepflow.operators.ordering import OrderBy, place_of, required_order
from prepflow.schema import (
    FLOAT_TYPES,
    INTEGER_TYPES,
    col,
    cols,
    data_type,
    name_list,
    require_batch,
    require_columns,
)

CELLS: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "mean": F.avg,
    "count": lambda c: F.count(F.lit(1)),
    "min": F.min,
    "max": F.max,
}
MAX_HEADERS = "spark.sql.pivotMaxValues"


def pivot_wide(
    df: DataFrame,
    index: Sequence[str] | str = (),
    columns: str = "",
    values: str = "",
    aggregate_function: str = "sum",
    header_values: Sequence[str] | None = None,
    order_by: OrderBy | None = None,
    header_order_by: str | None = None,
) -> DataFrame:
    """One row per index, one column per value of ``columns``; missing cells are null.

    ``count`` counts rows; ``first`` and ``last`` need ``order_by``.  The header
    values are looked up by one job unless ``header_values`` is given, and are
    sorted by name or by the smallest ``header_order_by``.  An incomplete
    request leaves the table unchanged.
    """
    keys = name_list(index)
    if not keys or not columns or not values:
        return df
    require_columns(df, [*keys, columns, values], "pivot")
    require_batch(df, "pivot")
    header = F.coalesce(col(columns).cast("string"), F.lit("null"))
    if header_values is None:
        header_values = find_headers(df, col(columns).cast("string"), header_order_by)

    if aggregate_function in ("first", "last"):
        order = required_order(df, order_by, "pivot")
        place = place_of(df, order, [values])
        cell = place.pick(col(values), aggregate_function == "first")
    elif aggregate_function in CELLS:
        cell = CELLS[aggregate_function](col(values))
    else:
        raise ValueError(f"pivot: unknown aggregate {aggregate_function!r}")
    cells = df.groupBy(*cols(keys), header.alias("__header")).agg(cell.alias("__cell"))
    return cells.groupBy(*cols(keys)).pivot("__header", list(header_values)).agg(F.first("__cell"))


def find_headers(df: DataFrame, header: Column, order: str | None) -> list[str]:
    """Distinct header texts; more than Spark's pivot limit is an error, as in Spark."""
    limit = int(df.sparkSession.conf.get(MAX_HEADERS, "10000"))
    place = F.min(col(order)) if order else F.lit(0)
    found = df.groupBy(header.alias("h")).agg(place.alias("p")).orderBy("p", "h")
    rows = found.limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"pivot: more than {limit} header values ({MAX_HEADERS})")
    names = [r["h"] for r in rows]
    if None in names and "null" in names:
        raise ValueError("pivot: the header column holds both null and the text 'null'")
    return ["null" if n is None else n for n in names]


def common_type(kinds: list[T.DataType]) -> T.DataType:
    """The one type of all, else bigint or double for numbers, else string."""
    if len({k.simpleString() for k in kinds}) == 1:
        return kinds[0]
    if all(isinstance(k, INTEGER_TYPES) for k in kinds):
        return T.LongType()
    if all(isinstance(k, INTEGER_TYPES + FLOAT_TYPES) for k in kinds):
        return T.DoubleType()
    return T.StringType()


def unpivot_long(
    df: DataFrame,
    id_vars: Sequence[str] | str = (),
    value_vars: Sequence[str] | str = (),
    variable_name: str = "name",
    value_name: str = "value",
) -> DataFrame:
    """Id columns repeated, the other (or chosen) columns as name and value; nulls are kept."""
    ids = name_list(id_vars)
    values = name_list(value_vars) or [c for c in df.columns if c not in ids]
    require_columns(df, [*ids, *values], "unpivot")
    if not values:
        raise ValueError("unpivot: no value columns")
    kind = common_type([data_type(df, v) for v in values])
    same = {v: col(v).cast(kind) for v in values if data_type(df, v) != kind}
    clash = [v for v in values if v in ids]
    if clash:
        raise ValueError(f"unpivot: {clash} cannot be id and value at once")
    if same:
        df = df.withColumns(same)
    return df.unpivot(cols(ids), cols(values), variable_name or "name", value_name or "value")
