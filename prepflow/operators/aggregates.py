"""Grouped and global aggregation by a list of rules."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, functions as F

from prepflow.operators.joins import null_safe_join
from prepflow.operators.ordering import OrderBy, Place, place_of, required_order
from prepflow.operators.quantiles import (
    EVERYTHING,
    GROUP_LIMIT,
    exact_quantile,
    largest_group,
    selected_quantiles,
)
from prepflow.schema import MOMENT_TYPES, col, cols, data_type, name_list, require_columns

CONCAT_SEPARATOR = ", "


def count_unique(column: Column) -> Column:
    """Distinct values, null counting as one value."""
    return F.count_distinct(column) + F.coalesce(F.max(column.isNull().cast("bigint")), F.lit(0))


SIMPLE: dict[str, Callable[[Column], Column]] = {
    "sum": lambda c: F.coalesce(F.sum(c), F.lit(0)),
    "count": F.count,
    "count_unique": count_unique,
    "min": F.min,
    "max": F.max,
    "mean": F.avg,
    "std": F.stddev_samp,
    "var": F.var_samp,
}
APPROXIMATE: dict[str, Callable[[Column], Column]] = {
    "count_unique": lambda c: F.approx_count_distinct(c)
    + F.coalesce(F.max(c.isNull().cast("bigint")), F.lit(0)),
    "median": lambda c: F.percentile_approx(c, 0.5),
}
ORDERED = {"first", "last", "concat"}
GATHERING = {"median", "concat"}


def legacy_rules(
    group_by: str | Sequence[str], agg_column: str, agg_function: str, output_name: str
) -> list[dict[str, str]]:
    rules = [{"column": g, "action": "group_by"} for g in name_list(group_by)]
    if agg_column:
        rules.append({"column": agg_column, "action": agg_function, "output": output_name})
    return rules


def summarize(
    df: DataFrame,
    actions: Sequence[dict[str, str]] = (),
    group_by: str | Sequence[str] = (),
    agg_column: str = "",
    agg_function: str = "sum",
    output_name: str = "Aggregated",
    order_by: OrderBy | None = None,
    approx: bool = False,
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Aggregate by rules ``{column, action, output}``.

    ``group_by`` rules name the keys; other actions are sum, count,
    count_unique, min, max, mean, median, std, var, first, last and concat.
    Only keys give the distinct keys, no keys give one row, no rules give the
    table itself.  ``first``, ``last`` and ``concat`` need ``order_by``.

    Everything but median and concat combines before the shuffle.  These two
    gather a group; when some group has more than ``group_limit`` rows they are
    computed slice by slice instead.  ``approx`` trades exact distinct counts
    and medians for sketches.  The median of dates and timestamps is a timestamp.
    """
    rules = list(actions) or legacy_rules(group_by, agg_column, agg_function, output_name)
    if not rules:
        return df
    require_columns(df, [r.get("column") for r in rules], "summarize")
    steps = [(r["column"], (r.get("action") or "").lower(), r.get("output")) for r in rules]
    keys = list(dict.fromkeys(c for c, action, _ in steps if action == "group_by"))
    outputs = [(c, a, out or f"{a}_{c}") for c, a, out in steps if a != "group_by"]
    if not outputs:
        return df.select(*cols(keys)).distinct() if keys else df
    unknown = [a for _, a, _ in outputs if a not in SIMPLE and a not in ORDERED | GATHERING]
    if unknown:
        raise ValueError(f"summarize: unknown action {unknown[0]!r}")

    used = {a for _, a, _ in outputs}
    order: list = []
    if used & ORDERED:
        order = required_order(df, order_by, "summarize")
    gathering = [o for o in outputs if o[1] in GATHERING and not (approx and o[1] == "median")]
    apart = gathering if gathering and largest_group(df, keys) > group_limit else []

    moments = [n for c, a, n in outputs if a == "median" and isinstance(data_type(df, c), MOMENT_TYPES)]

    def dated(result: DataFrame) -> DataFrame:
        """Medians of moments are found in seconds and turned back."""
        back = {n: col(n).cast("timestamp").cast("timestamp_ntz") for n in moments}
        return result.withColumns(back) if back else result

    def number(column: str) -> Column:
        moment = isinstance(data_type(df, column), MOMENT_TYPES)
        return col(column).cast("timestamp").cast("double") if moment else col(column)

    def aggregate(column: str, action: str) -> Column:
        this = col(column)
        if action == "median":
            this = number(column)
        if approx and action in APPROXIMATE:
            return APPROXIMATE[action](this)
        if action in SIMPLE:
            return SIMPLE[action](this)
        if action == "median":
            return exact_quantile(this, 0.5)
        place = place_of(df, order, [column])
        if action in ("first", "last"):
            return place.pick(this, action == "first")
        return joined_text(place.key, this.cast("string"), place.down)

    together = [o for o in outputs if o not in apart]
    if not apart:
        return dated(df.groupBy(*cols(keys)).agg(*(aggregate(c, a).alias(n) for c, a, n in together)))

    group = keys or [EVERYTHING]
    source = df if keys else df.withColumn(EVERYTHING, F.lit(0))
    base = source.groupBy(*cols(group)).agg(
        F.count(F.lit(1)).alias("__rows"), *(aggregate(c, a).alias(n) for c, a, n in together)
    )
    frames = [base]
    for column, action, name in apart:
        if action == "median":
            part = selected_quantiles(source.withColumn("__number", number(column)), group, "__number", {name: 0.5})
            part = null_safe_join_left(base.select(*cols(group)), part, group)
        else:
            part = sliced_concat(source, group, column, place_of(df, order, [column]), name)
        frames.append(part)
    wide = null_safe_join(frames, group)
    return dated(wide.select(*cols(keys), *cols(n for _, _, n in outputs)))


def null_safe_join_left(base: DataFrame, part: DataFrame, keys: list[str]) -> DataFrame:
    """Keep the groups of ``base`` that ``part`` (values only) does not have."""
    marks = {k: f"__m{i}" for i, k in enumerate(keys)}
    renamed = part.withColumnsRenamed(marks)
    same = F.lit(True)
    for k, m in marks.items():
        same = same & col(k).eqNullSafe(F.col(m))
    return base.join(renamed, same, "left").drop(*marks.values())


def joined_text(place: Column, text: Column, down: bool = False) -> Column:
    """Aggregate: texts joined in the order of ``place``, nulls left out."""
    items = F.array_sort(F.collect_list(F.struct(place.alias("o"), text.alias("v"))))
    texts = F.transform(items, lambda x: x["v"])
    return F.array_join(F.reverse(texts) if down else texts, CONCAT_SEPARATOR)


def sliced_concat(df: DataFrame, keys: list[str], column: str, place: Place, name: str) -> DataFrame:
    """Ordered text of large groups: joined per sorted slice, then slice by slice.

    The slices follow the range shuffle, so each holds a run of one group; the
    last step only gathers the finished pieces, one per group and slice.
    """
    ready = df.select(
        *cols(keys), place.key.alias("__o"), col(column).cast("string").alias("__v")
    )
    sliced = ready.repartitionByRange(*cols(keys), F.col("__o")).withColumn(
        "__part", F.spark_partition_id()
    )
    pieces = sliced.groupBy(*cols(keys), "__part").agg(
        F.when(F.count("__v") > 0, joined_text(F.col("__o"), F.col("__v"), place.down)).alias("__text")
    )
    whole = joined_text(F.col("__part"), F.col("__text"), place.down)
    return pieces.groupBy(*cols(keys)).agg(whole.alias(name))
