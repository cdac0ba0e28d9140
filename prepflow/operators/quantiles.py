"""Exact quantiles per group without holding a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from prepflow.operators.joins import null_safe_join
from prepflow.operators.ordering import POSITION, SLICE, sorted_slices
from prepflow.schema import col, cols

# Groups up to this many rows may be gathered by one aggregation buffer.
GROUP_LIMIT = 500_000

EVERYTHING = "__all"


def largest_group(df: DataFrame, keys: Sequence[str]) -> int:
    """Rows of the largest group; a partial count per task, one number to the driver."""
    counts = df.groupBy(*cols(keys)).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.max("n")).first()[0] or 0


def gathered_quantiles(value: Column, probabilities: Sequence[float]) -> Column:
    """Interpolated quantiles, as an array, of a group that is known to be small.

    Sorting a plain list of the values is several times faster than Spark's
    percentile, which keeps a hash map of counts.
    """
    values = F.sort_array(F.collect_list(value.cast("double")))

    def quantile(sorted_values: Column, probability: float) -> Column:
        place = (F.size(sorted_values) - 1) * F.lit(float(probability))
        low, high = F.floor(place), F.ceil(place)
        below = F.get(sorted_values, low.cast("int"))
        above = F.get(sorted_values, high.cast("int"))
        between = (high - place) * below + (place - low) * above
        return F.when(low == high, below).otherwise(between)

    # The one-element array binds the sorted list to a name, so it is sorted once.
    bound = F.transform(F.array(values), lambda a: F.array(*(quantile(a, p) for p in probabilities)))
    return F.get(bound, F.lit(0))


def exact_quantile(value: Column, probability: float) -> Column:
    return F.get(gathered_quantiles(value, [probability]), F.lit(0))


def selected_quantiles(
    df: DataFrame, keys: Sequence[str], value: str, wanted: dict[str, float]
) -> DataFrame:
    """Interpolated quantiles by distributed selection, one row per group with values.

    Equal values are counted first.  The counts are written in slices sorted by
    key and value; from the slice totals follows which slice holds the rows a
    quantile lies between, and only those slices are looked at again.  However
    large a group is, a task sees one slice of it.
    """
    group = list(keys) or [EVERYTHING]
    source = df if keys else df.withColumn(EVERYTHING, F.lit(0))
    counted = (
        source.select(*cols(group), col(value).cast("double").alias("__v"))
        .filter(F.col("__v").isNotNull())
        .groupBy(*cols(group), "__v")
        .agg(F.count(F.lit(1)).alias("__n"))
    )
    slices = sorted_slices(counted, [*group, "__v"], unique_order=True)

    per_slice = slices.groupBy(*cols(group), SLICE).agg(F.sum("__n").alias("__m"))
    whole = Window.partitionBy(*cols(group))
    earlier = whole.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    placed = per_slice.select(
        *cols(group),
        SLICE,
        "__m",
        F.coalesce(F.sum("__m").over(earlier), F.lit(0)).alias("__before"),
        F.sum("__m").over(whole).alias("__total"),
    )
    places = {name: (F.col("__total") - 1) * F.lit(float(p)) for name, p in wanted.items()}
    ranks = [edge(place) for place in places.values() for edge in (F.floor, F.ceil)]
    in_slice = F.exists(
        F.array(*ranks), lambda r: (r >= F.col("__before")) & (r < F.col("__before") + F.col("__m"))
    )
    hit = placed.filter(in_slice).drop("__m")

    # Join and rank within (group, slice) only.
    near = null_safe_join([slices, hit], [*group, SLICE])
    within = Window.partitionBy(*cols(group), SLICE).orderBy(POSITION)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    ranked = near.withColumn("__end", F.col("__before") + F.sum("__n").over(upto))

    def at(rank: Column) -> Column:
        here = (rank >= F.col("__end") - F.col("__n")) & (rank < F.col("__end"))
        return F.max(F.when(here, F.col("__v")))

    out = []
    for name, place in places.items():
        low, high = at(F.floor(place)), at(F.ceil(place))
        to_low, to_high = F.max(F.ceil(place) - place), F.max(place - F.floor(place))
        between = to_low * low + to_high * high
        out.append(F.when(low == high, low).otherwise(between).alias(name))
    result = ranked.groupBy(*cols(group)).agg(*out)
    return result if keys else result.drop(EVERYTHING)


def grouped_quantiles(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    wanted: dict[str, float],
    group_limit: int = GROUP_LIMIT,
) -> DataFrame:
    """Interpolated quantiles per group, by aggregation where every group is small."""
    if largest_group(df, keys) > group_limit:
        return selected_quantiles(df, keys, value, wanted)
    present = df.filter(col(value).isNotNull())
    points = gathered_quantiles(col(value), list(wanted.values()))
    found = present.groupBy(*cols(keys)).agg(points.alias("__q"))
    return found.select(*cols(keys), *(F.col("__q")[i].alias(n) for i, n in enumerate(wanted)))
