"""The tables behind charts: what is drawn, computed where the data is."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prepflow.operators.joins import null_safe_join
from prepflow.operators.ordering import number_rows, running_total, sample_rows
from prepflow.operators.quantiles import GROUP_LIMIT, grouped_quantiles
from prepflow.schema import MOMENT_TYPES, col, cols, data_type, require_columns, semantic_types

# Axis format per semantic type.
AXIS_FORMATS = {"currency_usd": "$,.2f", "percentage": ".0%"}
WHISKER = 1.5


def axis_formats(df: DataFrame, *columns: str) -> dict[str, str]:
    """Axis format of each column whose semantic type has one."""
    tags = semantic_types(df)
    return {c: AXIS_FORMATS[tags[c]] for c in columns if tags.get(c) in AXIS_FORMATS}


def with_axis_formats(chart: DataFrame, source: DataFrame, names: dict[str, str]) -> DataFrame:
    """Keep the axis format of source columns as metadata of the chart's columns."""
    formats = axis_formats(source, *names.values())
    for name, origin in names.items():
        if origin in formats:
            metadata = dict(chart.schema[name].metadata or {}) | {"format": formats[origin]}
            chart = chart.withMetadata(name, metadata)
    return chart


def series(color: str | None) -> list[str]:
    return [color] if color else []


def points(df: DataFrame, x: str, y: str, color: str | None = None, z: str | None = None,
           n_records: int | None = None, seed: int | None = None) -> DataFrame:
    """Scatter, line and 3-D data: the drawn columns of every row, or of a random sample."""
    wanted = list(dict.fromkeys([x, y, *series(z), *series(color)]))
    require_columns(df, wanted, "chart")
    chosen = df.select(*cols(wanted))
    return sample_rows(chosen, "random", n_records, seed=seed) if n_records else chosen


def bar_totals(df: DataFrame, x: str, y: str, color: str | None = None) -> DataFrame:
    """Total of y per x (and colour): bars, stacks and funnels."""
    keys = [x, *series(color)]
    require_columns(df, [*keys, y], "chart")
    return df.groupBy(*cols(keys)).agg(F.coalesce(F.sum(col(y)), F.lit(0)).alias("total"))


def pie_shares(df: DataFrame, names: str, values: str) -> DataFrame:
    """Total per name and its share of the whole; shares are null when the whole is 0."""
    totals = bar_totals(df, names, values)
    whole = df.agg(F.sum(col(values)).cast("double")).scalar()
    return totals.withColumn("share", F.try_divide(F.col("total").cast("double"), whole))


def on_axis(df: DataFrame, x: str, value: Column) -> Column:
    """A value as a number: dates and timestamps as seconds."""
    if isinstance(data_type(df, x), MOMENT_TYPES):
        return value.cast("timestamp").cast("double")
    return value.cast("double")


def off_axis(df: DataFrame, x: str, value: Column) -> Column:
    """An edge in the type of the axis: timestamps for dates and timestamps."""
    if isinstance(data_type(df, x), MOMENT_TYPES):
        return value.cast("timestamp").cast("timestamp_ntz")
    return value


def is_text(df: DataFrame, x: str) -> bool:
    return isinstance(data_type(df, x), T.StringType)


def bins(df: DataFrame, x: str, count: int) -> tuple[Column, Column, Column]:
    """Bin number, lower edge and width of equal bins between the smallest and largest x."""
    lowest = df.agg(on_axis(df, x, F.min(col(x)))).scalar()
    highest = df.agg(on_axis(df, x, F.max(col(x)))).scalar()
    width = (highest - lowest) / F.lit(float(count))
    place = F.floor(F.try_divide(on_axis(df, x, col(x)) - lowest, width))
    number = F.least(F.coalesce(place, F.lit(0)).cast("bigint"), F.lit(count - 1).cast("bigint"))
    return number, lowest, width


def histogram(df: DataFrame, x: str, bin_count: int = 20, color: str | None = None) -> DataFrame:
    """Rows per equal-width bin of x (and colour); empty bins are absent, nulls left out.

    Dates and timestamps have timestamps as edges; of texts, each value is a bin of its own.
    """
    require_columns(df, [x, *series(color)], "chart")
    if is_text(df, x):
        values = df.filter(col(x).isNotNull()).select(col(x).alias("bin"), *cols(series(color)))
        counted = values.groupBy("bin", *cols(series(color))).agg(F.count(F.lit(1)).alias("rows"))
        edges = [F.col("bin").alias("bin_start"), F.col("bin").alias("bin_end")]
        return counted.select("bin", *edges, *cols(series(color)), "rows")
    number, lowest, width = bins(df, x, bin_count)
    binned = df.filter(col(x).isNotNull()).select(number.alias("bin"), *cols(series(color)))
    counted = binned.groupBy("bin", *cols(series(color))).agg(F.count(F.lit(1)).alias("rows"))
    return counted.select(
        "bin",
        off_axis(df, x, lowest + F.col("bin") * width).alias("bin_start"),
        off_axis(df, x, lowest + (F.col("bin") + 1) * width).alias("bin_end"),
        *cols(series(color)),
        "rows",
    )


def heatmap(df: DataFrame, x: str, y: str, x_bins: int = 20, y_bins: int = 20,
            z: str | None = None) -> DataFrame:
    """Rows, or the total of z, per cell of a grid over x and y; of texts, each value is a bin of its own."""
    require_columns(df, [x, y, *series(z)], "chart")
    x_bin = col(x) if is_text(df, x) else bins(df, x, x_bins)[0]
    y_bin = col(y) if is_text(df, y) else bins(df, y, y_bins)[0]
    measure = F.coalesce(F.sum(col(z)), F.lit(0)) if z else F.count(F.lit(1))
    cells = df.filter(col(x).isNotNull() & col(y).isNotNull()).select(
        x_bin.alias("x_bin"), y_bin.alias("y_bin"), *cols(series(z))
    )
    return cells.groupBy("x_bin", "y_bin").agg(measure.alias("density"))


def box_stats(df: DataFrame, x: str, y: str, color: str | None = None,
              group_limit: int = GROUP_LIMIT) -> DataFrame:
    """Quartiles, extremes and whiskers of y per x (and colour).

    Whiskers are the outermost values within 1.5 interquartile ranges of the box.
    """
    keys = list(dict.fromkeys([x, *series(color)]))
    require_columns(df, [*keys, y], "chart")
    values = df.select(*cols(keys), col(y).cast("double").alias("__y")).filter("__y is not null")
    quartiles = grouped_quantiles(
        values, keys, "__y", {"q1": 0.25, "median": 0.5, "q3": 0.75}, group_limit
    )
    reach = WHISKER * (F.col("q3") - F.col("q1"))
    inside = F.when(F.col("__y").between(F.col("q1") - reach, F.col("q3") + reach), F.col("__y"))
    fenced = null_safe_join([values, quartiles], keys)
    return fenced.groupBy(*cols(keys)).agg(
        F.count(F.lit(1)).alias("n"),
        F.min("__y").alias("lowest"),
        F.min(inside).alias("lower_whisker"),
        F.first("q1").alias("q1"),
        F.first("median").alias("median"),
        F.first("q3").alias("q3"),
        F.max(inside).alias("upper_whisker"),
        F.max("__y").alias("highest"),
    )


def waterfall(df: DataFrame, x: str, y: str) -> DataFrame:
    """Steps of y in the order of x, with the running total before and after each step."""
    steps = bar_totals(df, x, y).withColumnRenamed("total", "step")
    totals = running_total(steps, "step", [x], "step_end", unique_order=True, before="step_start")
    return totals.select(col(x), "step", "step_start", "step_end")


def sankey_links(df: DataFrame, source: str, target: str) -> DataFrame:
    """Rows per (source, target), with numbers for the sorted union of all labels."""
    require_columns(df, [source, target], "chart")
    links = (
        df.select(col(source).cast("string").alias("source"), col(target).cast("string").alias("target"))
        .filter("source is not null and target is not null")
        .groupBy("source", "target")
        .agg(F.count(F.lit(1)).alias("value"))
    )
    ids = number_labels(links)
    sources = ids.withColumnsRenamed({"label": "source", "id": "source_id"})
    targets = ids.withColumnsRenamed({"label": "target", "id": "target_id"})
    return links.join(sources, "source").join(targets, "target").select(
        "source", "target", "value", "source_id", "target_id"
    )


def number_labels(links: DataFrame) -> DataFrame:
    labels = links.select(F.explode(F.array("source", "target")).alias("label")).distinct()
    return number_rows(labels, ["label"], "id", unique_order=True)
