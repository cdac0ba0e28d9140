"""Node types of a graph: each names an operator and its parameters with defaults."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from prepflow.functions.cleanse import cleanse
from prepflow.functions.datetimes import AUTO, PARSE, convert_datetime
from prepflow.operators import charts
from prepflow.operators.aggregates import summarize
from prepflow.operators.batches import map_model, python_transform
from prepflow.operators.columns import formula, regex_extract, select_columns
from prepflow.operators.filters import filter_column, filter_text
from prepflow.operators.joins import join_tables
from prepflow.operators.ordering import chunk_rows, record_id, sample_rows, sort_rows
from prepflow.operators.profile import browse
from prepflow.operators.reshape import pivot_wide, unpivot_long
from prepflow.operators.stack import union_tables, unique_rows
from prepflow.sources import jdbc
from prepflow.sources.files import read_any, read_remote
from prepflow.sources.media import image_table
from prepflow.sources.sinks import write_remote, write_table

Inputs = dict[str, DataFrame | list[DataFrame]]
Result = DataFrame | dict[str, DataFrame]
Run = Callable[[SparkSession, Inputs, dict[str, Any]], Result]


@dataclass(frozen=True)
class Operator:
    """A node type: how to run it, and every parameter with its default."""

    run: Run
    defaults: dict[str, Any] = field(default_factory=dict)
    needs_input: bool = True


OPERATORS: dict[str, Operator] = {}


def register(name: str, run: Run, needs_input: bool = True, **defaults: Any) -> None:
    """Add a node type; an existing one of that name is replaced."""
    OPERATORS[name] = Operator(run, defaults, needs_input)


def on_table(fn: Callable[..., Result], **names: str) -> Run:
    """Node over one input table; ``names`` maps node parameters to function parameters."""

    def run(spark: SparkSession, inputs: Inputs, params: dict[str, Any]) -> Result:
        return fn(only_input(inputs), **{names.get(k, k): v for k, v in params.items()})

    return run


def only_input(inputs: Inputs) -> DataFrame:
    table = inputs.get("input", next(iter(inputs.values()), None))
    if table is None:
        raise ValueError("no input table is connected")
    if isinstance(table, list):
        raise ValueError("more than one table is connected to a single-table port")
    return table


def run_filter(spark: SparkSession, inputs: Inputs, params: dict[str, Any]) -> Result:
    df = only_input(inputs)
    if params["filterType"] == "custom":
        return filter_text(df, params["customExpression"])
    return filter_column(df, params["column"], params["operator"], params["value"])


def run_join(spark: SparkSession, inputs: Inputs, params: dict[str, Any]) -> Result:
    ports = list(inputs.values())
    if len(ports) == 1 and isinstance(ports[0], list):
        ports = ports[0]
    if len(ports) < 2:
        raise ValueError("join needs two tables")
    left, right = inputs.get("left", ports[0]), inputs.get("right", ports[1])

    def keys(side: str):
        spellings = (f"{side}_keys", f"{side}_key", f"{side}_on")
        return next((params[s] for s in spellings if params.get(s)), [])

    return join_tables(left, right, keys("left"), keys("right"), params["how"],
                       suffix=params["suffix"], coalesce_keys=params["coalesce_keys"])


def run_union(spark: SparkSession, inputs: Inputs, params: dict[str, Any]) -> Result:
    tables = inputs.get("input", list(inputs.values()))
    return union_tables(tables, params["how"])


def run_chart(spark: SparkSession, inputs: Inputs, params: dict[str, Any]) -> Result:
    df = only_input(inputs)
    kind, x, y = params["chartType"], params["xAxis"], params["yAxis"]
    color = params["colorBy"] if params["colorBy"] in df.columns else None
    if not x or not y:
        raise ValueError("a chart needs an x and a y column")
    if kind in ("scatter", "line", "scatter_3d"):
        z = (df.columns[2] if len(df.columns) > 2 else x) if kind == "scatter_3d" else None
        chart = charts.points(df, x, y, color, z)
        return charts.with_axis_formats(chart, df, {x: x, y: y})
    if kind in ("bar", "funnel"):
        chart = charts.bar_totals(df, x, y, color)
        return charts.with_axis_formats(chart, df, {x: x, "total": y})
    if kind == "pie":
        return charts.pie_shares(df, x, y)
    if kind == "histogram":
        return charts.histogram(df, x, color=color)
    if kind == "box":
        return charts.box_stats(df, x, y, color)
    if kind == "heatmap":
        return charts.heatmap(df, x, y, z=color)
    if kind == "waterfall":
        return charts.waterfall(df, x, y)
    if kind == "sankey":
        return charts.sankey_links(df, x, y)
    raise ValueError(f"unknown chart {kind!r}")


def run_file_input(spark: SparkSession, inputs: Inputs, params: dict[str, Any]) -> Result:
    path, kind = params["filePath"], params["fileType"]
    options = {}
    if params["fileType"] == "csv" or path.lower().endswith(".csv"):
        options = {
            "delimiter": params["csvDelimiter"],
            "header": params["csvHeader"],
            "encoding": params["csvEncoding"],
            "multi_line": params["multi_line"],
            "same_columns": params["same_columns"],
            "schema": params["schema"],
        }
    return read_any(spark, path, kind, params["process_local"], **options)


def run_model(spark: SparkSession, inputs: Inputs, params: dict[str, Any]) -> Result:
    params = dict(params)
    model = params.pop("model")
    if model is None:
        raise ValueError("no model function is given")
    return map_model(only_input(inputs), model, **params)


def run_python(spark: SparkSession, inputs: Inputs, params: dict[str, Any]) -> Result:
    df = inputs.get("input")
    return python_transform(df, params["fn"])


register("fileInput", run_file_input, needs_input=False, filePath="", fileType="auto",
         process_local=True, csvDelimiter=",", csvHeader=True, csvEncoding="utf-8",
         multi_line=False, same_columns=False, schema=None)
register("databaseInput",
         lambda s, i, p: jdbc.read_query(s, p["db_uri"], p["query"], partition_column=p["partition_column"],
                                         bounds=p["bounds"], partitions=p["partitions"]),
         needs_input=False, db_uri="", query="", partition_column=None, bounds=None, partitions=None)
register("remote_in", lambda s, i, p: read_remote(s, p["bucket"], p["path"], p["file_format"]),
         needs_input=False, bucket="", path="", file_format="csv")
register("imageCaption", lambda s, i, p: image_table(s, p["imagePath"], p["captioner"]),
         needs_input=False, imagePath="", captioner=None)
register("fileOutput",
         lambda s, i, p: write_table(only_input(i), p["filePath"], p["outputFormat"],
                                     p["mode"], p["saveFile"]),
         filePath="", outputFormat="csv", mode="errorifexists", saveFile=False)
register("databaseOutput",
         lambda s, i, p: jdbc.write_table(only_input(i), p["db_uri"], p["table_name"], p["if_exists"]),
         db_uri="", table_name="", if_exists="append")
register("remote_out",
         lambda s, i, p: write_remote(only_input(i), p["bucket"], p["path"], p["file_format"], p["mode"]),
         bucket="", path="", file_format="csv", mode="errorifexists")

register("filter", run_filter, filterType="basic", customExpression="", column="",
         operator="==", value="")
register("sort", on_table(sort_rows), rules=[], column="", descending=False)
register("select", on_table(select_columns), columns=[])
register("formula", on_table(formula), output_column="NewColumn", expression="")
register("regex", on_table(regex_extract, outputColumns="output_columns"),
         column="", pattern="", outputColumns=[])
register("data_cleansing", on_table(cleanse), columns=[], replace_nulls_string=False,
         replace_nulls_numeric=False, trim_whitespace=False, remove_punctuation=False,
         remove_numbers=False, remove_letters=False, string_case="None")
register("datetime", on_table(convert_datetime), column="", action=PARSE, format=AUTO,
         custom_format="", output_column="", whole_column=False)
register("record_id", on_table(record_id), column_name="RecordID", starting_value=1, order_by=None,
         unique_order=False)
register("browse", on_table(browse))

register("join", run_join, left_keys=[], right_keys=[], left_key="", right_key="", left_on=[],
         right_on=[], how="inner", suffix="_right", coalesce_keys=False)
register("union", run_union, how="diagonal")
register("summarize", on_table(summarize), actions=[], group_by=[], agg_column="",
         agg_function="sum", output_name="Aggregated", order_by=None)
register("pivot", on_table(pivot_wide), index=[], columns="", values="",
         aggregate_function="sum", order_by=None, header_values=None, header_order_by=None)
register("unpivot", on_table(unpivot_long), id_vars=[], value_vars=[], variable_name="name",
         value_name="value")
register("unique", on_table(unique_rows), columns=[], keep="first", order_by=None)
register("sampling", on_table(sample_rows), sample_type="first", n_records=100, order_by=None,
         seed=None, unique_order=False)
register("chunk_rows", on_table(chunk_rows), chunk_size=10, columns_to_chunk=[],
         row_separator="\n", order_by=None, unique_order=False)
register("visualization", run_chart, chartType="scatter", xAxis="", yAxis="", colorBy="",
         barmode="group", title="")
register("python_code", run_python, needs_input=False, fn=None)
register("map_model", run_model, input_column="", output_column="AI_Response",
         prompt_template="Extract the sentiment from: {Input}", bypass_warning=False, model=None)

# Other node names a stored graph may use.
ALIASES = {
    "llm_chunker": "chunk_rows",
    "gemini_ai": "map_model",
    "gcs_in": "remote_in",
    "gcs_out": "remote_out",
}

# Other parameter names a stored graph may use.
PARAMETER_ALIASES = {
    "record_id": {"start_value": "starting_value"},
    "regex": {"regex_pattern": "pattern", "target_column": "column"},
}

# Settings of a node that are none of its operator's.
NODE_SETTINGS = {"isCached", "label"}


def find_operator(name: str) -> Operator:
    name = ALIASES.get(name, name)
    if name not in OPERATORS:
        raise ValueError(f"unknown node type: {name}")
    return OPERATORS[name]
