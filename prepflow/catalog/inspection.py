"""Profiles, chart tables, user functions, graphs and streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from prepflow.catalog import query, table
from prepflow.functions.cleanse import cleanse
from prepflow.operators import charts
from prepflow.operators.batches import map_batches, map_model, python_transform
from prepflow.operators.columns import formula, regex_extract
from prepflow.operators.filters import filter_text
from prepflow.operators.joins import join_tables
from prepflow.operators.profile import browse, column_profile, preview
from prepflow.plans.graph import cache_table, run_graph
from prepflow.schema import SEMANTIC_KEY, carry_tags, semantic_types
from prepflow.session import scratch_path
from prepflow.sources.infer import semantic_profile_cast
from prepflow.streaming.stateless import write_available


@query("browse", "SELECT * FROM nation")
def browse_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return browse(table(spark, sf_dir, "nation"))


def profile_sql(columns: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"""
        SELECT '{c}' AS "column", '{kind}' AS type, NULL::VARCHAR AS semantic_type, count({c}) AS non_null,
               count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values,
               min({c})::VARCHAR AS min_value, max({c})::VARCHAR AS max_value
        FROM (SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'P') AS o_orderstatus, o_orderdate, o_orderpriority
              FROM orders)
        """
        for c, kind in columns.items()
    )


PROFILED = {
    "o_orderkey": "bigint",
    "o_custkey": "bigint",
    "o_orderstatus": "string",
    "o_orderdate": "timestamp_ntz",
    "o_orderpriority": "string",
}


@query("column_profile", profile_sql(PROFILED))
def column_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("o_orderstatus", F.expr("nullif(o_orderstatus, 'P')"))
    return column_profile(orders.select(*PROFILED))


@query("preview_sorted", "SELECT * FROM orders ORDER BY o_totalprice DESC LIMIT 1000")
def preview_sorted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return preview(table(spark, sf_dir, "orders"), column="o_totalprice", descending=True).rows


@query(
    "chart_sankey_links",
    """
    WITH links AS (
      SELECT c_mktsegment AS source, n_name AS target, count(*) AS value
      FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2
    ), labels AS (
      SELECT label, row_number() OVER (ORDER BY label) - 1 AS id
      FROM (SELECT source AS label FROM links UNION SELECT target FROM links)
    )
    SELECT source, target, value, s.id AS source_id, t.id AS target_id
    FROM links JOIN labels s ON source = s.label JOIN labels t ON target = t.label
    """,
)
def sankey_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    flows = join_tables(
        table(spark, sf_dir, "customer"), table(spark, sf_dir, "nation"), "c_nationkey", "n_nationkey", "inner"
    )
    return charts.sankey_links(flows, "c_mktsegment", "n_name")


@query(
    "chart_histogram",
    """
    WITH span AS (SELECT min(l_quantity) AS lo, (max(l_quantity) - min(l_quantity)) / 20 AS width FROM lineitem),
    binned AS (
      SELECT least(floor((l_quantity - lo) / width), 19)::BIGINT AS bin, l_returnflag, lo, width FROM lineitem, span
    )
    SELECT bin, round(lo + bin * width, 6) AS bin_start, round(lo + (bin + 1) * width, 6) AS bin_end,
           l_returnflag, count(*) AS rows
    FROM binned GROUP BY bin, lo, width, l_returnflag
    """,
)
def histogram_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = charts.histogram(table(spark, sf_dir, "lineitem"), "l_quantity", 20, "l_returnflag")
    return df.withColumns({c: F.round(c, 6) for c in ("bin_start", "bin_end")})


BOX_SQL = """
WITH q AS (
  SELECT l_returnflag, quantile_cont(l_extendedprice, 0.25) AS q1, quantile_cont(l_extendedprice, 0.5) AS median,
         quantile_cont(l_extendedprice, 0.75) AS q3
  FROM lineitem GROUP BY l_returnflag
)
SELECT l_returnflag, count(*) AS n, min(l_extendedprice) AS lowest,
       min(l_extendedprice) FILTER (l_extendedprice >= q1 - 1.5 * (q3 - q1)) AS lower_whisker,
       round(q1, 4) AS q1, round(median, 4) AS median, round(q3, 4) AS q3,
       max(l_extendedprice) FILTER (l_extendedprice <= q3 + 1.5 * (q3 - q1)) AS upper_whisker,
       max(l_extendedprice) AS highest
FROM lineitem JOIN q USING (l_returnflag) GROUP BY l_returnflag, q1, median, q3
"""


def box_table(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    df = charts.box_stats(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_extendedprice", **options)
    return df.withColumns({c: F.round(c, 4) for c in ("q1", "median", "q3")})


@query("chart_box_stats", BOX_SQL)
def box_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return box_table(spark, sf_dir)


@query("chart_box_stats_sliced", BOX_SQL)
def box_sliced_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken when a group is too large for one aggregation buffer."""
    return box_table(spark, sf_dir, group_limit=0)


@query(
    "chart_heatmap",
    """
    WITH span AS (
      SELECT min(l_quantity) AS x0, (max(l_quantity) - min(l_quantity)) / 10 AS xw,
             min(l_linenumber) AS y0, (max(l_linenumber) - min(l_linenumber)) / 3 AS yw FROM lineitem
    )
    SELECT least(floor((l_quantity - x0) / xw), 9)::BIGINT AS x_bin,
           least(floor((l_linenumber - y0) / yw), 2)::BIGINT AS y_bin,
           round(sum(l_extendedprice), 2) AS density
    FROM lineitem, span GROUP BY 1, 2
    """,
)
def heatmap_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = charts.heatmap(table(spark, sf_dir, "lineitem"), "l_quantity", "l_linenumber", 10, 3, "l_extendedprice")
    return df.withColumn("density", F.round("density", 2))


@query(
    "chart_histogram_date",
    """
    WITH ends AS (SELECT min(epoch(o_orderdate)) AS low, max(epoch(o_orderdate)) AS high FROM orders)
    SELECT CAST(least(floor((epoch(o_orderdate) - low) / ((high - low) / 12.0)), 11) AS BIGINT) AS bin, count(*) AS rows
    FROM orders, ends GROUP BY 1
    """,
)
def histogram_date_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.histogram(table(spark, sf_dir, "orders"), "o_orderdate", 12).select("bin", "rows")


@query("chart_heatmap_text", "SELECT o_orderpriority AS x_bin, o_orderstatus AS y_bin, count(*) AS density FROM orders GROUP BY 1, 2")
def heatmap_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.heatmap(table(spark, sf_dir, "orders"), "o_orderpriority", "o_orderstatus")


@query("chart_bar_totals", "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS total FROM lineitem GROUP BY 1, 2")
def bar_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.bar_totals(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "l_linestatus")


@query(
    "chart_pie_shares",
    """
    SELECT l_suppkey, sum(l_quantity) AS total,
           round(sum(l_quantity) / (SELECT sum(l_quantity) FROM lineitem), 8) AS share
    FROM lineitem GROUP BY l_suppkey
    """,
)
def pie_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = charts.pie_shares(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity")
    return df.withColumn("share", F.round("share", 8))


@query(
    "chart_waterfall",
    """
    WITH steps AS (SELECT l_shipdate, sum(l_quantity) AS step FROM lineitem GROUP BY l_shipdate)
    SELECT l_shipdate, step, sum(step) OVER w - step AS step_start, sum(step) OVER w AS step_end
    FROM steps WINDOW w AS (ORDER BY l_shipdate ROWS UNBOUNDED PRECEDING)
    """,
)
def waterfall_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.waterfall(table(spark, sf_dir, "lineitem"), "l_shipdate", "l_quantity")


@query("chart_points", "SELECT l_quantity, l_extendedprice, l_discount, l_returnflag FROM lineitem")
def points_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return charts.points(
        table(spark, sf_dir, "lineitem"), "l_quantity", "l_extendedprice", "l_returnflag", "l_discount"
    )


@query("semantic_axis_format", "SELECT c_mktsegment, round(sum(c_nationkey / 100.0), 2) AS total, '.0%' AS axis FROM customer GROUP BY c_mktsegment")
def axis_format_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.concat(F.col("c_nationkey").cast("string"), F.lit("%")).alias("share")
    typed = semantic_profile_cast(table(spark, sf_dir, "customer").select("c_mktsegment", share))
    bars = charts.bar_totals(typed, "c_mktsegment", "share")
    bars = charts.with_axis_formats(bars, typed, {"total": "share"})
    axis = bars.schema["total"].metadata.get("format", "")
    return bars.select("c_mktsegment", F.round("total", 2).alias("total"), F.lit(axis).alias("axis"))


@query("python_transform", "SELECT l_orderkey, sum(l_quantity) AS quantity FROM lineitem GROUP BY l_orderkey")
def python_transform_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def per_order(df: DataFrame) -> DataFrame:
        return df.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("quantity"))

    return python_transform(table(spark, sf_dir, "lineitem"), per_order)


@query("map_batches", "SELECT event_id, value * 2 AS doubled FROM events")
def map_batches_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def double(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"event_id": batch["event_id"], "doubled": batch["value"] * 2})

    events = table(spark, sf_dir, "events").select("event_id", "value")
    return map_batches(events, double, "event_id bigint, doubled double")


@query("map_model", "SELECT conv_id, turn, reverse('Say: ' || role) AS answer FROM conversations")
def map_model_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    def backwards(prompts: list[str]) -> list[str]:
        return [p[::-1] for p in prompts]

    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return map_model(df, backwards, "role", "answer", "Say: {Input}", bypass_warning=True).drop("role")


GRAPH = {
    "nodes": [
        {"id": "box", "type": "container", "data": {"enabled": False}},
        {"id": "orders", "type": "fileInput", "parameters": {"filePath": "{sf_dir}/orders.parquet"}},
        {"id": "off", "type": "browse", "parentId": "box"},
        {"id": "dear", "type": "filter", "parameters": {"column": "o_totalprice", "operator": ">", "value": "200000"}},
        {"id": "mark", "type": "formula",
         "parameters": {"output_column": "kind", "expression": "'big ' + [o_orderstatus]"}},
        {"id": "rest", "type": "formula",
         "parameters": {"output_column": "kind", "expression": "'small ' + [o_orderstatus]"}},
        {"id": "all", "type": "union"},
        {"id": "count", "type": "summarize",
         "parameters": {"actions": [{"column": "kind", "action": "group_by"},
                                    {"column": "o_orderkey", "action": "count", "output": "n"}]}},
        {"id": "sorted", "type": "sort", "parameters": {"rules": [{"column": "n", "order": "desc"}]}},
    ],
    "edges": [
        {"source": "orders", "target": "dear"},
        {"source": "orders", "target": "off"},
        {"source": "dear", "target": "mark", "sourcePort": "output"},
        {"source": "dear", "target": "rest", "sourcePort": "false"},
        {"source": "mark", "target": "all"},
        {"source": "rest", "target": "all"},
        {"source": "all", "target": "count"},
        {"source": "count", "target": "sorted"},
    ],
}


@query(
    "run_graph",
    """
    SELECT CASE WHEN o_totalprice > 200000 THEN 'big ' ELSE 'small ' END || o_orderstatus AS kind, count(*) AS n
    FROM orders GROUP BY 1
    """,
)
def run_graph_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    nodes = [dict(n) for n in GRAPH["nodes"]]
    nodes[1]["parameters"] = {"filePath": f"{sf_dir}/orders.parquet"}
    return run_graph(spark, {"nodes": nodes, "edges": GRAPH["edges"]}).table("sorted")


@query("cache_node", "SELECT p_brand, count(*) AS n FROM part GROUP BY p_brand")
def cache_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = table(spark, sf_dir, "part").groupBy("p_brand").agg(F.count(F.lit(1)).alias("n"))
    return cache_table(counted, reliable=True)


@query("semantic_propagation", "SELECT c_mktsegment, round(avg(c_acctbal), 4) AS balance, 'currency_usd' AS tag FROM customer GROUP BY c_mktsegment")
def semantic_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = table(spark, sf_dir, "customer").select(
        "c_mktsegment",
        F.regexp_replace(F.concat(F.lit("$"), F.format_number("c_acctbal", 2)), r"^\$-(.*)$", r"(\$$1)").alias("balance"),
    )
    typed = semantic_profile_cast(text)
    averaged = typed.groupBy("c_mktsegment").agg(F.round(F.avg("balance"), 4).alias("balance"))
    tagged = carry_tags(averaged, typed)
    return tagged.withColumn(
        "tag", F.lit(semantic_types(tagged).get("balance", f"no {SEMANTIC_KEY}"))
    )


STREAM_SQL = r"""
SELECT event_id, upper(event_type) AS event_type, value,
       TRY_CAST(regexp_extract(props, '(\d+)', 1) AS BIGINT) AS k, c_name,
       CASE WHEN value > 10 THEN 'high' ELSE 'low' END AS level
FROM events LEFT JOIN customer ON user_id = c_custkey WHERE event_type <> 'error'
"""


def stateless_steps(df: DataFrame, customer: DataFrame) -> DataFrame:
    df = filter_text(df, "[event_type] <> 'error'")["true"]
    df = regex_extract(df, "props", r"(\d+)", [{"name": "k", "type": "Int64"}])
    df = formula(df, "level", "IIF([value] > 10, 'high', 'low')")
    df = cleanse(df, ["event_type"], string_case="Uppercase")
    df = join_tables(df, customer, "user_id", "c_custkey", "left")
    return df.select("event_id", "event_type", "value", "k", "c_name", "level")


@query("stream_stateless", STREAM_SQL)
def stream_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = table(spark, sf_dir, "events").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_name")
    path = scratch_path(spark, "stream-out")
    write_available(stream, lambda df: stateless_steps(df, customer), path)
    return spark.read.parquet(path)
