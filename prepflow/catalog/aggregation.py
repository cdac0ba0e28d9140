"""Summaries, pivots and unpivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prepflow.catalog import query, table
from prepflow.operators.aggregates import summarize
from prepflow.operators.filters import filter_column
from prepflow.operators.joins import join_tables
from prepflow.operators.ordering import sort_rows
from prepflow.operators.columns import select_columns
from prepflow.operators.reshape import pivot_wide, unpivot_long

LINE_ORDER = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
LINE_ORDER_SQL = ", ".join(LINE_ORDER)


def rules(keys: list[str], *actions: tuple[str, str, str]) -> list[dict[str, str]]:
    return [{"column": k, "action": "group_by"} for k in keys] + [
        {"column": c, "action": a, "output": o} for c, a, o in actions
    ]


@query(
    "segment_revenue",
    """
    SELECT c_mktsegment AS segment, round(sum(l_extendedprice), 2) AS revenue
    FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
    WHERE o_totalprice > 100000 GROUP BY c_mktsegment
    """,
)
def segment_revenue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Revenue per market segment over orders above a price: filter, join, summarize, sort, select."""
    orders = filter_column(table(spark, sf_dir, "orders"), "o_totalprice", ">", "100000")["true"]
    lines = join_tables(table(spark, sf_dir, "lineitem"), orders, "l_orderkey", "o_orderkey", "inner")
    lines = join_tables(lines, table(spark, sf_dir, "customer"), "o_custkey", "c_custkey", "inner")
    total = summarize(lines, rules(["c_mktsegment"], ("l_extendedprice", "sum", "revenue")))
    total = sort_rows(total, column="revenue", descending=True)
    out = select_columns(total, [{"name": "c_mktsegment", "rename": "segment"}, {"name": "revenue"}])
    return out.withColumn("revenue", F.round("revenue", 2))


@query("agg_group", "SELECT o_orderstatus, o_orderpriority, count(o_orderkey) AS n FROM orders GROUP BY 1, 2")
def agg_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["o_orderstatus", "o_orderpriority", "o_orderstatus"]
    return summarize(table(spark, sf_dir, "orders"), rules(keys, ("o_orderkey", "count", "n")))


@query("agg_global", "SELECT count(l_orderkey) AS \"count_l_orderkey\", min(l_shipdate) AS first_day, CAST(sum(l_linenumber) AS BIGINT) AS total FROM lineitem")
def agg_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    actions = rules([], ("l_orderkey", "count", ""), ("l_shipdate", "min", "first_day"), ("l_linenumber", "sum", "total"))
    return summarize(table(spark, sf_dir, "lineitem"), actions)


@query("agg_distinct_keys", "SELECT DISTINCT l_returnflag, l_linestatus FROM lineitem")
def agg_distinct_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(table(spark, sf_dir, "lineitem"), rules(["l_returnflag", "l_linestatus"]))


@query("agg_legacy", "SELECT user_id, round(sum(value), 2) AS total FROM events GROUP BY user_id")
def agg_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = summarize(
        table(spark, sf_dir, "events"), group_by="user_id", agg_column="value", output_name="total"
    )
    return df.withColumn("total", F.round("total", 2))


@query(
    "agg_sum",
    """
    SELECT o_custkey, coalesce(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 0)::DECIMAL(18, 2) AS spent
    FROM orders GROUP BY o_custkey
    """,
)
def agg_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "if(o_orderstatus = 'F', o_totalprice, null) AS paid"
    )
    df = summarize(df, rules(["o_custkey"], ("paid", "sum", "spent")))
    return df.withColumn("spent", F.col("spent").cast("decimal(18,2)"))


@query("agg_count", "SELECT o_custkey, count(nullif(o_orderstatus, 'P')) AS n FROM orders GROUP BY o_custkey")
def agg_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr("o_custkey", "nullif(o_orderstatus, 'P') AS s")
    return summarize(df, rules(["o_custkey"], ("s", "count", "n")))


@query(
    "agg_count_unique",
    """
    SELECT l_returnflag, count(DISTINCT l_partkey) AS parts,
           count(DISTINCT nullif(l_linestatus, 'O')) + max(CASE WHEN l_linestatus = 'O' THEN 1 ELSE 0 END) AS states
    FROM lineitem GROUP BY l_returnflag
    """,
)
def agg_count_unique(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_returnflag", "l_partkey", "nullif(l_linestatus, 'O') AS s"
    )
    return summarize(
        df, rules(["l_returnflag"], ("l_partkey", "count_unique", "parts"), ("s", "count_unique", "states"))
    )


@query("agg_min_max", "SELECT l_suppkey, min(l_shipdate) AS first_day, max(l_extendedprice) AS dearest, min(l_returnflag) AS flag FROM lineitem GROUP BY l_suppkey")
def agg_min_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(
        table(spark, sf_dir, "lineitem"),
        rules(
            ["l_suppkey"],
            ("l_shipdate", "min", "first_day"),
            ("l_extendedprice", "max", "dearest"),
            ("l_returnflag", "min", "flag"),
        ),
    )


@query("agg_mean", "SELECT p_brand, round(avg(p_retailprice), 6) AS price FROM part GROUP BY p_brand")
def agg_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = summarize(table(spark, sf_dir, "part"), rules(["p_brand"], ("p_retailprice", "mean", "price")))
    return df.withColumn("price", F.round("price", 6))


@query("agg_median", "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1, 2")
def agg_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = summarize(
        table(spark, sf_dir, "lineitem"),
        rules(["l_returnflag", "l_linestatus"], ("l_extendedprice", "median", "price")),
    )
    return df.withColumn("price", F.round("price", 4))


@query("agg_median_sliced", "SELECT l_returnflag, l_linestatus, round(median(l_extendedprice), 4) AS price FROM lineitem GROUP BY 1, 2")
def agg_median_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken when a group is too large for one aggregation buffer."""
    df = summarize(
        table(spark, sf_dir, "lineitem"),
        rules(["l_returnflag", "l_linestatus"], ("l_extendedprice", "median", "price")),
        group_limit=0,
    )
    return df.withColumn("price", F.round("price", 4))


@query("agg_median_date", "SELECT o_orderstatus, median(o_orderdate) AS middle FROM orders GROUP BY o_orderstatus")
def agg_median_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    return summarize(
        table(spark, sf_dir, "orders"), rules(["o_orderstatus"], ("o_orderdate", "median", "middle"))
    )


@query("agg_std", "SELECT c_mktsegment, round(stddev_samp(c_acctbal), 4) AS spread FROM customer GROUP BY c_mktsegment")
def agg_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = summarize(table(spark, sf_dir, "customer"), rules(["c_mktsegment"], ("c_acctbal", "std", "spread")))
    return df.withColumn("spread", F.round("spread", 4))


@query("agg_var", "SELECT o_custkey, round(var_samp(o_totalprice) / 1000000, 3) AS spread FROM orders GROUP BY o_custkey")
def agg_var(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = summarize(table(spark, sf_dir, "orders"), rules(["o_custkey"], ("o_totalprice", "var", "spread")))
    return df.withColumn("spread", F.round(F.col("spread") / 1000000, 3))


FIRST_SQL = """
SELECT o_custkey, status FROM (
  SELECT o_custkey, nullif(o_orderstatus, 'P') AS status,
         row_number() OVER (PARTITION BY o_custkey ORDER BY {order}) AS rn
  FROM orders
) WHERE rn = 1
"""


def status_at(spark: SparkSession, sf_dir: str, action: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "o_orderdate", "o_orderkey", "nullif(o_orderstatus, 'P') AS s"
    )
    return summarize(
        df, rules(["o_custkey"], ("s", action, "status")), order_by=["o_orderdate", "o_orderkey"]
    )


@query("agg_first", FIRST_SQL.format(order="o_orderdate, o_orderkey"))
def agg_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_at(spark, sf_dir, "first")


@query("agg_last", FIRST_SQL.format(order="o_orderdate DESC, o_orderkey DESC"))
def agg_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return status_at(spark, sf_dir, "last")


CONCAT_SQL = """
SELECT user_id, coalesce(string_agg(event_type, ', ' ORDER BY ts, event_id), '') AS path
FROM events GROUP BY user_id
"""


def event_paths(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    df = table(spark, sf_dir, "events").selectExpr(
        "user_id", "ts", "event_id", "event_type AS kind"
    )
    return summarize(df, rules(["user_id"], ("kind", "concat", "path")), order_by=["ts", "event_id"], **options)


@query("agg_concat", CONCAT_SQL)
def agg_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_paths(spark, sf_dir)


@query("agg_concat_sliced", CONCAT_SQL)
def agg_concat_sliced(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The way taken when a group is too large to be gathered at once."""
    return event_paths(spark, sf_dir, group_limit=0)


def pivot_sql(cell: str, flags: str = "NRA") -> str:
    cells = ", ".join(f"{cell.format(f=f)} AS \"{f}\"" for f in flags)
    return f"SELECT l_linestatus, l_linenumber, {cells} FROM lineitem GROUP BY 1, 2"


PIVOT_CELL = {
    "sum": "CAST(sum(l_quantity) FILTER (l_returnflag = '{f}') AS DOUBLE)",
    "mean": "round(avg(l_extendedprice) FILTER (l_returnflag = '{f}'), 6)",
    "count": "count(*) FILTER (l_returnflag = '{f}')",
    "min": "min(l_extendedprice) FILTER (l_returnflag = '{f}')",
    "max": "max(l_extendedprice) FILTER (l_returnflag = '{f}')",
    "first": "arg_min(l_quantity, row(" + LINE_ORDER_SQL + ")) FILTER (l_returnflag = '{f}')",
    "last": "arg_max(l_quantity, row(" + LINE_ORDER_SQL + ")) FILTER (l_returnflag = '{f}')",
}
PIVOT_VALUE = {"mean": "l_extendedprice", "min": "l_extendedprice", "max": "l_extendedprice"}


def register_pivot(aggregate: str) -> None:
    @query(f"pivot_{aggregate}", pivot_sql(PIVOT_CELL[aggregate]))
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = pivot_wide(
            table(spark, sf_dir, "lineitem"),
            ["l_linestatus", "l_linenumber"],
            "l_returnflag",
            PIVOT_VALUE.get(aggregate, "l_quantity"),
            aggregate,
            order_by=LINE_ORDER,
        )
        if aggregate == "mean":
            df = df.withColumns({f: F.round(f, 6) for f in "NRA"})
        return df


for name in PIVOT_CELL:
    register_pivot(name)


@query(
    "pivot_wide",
    """
    SELECT o_custkey,
           CAST(sum(o_totalprice) FILTER (o_orderstatus = 'F') AS DECIMAL(18, 2)) AS "F",
           CAST(sum(o_totalprice) FILTER (o_orderstatus = 'O') AS DECIMAL(18, 2)) AS "O",
           CAST(sum(o_totalprice) FILTER (o_orderstatus = 'P') AS DECIMAL(18, 2)) AS "null"
    FROM orders GROUP BY o_custkey
    """,
)
def pivot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_custkey", "nullif(o_orderstatus, 'P') AS s", "cast(o_totalprice AS decimal(12,2)) AS price"
    )
    wide = pivot_wide(df, ["o_custkey"], "s", "price", "sum")
    return wide.select("o_custkey", *(F.col(c).cast("decimal(18,2)").alias(c) for c in ("F", "O", "null")))


@query(
    "unpivot_long",
    """
    FROM (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_discount, nullif(l_tax, 0) AS l_tax FROM lineitem)
    UNPIVOT INCLUDE NULLS (rate FOR kind IN (l_discount, l_tax))
    """,
)
def unpivot_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_discount", "nullif(l_tax, 0) AS l_tax"
    )
    return unpivot_long(
        df, ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"], [], "kind", "rate"
    )


@query(
    "unpivot_mixed",
    """
    SELECT c_custkey, 'c_name' AS name, c_name AS value FROM customer
    UNION ALL SELECT c_custkey, 'c_nationkey', c_nationkey::VARCHAR FROM customer
    UNION ALL SELECT c_custkey, 'c_mktsegment', c_mktsegment FROM customer
    """,
)
def unpivot_mixed(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer")
    return unpivot_long(df, "c_custkey", ["c_name", "c_nationkey", "c_mktsegment"], "", "")
