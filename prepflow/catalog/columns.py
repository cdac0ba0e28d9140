"""Select, formula, regular expressions, cleansing, dates, filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from prepflow.catalog import query, table
from prepflow.functions.cleanse import cleanse
from prepflow.functions.datetimes import CUSTOM, FORMAT, convert_datetime
from prepflow.operators.columns import formula, prompt_text, regex_extract, select_columns
from prepflow.operators.filters import filter_column, filter_text
from prepflow.operators.ordering import record_id

EVENT_ORDER = ["ts", "event_id"]


@query("select_columns", "SELECT o_orderdate, o_orderkey, o_totalprice FROM orders")
def select_columns_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_columns(
        table(spark, sf_dir, "orders"),
        [
            {"name": "o_orderkey", "order_index": 2},
            {"name": "o_custkey", "keep": False},
            {"name": "not_there"},
            {"name": "o_totalprice"},
            {"name": "o_orderdate", "order_index": 1},
        ],
    )


@query("select_nothing", "SELECT count(*) AS n FROM orders")
def select_nothing_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """No column is kept; the rows still count."""
    orders = table(spark, sf_dir, "orders")
    none = select_columns(orders, [{"name": c, "keep": False} for c in orders.columns])
    return none.agg(F.count(F.lit(1)).alias("n"))


@query("select_rename", "SELECT c_custkey AS id, c_name AS \"Customer Name\", c_acctbal FROM customer")
def select_rename_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return select_columns(
        table(spark, sf_dir, "customer"),
        [
            {"name": "c_custkey", "rename": "id"},
            {"name": "c_name", "rename": "Customer Name"},
            {"name": "c_acctbal", "rename": ""},
        ],
    )


@query(
    "select_cast",
    """
    SELECT l_orderkey, l_linenumber::VARCHAR AS line_text, TRY_CAST(l_returnflag AS BIGINT) AS flag_number,
           CAST(l_partkey AS DOUBLE) AS part_number, CAST(l_linenumber - 1 AS BOOLEAN) AS not_first,
           CAST(trunc(l_quantity) AS BIGINT) AS quantity
    FROM lineitem
    """,
)
def select_cast_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem").withColumn("before", F.col("l_linenumber") - 1)
    return select_columns(
        lines,
        [
            {"name": "l_orderkey"},
            {"name": "l_linenumber", "type": "String", "rename": "line_text"},
            {"name": "l_returnflag", "type": "Int64", "rename": "flag_number"},
            {"name": "l_partkey", "type": "Float64", "rename": "part_number"},
            {"name": "before", "type": "Boolean", "rename": "not_first"},
            {"name": "l_quantity", "type": "integer", "rename": "quantity"},
        ],
    )


@query("formula", "SELECT p_partkey, p_name, p_brand, p_type, p_size, round(p_retailprice * 1.1, 4) AS p_retailprice FROM part")
def formula_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formula(table(spark, sf_dir, "part"), "p_retailprice", "round([p_retailprice] * 1.1, 4)")


@query(
    "formula_arith",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey,
           l_extendedprice * (1 - l_discount) / l_quantity + l_linenumber % 2 AS unit
    FROM lineitem
    """,
)
def formula_arith_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "[l_extendedprice] * (1 - [l_discount]) / [l_quantity] + [l_linenumber] % 2"
    df = formula(table(spark, sf_dir, "lineitem"), "unit", text)
    return df.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "unit")


@query("formula_concat", "SELECT *, p_name || ' + ' || p_brand || ' / ' || p_size::VARCHAR AS label FROM part")
def formula_concat_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formula(
        table(spark, sf_dir, "part"), "label", '[p_name] + " + " + [p_brand] + \' / \' + ToString([p_size])'
    )


@query(
    "formula_iif",
    """
    SELECT o_orderkey,
           CASE WHEN nullif(o_orderstatus, 'P') = 'F' AND o_totalprice > 100000 THEN 'big'
                ELSE 'other' END AS size
    FROM orders
    """,
)
def formula_iif_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").withColumn("s", F.expr("nullif(o_orderstatus, 'P')"))
    return formula(
        orders, "size", 'IIF([s] == "F" AND [o_totalprice] > 100000, "big", "other")'
    ).select("o_orderkey", "size")


@query("formula_tostring", "SELECT n_nationkey, c_custkey, c_custkey::VARCHAR AS key_text FROM customer JOIN nation ON n_nationkey = c_nationkey")
def formula_tostring_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    customer = table(spark, sf_dir, "customer").withColumnRenamed("c_nationkey", "n_nationkey")
    return formula(customer, "key_text", "ToString([c_custkey])").select(
        "n_nationkey", "c_custkey", "key_text"
    )


@query("formula_tonumber", "SELECT s_suppkey, CAST(substr(s_name, 10) AS DOUBLE) AS number FROM supplier")
def formula_tonumber_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return formula(table(spark, sf_dir, "supplier"), "number", "ToNumber(substring([s_name], 10))").select(
        "s_suppkey", "number"
    )


@query(
    "formula_string_fn",
    "SELECT p_partkey, upper(p_name) || ' ' || CAST(length(p_type) AS VARCHAR) || replace(p_brand, '#', '-') AS code FROM part",
)
def formula_string_fn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "upper([p_name]) + ' ' + ToString(length([p_type])) + replace([p_brand], '#', '-')"
    return formula(table(spark, sf_dir, "part"), "code", text).select("p_partkey", "code")


@query(
    "formula_date_fn",
    """
    SELECT o_orderkey, CAST(year(o_orderdate) * 100 + month(o_orderdate) AS INTEGER) AS month_no,
           date_diff('day', DATE '1992-01-01', CAST(o_orderdate AS DATE))::INTEGER AS days
    FROM orders
    """,
)
def formula_date_fn_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = formula(table(spark, sf_dir, "orders"), "month_no", "year([o_orderdate]) * 100 + month([o_orderdate])")
    df = formula(df, "days", "datediff([o_orderdate], date'1992-01-01')")
    return df.select("o_orderkey", "month_no", "days")


@query(
    "formula_window",
    """
    SELECT event_id, user_id,
           CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS visit
    FROM events
    """,
)
def formula_window_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "row_number() OVER (PARTITION BY [user_id] ORDER BY [ts], [event_id])"
    return formula(table(spark, sf_dir, "events"), "visit", text).select("event_id", "user_id", "visit")


@query(
    "record_id",
    """
    SELECT row_number() OVER (ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_suppkey) + 99
             AS "RecordID", lineitem.*
    FROM lineitem
    """,
)
def record_id_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_shipdate", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
    lines = table(spark, sf_dir, "lineitem")
    return record_id(lines, starting_value=100, order_by=order, unique_order=True)


@query(
    "record_id_ties",
    """
    SELECT row_number() OVER (ORDER BY event_type) AS "RecordID", event_type FROM events
    """,
)
def record_id_ties_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return record_id(table(spark, sf_dir, "events").select("event_type"), order_by=["event_type"])


@query(
    "regex_extract",
    r"""
    SELECT event_id,
           CASE WHEN regexp_matches(props, '"(\w+)":\s*(\d+)')
                THEN regexp_extract(props, '"(\w+)":\s*(\d+)', 1) END AS key_name,
           TRY_CAST(CASE WHEN regexp_matches(props, '"(\w+)":\s*(\d+)')
                THEN regexp_extract(props, '"(\w+)":\s*(\d+)', 2) END AS BIGINT) AS number
    FROM events
    """,
)
def regex_extract_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regex_extract(
        table(spark, sf_dir, "events"),
        "props",
        r'"(?P<the_key>\w+)":\s*(?P<the_value>\d+)',
        [{"name": "key_name"}, {"name": "number", "type": "Int64"}],
    ).select("event_id", "key_name", "number")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "text")


@query("cleanse_nulls_string", "SELECT o_orderkey, coalesce(nullif(o_orderstatus, 'F'), '') AS status FROM orders")
def cleanse_nulls_string_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr("o_orderkey", "nullif(o_orderstatus, 'F') AS status")
    return cleanse(df, ["status"], replace_nulls_string=True)


@query("cleanse_nulls_numeric", "SELECT c_custkey, coalesce(nullif(c_nationkey, 3), 0) AS nation, CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END AS balance FROM customer")
def cleanse_nulls_numeric_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey", "nullif(c_nationkey, 3) AS nation", "if(c_acctbal < 0, null, c_acctbal) AS balance"
    )
    return cleanse(df, ["nation", "balance"], replace_nulls_numeric=True)


@query(
    "cleanse_trim",
    r"""
    SELECT conv_id, turn, regexp_replace(chr(9) || ' ' || text || chr(10) || ' ',
           '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g') AS text
    FROM conversations
    """,
)
def cleanse_trim_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", F.concat(F.lit("\t "), "text", F.lit("\n ")).alias("text")
    )
    return cleanse(df, ["text"], trim_whitespace=True)


@query(
    "cleanse_punctuation",
    r"SELECT doc_id, regexp_replace(text, '[^\p{L}\p{M}\p{N}_\t-\r\x{85}\p{Z}]', '', 'g') AS text FROM documents",
)
def cleanse_punctuation_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse(documents(spark, sf_dir), ["text"], remove_punctuation=True)


@query("cleanse_digits", r"SELECT doc_id, regexp_replace(text, '\p{Nd}+', '', 'g') AS text FROM documents")
def cleanse_digits_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse(documents(spark, sf_dir), ["text"], remove_numbers=True)


@query("cleanse_letters", "SELECT doc_id, regexp_replace(text, '[a-zA-Z]+', '', 'g') AS text FROM documents")
def cleanse_letters_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cleanse(documents(spark, sf_dir), ["text"], remove_letters=True)


@query("cleanse_case", "SELECT p_partkey, upper(p_name) AS p_name, p_brand FROM part UNION ALL SELECT p_partkey, p_name, lower(p_brand) FROM part")
def cleanse_case_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand")
    return cleanse(part, ["p_name"], string_case="Uppercase").union(
        cleanse(part, ["p_brand"], string_case="Lowercase")
    )


@query(
    "cleanse_titlecase",
    r"""
    SELECT conv_id, turn,
           list_aggregate(list_transform(regexp_extract_all(lower(text), '([\p{L}\p{N}]+|[^\p{L}\p{N}]+)'),
                                         lambda x: replace(replace(upper(x[1]), 'ß', 'SS'), 'ẞ', 'SS') || x[2:]), 'string_agg', '') AS text
    FROM conversations
    """,
)
def cleanse_titlecase_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").select("conv_id", "turn", "text")
    return cleanse(df, ["text"], string_case="Titlecase")


@query(
    "cleanse_chain",
    r"""
    WITH nulled AS (
      SELECT conv_id, coalesce(nullif(turn, 0), 0) AS turn,
             coalesce(text, '') AS text FROM conversations
    ), trimmed AS (
      SELECT conv_id, turn,
             regexp_replace(text, '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g') AS text FROM nulled
    )
    SELECT conv_id, turn, lower(regexp_replace(regexp_replace(
             text, '[^\p{L}\p{M}\p{N}_\t-\r\x{85}\p{Z}]', '', 'g'), '\p{Nd}+', '', 'g')) AS text
    FROM trimmed
    """,
)
def cleanse_chain_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "nullif(turn, 0) AS turn", "text"
    )
    return cleanse(
        df,
        ["text", "turn", "not_there"],
        replace_nulls_string=True,
        replace_nulls_numeric=True,
        trim_whitespace=True,
        remove_punctuation=True,
        remove_numbers=True,
        string_case="Lowercase",
    )


@query(
    "parse_datetime",
    """
    SELECT event_id, CASE WHEN event_type = 'click' THEN NULL ELSE date_trunc('second', ts) END AS at,
           CAST(CAST(ts AS DATE) AS TIMESTAMP) AS day
    FROM events
    """,
)
def parse_datetime_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "events").select(
        "event_id",
        F.when(F.col("event_type") == "click", F.lit("no date"))
        .otherwise(F.date_format("ts", "dd/MM/yyyy HH:mm:ss"))
        .alias("text"),
        F.date_format("ts", "MMM dd, yyyy").alias("day"),
    )
    df = convert_datetime(df, "text", format="dd/MM/yyyy HH:mm:ss", output_column="at")
    df = convert_datetime(df, "day", format=CUSTOM, custom_format="%b %d, %Y")
    return df.select("event_id", "at", "day")


@query(
    "parse_datetime_auto",
    """
    SELECT o_orderkey, CASE WHEN o_orderpriority = '5-LOW' THEN NULL ELSE o_orderdate END AS at FROM orders
    """,
)
def parse_datetime_auto_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    form = {
        "1-URGENT": "yyyy-MM-dd HH:mm:ss",
        "2-HIGH": "dd/MM/yyyy HH:mm:ss",
        "3-MEDIUM": "yyyy/MM/dd HH:mm",
        "4-NOT SPECIFIED": "yyyy-MM-dd'T'HH:mm:ss",
    }
    text = F.lit("unknown")
    for priority, pattern in form.items():
        text = F.when(F.col("o_orderpriority") == priority, F.date_format("o_orderdate", pattern)).otherwise(text)
    df = table(spark, sf_dir, "orders").select("o_orderkey", text.alias("text"))
    return convert_datetime(df, "text", output_column="at").drop("text")


@query(
    "format_datetime",
    """
    SELECT o_orderkey, strftime(o_orderdate, '%d/%m/%Y') AS day,
           strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS full_text, o_custkey::VARCHAR AS customer
    FROM orders
    """,
)
def format_datetime_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders")
    df = convert_datetime(df, "o_orderdate", FORMAT, "dd/MM/yyyy", output_column="day")
    df = convert_datetime(df, "o_orderdate", FORMAT, output_column="full_text")
    df = convert_datetime(df, "o_custkey", FORMAT, output_column="customer")
    return df.select("o_orderkey", "day", "full_text", "customer")


@query("parse_datetime_short", "SELECT o_orderkey, date_trunc('day', o_orderdate) AS day FROM orders")
def parse_datetime_short_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days and months of one digit or two."""
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "concat_ws('/', day(o_orderdate), month(o_orderdate), year(o_orderdate)) AS said"
    )
    df = convert_datetime(df, "said", format=CUSTOM, custom_format="%d/%m/%Y", output_column="day")
    return df.select("o_orderkey", "day")


@query(
    "prompt_template",
    """
    SELECT conv_id, turn, 'Sort: ' || coalesce(text, 'None') || ' [' || coalesce(text, 'None') || ']' AS prompt
    FROM conversations
    """,
)
def prompt_template_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "conversations").selectExpr(
        "conv_id", "turn", "text AS said"
    )
    return prompt_text(df, "said", "Sort: {Input} [{said}]", "prompt").drop("said")


# ---- filters ----------------------------------------------------------------


@query("filter_compare", "SELECT * FROM orders WHERE o_totalprice >= 250000 AND o_orderdate < TIMESTAMP '1996-06-01'")
def filter_compare_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    dear = filter_column(table(spark, sf_dir, "orders"), "o_totalprice", ">=", "250000")["true"]
    return filter_column(dear, "o_orderdate", "<", "1996-06-01T00:00:00")["true"]


@query("filter_contains", "SELECT * FROM part WHERE regexp_matches(p_name, '^(small|red) .*i[nd]g?')")
def filter_contains_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_column(table(spark, sf_dir, "part"), "p_name", "contains", "^(small|red) .*i[nd]g?")["true"]


@query("filter_not_contains", "SELECT * FROM documents WHERE NOT regexp_matches(text, '[0-9]{3}')")
def filter_not_contains_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_column(table(spark, sf_dir, "documents"), "text", "not_contains", "[0-9]{3}")["true"]


@query("filter_starts_ends", "SELECT * FROM part WHERE starts_with(p_brand, 'Brand#1') AND ends_with(p_brand, '7')")
def filter_starts_ends_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = filter_column(table(spark, sf_dir, "part"), "p_brand", "starts_with", "Brand#1")["true"]
    return filter_column(first, "p_brand", "ends_with", "7")["true"]


NULLED_ORDERS = "SELECT o_orderkey, nullif(o_orderstatus, 'F') AS status, o_totalprice FROM orders"


def nulled_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "nullif(o_orderstatus, 'F') AS status", "o_totalprice"
    )


@query("filter_null", f"SELECT * FROM ({NULLED_ORDERS}) WHERE status IS NULL")
def filter_null_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_column(nulled_orders(spark, sf_dir), "status", "is_null")["true"]


@query("filter_true_branch", f"SELECT * FROM ({NULLED_ORDERS}) WHERE status <> 'O'")
def filter_true_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_column(nulled_orders(spark, sf_dir), "status", "!=", "O")["true"]


@query("filter_false_branch", f"SELECT * FROM ({NULLED_ORDERS}) WHERE NOT coalesce(status <> 'O', FALSE)")
def filter_false_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_column(nulled_orders(spark, sf_dir), "status", "!=", "O")["false"]


@query("filter_noop", "SELECT supplier.*, kind, 'true' AS branch FROM supplier, (VALUES ('column'), ('value'), ('text')) AS k(kind)")
def filter_noop_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filters without a column, a value or an expression keep everything."""
    df = table(spark, sf_dir, "supplier")
    splits = {
        "column": filter_column(df, ""),
        "value": filter_column(df, "s_name", "==", " "),
        "text": filter_text(df, ""),
    }
    marked = [
        split[port].withColumn("kind", F.lit(kind)).withColumn("branch", F.lit(port))
        for kind, split in splits.items()
        for port in ("true", "false")
    ]
    return reduce(DataFrame.unionByName, marked)


@query(
    "filter_expression",
    """
    SELECT * FROM lineitem
    WHERE l_quantity * 2 >= 60 AND NOT (l_returnflag = 'R' OR l_discount > l_tax) AND l_linestatus <> 'X'
    """,
)
def filter_expression_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """[l_quantity] * 2 >= 60 AND NOT ([l_returnflag] == "R" OR [l_discount] > [l_tax])
              and [l_linestatus] <> 'X'"""
    return filter_text(table(spark, sf_dir, "lineitem"), text)["true"]


@query(
    "filter_expression_text",
    """
    SELECT * FROM documents
    WHERE (regexp_matches(text, 'the|die') OR ends_with(text, '.')) AND NOT starts_with(source, 'src1')
    """,
)
def filter_expression_text_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """([text] CONTAINS "the|die" OR ENDSWITH([text], ".")) AND NOT [source] STARTSWITH 'src1'"""
    return filter_text(table(spark, sf_dir, "documents"), text)["true"]


@query("filter_expression_null", f"SELECT * FROM ({NULLED_ORDERS}) WHERE status IS NULL OR (status IS NOT NULL AND o_totalprice < 50000)")
def filter_expression_null_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = "[status] IS NULL OR ([status] is not null AND [o_totalprice] < 50000)"
    return filter_text(nulled_orders(spark, sf_dir), text)["true"]


@query("filter_expression_typed", "SELECT * FROM orders WHERE o_orderdate >= TIMESTAMP '1997-01-01' AND o_custkey < 700 AND o_totalprice > 1000.5")
def filter_expression_typed_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = """[o_orderdate] >= "1997-01-01" AND [o_custkey] < "700" AND [o_totalprice] > '1000.5'"""
    return filter_text(table(spark, sf_dir, "orders"), text)["true"]
