"""Joins, unions, duplicates, order, samples and row batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from prepflow.catalog import query, table
from prepflow.operators.joins import join_tables
from prepflow.operators.ordering import chunk_rows, sample_rows, sort_rows, top_k
from prepflow.operators.stack import union_tables, unique_rows

ORDER_SQL = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"


def shifted_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All orders, with keys shifted against the customers', so that joins find gaps on both sides."""
    return table(spark, sf_dir, "orders").selectExpr("o_custkey + 75 AS cust", "o_orderkey", "o_totalprice AS price")


BIG_SQL = """
big AS (SELECT o_custkey + 75 AS cust, o_orderkey, o_totalprice AS price FROM orders),
rich AS (SELECT c_custkey, c_name, c_acctbal AS price FROM customer)
"""


def all_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").selectExpr("c_custkey", "c_name", "c_acctbal AS price")


def both(spark: SparkSession, sf_dir: str, how: str, **options) -> DataFrame:
    return join_tables(
        shifted_orders(spark, sf_dir), all_customers(spark, sf_dir), "cust", ["c_custkey"], how, **options
    )


@query("join_inner", "SELECT l.*, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM lineitem l JOIN orders ON l_orderkey = o_orderkey")
def join_inner(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_tables(
        table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "orders"), "l_orderkey", "o_orderkey", "inner"
    )


@query("join_left", f"WITH {BIG_SQL} SELECT cust, o_orderkey, big.price, c_name, rich.price AS price_right FROM big LEFT JOIN rich ON cust = c_custkey")
def join_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir, "left")


@query("join_right", f"WITH {BIG_SQL} SELECT o_orderkey, big.price, c_custkey, c_name, rich.price AS price_right FROM big RIGHT JOIN rich ON cust = c_custkey")
def join_right(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir, "right")


@query("join_full", f"WITH {BIG_SQL} SELECT cust, o_orderkey, big.price, c_custkey, c_name, rich.price AS price_right FROM big FULL JOIN rich ON cust = c_custkey")
def join_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir, "outer")


@query("join_full_coalesced", f"WITH {BIG_SQL} SELECT coalesce(cust, c_custkey) AS cust, o_orderkey, big.price, c_name, rich.price AS price_right FROM big FULL JOIN rich ON cust = c_custkey")
def join_full_coalesced(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir, "full", coalesce_keys=True)


@query("join_semi", f"WITH {BIG_SQL} SELECT * FROM big WHERE EXISTS (SELECT 1 FROM rich WHERE cust = c_custkey)")
def join_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir, "semi")


@query("join_anti", f"WITH {BIG_SQL} SELECT * FROM big WHERE NOT EXISTS (SELECT 1 FROM rich WHERE cust = c_custkey)")
def join_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return both(spark, sf_dir, "anti")


@query("join_no_keys", "SELECT * FROM supplier")
def join_no_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join_tables(table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation"))


@query(
    "join_suffix",
    """
    SELECT a.conv_id, a.turn, a.role, a.text, b.role AS role_next, b.text AS text_next
    FROM conversations a JOIN (SELECT conv_id, turn - 1 AS turn, role, text FROM conversations) b
      ON a.conv_id = b.conv_id AND a.turn = b.turn
    """,
)
def join_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    following = turns.withColumn("turn", F.col("turn") - 1)
    return join_tables(turns, following, "conv_id, turn", "conv_id, turn", "inner", suffix="_next")


@query(
    "union_diagonal",
    """
    SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, NULL::INTEGER AS size FROM customer
    UNION ALL BY NAME SELECT p_partkey AS id, p_name AS name, p_size AS size FROM part
    UNION ALL BY NAME SELECT s_suppkey AS id, s_acctbal AS balance FROM supplier
    """,
)
def union_diagonal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return union_tables(
        [
            table(spark, sf_dir, "customer").selectExpr("c_custkey AS id", "c_name AS name", "c_acctbal AS balance"),
            table(spark, sf_dir, "part").selectExpr("p_size AS size", "p_partkey AS id", "p_name AS name"),
            table(spark, sf_dir, "supplier").selectExpr("s_suppkey AS id", "s_acctbal AS balance"),
        ]
    )


@query("union_vertical", "SELECT * FROM events UNION ALL SELECT * FROM events")
def union_vertical(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    return union_tables([events, events], "vertical")


UNIQUE_SQL = """
SELECT {columns} FROM (
  SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY {order}) AS rn FROM orders
) WHERE rn = 1
"""


@query("unique_first", UNIQUE_SQL.format(columns=ORDER_SQL, order="o_orderdate, o_orderkey"))
def unique_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_rows(table(spark, sf_dir, "orders"), ["o_custkey"], "first", ["o_orderdate", "o_orderkey"])


@query("unique_last", UNIQUE_SQL.format(columns=ORDER_SQL, order="o_orderdate DESC, o_orderkey DESC"))
def unique_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_rows(table(spark, sf_dir, "orders"), ["o_custkey"], "last", ["o_orderdate", "o_orderkey"])


@query("unique_any", "SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem")
def unique_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = unique_rows(table(spark, sf_dir, "lineitem"), "l_orderkey, l_linenumber", "any")
    return df.select("l_orderkey", "l_linenumber")


@query("unique_none", "SELECT * EXCLUDE (n) FROM (SELECT *, count(*) OVER (PARTITION BY l_orderkey, l_linenumber) AS n FROM lineitem) WHERE n = 1")
def unique_none(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unique_rows(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"], "none")


@query("sort_rows", "SELECT o_orderkey, nullif(o_orderstatus, 'P') AS status, o_totalprice FROM orders")
def sort_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey", "nullif(o_orderstatus, 'P') AS status", "o_totalprice"
    )
    return sort_rows(
        df,
        [
            {"column": "status", "order": "desc"},
            {"column": "not_there", "order": "asc"},
            {"column": "o_totalprice", "order": "asc"},
            {"column": "o_orderkey", "order": "asc"},
        ],
    )


@query("sample_first", "SELECT * FROM events ORDER BY ts, event_id LIMIT 250")
def sample_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(table(spark, sf_dir, "events"), "first", 250, ["ts", "event_id"])


@query("sample_last", "SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 250")
def sample_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(table(spark, sf_dir, "events"), "last", 250, ["ts", "event_id"])


@query("sample_random", "SELECT least(count(*), 300) AS rows, least(count(*), 300) AS different, least(count(*), 300) AS known FROM events")
def sample_random(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A random draw has no fixed rows; its size, distinctness and origin are checked."""
    events = table(spark, sf_dir, "events")
    drawn = sample_rows(events, "random", 300, seed=7).select("event_id", F.lit(1).alias("one"))
    found = events.join(drawn, "event_id", "left")
    return found.agg(
        F.count("one").alias("rows"),
        F.count_distinct(F.when(F.col("one") == 1, F.col("event_id"))).alias("different"),
        F.sum(F.coalesce("one", F.lit(0)).cast("bigint")).alias("known"),
    )


@query("sample_zero", "SELECT * FROM events LIMIT 0")
def sample_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sample_rows(table(spark, sf_dir, "events"), "first", 0)


@query("top_k", "SELECT * FROM lineitem ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber, l_partkey, l_suppkey LIMIT 100")
def top_k_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = [{"column": "l_extendedprice", "order": "desc"}] + [
        {"column": c, "order": "asc"} for c in ("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    ]
    return top_k(table(spark, sf_dir, "lineitem"), by, 100)


@query(
    "chunk_rows",
    """
    WITH numbered AS (
      SELECT row_number() OVER (ORDER BY doc_id) - 1 AS i, text, nullif(lang, 'de') AS lang, source
      FROM documents
    )
    SELECT CAST(i // 7 AS BIGINT) AS "Chunk_ID", coalesce(string_agg(text, chr(10) || chr(10) ORDER BY i), '') AS text,
           coalesce(string_agg(lang, chr(10) || chr(10) ORDER BY i), '') AS lang,
           string_agg(source, chr(10) || chr(10) ORDER BY i) AS source, count(*) AS "Rows_in_Chunk"
    FROM numbered GROUP BY i // 7
    """,
)
def chunk_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "documents").selectExpr(
        "doc_id", "text", "nullif(lang, 'de') AS lang", "source"
    )
    return chunk_rows(df, 7, ["text", "lang", "source", "not_there"], "\\n\\n", ["doc_id"], unique_order=True)
