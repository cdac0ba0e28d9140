"""Sources and sinks: tables are written to the scratch folder and read back."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F

from prepflow.catalog import query, table
from prepflow.operators.stack import union_tables
from prepflow.session import scratch_path
from prepflow.sources.files import SOURCE_FILE, read_any, read_csv, read_jsonl, read_parquet
from prepflow.sources.infer import infer_types, semantic_profile_cast
from prepflow.sources.media import list_media_paths, parse_files, promote_header, text_lines
from prepflow.sources.sinks import write_table

LINEITEM_WIDE = """
SELECT l_orderkey, l_partkey, l_suppkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity,
       l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate
FROM lineitem
"""
ORDERS_WIDE = """
SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority FROM orders
"""


@query("read_csv", LINEITEM_WIDE)
def read_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "csv")
    write_table(table(spark, sf_dir, "lineitem"), path, "csv")
    return read_csv(spark, f"{path}/*.csv", source_file=False, same_columns=True)


@query(
    "read_csv_quoted_breaks",
    """
    SELECT doc_id, CASE WHEN text IN ('', 'NA', 'NaN', 'null') THEN NULL ELSE text END AS text, source
    FROM documents
    """,
)
def read_csv_quoted_breaks_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole documents, whose texts hold line breaks, through delimited text: records are found in parallel."""
    path = scratch_path(spark, "csv-breaks")
    write_table(table(spark, sf_dir, "documents").select("doc_id", "text", "source"), path, "csv")
    return read_csv(spark, f"{path}/*.csv", source_file=False, same_columns=True, profile=False)


@query("infer_types", LINEITEM_WIDE)
def infer_types_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = table(spark, sf_dir, "lineitem")
    return infer_types(df.select(*(F.col(c).cast("string").alias(c) for c in df.columns)))


@query(
    "read_glob_source_file",
    """
    SELECT o_orderkey, o_custkey, o_totalprice, NULL::VARCHAR AS o_orderpriority, TRUE AS from_file
    FROM orders
    UNION ALL
    SELECT o_orderkey, NULL, NULL, o_orderpriority, TRUE FROM orders
    """,
)
def read_glob_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    path = scratch_path(spark, "parts")
    write_table(orders.select("o_orderkey", "o_custkey", "o_totalprice"), path, "csv")
    write_table(orders.select("o_orderkey", "o_orderpriority"), path, "csv", mode="append")
    df = read_csv(spark, f"{path}/*.csv")
    return df.withColumn("from_file", F.col(SOURCE_FILE).like("part-%.csv")).drop(SOURCE_FILE)


@query("auto_format", "SELECT *, 'orders.parquet' AS \"Source_File\" FROM orders")
def auto_format_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_any(spark, f"{sf_dir}/orders.parquet")


@query("read_parquet", "SELECT * FROM customer")
def read_parquet_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/customer.parquet")


@query("read_jsonl", "SELECT * FROM events")
def read_jsonl_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "json")
    events = table(spark, sf_dir, "events")
    write_table(events, path, "jsonl")
    return read_jsonl(spark, path, events.schema)


@query(
    "list_media_paths",
    """
    SELECT unnest(['region', 'nation', 'customer', 'supplier', 'part', 'orders', 'lineitem', 'events',
                   'documents', 'embeddings', 'pages', 'benchmark', 'labels', 'conversations'])
           || '.parquet' AS file_name
    """,
)
def list_media_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = list_media_paths(spark, f"{sf_dir}/*.parquet")
    return paths.select(F.element_at(F.split("FilePath", "/"), -1).alias("file_name"))


@query(
    "text_lines",
    r"""
    WITH split AS (
      SELECT doc_id, string_split_regex(text, '\r\n|\n|\r') AS lines FROM documents
    ), numbered AS (
      SELECT doc_id, generate_subscripts(lines, 1) AS line_no, unnest(lines) AS line FROM split
    ), trimmed AS (
      SELECT doc_id, CAST(line_no AS INTEGER) AS line_no,
             regexp_replace(line, '^[\t-\r\x{85}\p{Z}]+|[\t-\r\x{85}\p{Z}]+$', '', 'g') AS "Text_Line"
      FROM numbered
    )
    SELECT * FROM trimmed WHERE "Text_Line" <> ''
    """,
)
def text_lines_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return text_lines(table(spark, sf_dir, "documents"), "text", ["doc_id"], "line_no")


@query(
    "promote_header",
    """
    SELECT CAST(o_orderkey AS VARCHAR) AS order_key,
           CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderstatus END AS "Column_1",
           CASE WHEN o_orderstatus = 'F' THEN '' ELSE o_orderpriority END AS priority
    FROM orders
    """,
)
def promote_header_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    key, status = F.col("o_orderkey").cast("string"), F.col("o_orderstatus")
    long_row = F.array(key, status, F.col("o_orderpriority"), F.lit("surplus"))
    rows = orders.select(
        F.col("o_orderkey").alias("row_no"),
        F.when(status == "F", F.array(key)).otherwise(long_row).alias("cells"),
    )
    header = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("row_no"),
        F.array(F.lit("order_key"), F.lit(" "), F.lit("priority")).alias("cells"),
    )
    return promote_header(union_tables([rows, header]), "cells", ["row_no"])


def json_rows(path: str, content: bytes) -> list[dict]:
    return [json.loads(line) for line in content.decode("utf-8").splitlines()]


@query("parse_files", "SELECT item_id, text FROM benchmark")
def parse_files_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "documents")
    write_table(table(spark, sf_dir, "benchmark").select("item_id", "text"), path, "jsonl")
    rows = parse_files(spark, f"{path}/*.json", json_rows, "item_id bigint, text string")
    return rows.drop(SOURCE_FILE)


@query(
    "semantic_profile_cast",
    "SELECT c_custkey, c_acctbal AS balance, round(c_nationkey / 100.0, 4) AS share, c_mktsegment FROM customer",
)
def semantic_profile_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    amount = F.col("c_acctbal")
    plain = F.concat(F.lit("$"), F.format_number(F.abs(amount), 2))
    texts = table(spark, sf_dir, "customer").select(
        "c_custkey",
        F.when(amount < 0, F.concat(F.lit("("), plain, F.lit(")"))).otherwise(plain).alias("balance"),
        F.concat(F.col("c_nationkey").cast("string"), F.lit(" %")).alias("share"),
        "c_mktsegment",
    )
    return semantic_profile_cast(texts).withColumn("share", F.round("share", 4))


def round_trip(spark: SparkSession, df: DataFrame, output_format: str) -> str:
    path = scratch_path(spark, output_format)
    write_table(df, path, output_format)
    return path


@query("write_csv", "SELECT * FROM events")
def write_csv_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    path = round_trip(spark, events, "csv")
    return read_csv(spark, path, schema=events.schema, source_file=False)


@query("write_parquet", ORDERS_WIDE)
def write_parquet_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_parquet(spark, round_trip(spark, table(spark, sf_dir, "orders"), "parquet"))


@query("write_jsonl", ORDERS_WIDE)
def write_jsonl_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    return read_jsonl(spark, round_trip(spark, orders, "jsonl"), orders.schema)


@query("sink_passthrough", "SELECT * FROM part")
def sink_passthrough_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return write_table(table(spark, sf_dir, "part"), scratch_path(spark, "off"), enabled=False)
