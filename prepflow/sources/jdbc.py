"""Database queries and tables through Spark's JDBC source."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from prepflow.schema import GuardError

# Words that change data or rights, and tables that belong to the database.
CHANGING_WORDS = ("DROP", "DELETE", "TRUNCATE", "ALTER", "UPDATE", "INSERT", "GRANT", "REVOKE")
SYSTEM_TABLES = ("pg_stat", "information_schema", "sqlite_master", "mysql", "sys")

# The save modes a user may write.
SAVE_MODES = {
    "append": "append",
    "fail": "errorifexists",
    "replace_warning": "overwrite",
    "replace": "overwrite",
}


#: What a query is read as: quoted text with doubled quotes, comments, words and single signs.
TOKEN = re.compile(
    r"""(?P<skip>'(?:[^']|'')*'|"(?:[^"]|"")*"|--[^\n]*|/\*.*?\*/|\s+)|(?P<token>\w+|.)""", re.DOTALL
)


def sql_tokens(query: str):
    """Words and signs of a query outside of quotes and comments; an open quote is a sign of its own."""
    return (m["token"] for m in TOKEN.finditer(query) if m["token"])


def check_query(query: str) -> str:
    """Refuse chained or data-changing SQL; quoted text does not count."""
    for token in sql_tokens(query):
        if token == ";":
            raise GuardError("query: only one statement is allowed")
        if token.upper() in CHANGING_WORDS:
            raise GuardError(f"query: {token.upper()} is not allowed in a read")
    return query


def check_table(table: str, reserved: tuple[str, ...] = ()) -> str:
    """Refuse table names with other characters than letters, digits and ``_``, and system tables.

    ``reserved`` adds further name beginnings to refuse.
    """
    if not table:
        raise ValueError("table name is empty")
    if not re.fullmatch(r"[A-Za-z0-9_]+", table):
        raise GuardError(f"table name {table!r} may only hold letters, digits and _")
    if table.lower().startswith(SYSTEM_TABLES + reserved):
        raise GuardError(f"table {table!r} belongs to the database system")
    return table


def read_options(
    url: str,
    query: str,
    partition_column: str | None = None,
    bounds: tuple | None = None,
    partitions: int | None = None,
    **options: str,
) -> dict[str, str]:
    """Options of a checked query read.

    With a partition column, its bounds and a partition count the query is read
    in parallel slices; Spark wants a sub-query instead of ``query`` for that.
    """
    if not url or not query:
        raise ValueError("a connection url and a query are both needed")
    check_query(query)
    base = {"url": url, **options}
    if partition_column is None:
        return base | {"query": query}
    if bounds is None or partitions is None:
        raise ValueError("a partitioned read needs bounds and a partition count")
    return base | {
        "dbtable": f"({query}) q",
        "partitionColumn": partition_column,
        "lowerBound": str(bounds[0]),
        "upperBound": str(bounds[1]),
        "numPartitions": str(partitions),
    }


def read_query(spark: SparkSession, url: str, query: str, **options) -> DataFrame:
    """Run a read-only query in the database; see ``read_options`` for parallel reads."""
    return spark.read.format("jdbc").options(**read_options(url, query, **options)).load()


def save_mode(if_exists: str) -> str:
    mode = SAVE_MODES.get(if_exists.lower())
    if mode is None:
        raise ValueError(f"unknown save mode {if_exists!r}; use one of {sorted(SAVE_MODES)}")
    return mode


def write_table(
    df: DataFrame, url: str, table: str, if_exists: str = "append", **options: str
) -> DataFrame:
    """Write to a database table, one connection per partition; returns the input."""
    if not url:
        raise ValueError("a connection url is needed")
    check_table(table)
    mode = save_mode(if_exists)
    df.write.format("jdbc").options(url=url, dbtable=table, **options).mode(mode).save()
    return df
