"""Type names, column checks and the semantic tag kept in field metadata."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, functions as F, types as T

SEMANTIC_KEY = "semantic_type"

# The type names a user may write, and the Spark type each stands for.
CAST_TYPES = {
    "int64": "bigint",
    "integer": "bigint",
    "int": "bigint",
    "float64": "double",
    "float": "double",
    "decimal": "double",
    "numerical": "double",
    "boolean": "boolean",
    "bool": "boolean",
}

# Texts Spark casts to boolean, and what numbers look like.
BOOLEAN_WORDS = ("t", "true", "y", "yes", "1", "f", "false", "n", "no", "0")
NUMBER_SHAPES = {
    "bigint": r"^[+-]?\d+$",
    "double": r"^[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?|(?i:nan|inf|infinity))$",
}

UNKNOWN_SIZE = 1 << 60

INTEGER_TYPES = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FLOAT_TYPES = (T.FloatType, T.DoubleType)
NUMERIC_TYPES = INTEGER_TYPES + FLOAT_TYPES + (T.DecimalType,)
MOMENT_TYPES = (T.DateType, T.TimestampType, T.TimestampNTZType)


class SchemaError(ValueError):
    """A required column is missing or has an unusable type."""


class GuardError(ValueError):
    """A text, query or table name was refused before it was run."""


def cast_target(name: str | None) -> str:
    """Spark type for a user-visible type name; unknown names mean string."""
    return CAST_TYPES.get((name or "").lower(), "string")


def safe_cast(column: Column, kind: T.DataType, type_name: str | None) -> Column:
    """Cast from ``kind`` to a user-visible type that gives null instead of failing."""
    target = cast_target(type_name)
    if not isinstance(kind, T.StringType) or target == "string":
        return column.try_cast(target)
    return F.when(castable(column, target), column.try_cast(target))


def castable(text: Column, target: str) -> Column:
    """Cheap test before casting text: a cast that fails costs an exception per row."""
    if target == "boolean":
        return F.lower(F.trim(text)).isin(*BOOLEAN_WORDS)
    return text.rlike(NUMBER_SHAPES[target])


def input_bytes(df: DataFrame) -> int | None:
    """Size of everything a table is read from, a fair guess at its order of magnitude."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    return size if size < UNKNOWN_SIZE else None


def data_type(df: DataFrame, column: str) -> T.DataType:
    return df.schema[column].dataType


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    """Column by exact name, also when the name holds dots or spaces."""
    return F.col(quoted(name))


def cols(names: Iterable[str]) -> list[Column]:
    return [col(n) for n in names]


def require_columns(df: DataFrame, names: Iterable[str], operator: str) -> None:
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise SchemaError(
            f"{operator}: column(s) {missing} not found; available: {df.columns}"
        )


def require_batch(df: DataFrame, operator: str) -> None:
    if df.isStreaming:
        raise ValueError(
            f"{operator} depends on row order or on the whole table and cannot run on a stream"
        )


def name_list(value: str | Iterable[str] | None) -> list[str]:
    """Accept ``"a, b"``, ``["a", "b"]`` or nothing; blanks are dropped."""
    if value is None:
        return []
    parts = value.split(",") if isinstance(value, str) else value
    return [p.strip() for p in parts if isinstance(p, str) and p.strip()]


def semantic_types(df: DataFrame) -> dict[str, str]:
    """Semantic tag of every tagged column."""
    return {
        f.name: f.metadata[SEMANTIC_KEY]
        for f in df.schema.fields
        if f.metadata and SEMANTIC_KEY in f.metadata
    }


def tag(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """Set the semantic tag of the named columns; names that are absent are ignored."""
    for name, kind in tags.items():
        if name in df.columns:
            metadata = dict(df.schema[name].metadata or {})
            df = df.withMetadata(name, metadata | {SEMANTIC_KEY: kind})
    return df


def carry_tags(result: DataFrame, *inputs: DataFrame) -> DataFrame:
    """Give ``result`` the tags of its inputs by column name.

    Casts and aggregates drop field metadata.  Later inputs win over earlier
    ones, and a tag that ``result`` already carries wins over both.
    """
    known: dict[str, str] = {}
    for frame in inputs:
        known |= semantic_types(frame)
    have = semantic_types(result)
    return tag(result, {n: k for n, k in known.items() if n not in have})
