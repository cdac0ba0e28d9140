"""Finding physical and semantic types of text columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prepflow.functions.datetimes import lenient, shape_of
from prepflow.operators.ordering import OrderBy, sample_rows
from prepflow.schema import SEMANTIC_KEY, col, require_batch

# Texts that stand for null in delimited files.
NULL_TOKENS = ("", "NA", "NaN", "null")

# What currency and percentage texts look like.
CURRENCY = r"^\s*\(?\s*\$?\s*\d{1,3}(?:,\d{3})*(?:\.\d+)?\s*\)?\s*$"
PERCENTAGE = r"^\s*-?\d+(?:\.\d+)?\s*%\s*$"


SIGNS = ("", "+", "-")

# The marks left of a text when its digits are taken out.  Types are tried in this
# order: first the marks, and only then a cast, since casts that fail are slow and
# some succeed too easily (``10D`` as a number, ``2020-01`` as a date).
MARKS = {
    "bigint": set(SIGNS),
    "double": {
        sign + point + power
        for sign in SIGNS
        for point in (".", "")
        for power in ("", *(e + s for e in "eE" for s in SIGNS))
    },
    "boolean": {"true", "false", "True", "False", "TRUE", "FALSE"},
    "date": {"--"},
    "timestamp_ntz": {"--" + gap + clock for gap in "T " for clock in (":", "::", "::.")},
    "date dd-MM-yyyy": {"--"},
    "date yyyy/MM/dd": {"//"},
    "date dd/MM/yyyy": {"//"},
}
CANDIDATES = tuple(MARKS)

# Kinds of text that may be mixed in a column of one type.
UNIONS = (
    ({"bigint"}, "bigint"),
    ({"bigint", "double"}, "double"),
    ({"boolean"}, "boolean"),
    ({"date"}, "date"),
    ({"date", "timestamp_ntz"}, "timestamp_ntz"),
    ({"date dd-MM-yyyy"}, "date dd-MM-yyyy"),
    ({"date yyyy/MM/dd"}, "date yyyy/MM/dd"),
    ({"date dd/MM/yyyy"}, "date dd/MM/yyyy"),
)


def text_columns(df: DataFrame, columns: Sequence[str] | None = None) -> list[str]:
    return [
        f.name
        for f in df.schema.fields
        if isinstance(f.dataType, T.StringType) and (columns is None or f.name in columns)
    ]


def null_tokens(df: DataFrame) -> DataFrame:
    """Turn the null texts of all text columns into null."""
    out = {c: F.when(~col(c).isin(*NULL_TOKENS), col(c)) for c in text_columns(df)}
    return df.withColumns(out) if out else df


def read_as(text: Column, kind: str) -> Column:
    """Value of a text of a kind: a type to cast to, or ``date`` and its pattern."""
    _, _, pattern = kind.partition(" ")
    return F.try_to_date(text, lenient(pattern)) if pattern else text.try_cast(kind)


def kind_flag(text: Column, marks: Column) -> Column:
    """One bit for the narrowest type a text fits; null stays null."""
    flag = F.when(text.isNull(), F.lit(None).cast("int"))
    for bit, (kind, allowed) in enumerate(MARKS.items()):
        fits = marks.isin(*sorted(allowed))
        if kind in ("date", "timestamp_ntz"):
            fits = fits & (F.substring(text, 5, 1) == "-") & (F.length(text) >= 8)
        elif kind.startswith("date "):
            fits = fits & text.rlike(shape_of(kind.removeprefix("date ")))
        flag = flag.when(fits & read_as(text, kind).isNotNull(), F.lit(1 << bit))
    return flag.otherwise(F.lit(1 << len(MARKS)))


def kind_of(flags: int | None) -> str | None:
    """Type for the set of bits seen in a column; none for text and for empty columns."""
    for kinds, target in UNIONS:
        bits = sum(1 << i for i, kind in enumerate(CANDIDATES) if kind in kinds)
        if flags and flags & ~bits == 0:
            return target
    return None


def find_types(df: DataFrame, columns: Sequence[str] | None = None) -> dict[str, str]:
    """Narrowest type every non-null text of a column fits; one aggregation over the table.

    Columns without any value stay text.
    """
    require_batch(df, "infer_types")
    names = text_columns(df, columns)
    if not names:
        return {}
    # One row per cell, so that the tests are compiled once and not once per column.
    cells = [
        F.struct(F.lit(i).alias("i"), col(c).alias("t"), F.translate(col(c), "0123456789", "").alias("m"))
        for i, c in enumerate(names)
    ]
    flags = (
        df.select(F.inline(F.array(*cells)))
        .groupBy("i")
        .agg(F.bit_or(kind_flag(F.col("t"), F.col("m"))).alias("flags"))
    )
    kinds = {names[row["i"]]: kind_of(row["flags"]) for row in flags.collect()}
    return {name: kind for name, kind in kinds.items() if kind}


def infer_types(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Cast text columns to the types their values fit."""
    found = find_types(df, columns)
    return df.withColumns({c: read_as(col(c), k) for c, k in found.items()}) if found else df


def as_currency(text: Column) -> Column:
    """Number of a currency text; an amount in parentheses is negative."""
    amount = F.translate(text, "$,() \t\r\n\f\x0b", "").try_cast("double")
    opened, closed = text.rlike(r"^\s*\("), text.rlike(r"\)\s*$")
    return F.when(opened & closed, -amount).when(~opened & ~closed, amount)


def as_fraction(text: Column) -> Column:
    """Number of a percentage text, divided by 100."""
    return F.translate(text, "%", "").try_cast("double") / F.lit(100.0)


SEMANTIC_CASTS = {"currency_usd": as_currency, "percentage": as_fraction}


def find_semantic_types(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    sample_size: int | None = None,
    order_by: OrderBy | None = None,
) -> dict[str, str]:
    """Text columns whose non-blank values all look like currency, or all like percentages.

    Decided on all rows by one aggregation, or on the first ``sample_size`` rows
    in ``order_by``.  At least one non-blank value is needed.
    """
    require_batch(df, "semantic_profile_cast")
    names = text_columns(df, columns)
    if not names:
        return {}
    if sample_size:
        df = sample_rows(df, "first", sample_size, order_by=order_by)
    tests = []
    for i, name in enumerate(names):
        filled = F.when(col(name).rlike(r"\S"), col(name))
        tests += [
            F.bool_and(filled.rlike(CURRENCY)).alias(f"c{i}"),
            F.bool_and(filled.rlike(PERCENTAGE)).alias(f"p{i}"),
        ]
    row = df.agg(*tests).first()
    kinds = {}
    for i, name in enumerate(names):
        if row[f"c{i}"]:
            kinds[name] = "currency_usd"
        elif row[f"p{i}"]:
            kinds[name] = "percentage"
    return kinds


def semantic_profile_cast(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    sample_size: int | None = None,
    order_by: OrderBy | None = None,
    kinds: dict[str, str] | None = None,
) -> DataFrame:
    """Turn currency and percentage texts into numbers and tag their columns.

    ``kinds`` states the semantic types and saves the job that finds them.  With a
    ``sample_size`` the first rows rule columns out; those left must hold on all
    rows, so that no value is lost.
    """
    if kinds is None:
        kinds = find_semantic_types(df, columns, sample_size, order_by)
        if sample_size and kinds:
            everywhere = find_semantic_types(df, list(kinds))
            kinds = {name: kind for name, kind in kinds.items() if everywhere.get(name) == kind}
    if not kinds:
        return df
    out = []
    for name in df.columns:
        if name in kinds:
            number = SEMANTIC_CASTS[kinds[name]](col(name))
            out.append(number.alias(name, metadata={SEMANTIC_KEY: kinds[name]}))
        else:
            out.append(col(name))
    return df.select(*out)
