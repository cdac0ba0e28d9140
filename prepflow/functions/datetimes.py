"""Text to timestamp and back."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, functions as F

from prepflow.schema import MOMENT_TYPES, col, data_type, require_batch, require_columns

# The preset formats.
PRESETS = (
    "yyyy-MM-dd",
    "yyyy/MM/dd",
    "dd-MM-yyyy",
    "dd/MM/yyyy",
    "HH:mm:ss",
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy HH:mm:ss",
)
AUTO, CUSTOM = "Auto-Infer", "Custom"
PARSE, FORMAT = "String to Date/Time", "Date/Time to String"
DEFAULT_TEXT = "yyyy-MM-dd HH:mm:ss"

# Strptime directives and the Java pattern letters they stand for.
DIRECTIVES = {
    "Y": "yyyy",
    "y": "yy",
    "m": "MM",
    "d": "dd",
    "H": "HH",
    "I": "hh",
    "M": "mm",
    "S": "ss",
    "f": "SSSSSS",
    "p": "a",
    "b": "MMM",
    "B": "MMMM",
    "j": "DDD",
    "F": "yyyy-MM-dd",
    "T": "HH:mm:ss",
    "%": "'%'",
}

# Forms tried by the automatic mode, most specific first.
AUTO_FORMS = tuple(
    f"{day}{clock}"
    for day in ("yyyy-MM-dd", "yyyy/MM/dd", "dd-MM-yyyy", "dd/MM/yyyy")
    for clock in ("'T'HH:mm:ss[.SSSSSS]", " HH:mm:ss[.SSSSSS]", " HH:mm", "")
)


def java_format(strptime: str) -> str:
    """Java pattern for a strptime format; unknown directives are refused."""

    def letter(match: re.Match) -> str:
        if match.group(1) is not None:
            if match.group(1) not in DIRECTIVES:
                raise ValueError(f"date format: %{match.group(1)} is not supported")
            return DIRECTIVES[match.group(1)]
        return "'" + match.group(2) + "'"

    return re.sub(r"%(.)|([A-Za-z]+)", letter, strptime)


def chosen_format(name: str, custom: str) -> str | None:
    if name == CUSTOM:
        return java_format(custom) if custom else None
    return name if name in PRESETS else None


def shape_of(pattern: str) -> str | None:
    """Regular expression of the texts a pattern can read; none if it holds names."""
    parts = []
    for quoted, letters, other in re.findall(r"'([^']*)'|([A-Za-z]+)|([^A-Za-z'])", pattern):
        if letters:
            if letters[0] not in "yMdHhmsS" or letters.startswith("MMM"):
                return None
            size = len(letters)
            fewer = letters[0] == "S" or (size <= 2 and letters[0] != "y" and not packed(pattern))
            parts.append(rf"\d{{1,{max(size, 2) if letters[0] != 'S' else size}}}" if fewer else rf"\d{{{size}}}")
        else:
            parts.append({"[": "(?:", "]": ")?"}.get(other) or re.escape(quoted or other))
    return "^" + "".join(parts) + "$"


def packed(pattern: str) -> bool:
    """Do fields follow each other without a sign between them?  Then their widths are fixed."""
    return bool(re.search(r"([A-Za-z])(?!\1)[A-Za-z]", re.sub(r"'[^']*'", "'", pattern)))


def lenient(pattern: str) -> str:
    """The pattern with one-letter days, months and times, which read one digit or two."""
    if packed(pattern):
        return pattern
    return re.sub(r"('[^']*')|(?<![A-Za-z])([dMHhms])\2(?![A-Za-z])", lambda m: m[1] or m[2], pattern)


def parse_with(text: Column, pattern: str) -> Column:
    """Timestamp of a text, or null.

    Texts of another shape are set aside first, as a failing parse costs an
    exception per row.
    """
    parsed = F.try_to_timestamp(text, F.lit(lenient(pattern))).cast("timestamp_ntz")
    shape = shape_of(pattern)
    return F.when(text.rlike(shape), parsed) if shape else parsed


def first_form_for_all(df: DataFrame, text: Column) -> str | None:
    """The first automatic form that reads every value of the column (one job)."""
    require_batch(df, "datetime")
    misses = [
        F.count(F.when(text.isNotNull() & parse_with(text, form).isNull(), 1)).alias(f"f{i}")
        for i, form in enumerate(AUTO_FORMS)
    ]
    row = df.agg(*misses).first()
    return next((form for i, form in enumerate(AUTO_FORMS) if row[i] == 0), None)


def convert_datetime(
    df: DataFrame,
    column: str = "",
    action: str = PARSE,
    format: str = AUTO,
    custom_format: str = "",
    output_column: str = "",
    whole_column: bool = False,
) -> DataFrame:
    """Parse text to timestamps, or format dates and timestamps as text.

    Text that cannot be read gives null.  The automatic mode tries its forms row
    by row; with ``whole_column`` it settles on the first form that reads every
    value (null throughout if there is none).  A column that is a date or
    timestamp already is copied; formatting anything else is a cast to text.
    """
    if not column:
        return df
    require_columns(df, [column], "datetime")
    target = output_column.strip() or column
    moment = isinstance(data_type(df, column), MOMENT_TYPES)
    pattern = chosen_format(format, custom_format)
    this = col(column)
    if action == PARSE:
        if moment:
            result = this
        else:
            text = this.cast("string")
            forms = [pattern] if pattern else AUTO_FORMS
            if not pattern and whole_column:
                forms = [first_form_for_all(df, text)]
            result = (
                F.coalesce(*(parse_with(text, f) for f in forms))
                if forms[0]
                else F.lit(None).cast("timestamp_ntz")
            )
    else:
        result = F.date_format(this, pattern or DEFAULT_TEXT) if moment else this.cast("string")
    return df.withColumn(target, result)
