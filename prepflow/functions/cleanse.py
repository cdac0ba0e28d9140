"""Cleansing of text and number columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F, types as T

from prepflow.schema import NUMERIC_TYPES, col, data_type, name_list

# What each step removes; patterns in Java notation with Unicode classes.
WHITE_SPACE = "\t\n\v\f\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
PUNCTUATION = r"(?U)[^a-zA-Z0-9_ \w\s]"  # common characters first, they are told apart fastest
DIGITS = r"(?U)\d+"
LETTERS = r"[a-zA-Z]+"
WORD_OR_GAP = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"


def trim_space(text: Column) -> Column:
    """Remove all kinds of white space at both ends."""
    return F.btrim(text, F.lit(WHITE_SPACE))


def title_case(text: Column) -> Column:
    """First letter of every run of letters and digits in upper case, the rest lower."""
    runs = F.regexp_extract_all(F.lower(text), F.lit(WORD_OR_GAP), F.lit(1))
    capital = F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.substring(r, 2, 2**31 - 1)))
    return F.array_join(capital, "")


CASES = {"uppercase": F.upper, "lowercase": F.lower, "titlecase": title_case}


def cleanse(
    df: DataFrame,
    columns: Sequence[str] | str = (),
    replace_nulls_string: bool = False,
    replace_nulls_numeric: bool = False,
    trim_whitespace: bool = False,
    remove_punctuation: bool = False,
    remove_numbers: bool = False,
    remove_letters: bool = False,
    string_case: str = "None",
) -> DataFrame:
    """Clean the named columns; names the table lacks and other types are left alone.

    Text steps run in the order of the parameters, letter case last.
    """
    out: dict[str, Column] = {}
    for name in name_list(columns):
        if name not in df.columns:
            continue
        kind, value = data_type(df, name), col(name)
        if isinstance(kind, T.StringType):
            if replace_nulls_string:
                value = F.coalesce(value, F.lit(""))
            if trim_whitespace:
                value = trim_space(value)
            for wanted, pattern in (
                (remove_punctuation, PUNCTUATION),
                (remove_numbers, DIGITS),
                (remove_letters, LETTERS),
            ):
                if wanted:
                    value = F.regexp_replace(value, pattern, "")
            change = CASES.get((string_case or "").lower())
            out[name] = change(value) if change else value
        elif isinstance(kind, NUMERIC_TYPES) and replace_nulls_numeric:
            out[name] = F.coalesce(value, F.lit(0).cast(kind))
    return df.withColumns(out) if out else df
