"""Short text expressions, rewritten token by token to Spark SQL.

Only the notation is changed here: ``[Column]`` references, the text tests
``CONTAINS``/``STARTSWITH``/``ENDSWITH``, a few helper names, and ``+`` between
strings.  Parsing, types and precedence are left to Spark (``F.expr``).
"""

from __future__ import annotations

import re
from typing import NamedTuple

from pyspark.sql import types as T

from prepflow.schema import NUMERIC_TYPES, GuardError, quoted

TOKEN = re.compile(
    r"""(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')
      | (?P<column>\[[^\]]+\])
      | (?P<name>`(?:[^`]|``)*`)
      | (?P<number>\d+(?:\.\d+)?(?:[eE][+-]?\d+)?[A-Za-z]*)
      | (?P<word>[^\W\d]\w*)
      | (?P<space>\s+)
      | (?P<sign><=>|==|!=|>=|<=|<>|\|\||.)""",
    re.VERBOSE | re.DOTALL,
)

# SQL names that reach outside the row and are refused.
REFUSED_WORDS = {"reflect", "try_reflect", "java_method", "select"}

# Helper names and the Spark functions they stand for.
HELPERS = {"tostring": "string", "tonumber": "double", "iif": "if"}

# Bracketed character classes.
ASCII_CLASSES = {
    "alpha": "a-zA-Z",
    "digit": "0-9",
    "alnum": "a-zA-Z0-9",
    "upper": "A-Z",
    "lower": "a-z",
    "word": "a-zA-Z0-9_",
    "xdigit": "0-9a-fA-F",
    "space": r"\t-\r ",
    "blank": r"\t ",
}

TEXT_TESTS = {"contains", "startswith", "endswith"}
COMPARE = {"=", "==", "!=", "<>", "<", "<=", ">", ">="}

# Functions whose result is text, so that a "+" beside them means concatenation.
TEXT_FUNCTIONS = set(
    "tostring string upper lower trim ltrim rtrim concat concat_ws substring substr left right"
    " replace regexp_replace regexp_extract date_format initcap lpad rpad reverse repeat".split()
)


class Token(NamedTuple):
    kind: str
    text: str


def tokens(expression: str) -> list[Token]:
    found = (Token(m.lastgroup, m.group()) for m in TOKEN.finditer(expression))
    return [t for t in found if t.kind != "space"]


def guard(parts: list[Token]) -> None:
    for part in parts:
        if part.kind in ("word", "name") and part.text.strip("`").lower() in REFUSED_WORDS:
            raise GuardError(f"expression may not use {part.text!r}")


def java_pattern(pattern: str) -> str:
    """A regular expression in Java notation.

    Named groups become plain ones (they are only used by number, and Java
    allows fewer names), bracketed classes such as ``[:alpha:]`` are spelled
    out, and classes such as ``\\w`` cover all of Unicode.
    """
    pattern = re.sub(r"(?<!\\)\(\?P?<(?![=!])[^>]*>", "(", pattern)
    return "(?U)" + re.sub(r"\[:(\w+):\]", lambda m: ASCII_CLASSES.get(m[1], m[0]), pattern)


def column_name(part: Token) -> str:
    return part.text[1:-1]


def text_value(part: Token) -> str:
    """What a quoted literal stands for: only quotes and backslashes can be escaped."""
    return re.sub(r"""\\([\\"'])""", r"\1", part.text[1:-1])


def sql_text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def text_test(test: str, column: Token, wanted: Token) -> str:
    target = f"cast({quoted(column_name(column))} as string)"
    if test.lower() == "contains":
        return f"({target} rlike {sql_text(java_pattern(text_value(wanted)))})"
    return f"{test.lower()}({target}, {sql_text(text_value(wanted))})"


def shape(parts: list[Token], at: int, length: int) -> list[str]:
    """Kinds of the next tokens, with signs and text tests spelled out."""
    out = []
    for part in parts[at : at + length]:
        if part.kind == "sign":
            out.append(part.text)
        elif part.kind == "word" and part.text.lower() in TEXT_TESTS:
            out.append("test")
        else:
            out.append(part.kind)
    return out


def plain(part: Token) -> str:
    if part.kind == "column":
        return quoted(column_name(part))
    if part.kind == "text" and part.text[0] == '"':
        return "'" + part.text[1:-1].replace('\\"', '"').replace("'", "\\'") + "'"
    return part.text


def predicate(expression: str, schema: T.StructType) -> str:
    """Spark SQL for a filter text."""
    parts = tokens(expression)
    guard(parts)
    types = {f.name: f.dataType for f in schema.fields}
    out: list[str] = []
    at = 0
    while at < len(parts):
        if shape(parts, at, 6) == ["test", "(", "column", ",", "text", ")"]:
            out.append(text_test(parts[at].text, parts[at + 2], parts[at + 4]))
            at += 6
        elif shape(parts, at, 3) == ["column", "test", "text"]:
            out.append(text_test(parts[at + 1].text, parts[at], parts[at + 2]))
            at += 3
        elif (
            parts[at].kind == "text"
            and at >= 2
            and parts[at - 1].text in COMPARE
            and parts[at - 2].kind == "column"
            and isinstance(types.get(column_name(parts[at - 2])), NUMERIC_TYPES)
            and re.fullmatch(r"\s*-?\d+(\.\d+)?\s*", parts[at].text[1:-1])
        ):
            out.append(parts[at].text[1:-1].strip())
            at += 1
        else:
            out.append(plain(parts[at]))
            at += 1
    return " ".join(out)


def formula_sql(expression: str, schema: T.StructType) -> str:
    """Spark SQL for a formula text."""
    parts = tokens(expression)
    guard(parts)
    text_columns = {f.name for f in schema.fields if isinstance(f.dataType, T.StringType)}
    out: list[str] = []
    for at, part in enumerate(parts):
        called = at + 1 < len(parts) and parts[at + 1].text == "("
        if part.kind == "word" and called and part.text.lower() in HELPERS:
            out.append(HELPERS[part.text.lower()])
        elif part.text == "+" and (
            ends_in_text(parts, at - 1, text_columns) or starts_with_text(parts, at + 1, text_columns)
        ):
            out.append("||")
        else:
            out.append(plain(part))
    return " ".join(out)


def is_text(part: Token, text_columns: set[str]) -> bool:
    if part.kind in ("column", "name"):
        return column_name(part) in text_columns
    return part.kind == "text"


def starts_with_text(parts: list[Token], at: int, text_columns: set[str]) -> bool:
    """Does the operand that starts here hold text?"""
    while at < len(parts) and parts[at].text == "(":
        at += 1
    if at >= len(parts):
        return False
    part = parts[at]
    if part.kind == "word":
        return (
            part.text.lower() in TEXT_FUNCTIONS
            and at + 1 < len(parts)
            and parts[at + 1].text == "("
        )
    return is_text(part, text_columns) and not compared(parts, at + 1)


def ends_in_text(parts: list[Token], at: int, text_columns: set[str]) -> bool:
    """Does the operand that ends here hold text?"""
    if at < 0:
        return False
    if parts[at].text != ")":
        return is_text(parts[at], text_columns)
    depth, start = 1, at - 1
    while start >= 0 and depth:
        depth += {")": 1, "(": -1}.get(parts[start].text, 0)
        start -= 1
    if start >= 0 and parts[start].kind == "word":
        return parts[start].text.lower() in TEXT_FUNCTIONS
    return starts_with_text(parts, start + 1, text_columns)


def compared(parts: list[Token], at: int) -> bool:
    return at < len(parts) and parts[at].text in COMPARE
