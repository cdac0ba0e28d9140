"""Personal data: patterns propose spans, checksums confirm them, nearby words adjust a score. SQL functions only.

The pieces between matches (``split``) and the matches themselves (``regexp_extract_all``) alternate, so the lengths
of both give every position. Patterns are written so that no text makes them backtrack: a match may only begin
where a run of its first class begins, or where the previous match ended, and repeats are possessive.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LOCAL = "A-Za-z0-9._%+-"

# The kinds in their order with pattern, a text each match contains, and context words. The first
# four are the base kinds.
PATTERNS = {
    "email": rf"(?:\G|(?<![{LOCAL}]))[{LOCAL}]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
}
CONTAINED = {"email": "@", "ip": ".", "phone": "+", "ssn": "-"}
BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = tuple(PATTERNS)
CONTEXT = {
    "email": "mail|contact|write|address",
    "ip": "ip|address|host|server|login",
    "card": "card|visa|credit|payment|amex|mastercard",
    "phone": "phone|call|tel|mobile|fax|contact",
    "iban": "iban|account|bank|konto|compte|cuenta",
    "ssn": "ssn|social|security",
}
SCORES = {"email": 0.8, "ip": 0.6, "card": 0.8, "phone": 0.6, "iban": 0.8, "ssn": 0.4}
CONTEXT_GAIN = 0.2
CONTEXT_CHARS = 40
LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"

#: Positions are summed in blocks of so many matches, so that a text with very many costs little more a match.
BLOCK = 256


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once, also when a nested function reads it for every element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def total(numbers: Column) -> Column:
    return F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x)


def digits(hit: Column) -> Column:
    return F.regexp_replace(hit, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a text of digits passes the Luhn checksum."""

    def value(i: Column) -> Column:
        digit = F.substring(number, F.length(number) - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, digit).when(digit > 4, digit * 2 - 9).otherwise(digit * 2).cast("long")

    return total(F.transform(F.sequence(F.lit(0), F.length(number) - 1), value)) % 10 == 0


def mod97(code: Column) -> Column:
    """Whether an account number without blanks leaves 1 by 97, letters counting 10 to 35, first four moved last."""
    moved = F.concat(F.substring(code, F.lit(5), F.length(code)), F.substring(code, F.lit(1), F.lit(4)))

    def step(rest: Column, char: Column) -> Column:
        letter = F.instr(F.lit(LETTERS), char)
        return F.when(letter > 0, (rest * 100 + letter + 9) % 97).otherwise(
            (rest * 10 + F.when(letter > 0, F.lit(0)).otherwise(char.cast("int"))) % 97
        ).cast("long")

    return F.aggregate(F.filter(F.split(moved, ""), lambda c: c != ""), F.lit(0).cast("long"), step) == 1


def confirmed(kind: str, hit: Column) -> Column:
    if kind == "ip":
        return F.forall(
            F.split(hit, r"\."), lambda p: p.rlike("^0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])$")
        )
    if kind == "card":
        return let(digits(hit), lambda d: F.length(d).between(14, 19) & luhn(d))
    if kind == "phone":
        return F.length(digits(hit)).between(10, 15)
    if kind == "iban":
        return let(F.replace(hit, F.lit(" "), F.lit("")), lambda c: F.length(c).between(15, 34) & mod97(c))
    if kind == "ssn":
        return ~hit.rlike("^(?:000|666|9)|-00-|-0000$")
    return F.lit(True)


def spans(text: Column, kind: str) -> Column:
    """Confirmed spans of one kind: array of (start, rank, kind, end, score)."""
    pattern = PATTERNS[kind]
    word = rf"(?i)(?<![a-z])(?:{CONTEXT[kind]})"

    def build(gaps: Column, hits: Column) -> Column:
        steps = F.zip_with(
            F.slice(gaps, 1, F.size(hits)), hits, lambda g, h: (F.char_length(g) + F.char_length(h)).cast("long")
        )

        def placed(steps: Column) -> Column:
            blocks = F.transform(
                F.sequence(F.lit(0), F.floor((F.size(hits) - 1) / BLOCK).cast("int")),
                lambda b: total(F.slice(steps, b * BLOCK + 1, F.lit(BLOCK))),
            )

            def after_blocks(blocks: Column) -> Column:
                offsets = F.transform(blocks, lambda _, b: total(F.slice(blocks, F.lit(1), b)))
                return let(offsets, lambda offsets: F.transform(hits, lambda h, i: one(h, i, offsets)))

            def one(hit: Column, i: Column, offsets: Column) -> Column:
                block = F.floor(i / BLOCK).cast("int")
                gap = F.element_at(gaps, i + 1)
                start = (
                    F.element_at(offsets, block + 1)
                    + total(F.slice(steps, block * BLOCK + 1, i - block * BLOCK))
                    + F.char_length(gap)
                )
                near = F.concat_ws(
                    " ", F.right(gap, F.lit(CONTEXT_CHARS)), F.left(F.element_at(gaps, i + 2), F.lit(CONTEXT_CHARS))
                )
                gain = F.when(near.rlike(word), CONTEXT_GAIN).otherwise(0.0)
                return F.struct(
                    start.alias("start"),
                    F.lit(KINDS.index(kind)).alias("rank"),
                    F.lit(kind).alias("kind"),
                    (start + F.char_length(hit)).alias("end"),
                    (F.lit(SCORES[kind]) + gain).alias("score"),
                    hit.alias("hit"),
                )

            return let(blocks, after_blocks)

        return let(steps, placed)

    kept = F.filter(
        let(
            F.split(text, pattern, -1),
            lambda gaps: let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda hits: build(gaps, hits)),
        ),
        lambda s: confirmed(kind, s["hit"]),
    )
    found = text.rlike(pattern)
    if kind in CONTAINED:
        found = F.contains(text, F.lit(CONTAINED[kind])) & found
    elif kind == "card":
        # At least fourteen digits must follow each other, so most texts need no second pass.
        found = text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}")
    return F.when(found, kept)


def find_personal_data(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", kinds: tuple[str, ...] = KINDS
) -> DataFrame:
    """One row per row of ``docs``: doc_id, found (array of start, rank, kind, end, score, hit; by start, then kind).

    Positions are code points, the end is exclusive. Matches of a kind are leftmost and do not overlap; a match that
    is not confirmed is dropped without another try inside it. Null counts as empty and finds nothing. Repeated rows
    give repeated rows, an empty table an empty result; other columns are not looked at.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    span = "array<struct<start: bigint, rank: int, kind: string, end: bigint, score: double, hit: string>>"
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    parts = [F.coalesce(spans(text, kind).cast(span), F.array().cast(span)) for kind in kinds]
    return rows.select("doc_id", F.array_sort(F.concat(*parts)).alias("found"))
