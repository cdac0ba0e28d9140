"""Secret scan: keyword automaton, anchored patterns near its hits, checksum validation.

An Aho-Corasick automaton finds all keywords of all kinds in one pass over a text. Each hit starts an anchored
match of its kind's pattern at that place, unless an earlier match of the kind covers it; this gives the leftmost
non-overlapping matches without searching. Runs of hexadecimal digits have no keyword: a probe of every 32nd byte
finds the places a long run must touch. Kinds with an embedded checksum are only reported if it holds.
"""

from __future__ import annotations

import re
import zlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from prepflow.llm.common import map_texts

# The kinds in their order, their keywords and patterns. All are ASCII; texts are matched as UTF-8.
BASE_KINDS = ("assign", "access", "hex")
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ASSIGN = re.compile(
    rb"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
ASSIGN_LEAST = 8
ACCESS_WORD = "akia"
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
ACCESS_LEAST = 16
HEX_DIGITS = b"0123456789abcdef"
HEX_LEAST = 32
CHECKED_WORDS = ("ghp_", "gho_", "ghu_", "ghs_", "ghr_", "npm_")
CHECKED = re.compile(rb"(?:gh[pousr]|npm)_([A-Za-z0-9]{30})([A-Za-z0-9]{6})(?![A-Za-z0-9])")
BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
KEY_WORD = "-----begin "
KEY = re.compile(rb"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----")

KINDS = (*BASE_KINDS, "checked_token", "private_key")


def base62_crc(body: bytes) -> bytes:
    """CRC-32 of a token's random part in six base-62 digits, as such tokens end with it."""
    value, digits = zlib.crc32(body), ""
    for _ in range(6):
        value, digit = divmod(value, 62)
        digits = BASE62[digit] + digits
    return digits.encode()


def automaton() -> ahocorasick.Automaton:
    found = ahocorasick.Automaton()
    for kind, keywords in (
        ("assign", ASSIGN_WORDS),
        ("access", (ACCESS_WORD,)),
        ("checked_token", CHECKED_WORDS),
        ("private_key", (KEY_WORD,)),
    ):
        for word in keywords:
            found.add_word(word, (kind, len(word)))
    found.make_automaton()
    return found


IS_HEX = np.zeros(256, bool)
IS_HEX[list(HEX_DIGITS)] = True


def hex_runs(data: bytes) -> list[tuple[int, int]]:
    """Runs of at least HEX_LEAST digits: each covers a probed byte, from which it is widened both ways."""
    runs, done = [], 0
    probes = np.flatnonzero(IS_HEX[np.frombuffer(data, np.uint8)[HEX_LEAST - 1 :: HEX_LEAST]])
    for probe in (probes * HEX_LEAST + HEX_LEAST - 1).tolist():
        if probe < done:
            continue
        start = probe
        while start > done and data[start - 1] in HEX_DIGITS:
            start -= 1
        end = probe + 1
        while end < len(data) and data[end] in HEX_DIGITS:
            end += 1
        done = end
        if end - start >= HEX_LEAST:
            runs.append((start, end))
    return runs


def find_secrets(data: bytes, words: ahocorasick.Automaton) -> list[tuple[str, int, int]]:
    """(kind, start, end) in bytes, unordered."""
    spans = [("hex", a, b) for a, b in hex_runs(data)]
    done = dict.fromkeys(KINDS, 0)
    # Keywords of a kind have different lengths, so hits are put in order of their starts.
    lowered = data.lower().decode("latin-1")
    hits = sorted((end - size + 1, kind) for end, (kind, size) in words.iter(lowered))
    for start, kind in hits:
        if start < done[kind]:
            continue
        if kind == "assign":
            if match := ASSIGN.match(data, start):
                done[kind] = match.end()
                if len(match[2]) >= ASSIGN_LEAST:
                    spans.append((kind, start, match.end()))
        elif kind == "access":
            if match := ACCESS.match(data, start):
                done[kind] = match.end()
                if match.end() - start >= ACCESS_LEAST:
                    spans.append((kind, start, match.end()))
        elif kind == "checked_token":
            if (match := CHECKED.match(data, start)) and base62_crc(match[1]) == match[2]:
                done[kind] = match.end()
                spans.append((kind, start, match.end()))
        elif match := KEY.match(data, start):
            done[kind] = match.end()
            spans.append((kind, start, match.end()))
    return spans


def in_code_points(data: bytes, spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """The same spans counted in code points, by start and then kind."""
    if spans and not data.isascii():
        starts = np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)
        at = lambda i: int(starts[i - 1]) if i else 0
        spans = [(kind, at(a), at(b)) for kind, a, b in spans]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, found (array of kind, start, end in code points, end exclusive).

    Whole texts are scanned; null counts as empty and finds nothing. Repeated rows give repeated rows, an empty
    table an empty result; other columns are not looked at.
    """

    def make():
        words = automaton()

        def one(text: str | None) -> tuple:
            data = (text or "").encode()
            spans = in_code_points(data, find_secrets(data, words))
            return ([{"kind": k, "start": a, "end": b} for k, a, b in spans],)

        return one

    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
    return map_texts(
        docs, make, [("found", span)], "found array<struct<kind: string, start: bigint, end: bigint>>", id_col, text_col
    )

