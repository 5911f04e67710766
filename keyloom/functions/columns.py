"""Column helpers shared by the operators: index ranges, globs, score and lexical bounds, slots."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F


def from_end(i: int, n: Column) -> Column:
    """An index where negative numbers count from the end, not below 0."""
    return F.lit(i) if i >= 0 else F.greatest(n + i, F.lit(0))


def in_range(pos: Column, n: Column, start: int, stop: int) -> Column:
    """Whether 0-based ``pos`` of ``n`` lies in the inclusive range; negative ends count from the end."""
    last = F.lit(stop) if stop >= 0 else n + stop
    return (pos >= from_end(start, n)) & (pos <= last)


def glob_to_regex(pattern: str) -> str:
    """An anchored regular expression of a key glob: ``*``, ``?``, ``[a-z]``, ``[^x]`` and backslash escapes."""
    out, i = "", 0
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "\\" and i + 1 < len(pattern):
            i += 1
            out += re.escape(pattern[i])
        elif c == "[" and (end := pattern.find("]", i + 2 if pattern[i + 1 : i + 2] == "^" else i + 1)) > 0:
            body = pattern[i + 1 : end]
            negated, body = (True, body[1:]) if body[:1] == "^" else (False, body)
            safe = re.sub(r"([\\\[\]&~^])", r"\\\1", body)
            out += f"[{'^' if negated else ''}{safe}]" if body else ("." if negated else "(?!)")
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}$"


def matches(c: Column, pattern: str) -> Column:
    return c.rlike(glob_to_regex(pattern))


def capturing_glob(pattern: str) -> str:
    """An anchored regular expression of a policy glob, in which every ``*`` captures."""
    return "(?s)^" + "".join({"*": "(.*)", "?": "."}.get(c, re.escape(c)) for c in pattern) + "$"


def score_between(score: Column, low: str, high: str) -> Column:
    """A score range in command syntax: inclusive, ``(`` exclusive, ``-inf`` and ``+inf``. NaN scores are in none."""

    def end(text: str) -> tuple[bool, float]:
        return (False, float(text[1:])) if text.startswith("(") else (True, float(text))

    (li, lo), (hi_inclusive, hi) = end(low), end(high)
    if lo == float("inf") or hi == float("-inf"):
        return F.lit(False)
    above = F.lit(True) if lo == float("-inf") else (score >= lo if li else score > lo)
    below = F.lit(True) if hi == float("inf") else (score <= hi if hi_inclusive else score < hi)
    return above & below & ~F.isnan(score)


def lex_between(member: Column, low: str, high: str) -> Column:
    """A lexical range in command syntax: ``[x``, ``(x``, ``-``, ``+``; compared bytewise."""

    def side(text: str, less: bool) -> Column:
        if text == ("-" if less else "+"):
            return F.lit(True)
        if text in "-+" or text[:1] not in "[(":
            if text in "-+":
                return F.lit(False)
            raise ValueError(f"not a lexical bound: {text!r}")
        value = F.lit(text[1:].rstrip("])")).cast("binary")
        m = member.cast("binary")
        if less:
            return m >= value if text[0] == "[" else m > value
        return m <= value if text[0] == "[" else m < value

    return side(low, True) & side(high, False)


def slot(key: Column, slots: int = 16384) -> Column:
    """Key to slot: the CRC-16/USB of the ``{tag}`` in the key, or of the whole key, modulo the number of slots."""
    tag = F.regexp_extract(key, r"^[^{]*\{([^}]+)\}", 1)
    hashed = F.when(tag != "", tag).otherwise(key).cast("binary")
    width = F.octet_length(hashed)
    byte = lambda i: F.conv(F.hex(F.substring(hashed, i, F.lit(1))), 16, 10).cast("int")

    def shift(crc: Column) -> Column:
        half = F.shiftrightunsigned(crc, 1)
        return F.when(crc.bitwiseAND(1) == 1, half.bitwiseXOR(0xA001)).otherwise(half)

    def step(crc: Column, i: Column) -> Column:
        return F.aggregate(F.sequence(F.lit(1), F.lit(8)), crc.bitwiseXOR(byte(i)), lambda c, _: shift(c))

    steps = F.when(width > 0, F.sequence(F.lit(1), width)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.lit(0xFFFF), step, lambda c: c.bitwiseXOR(0xFFFF) % slots)


def epoch_millis(ts: Column) -> Column:
    """Milliseconds since 1970 of a timestamp without time zone, whatever the session's zone."""
    return F.timestamp_diff("MILLISECOND", F.expr("TIMESTAMP_NTZ '1970-01-01 00:00:00'"), ts)


def number_text(x: Column) -> Column:
    """A score as text: whole numbers without a fraction, others in the shortest form that reads back."""
    return F.when((x == F.floor(x)) & (F.abs(x) < 1e15), x.cast("bigint").cast("string")).otherwise(x.cast("string"))
