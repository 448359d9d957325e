"""Criteria of the conditional aggregates, as a predicate on values and as a Spark column.

A number or boolean matches numeric cells within 1e-10; text may begin with a comparison of numbers, or be a number,
or a pattern with ``*`` and ``?`` that is matched without regard to case; empty text matches empty cells. With
strict=False comparisons of text (``<>text``, ``>a``) and the ``~`` escape work as well.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.plans.values import Err, text

NEAR = 1e-10
_OP = re.compile(r"(<>|<=|>=|<|>|=)(.*)", re.S)
_NUMBER = re.compile(r"\s*[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?\s*")


@dataclass(frozen=True)
class Criterion:
    """kind: number (op, value), pattern (regex), text (op, value) or empty."""

    kind: str
    op: str = "="
    value: object = None


def _pattern(s: str, escape: bool) -> str:
    out, i = "", 0
    while i < len(s):
        if escape and s[i] == "~" and i + 1 < len(s) and s[i + 1] in "*?~":
            i += 1
            out += re.escape(s[i])
        else:
            out += ".*" if s[i] == "*" else "." if s[i] == "?" else re.escape(s[i])
        i += 1
    return out


def parse(v, strict: bool = True) -> Criterion:
    if isinstance(v, bool):
        return Criterion("number", "=", float(v))
    if isinstance(v, (int, float)):
        return Criterion("number", "=", float(v))
    if v is None or isinstance(v, (Err, list)) or not (v := v.strip()):
        return Criterion("empty")
    if m := _OP.fullmatch(v):
        if _NUMBER.fullmatch(m[2]):
            return Criterion("number", m[1], float(m[2]))
        if not strict:
            if m[2] == "":
                return Criterion("empty" if m[1] == "=" else "filled") if m[1] in ("=", "<>") else Criterion("text", m[1], "")
            if m[1] in ("=", "<>"):
                return Criterion("pattern", m[1], _pattern(m[2].strip().lower(), True))
            return Criterion("text", m[1], m[2].lower())
    if _NUMBER.fullmatch(v):
        return Criterion("number", "=", float(v))
    return Criterion("pattern", "=", _pattern(v.strip().lower(), not strict))


def _test(op: str, a, b):
    return {"=": lambda: a == b, "<>": lambda: a != b, "<": lambda: a < b, "<=": lambda: a <= b, ">": lambda: a > b, ">=": lambda: a >= b}[op]()


def matches(c: Criterion, v) -> bool:
    """Whether a cell value matches."""
    if c.kind == "empty":
        return v is None or v == ""
    if c.kind == "filled":
        return not (v is None or v == "")
    if isinstance(v, (Err, list)):
        return False
    if c.kind == "number":
        if isinstance(v, str) or v is None:
            return False
        x = float(v)
        return abs(x - c.value) < NEAR if c.op == "=" else abs(x - c.value) >= NEAR if c.op == "<>" else _test(c.op, x, c.value)
    shown = text(v).strip().lower()
    if c.kind == "pattern":
        return (re.fullmatch(c.value, shown, re.S) is not None) == (c.op == "=")
    return isinstance(v, str) and _test(c.op, shown, c.value)


def column(c: Criterion, col: Column, kind: str, shown: Column) -> Column:
    """The same test on a column of one kind (num, bool or text); ``shown`` is its text rendering. Never null."""
    if c.kind == "empty":
        return col.isNull() | ((col == "") if kind == "text" else F.lit(False))
    if c.kind == "filled":
        return col.isNotNull() & ((col != "") if kind == "text" else F.lit(True))
    if c.kind == "number":
        if kind == "text":
            return F.lit(False)
        x = col.cast("double")
        test = F.abs(x - c.value) < NEAR if c.op == "=" else F.abs(x - c.value) >= NEAR if c.op == "<>" else _test(c.op, x, F.lit(c.value))
        return F.coalesce(test, F.lit(False))
    low = F.lower(F.trim(F.coalesce(shown, F.lit(""))))
    if c.kind == "pattern":
        plain = re.sub(r"\\(.)", r"\1", c.value)
        hit = low.rlike(f"(?s)^(?:{c.value})$") if re.search(r"(?<!\\)\.", c.value) else low == plain
        return hit if c.op == "=" else ~hit
    return F.coalesce(_test(c.op, low, F.lit(c.value)), F.lit(False)) if kind == "text" else F.lit(False)
