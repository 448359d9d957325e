"""Values of the cell-by-cell evaluator: None (empty), bool, float, str, Err, and arrays as lists of rows."""

from __future__ import annotations

import re
from dataclasses import dataclass
from datetime import date, timedelta
from decimal import Decimal

_NUMBER = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


@dataclass(frozen=True)
class Err(Exception):
    """An error value; raised inside functions, caught where a value is stored or tested."""

    code: str


DIV0, VALUE, REF, NAME, NUM, NA = map(Err, ("#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A"))
SPILL, CALC = Err("#SPILL!"), Err("#CALC!")


def is_array(v) -> bool:
    return isinstance(v, list)


def cells(v):
    """All elements of a scalar or array, row by row."""
    if is_array(v):
        for row in v:
            yield from row
    else:
        yield v


def number(v) -> float:
    """Operator coercion: empty is 0, booleans 1 and 0, numeric text its number."""
    if isinstance(v, Err):
        raise v
    if v is None:
        return 0.0
    if isinstance(v, (bool, int, float)):
        return float(v)
    if isinstance(v, str) and _NUMBER.fullmatch(v):
        return float(v)
    raise VALUE


def pure_number(v) -> float:
    """Function coercion: a number or empty, nothing else."""
    if isinstance(v, Err):
        raise v
    if v is None:
        return 0.0
    if isinstance(v, bool) or not isinstance(v, (int, float)):
        raise VALUE
    return float(v)


def text(v) -> str:
    """Text rendering: whole numbers without a point, never an exponent."""
    if isinstance(v, Err):
        raise v
    if v is None:
        return ""
    if isinstance(v, bool):
        return "TRUE" if v else "FALSE"
    if isinstance(v, str):
        return v
    if is_array(v):
        raise VALUE
    if v == int(v) if abs(v) < 1e300 else True:
        return str(int(v))
    out = format(Decimal(repr(v)), "f")
    return out.rstrip("0").rstrip(".") if "." in out else out


def rank(v) -> int:
    return 2 if isinstance(v, bool) else 1 if isinstance(v, str) else 0


def compare(a, b) -> int:
    """-1, 0 or 1: numbers before text before booleans, text without regard to case, empty as 0."""
    for v in (a, b):
        if isinstance(v, Err):
            raise v
    a, b = (0.0 if v is None else v for v in (a, b))
    if rank(a) != rank(b):
        return -1 if rank(a) < rank(b) else 1
    if isinstance(a, str):
        a, b = a.lower(), b.lower()
    return (a > b) - (a < b)


def _ascii_lower(s: str) -> str:
    return "".join(c.lower() if c.isascii() else c for c in s)


def equal(a, b) -> bool:
    """Equality of lookups: numeric text equals its number, empty equals 0 and empty text, booleans only booleans."""
    if isinstance(a, Err) or isinstance(b, Err):
        return False
    if isinstance(a, bool) or isinstance(b, bool):
        return isinstance(a, bool) and isinstance(b, bool) and a == b
    if a is None or b is None:
        return all(v is None or v == "" or v == 0 for v in (a, b))
    if isinstance(a, str) and isinstance(b, str):
        return _ascii_lower(a) == _ascii_lower(b)
    try:
        return number(a) == number(b)
    except Err:
        return False


# Serial dates -----------------------------------------------------------------------------------------------------


def serial_of(d: date, date_1904: bool = False) -> float:
    """Serial number of a date; the 1900 system counts a 1900-02-29 that never was."""
    if date_1904:
        return float((d - date(1904, 1, 1)).days)
    return float((d - date(1899, 12, 30)).days if d >= date(1900, 3, 1) else (d - date(1899, 12, 31)).days)


def date_of(serial: float, date_1904: bool = False) -> tuple[int, int, int]:
    """(year, month, day) of a serial number."""
    n = int(serial // 1)
    if n < 0 or n > 2_958_465:
        raise NUM
    if date_1904:
        d = date(1904, 1, 1) + timedelta(n)
    elif n == 60:
        return 1900, 2, 29
    elif n == 0:
        return 1900, 1, 0
    else:
        d = date(1899, 12, 30 if n > 60 else 31) + timedelta(n)
    return d.year, d.month, d.day
