"""The formula language: tokens, syntax tree and a recursive-descent parser.

Precedence, loosest first: comparison, ``&``, ``+ -``, ``* /``, ``^`` (right-associative), unary signs, postfix ``%``,
``:``. A sign binds tighter than ``^``. ``[col]`` is a whole column of a table, ``[@col]`` its value in this row.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

#: The error codes that formulas can hold.
ERRORS = ("#NULL!", "#DIV/0!", "#VALUE!", "#REF!", "#NAME?", "#NUM!", "#N/A", "#GETTING_DATA", "#SPILL!", "#CALC!")
MAX_ROWS, MAX_COLS = 1_048_576, 16_384


class FormulaError(ValueError):
    """A formula that can't be parsed or compiled."""


@dataclass(frozen=True)
class Num:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Bool:
    value: bool


@dataclass(frozen=True)
class ErrorLit:
    code: str


@dataclass(frozen=True)
class Ref:
    """A rectangle of cells, 0-based and inclusive; a single cell has equal corners. Whole columns or rows are open."""

    sheet: str | None
    row: int
    col: int
    row2: int
    col2: int
    single: bool = True


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Column:
    name: str
    this_row: bool


@dataclass(frozen=True)
class Unary:
    op: str
    arg: object


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Array:
    rows: tuple


_TOKEN = re.compile(
    r"""\s*(?:
    (?P<num>(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)(?![A-Za-z_])
  | (?P<str>"(?:[^"]|"")*")
  | (?P<err>\#(?:NULL!|DIV/0!|VALUE!|REF!|NAME\?|NUM!|N/A|GETTING_DATA|SPILL!|CALC!))
  | (?P<sheet>(?:'(?:[^']|'')+'|[A-Za-z_][\w.]*)!)
  | (?P<tcol>\[@?[^\]]+\])
  | (?P<word>[$]?[^\W\d][\w.$?\\]*|\$\d+|\d+(?=:\$?\d))
  | (?P<op><>|<=|>=|[-+*/^&=<>%:,;(){}])
    )""",
    re.X,
)
_CELL = re.compile(r"\$?([A-Za-z]{1,3})\$?([1-9]\d*)")
_COL = re.compile(r"\$?([A-Za-z]{1,3})")
_ROW = re.compile(r"\$?([1-9]\d*)")


def column_index(letters: str) -> int:
    """A → 0, Z → 25, AA → 26."""
    n = 0
    for ch in letters.upper():
        n = n * 26 + ord(ch) - 64
    return n - 1


@lru_cache(MAX_COLS)
def column_letters(index: int) -> str:
    out = ""
    index += 1
    while index:
        index, rest = divmod(index - 1, 26)
        out = chr(65 + rest) + out
    return out


def cell_name(row: int, col: int) -> str:
    return f"{column_letters(col)}{row + 1}"


def parse_cell(text: str) -> tuple[int, int]:
    """(row, col), 0-based, of a name such as ``B$7``."""
    m = _CELL.fullmatch(text.strip())
    if not m or int(m[2]) > MAX_ROWS or column_index(m[1]) >= MAX_COLS:
        raise FormulaError(f"not a cell: {text}")
    return int(m[2]) - 1, column_index(m[1])


def parse_range(text: str) -> tuple[int, int, int, int]:
    """(row, col, row2, col2) of ``A1`` or ``A1:B2``, with the corners put in order."""
    a, _, b = text.partition(":")
    (r, c), (r2, c2) = parse_cell(a), parse_cell(b or a)
    return min(r, r2), min(c, c2), max(r, r2), max(c, c2)


def tokenize(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise FormulaError(f"unexpected character at {at} in {text!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


_LEVELS = (("=", "<>", "<", ">", "<=", ">="), ("&",), ("+", "-"), ("*", "/"))


class _Parser:
    def __init__(self, text: str):
        self.tokens, self.at = [*tokenize(text), ("end", "")], 0

    def peek(self, *values: str) -> bool:
        kind, value = self.tokens[self.at]
        return kind == "op" and value in values

    def take(self) -> tuple[str, str]:
        self.at += 1
        return self.tokens[self.at - 1]

    def expect(self, value: str) -> None:
        if not self.peek(value):
            raise FormulaError(f"expected {value!r}, found {self.tokens[self.at][1]!r}")
        self.at += 1

    def binary(self, level: int = 0):
        if level == len(_LEVELS):
            return self.power()
        left = self.binary(level + 1)
        while self.peek(*_LEVELS[level]):
            op = self.take()[1]
            left = Binary(op, left, self.binary(level + 1))
        return left

    def power(self):
        base = self.unary()
        if self.peek("^"):
            self.at += 1
            return Binary("^", base, self.power())
        return base

    def unary(self):
        if self.peek("-", "+"):
            op = self.take()[1]
            return Unary(op, self.unary())
        out = self.range()
        while self.peek("%"):
            self.at += 1
            out = Unary("%", out)
        return out

    def range(self):
        left = self.primary()
        if not self.peek(":"):
            return left
        first = self.tokens[self.at - 1][1]
        self.at += 1
        right = self.primary()
        if isinstance(left, Ref) and isinstance(right, Ref):
            sheet = left.sheet or right.sheet
            if right.sheet and right.sheet != sheet:
                raise FormulaError("a range must be on one sheet")
            rows, cols = sorted((left.row, right.row)), sorted((left.col, right.col))
            return Ref(sheet, rows[0], cols[0], rows[1], cols[1], False)
        sheet = left.sheet if isinstance(left, Ref) else None
        words = (first, self.tokens[self.at - 1][1])
        if all(_COL.fullmatch(w) for w in words):
            a, b = sorted(column_index(w.replace("$", "")) for w in words)
            return Ref(sheet, 0, a, MAX_ROWS - 1, b, False)
        if all(_ROW.fullmatch(w) for w in words):
            a, b = sorted(int(w.replace("$", "")) - 1 for w in words)
            return Ref(sheet, a, 0, b, MAX_COLS - 1, False)
        raise FormulaError("':' needs two references")

    def primary(self):
        kind, value = self.take()
        if kind == "num":
            return Num(float(value))
        if kind == "str":
            return Text(value[1:-1].replace('""', '"'))
        if kind == "err":
            return ErrorLit(value)
        if kind == "tcol":
            return Column(value.strip("[]").lstrip("@"), value[1] == "@")
        if kind == "sheet":
            sheet = value[:-1]
            sheet = sheet[1:-1].replace("''", "'") if sheet[0] == "'" else sheet
            kind, value = self.take()
            if kind != "word":
                raise FormulaError("a sheet name needs a reference")
            if _CELL.fullmatch(value):
                r, c = parse_cell(value)
                return Ref(sheet, r, c, r, c)
            if self.peek(":"):
                return Ref(sheet, -1, -1, -1, -1)
            return Name(f"{sheet}!{value}")
        if kind == "word":
            if self.peek("("):
                self.at += 1
                args = []
                if not self.peek(")"):
                    args.append(self.binary())
                    while self.peek(","):
                        self.at += 1
                        args.append(self.binary())
                self.expect(")")
                return Call(value.upper(), tuple(args))
            if value.upper() in ("TRUE", "FALSE"):
                return Bool(value.upper() == "TRUE")
            if (m := _CELL.fullmatch(value)) and int(m[2]) <= MAX_ROWS and column_index(m[1]) < MAX_COLS:
                r, c = parse_cell(value)
                return Ref(None, r, c, r, c)
            return Name(value)
        if (kind, value) == ("op", "("):
            out = self.binary()
            self.expect(")")
            return out
        if (kind, value) == ("op", "{"):
            rows = [[self.literal()]]
            while self.peek(",", ";"):
                if self.take()[1] == ";":
                    rows.append([])
                rows[-1].append(self.literal())
            self.expect("}")
            if len({len(r) for r in rows}) != 1:
                raise FormulaError("rows of an array differ in length")
            return Array(tuple(tuple(r) for r in rows))
        raise FormulaError(f"unexpected {value!r}")

    def literal(self):
        return self.unary()


def parse(text: str):
    """The tree of a formula, with or without its leading ``=``."""
    p = _Parser(text.strip().removeprefix("="))
    out = p.binary()
    if p.tokens[p.at][0] != "end":
        raise FormulaError(f"unexpected {p.tokens[p.at][1]!r} after the formula")
    return out


def walk(node):
    """The node and all below it."""
    yield node
    for below in (getattr(node, "arg", None), getattr(node, "left", None), getattr(node, "right", None)):
        if below is not None:
            yield from walk(below)
    for below in getattr(node, "args", ()):
        yield from walk(below)
    for row in getattr(node, "rows", ()):
        for below in row:
            yield from walk(below)
