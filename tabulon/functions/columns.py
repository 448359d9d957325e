"""The functions as Spark columns. A value is a Val: a column of one kind with an optional column of error codes.

Everything stays in built-in expressions, so whole formulas are part of whole-stage code generation, and aggregates
of one table are one partial and one final hash aggregation.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.operators import criteria
from tabulon.plans.parser import FormulaError

NUMERIC = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"
TABLE: dict[str, tuple[int, int | None, object]] = {}


@dataclass(frozen=True)
class Val:
    """kind: num, text, bool or empty. err is null where there is no error, None where there can't be one.

    array marks a whole column (one element per row); null stands for an empty cell where may_be_empty says so.
    """

    kind: str
    col: Column | None
    err: Column | None = None
    array: bool = False
    may_be_empty: bool = False
    literal: object = None
    native: Column | None = None  # the date or timestamp behind a serial number


def num(col, err=None, **k) -> Val:
    return Val("num", col, err, **k)


def lit(v) -> Val:
    if v is None:
        return Val("empty", F.lit(None), literal=None)
    if isinstance(v, bool):
        return Val("bool", F.lit(v), literal=v)
    if isinstance(v, (int, float)):
        return Val("num", F.lit(float(v)), literal=float(v))
    return Val("text", F.lit(v), literal=v)


def error(code: str) -> Val:
    return Val("empty", F.lit(None).cast("double"), F.lit(code))


def errs(*values) -> Column | None:
    """The first error of several values or error columns, left to right."""
    found = [e for v in values if (e := v.err if isinstance(v, Val) else v) is not None]
    return None if not found else found[0] if len(found) == 1 else F.coalesce(*found)


def when_error(test: Column, code: str) -> Column:
    return F.when(test, F.lit(code))


def as_number(v: Val) -> tuple[Column, Column | None]:
    """Operator coercion: (double without nulls, error)."""
    if v.kind == "empty":
        return F.lit(0.0), v.err
    if v.kind == "text":
        ok = F.coalesce(v.col, F.lit("")).rlike(NUMERIC)
        own = F.when(v.col.isNotNull() & ~ok, F.lit("#VALUE!"))
        return F.coalesce(F.when(ok, v.col.try_cast("double")), F.lit(0.0)), errs(v, own)
    col = v.col.cast("double")
    return (F.coalesce(col, F.lit(0.0)) if v.may_be_empty or v.err is not None else col), v.err


def pure_number(v: Val) -> tuple[Column, Column | None]:
    """Function coercion: numbers and empty cells only."""
    if v.kind in ("text", "bool"):
        own = F.when(v.col.isNotNull(), F.lit("#VALUE!")) if v.may_be_empty else F.lit("#VALUE!")
        return F.lit(0.0), errs(v, own)
    return as_number(v)


def render(x: Column) -> Column:
    """A double as text: whole numbers without a point, never an exponent."""
    plain = x.cast("string")
    long = F.regexp_replace(F.regexp_replace(x.try_cast("decimal(38,15)").cast("string"), "0+$", ""), "\\.$", "")
    whole = (x == F.floor(x).cast("double")) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).when(plain.contains("E"), F.coalesce(long, x.try_cast("decimal(38,0)").cast("string"), plain)).otherwise(plain)


def as_text(v: Val) -> Column:
    """Text rendering without nulls."""
    if v.kind == "empty":
        return F.lit("")
    if v.kind == "bool":
        shown = F.when(v.col, "TRUE").when(~v.col, "FALSE")
    else:
        shown = render(v.col) if v.kind == "num" else v.col
    return F.coalesce(shown, F.lit("")) if v.may_be_empty or v.err is not None else shown


def truth(v: Val) -> tuple[Column, Column | None]:
    """A condition: booleans and numbers only."""
    if v.kind in ("text", "empty"):
        return F.lit(False), errs(v, F.lit("#VALUE!"))
    c = v.col if v.kind == "bool" else v.col != 0
    own = when_error(v.col.isNull(), "#VALUE!") if v.may_be_empty else None
    return F.coalesce(c, F.lit(False)) if v.may_be_empty or v.err is not None else c, errs(v, own)


def function(*names: str, args: tuple[int, int | None]):
    def put(f):
        for n in names:
            TABLE[n] = (*args, f)
        return f

    return put


def array_of(*values: Val) -> bool:
    return any(v.array for v in values)


# One number -------------------------------------------------------------------------------------------------------


def _unary(name: str, f, bad=None, code: str = "#NUM!", after=None):
    """f on a double; bad tests the argument, after the result."""

    def run(env, v):
        x, e = pure_number(v)
        own = when_error(bad(x), code) if bad else None
        safe = F.when(~bad(x), x) if bad else x
        out = f(safe).cast("double")
        if after:
            own = errs(own, when_error(F.coalesce(after(out), F.lit(False)), code))
        return num(out, errs(e, own), array=v.array)

    function(name, args=(1, 1))(run)


def _infinite(x: Column) -> Column:
    return F.isnan(x) | (F.abs(x) == float("inf"))


def _whole(f):
    """floor or ceil that stays a double beyond the range of a long."""
    return lambda x: F.when(F.abs(x) < 9e18, f(x).cast("double")).otherwise(x)


floor, ceil = _whole(F.floor), _whole(F.ceil)
for _n, _f in {"ABS": F.abs, "INT": floor, "SIGN": F.signum, "SIN": F.sin, "COS": F.cos, "ATAN": F.atan, "DEGREES": F.degrees, "RADIANS": F.radians}.items():
    _unary(_n, _f)
_unary("SQRT", F.sqrt, lambda x: x < 0)
_unary("LOG10", F.log10, lambda x: x <= 0)
_unary("LN", F.ln, lambda x: x <= 0)
_unary("EXP", F.exp, after=_infinite)
_unary("TAN", F.tan, after=_infinite)
_unary("ASIN", F.asin, lambda x: (x < -1) | (x > 1))
_unary("ACOS", F.acos, lambda x: (x < -1) | (x > 1))


def _parity(odd: bool):
    def f(x):
        n = ceil(F.abs(x))
        n = n + F.when(n % 2 == (0 if odd else 1), 1.0).otherwise(0.0)
        return F.when(x < 0, -n).otherwise(n)

    return f


_unary("ODD", _parity(True))
_unary("EVEN", _parity(False))

function("PI", args=(0, 0))(lambda env: lit(math.pi))
function("RAND", args=(0, 0))(lambda env: num(F.rand()))


@function("RANDBETWEEN", args=(2, 2))
def randbetween(env, a, b):
    (x, e), (y, g) = pure_number(a), pure_number(b)
    low, high = ceil(x), floor(y)
    return num(floor(F.rand() * (high - low + 1)) + low, errs(e, g, when_error(low > high, "#NUM!")))


def _rounding(name, f, least):
    def run(env, v, d=None):
        x, e = pure_number(v)
        n, g = pure_number(d) if d is not None else (F.lit(0.0), None)
        p = F.lit(10.0 ** math.trunc(d.literal)) if d is not None and isinstance(d.literal, float) else F.pow(F.lit(10.0), F.when(n >= 0, floor(n)).otherwise(ceil(n)))
        if d is None:
            p = F.lit(1.0)
        return num(f(x, p), errs(e, g), array=v.array)

    function(name, args=(least, 2))(run)


_toward = lambda x, p: F.when(x >= 0, floor(x * p)).otherwise(ceil(x * p)) / p
_rounding("ROUND", lambda x, p: F.when(x >= 0, floor(x * p + 0.5)).otherwise(ceil(x * p - 0.5)) / p, 1)
_rounding("TRUNC", _toward, 1)
_rounding("ROUNDDOWN", _toward, 2)
_rounding("ROUNDUP", lambda x, p: F.when(x >= 0, ceil(x * p)).otherwise(floor(x * p)) / p, 2)


@function("MOD", args=(2, 2))
def mod(env, a, b):
    (n, e), (d, g) = pure_number(a), pure_number(b)
    safe = F.when(d != 0, d)
    out = n - safe * floor(n / safe)
    inside = F.when(d > 0, (out >= 0) & (out < d)).otherwise((out <= 0) & (out > d))
    return num(out, errs(e, g, when_error(d == 0, "#DIV/0!"), when_error(~inside, "#VALUE!")), array=array_of(a, b))


def raise_to(x: Column, y: Column) -> tuple[Column, Column]:
    out = F.pow(x, y)
    return out, when_error(_infinite(out), "#NUM!")


@function("POWER", args=(2, 2))
def power(env, a, b):
    (x, e), (y, g) = pure_number(a), pure_number(b)
    out, own = raise_to(x, y)
    return num(out, errs(e, g, own), array=array_of(a, b))


@function("LOG", args=(1, 2))
def log(env, a, b=None):
    (x, e), (y, g) = pure_number(a), pure_number(b or lit(10.0))
    bad = (x <= 0) | (y <= 0) | (y == 1)
    return num(F.when(~bad, F.ln(x) / F.ln(y)), errs(e, g, when_error(bad, "#NUM!")), array=a.array)


@function("ATAN2", args=(2, 2))
def atan2(env, a, b):
    (x, e), (y, g) = pure_number(a), pure_number(b)
    return num(F.atan2(y, x), errs(e, g, when_error((x == 0) & (y == 0), "#DIV/0!")), array=array_of(a, b))


def _multiple(name: str, up: bool):
    def run(env, v, step=None, mode=None):
        (x, e), (s, g), (m, h) = pure_number(v), pure_number(step or lit(1.0)), pure_number(mode or lit(0.0))
        s = F.abs(s)
        q = x / F.when(s != 0, s)
        towards, away = (ceil, floor) if up else (floor, ceil)
        out = F.when((x < 0) & (m != 0), away(q)).otherwise(towards(q)) * s
        return num(F.coalesce(out, F.lit(0.0)), errs(e, g, h), array=v.array)

    function(name, args=(1, 3))(run)


_multiple("CEILING.MATH", True)
_multiple("FLOOR.MATH", False)

# Logical ----------------------------------------------------------------------------------------------------------


def merge(*values: Val) -> tuple[str, list[Column]]:
    """A kind that all values fit (text where they differ), and their columns in it."""
    kinds = {v.kind for v in values if v.kind != "empty"}
    kind = kinds.pop() if len(kinds) == 1 else "text" if kinds else "empty"
    if kind == "empty":
        return "empty", [F.lit(None).cast("double") for _ in values]
    type_ = {"num": "double", "text": "string", "bool": "boolean"}[kind]
    cols = []
    for v in values:
        if v.kind == kind:
            cols.append(v.col.cast(type_))
        elif v.kind == "empty":
            cols.append(F.lit(None).cast(type_))
        else:
            cols.append(F.when(v.col.isNotNull(), as_text(v)))
    return kind, cols


def choose_by(tests: list[tuple[Column, Val]], other: Val, err: Column | None, arrays: bool = False) -> Val:
    """CASE over values, with the error of the branch that is taken."""
    values = [v for _, v in tests] + [other]
    kind, cols = merge(*values)
    col, own = cols[-1], other.err if other.err is not None else F.lit(None).cast("string")
    for (test, v), c in zip(reversed(tests), reversed(cols[:-1]), strict=True):
        col = F.when(test, c).otherwise(col)
        own = F.when(test, v.err if v.err is not None else F.lit(None).cast("string")).otherwise(own)
    any_err = any(v.err is not None for v in values)
    return Val(kind, col, errs(err, own if any_err else None), arrays or array_of(*values), any(v.may_be_empty or v.kind == "empty" for v in values))


@function("IF", args=(2, 3))
def if_(env, c, a, b=None):
    test, e = truth(c)
    return choose_by([(test, a)], b or lit(False), e, c.array)


def _logical(v: Val) -> Column | None:
    return None if v.kind in ("text", "empty") else v.col if v.kind == "bool" else v.col != 0


def _fold(name, stop: bool):
    """AND / OR: the first decisive value or error in argument order wins."""

    def run(env, *args):
        out, err = F.lit(not stop), F.lit(None).cast("string")
        for v in reversed(args):
            c = _logical(v)
            if v.array:
                env.aggregate_only(name)
                e = F.min(v.err) if v.err is not None else None
                c = None if c is None else F.coalesce((F.some if stop else F.every)(c), F.lit(not stop))
                v = replace(v, err=e)
            if c is not None:
                hit = F.coalesce(c == stop, F.lit(False))
                out = F.when(hit, stop).otherwise(out)
                err = F.when(hit, F.lit(None).cast("string")).otherwise(err)
            if v.err is not None:
                err = F.coalesce(v.err, err)
        return Val("bool", out, err if any(v.err is not None for v in args) else None)

    function(name, args=(1, None))(run)


_fold("AND", False)
_fold("OR", True)


@function("XOR", args=(1, None))
def xor(env, *args):
    total = F.lit(0)
    for v in args:
        c = _logical(v)
        if c is None:
            continue
        one = F.when(c, 1).otherwise(0)
        if v.array:
            env.aggregate_only("XOR")
            one = F.coalesce(F.sum(one), F.lit(0))
        total = total + one
    return Val("bool", total % 2 == 1, errs(*[replace(v, err=F.min(v.err)) if v.array and v.err is not None else v for v in args]))


@function("NOT", args=(1, 1))
def not_(env, v):
    c, e = truth(v)
    return Val("bool", ~c, e, v.array)


function("TRUE", args=(0, 0))(lambda env: lit(True))
function("FALSE", args=(0, 0))(lambda env: lit(False))


@function("IFERROR", args=(2, 2))
def iferror(env, v, alt):
    if v.err is None:
        return v
    return choose_by([(v.err.isNotNull(), alt)], replace(v, err=None), None)


@function("IFNA", args=(2, 2))
def ifna(env, v, alt):
    if v.err is None:
        return v
    na = v.err.eqNullSafe("#N/A")
    return choose_by([(na, alt)], v, None)


@function("IFS", args=(2, None))
def ifs(env, *args):
    if len(args) % 2:
        return error("#VALUE!")
    tests, err, open_ = [], None, F.lit(True)
    for c, v in zip(args[::2], args[1::2]):
        if c.kind == "text":
            low = F.lower(c.col)
            test, e = F.coalesce(low == "true", F.lit(False)), errs(c, F.when(~low.isin("true", "false"), "#VALUE!"))
        elif c.kind == "empty":
            test, e = F.lit(False), c.err
        else:
            test, e = truth(replace(c, may_be_empty=False, col=F.coalesce(c.col.cast("double"), F.lit(0.0)) != 0, kind="bool"))
        if e is not None:
            err = errs(err, F.when(open_, e))
        tests.append((test, v))
        open_ = open_ & ~test
    return choose_by(tests, error("#N/A"), err, array_of(*args))


@function("SWITCH", args=(3, None))
def switch(env, v, *args):
    def same(a: Val, b: Val) -> Column:
        if "text" in (a.kind, b.kind):
            if a.kind == b.kind:
                return F.lower(F.coalesce(a.col, F.lit(""))) == F.lower(F.coalesce(b.col, F.lit("")))
            other = b if a.kind == "text" else a
            mine = a if a.kind == "text" else b
            return (F.coalesce(mine.col, F.lit("")) == "") & other.col.isNull()
        return F.abs(as_number(a)[0] - as_number(b)[0]) < 1e-10

    tests = [(same(v, args[i]), args[i + 1]) for i in range(0, len(args) - 1, 2)]
    return choose_by(tests, args[-1] if len(args) % 2 else error("#N/A"), errs(v), v.array)


@function("CHOOSE", args=(2, None))
def choose(env, i, *args):
    x, e = pure_number(i)
    k = F.when(x >= 0, floor(x)).otherwise(ceil(x))
    return choose_by([(k == n, v) for n, v in enumerate(args, 1)], error("#VALUE!"), e, i.array)


# Text -------------------------------------------------------------------------------------------------------------


def txt(col, err, *of: Val) -> Val:
    return Val("text", col, err, array_of(*of))


def count_of(v: Val | None, default: float) -> tuple[Column, Column | None]:
    """A count: truncated; text that is no number counts as 0."""
    if v is None:
        return F.lit(int(default)), None
    if v.literal is not None and isinstance(v.literal, float):
        return F.lit(math.trunc(v.literal)), v.err
    if v.kind == "text":
        x = F.coalesce(v.col.try_cast("double"), F.lit(0.0))
        return x.cast("int"), v.err
    return as_number(v)[0].cast("int"), v.err


for _name, _text_f in {
    "LOWER": F.lower, "UPPER": F.upper, "TRIM": lambda s: F.trim(F.regexp_replace(s, r"(?U)\s+", " ")), "CLEAN": lambda s: F.regexp_replace(s, r"[\x00-\x1f]", ""),
    "PROPER": lambda s: F.array_join(F.transform(F.regexp_extract_all(F.lower(s), F.lit(r"[\p{L}\p{N}]+|[^\p{L}\p{N}]+"), F.lit(0)), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 2**31 - 1))), ""),
}.items():
    function(_name, args=(1, 1))(lambda env, v, f=_text_f: txt(f(as_text(v)), v.err, v))

function("LEN", "LENB", args=(1, 1))(lambda env, v: num(F.length(as_text(v)).cast("double"), v.err, array=v.array))


@function("LEFT", "LEFTB", args=(1, 2))
def left(env, v, n=None):
    k, e = count_of(n, 1)
    return txt(F.left(as_text(v), k), errs(v, e, when_error(k < 0, "#VALUE!")), v)


@function("RIGHT", "RIGHTB", args=(1, 2))
def right(env, v, n=None):
    k, e = count_of(n, 1)
    return txt(F.right(as_text(v), k), errs(v, e, when_error(k < 0, "#VALUE!")), v)


@function("MID", "MIDB", args=(3, 3))
def mid(env, v, start, n):
    (s, e), (k, g) = count_of(start, 1), count_of(n, 0)
    return txt(F.substring(as_text(v), F.greatest(s, F.lit(1)), F.greatest(k, F.lit(0))), errs(v, e, g, when_error((s < 1) | (k < 0), "#VALUE!")), v)


@function("CONCAT", "CONCATENATE", args=(1, None))
def concat(env, *args):
    if array_of(*args):
        return env.ordered_text(args)
    return txt(F.concat(*[as_text(v) for v in args]), errs(*args))


def _find(fold: bool):
    def run(env, a, b, start=None):
        s, e = count_of(start, 1)
        x, y = as_text(a), as_text(b)
        if fold:
            x, y = F.lower(x), F.lower(y)
        ok = (s >= 1) & (s <= F.length(y))
        at = F.when(ok, F.call_function("locate", x, y, s))
        return num(at.cast("double"), errs(a, b, e, when_error(~ok | (at == 0), "#VALUE!")), array=array_of(a, b))

    return run


function("FIND", "FINDB", args=(2, 3))(_find(False))
function("SEARCH", "SEARCHB", args=(2, 3))(_find(True))
function("EXACT", args=(2, 2))(lambda env, a, b: Val("bool", as_text(a) == as_text(b), errs(a, b), array_of(a, b)))


@function("REPT", args=(2, 2))
def rept(env, v, n):
    k, e = count_of(n, 0)
    s = as_text(v)
    bad = (k < 0) | (F.octet_length(s).cast("bigint") * k > 32767)
    return txt(F.call_function("repeat", s, F.when(~bad, k)), errs(v, e, when_error(bad, "#VALUE!")), v)


@function("SUBSTITUTE", args=(3, 4))
def substitute(env, v, old, new, nth=None):
    s, o, w = as_text(v), as_text(old), as_text(new)
    e = errs(v, old, new)
    if nth is None:
        return txt(F.when(o == "", s).otherwise(F.replace(s, o, w)), e, v)
    k, g = count_of(nth, 1)
    width = F.length(o)
    n = (F.length(s) - F.length(F.replace(s, o, F.lit("")))) / F.when(width > 0, width)
    at = F.length(F.call_function("substring_index", s, o, k)) + 1
    out = F.when((o == "") | (n < k), s).otherwise(F.concat(F.substring(s, F.lit(1), at - 1), w, F.substring(s, at + width, F.length(s))))
    return txt(out, errs(e, g, when_error(k < 1, "#VALUE!")), v)


@function("CHAR", args=(1, 1))
def char(env, v):
    x, e = as_number(v)
    n = x.cast("bigint")
    bad = (n < 1) | (n > 0x10FFFF) | n.between(0xD800, 0xDFFF)
    return txt(F.decode(F.unhex(F.lpad(F.hex(F.when(~bad, n)), 8, "0")), "UTF-32"), errs(e, when_error(bad, "#VALUE!")), v)


@function("CODE", args=(1, 1))
def code(env, v):
    s = as_text(v)
    return num(F.when(s != "", F.ascii(s)).cast("double"), errs(v, when_error(s == "", "#VALUE!")), array=v.array)


@function("VALUE", args=(1, 1))
def value(env, v):
    if v.kind == "bool":
        return error("#VALUE!")
    if v.kind == "text":
        s = F.trim(F.coalesce(v.col, F.lit("")))
        ok = s.rlike(NUMERIC)
        return num(F.when(ok, s.try_cast("double")), errs(v, when_error(~ok & v.col.isNotNull(), "#VALUE!")), array=v.array)
    x, e = as_number(v)
    return num(x, e, array=v.array)


function("T", args=(1, 1))(lambda env, v: txt(F.coalesce(v.col, F.lit("")) if v.kind == "text" else F.lit(""), v.err, v))
function("N", args=(1, 1))(lambda env, v: num(F.coalesce(v.col.cast("double"), F.lit(0.0)) if v.kind in ("num", "bool") else F.lit(0.0), v.err, array=v.array))

# Information ------------------------------------------------------------------------------------------------------


def _is(name, f):
    function(name, args=(1, 1))(lambda env, v: Val("bool", f(v), None, v.array))


def _clean(v: Val, test: Column) -> Column:
    return test if v.err is None else test & v.err.isNull()


def _filled(v: Val) -> Column:
    return v.col.isNotNull() if v.may_be_empty or v.err is not None else F.lit(True)


_is("ISBLANK", lambda v: _clean(v, F.lit(True) if v.kind == "empty" else v.col.isNull() if v.may_be_empty else F.lit(False)))
_is("ISNUMBER", lambda v: _clean(v, _filled(v) if v.kind == "num" else F.lit(False)))
_is("ISTEXT", lambda v: _clean(v, _filled(v) if v.kind == "text" else F.lit(False)))
_is("ISERROR", lambda v: F.lit(False) if v.err is None else v.err.isNotNull())
_is("ISNA", lambda v: F.lit(False) if v.err is None else v.err.eqNullSafe("#N/A"))
function("NA", args=(0, 0))(lambda env: error("#N/A"))

# Dates ------------------------------------------------------------------------------------------------------------


def serial(d: Column, date_1904: bool) -> Column:
    """Serial number of a date or timestamp column, with the time of day as fraction."""
    day = F.to_date(d)
    if date_1904:
        return F.datediff(day, F.lit("1904-01-01").cast("date")).cast("double")
    early = F.datediff(day, F.lit("1899-12-31").cast("date"))
    late = F.datediff(day, F.lit("1899-12-30").cast("date"))
    return F.when(day >= F.lit("1900-03-01").cast("date"), late).otherwise(early).cast("double")


@function("DATE", args=(3, 3))
def date(env, y, m, d):
    (y, e), (m, g), (d, h) = count_of(y, 0), count_of(m, 0), count_of(d, 0)
    bad = (y < 0) | (y > 9999)
    full = F.when(y < 1900, y + 1900).otherwise(y)
    month = F.add_months(F.make_date(F.when(~bad, full), F.lit(1), F.lit(1)), m - 1)
    leap = F.lit(False) if env.date_1904 else (month == F.lit("1900-02-01").cast("date")) & (d == 29)
    out = F.when(leap, 60.0).otherwise(serial(month, env.date_1904) + d - 1)
    return num(out, errs(e, g, h, when_error(bad | (out < 0), "#NUM!")))


def _part(name, f, at_60, at_0):
    def run(env, v):
        if v.native is not None:  # a date's serial number stands for that same date
            first = F.lit("1904-01-01" if env.date_1904 else "1900-01-01").cast("date")
            return num(F.coalesce(f(v.native).cast("double"), F.lit(float(at_0))), when_error(v.native < first, "#NUM!"), array=v.array)
        x, e = as_number(v)
        n = floor(x).cast("int")
        bad = (x < 0) | (x > 2_958_465)
        if env.date_1904:
            out = f(F.date_add(F.lit("1904-01-01").cast("date"), n))
        else:
            base = F.when(n > 60, F.date_add(F.lit("1899-12-30").cast("date"), n)).otherwise(F.date_add(F.lit("1899-12-31").cast("date"), n))
            out = F.when(n == 60, at_60).when(n == 0, at_0).otherwise(f(base))
        return num(F.when(~bad, out).cast("double"), errs(e, when_error(bad, "#NUM!")), array=v.array)

    function(name, args=(1, 1))(run)


_part("YEAR", F.year, 1900, 1900)
_part("MONTH", F.month, 2, 1)
_part("DAY", F.day, 29, 0)


@function("NOW", args=(0, 0))
def now(env):
    t = F.date_trunc("second", F.current_timestamp())
    return num(serial(t, env.date_1904) + (F.hour(t) * 3600 + F.minute(t) * 60 + F.second(t)) / 86400)


function("TODAY", args=(0, 0))(lambda env: num(serial(F.current_date(), env.date_1904)))

# Aggregates over whole columns ------------------------------------------------------------------------------------


def _numbers(env, args) -> tuple[list[Column], list[Column], Column | None]:
    """Array elements and scalars that are numbers, and the error of all."""
    arrays, scalars, err = [], [], []
    for v in args:
        if v.array:
            env.aggregate_only("an aggregate")
            if v.err is not None:
                err.append(F.min(v.err))
            if v.kind == "num":
                arrays.append(v.col if v.err is None else F.when(v.err.isNull(), v.col))
        else:
            err.append(v.err)
            if v.kind == "num":
                scalars.append(v.col)
    return arrays, scalars, errs(*err)


def _fold_numbers(name, agg, join, empty):
    def run(env, *args):
        arrays, scalars, e = _numbers(env, args)
        parts = [agg(c) for c in arrays] + scalars
        if not parts:
            return num(F.lit(empty), e)
        return num(F.coalesce(parts[0] if len(parts) == 1 else join(parts), F.lit(empty)), e)

    function(name, args=(1, None))(run)


def _sum(parts):
    out = F.lit(0.0)
    for p in parts:
        out = out + F.coalesce(p, F.lit(0.0))
    return out


_fold_numbers("SUM", F.sum, _sum, 0.0)
_fold_numbers("MIN", F.min, lambda p: F.least(*p), 0.0)
_fold_numbers("MAX", F.max, lambda p: F.greatest(*p), 0.0)


def _count(env, args, of):
    total = F.lit(0.0)
    for v in args:
        test = of(v)
        if v.array:
            env.aggregate_only("COUNT")
            total = total + F.count_if(test).cast("double")
        else:
            total = total + F.when(test, 1.0).otherwise(0.0)
    return num(total)


def _has(v: Val) -> Column:
    err = F.lit(False) if v.err is None else v.err.isNotNull()
    if v.kind == "empty":
        return err
    return err | F.coalesce(v.col != "", F.lit(False)) if v.kind == "text" else err | v.col.isNotNull()


function("COUNT", args=(1, None))(lambda env, *a: _count(env, a, lambda v: _clean(v, v.col.isNotNull()) if v.kind == "num" else F.lit(False)))
function("COUNTA", args=(1, None))(lambda env, *a: _count(env, a, _has))
function("COUNTBLANK", args=(1, None))(lambda env, *a: _count(env, a, lambda v: ~_has(v)))


@function("AVERAGE", args=(1, None))
def average(env, *args):
    arrays, scalars, e = _numbers(env, args)
    if len(arrays) == 1 and not scalars:
        total, n = F.avg(arrays[0]), F.count(arrays[0])
        return num(total, errs(e, when_error(n == 0, "#DIV/0!")))
    n = _sum([F.count(c).cast("double") for c in arrays] + [F.when(c.isNotNull(), 1.0).otherwise(0.0) for c in scalars])
    return num(_sum([F.sum(c) for c in arrays] + scalars) / F.when(n > 0, n), errs(e, when_error(n == 0, "#DIV/0!")))


@function("MEDIAN", args=(1, None))
def median(env, *args):
    arrays, scalars, e = _numbers(env, args)
    if scalars and arrays or len(arrays) > 1:
        raise FormulaError("MEDIAN takes one column here, or literals")
    if scalars:
        a = F.array_sort(F.array(*scalars))
        n = len(scalars)
        return num((F.get(a, F.lit((n - 1) // 2)) + F.get(a, F.lit(n // 2))) / 2, e)
    if not arrays:
        return error("#NUM!")
    out = F.median(arrays[0])
    return num(out, errs(e, when_error(F.count(arrays[0]) == 0, "#NUM!")))


def criterion_test(env, r: Val, c: Val) -> Column:
    """A row's test; a criterion from a column is compared for equality."""
    if c.literal is not None or c.kind == "empty":
        crit = criteria.parse(c.literal, env.strict_criteria)
        col = criteria.column(crit, r.col, "num" if r.kind in ("num", "bool") else r.kind, as_text(replace(r, may_be_empty=True)))
        return col if r.err is None else col & r.err.isNull()
    if c.kind == "num" or r.kind == "num":
        return F.coalesce(F.abs(as_number(r)[0] - as_number(c)[0]) < criteria.NEAR, F.lit(False))
    return F.coalesce(F.lower(F.trim(as_text(r))) == F.lower(F.trim(as_text(c))), F.lit(False))


def _tests(env, pairs) -> Column:
    out = None
    for r, c in pairs:
        if not r.array:
            raise FormulaError("a criteria range must be a whole column")
        env.aggregate_only("criteria")
        t = criterion_test(env, r, c)
        out = t if out is None else out & t
    return out


def _values(v: Val, test: Column) -> tuple[Column, Column | None]:
    col = F.when(test, v.col if v.kind == "num" else F.lit(None).cast("double"))
    return col, F.min(F.when(test, v.err)) if v.err is not None else None


def _sum_if(env, values, pairs):
    col, e = _values(values, _tests(env, pairs))
    return num(F.coalesce(F.sum(col), F.lit(0.0)), e)


def _average_if(env, values, pairs):
    col, e = _values(values, _tests(env, pairs))
    return num(F.avg(col), errs(e, when_error(F.count(col) == 0, "#DIV/0!")))


def _paired(args):
    return list(zip(args[::2], args[1::2]))


function("SUMIF", args=(2, 3))(lambda env, r, c, v=None: _sum_if(env, v if v is not None and v.array else r, [(r, c)]))
function("AVERAGEIF", args=(2, 3))(lambda env, r, c, v=None: _average_if(env, v if v is not None and v.array else r, [(r, c)]))
function("COUNTIF", args=(2, 2))(lambda env, r, c: num(F.count_if(_tests(env, [(r, c)])).cast("double")))
function("SUMIFS", args=(3, None))(lambda env, v, *a: error("#VALUE!") if len(a) % 2 else _sum_if(env, v, _paired(a)))
function("AVERAGEIFS", args=(3, None))(lambda env, v, *a: error("#VALUE!") if len(a) % 2 else _average_if(env, v, _paired(a)))
function("COUNTIFS", args=(2, None))(lambda env, *a: error("#VALUE!") if len(a) % 2 else num(F.count_if(_tests(env, _paired(a))).cast("double")))


@function("SUMPRODUCT", args=(1, None))
def sumproduct(env, *args):
    env.aggregate_only("SUMPRODUCT")
    out = F.lit(1.0)
    for v in args:
        x = F.coalesce(v.col.cast("double"), F.lit(0.0)) if v.kind in ("num", "bool") else F.lit(0.0)
        out = out * x
    bad = [F.min(v.err) for v in args if v.err is not None]
    return num(F.coalesce(F.sum(out), F.lit(0.0)), errs(*bad))


@function("ROWS", args=(1, 1))
def rows(env, v):
    if not v.array:
        return lit(1.0)
    env.aggregate_only("ROWS")
    return num(F.count(F.lit(1)).cast("double"))


function("COLUMNS", args=(1, 1))(lambda env, v: lit(1.0))
