"""Formula trees to Spark columns.

Row mode compiles a formula to an expression per row; a call over whole columns inside it is hoisted into one small
aggregate of the table. Aggregate mode compiles to aggregate expressions, so that all formulas over one table run in
one ``agg``. Whole columns combine element by element.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T
from pyspark.sql import functions as F

from tabulon.functions import columns as C
from tabulon.plans import parser as p
from tabulon.plans.parser import FormulaError

#: Functions that read whole tables in their own way and are planned by operators.table.
PLANNED = {"VLOOKUP", "MATCH", "INDEX", "LARGE", "SMALL", "SEQUENCE", "ROW", "COLUMN", "MEDIAN"}
#: Calls over whole columns that give one value per row, not one per table.
ROWWISE = {"IF", "IFERROR", "IFNA", "IFS", "SWITCH", "CHOOSE", "NOT"}


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.NumericType):
        return "num"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "date"
    return "text"


@dataclass
class Env:
    """What formulas see: the schema, names, settings, and the hoisted parts of the formula being compiled."""

    schema: T.StructType
    aggregate: bool = False
    names: dict = field(default_factory=dict)
    custom: dict = field(default_factory=dict)
    date_1904: bool = False
    strict_criteria: bool = True
    order_by: tuple = ()
    planner: object = None
    hoisted: list = field(default_factory=list)

    def aggregate_only(self, what: str) -> None:
        if not self.aggregate:
            raise FormulaError(f"{what} over a whole column is no row expression")

    def column(self, name: str, array: bool) -> C.Val:
        found = [f for f in self.schema.fields if f.name.lower() == name.strip().lower()]
        if not found:
            raise FormulaError(f"no column {name!r}")
        f = found[0]
        kind, col = kind_of(f.dataType), F.col(f"`{f.name}`")
        if kind == "date":
            return C.Val("num", C.serial(col, self.date_1904), None, array, True, native=col)
        elif kind == "num":
            col = col.cast("double")
        elif not isinstance(f.dataType, (T.StringType, T.BooleanType)):
            col = col.cast("string")
        return C.Val(kind, col, None, array, True)

    def ordered_text(self, args) -> C.Val:
        """CONCAT over whole columns, in the table's order."""
        self.aggregate_only("CONCAT")
        if not self.order_by:
            raise FormulaError("CONCAT over a column needs the table's order_by")
        out = []
        for v in args:
            s = C.as_text(v)
            if v.array:
                rows = F.array_sort(F.collect_list(F.struct(*[F.col(c) for c in self.order_by], s.alias("_s"))))
                s = F.array_join(F.transform(rows, lambda r: r["_s"]), "")
            out.append(s)
        return C.Val("text", F.concat(*out), C.errs(*[F.min(v.err) if v.array and v.err is not None else v.err for v in args]))


@dataclass(frozen=True)
class Held:
    """A value that stands in a column already."""

    value: C.Val


def constant(node, env: Env) -> C.Val:
    """The value of a tree without columns, such as a call over array literals."""
    from tabulon.plans.evaluator import Context, evaluate
    from tabulon.plans.values import Err, is_array

    v = evaluate(node, Context(date_1904=env.date_1904, strict_criteria=env.strict_criteria))
    if is_array(v):
        if len(v) * len(v[0]) > 1:
            raise FormulaError("an array has no place in a table's cell")
        v = v[0][0]
    return C.error(v.code) if isinstance(v, Err) else C.lit(v)


def compile_node(node, env: Env) -> C.Val:
    if isinstance(node, Held):
        return node.value
    if isinstance(node, (p.Num, p.Text, p.Bool)):
        return C.lit(node.value)
    if isinstance(node, p.ErrorLit):
        return C.error(node.code)
    if isinstance(node, p.Column):
        if env.aggregate and node.this_row:
            raise FormulaError("a row's value has no meaning in an aggregate formula")
        return env.column(node.name, not node.this_row)
    if isinstance(node, p.Name):
        value = env.names.get(node.name.lower())
        if value is None:
            raise FormulaError(f"#NAME? {node.name}")
        if isinstance(value, str):
            return compile_node(p.parse(value), env)
        return C.lit(value)
    if isinstance(node, p.Unary):
        v = compile_node(node.arg, env)
        x, e = C.as_number(v)
        if node.op == "+":
            return v
        if isinstance(v.literal, float):
            return C.lit(-v.literal if node.op == "-" else v.literal / 100)
        return C.num(-x if node.op == "-" else x / 100, e, array=v.array)
    if isinstance(node, p.Binary):
        return binary(node.op, compile_node(node.left, env), compile_node(node.right, env))
    if isinstance(node, p.Call):
        return call(node, env)
    raise FormulaError(f"{type(node).__name__} has no meaning over a table")


def binary(op: str, a: C.Val, b: C.Val) -> C.Val:
    array = C.array_of(a, b)
    if op == "&":
        return C.Val("text", F.concat(C.as_text(a), C.as_text(b)), C.errs(a, b), array)
    if op in ("=", "<>", "<", "<=", ">", ">="):
        return C.Val("bool", compare(op, a, b), C.errs(a, b), array)
    (x, e), (y, g) = C.as_number(a), C.as_number(b)
    err = C.errs(e, g)
    if op == "/":
        zero = b.literal == 0 if isinstance(b.literal, float) else None
        own = F.lit("#DIV/0!") if zero else None if zero is False else C.when_error(y == 0, "#DIV/0!")
        return C.num(F.try_divide(x, y), C.errs(err, own), array=array)
    if op == "^":
        out, own = C.raise_to(x, y)
        return C.num(out, C.errs(err, own), array=array)
    return C.num({"+": x + y, "-": x - y, "*": x * y}[op], err, array=array)


def compare(op: str, a: C.Val, b: C.Val):
    """Numbers before text before booleans; empty cells are 0; text without regard to case."""

    def test(x, y):
        return {"=": x == y, "<>": x != y, "<": x < y, "<=": x <= y, ">": x > y, ">=": x >= y}[op]

    rank = {"num": 0, "empty": 0, "text": 1, "bool": 2}

    def as_kind(v: C.Val, kind: str):
        return C.as_number(v)[0] if kind == "num" else F.lower(v.col) if kind == "text" else v.col

    if rank[a.kind] == rank[b.kind]:
        kind = "num" if a.kind == "empty" else a.kind
        out = test(as_kind(a, kind), as_kind(b, kind))
    else:
        out = F.lit(bool({"=": False, "<>": True, "<": rank[a.kind] < rank[b.kind], "<=": rank[a.kind] < rank[b.kind], ">": rank[a.kind] > rank[b.kind], ">=": rank[a.kind] > rank[b.kind]}[op]))
    # an empty cell of a text or boolean column is the number 0
    for v, o, flip in ((a, b, False), (b, a, True)):
        if v.kind in ("text", "bool") and v.may_be_empty:
            zero = C.lit(0.0)
            other = replace_empty(o)
            alone = compare(op, zero, other) if not flip else compare(op, other, zero)
            if o.kind in ("text", "bool") and o.may_be_empty:
                alone = F.when(o.col.isNull(), test(F.lit(0), F.lit(0))).otherwise(alone)
            out = F.when(v.col.isNull(), alone).otherwise(out)
    return out


def replace_empty(v: C.Val) -> C.Val:
    return C.Val(v.kind, v.col, v.err, v.array, v.may_be_empty if v.kind == "num" else False, v.literal)


def whole_columns(node) -> bool:
    return any(isinstance(x, p.Column) and not x.this_row for x in p.walk(node))


def call(node: p.Call, env: Env) -> C.Val:
    name = node.name
    below = list(p.walk(node))
    if any(isinstance(x, p.Array) for x in below) and not any(isinstance(x, (p.Column, p.Name, Held)) for x in below):
        return constant(node, env)
    over_table = name in ("ROWS", "COLUMNS") and len(node.args) == 1 and isinstance(node.args[0], p.Name)
    if env.planner is not None and (over_table or name in PLANNED and (name != "MEDIAN" or whole_columns(node))):
        return env.planner(node, env)
    table = C.TABLE | env.custom
    if name not in table:
        raise FormulaError(f"#NAME? {name}")
    low, high, f = table[name][:3]
    if len(node.args) < low or high is not None and len(node.args) > high:
        raise FormulaError(f"{name} takes {low} to {'any number of' if high is None else high} arguments")
    if not env.aggregate and whole_columns(node) and name not in ROWWISE:
        return env.planner(node, env) if env.planner else env.aggregate_only(name)
    return f(env, *[compile_node(a, env) for a in node.args])
