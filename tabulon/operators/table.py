"""Table mode: formulas over the columns of a DataFrame.

``Table(df).with_formula`` adds a column per row, ``agg`` gives one row of totals, ``group`` one row per key. Lookups
are joins with a deduplicated table; positions, order statistics and first matches are top-k and range aggregates,
never one sorted partition. Only frames of one row are broadcast by hint; lookup tables are left to the planner, which
knows their size before the join (from files) or at run time (from the shuffle).
"""

from __future__ import annotations

import functools
import itertools
import math
from dataclasses import dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tabulon.functions import columns as C
from tabulon.operators import ranks
from tabulon.plans import parser as p
from tabulon.plans.compiler import PLANNED, Env, Held, compare, compile_node, kind_of, whole_columns
from tabulon.plans.parser import FormulaError
from tabulon.session import checkpoint

_fresh = itertools.count()
#: Literal positions up to which LARGE, SMALL and INDEX are a top-k; beyond, running totals by ranges find them.
TOP = 10_000
#: Cells and criteria of one key whose running totals one task may add up; larger keys are dealt by ranges.
KEY_ROWS = 100_000
#: Distinct patterns with wildcards that a column of criteria may hold.
PATTERNS = 10_000


def fresh(prefix: str) -> str:
    return f"_{prefix}{next(_fresh)}"


def first_rows(df: DataFrame, keys: list[str], order_by: tuple[str, ...]) -> DataFrame:
    """The first row of each key in the given order (of all columns where none is given)."""
    rest = [c for c in df.columns if c not in keys]
    order = [c for c in order_by if c not in keys]
    held = F.min(F.struct(*[F.col(c) for c in order], *[F.col(c).alias(f"_{c}") for c in rest])) if rest else None
    if held is None:
        return df.select(*keys).distinct()
    return df.groupBy(*keys).agg(held.alias("_first")).select(*keys, *[F.col("_first")[f"_{c}"].alias(c) for c in rest])


@dataclass
class Table:
    """A DataFrame with what formulas need: an order, names, other tables, and settings."""

    df: DataFrame
    order_by: tuple[str, ...] = ()
    names: dict = field(default_factory=dict)
    tables: dict[str, Table] = field(default_factory=dict)
    custom: dict = field(default_factory=dict)
    date_1904: bool = False
    strict_criteria: bool = True

    def env(self, aggregate: bool, planner) -> Env:
        return Env(self.df.schema, aggregate, {k.lower(): v for k, v in self.names.items()}, self.custom, self.date_1904, self.strict_criteria, tuple(self.order_by), planner)

    def register(self, name: str, low: int, high: int | None, compile_function) -> Table:
        """With a function of one's own: compile_function(env, *Val) → Val."""
        return replace(self, custom=self.custom | {name.upper(): (low, high, compile_function)})

    # rows ---------------------------------------------------------------------------------------------------------

    def with_formula(self, name: str, formula: str, errors: bool = False) -> Table:
        """One more column; with errors=True also its error codes as ``{name}_err``."""
        plan = _RowPlan(self)
        v = compile_node(p.parse(formula), self.env(False, plan.planned))
        col = v.col if v.err is None else F.when(v.err.isNull(), v.col)
        df = plan.df.withColumn(name, col)
        if errors:
            df = df.withColumn(f"{name}_err", v.err if v.err is not None else F.lit(None).cast("string"))
        return replace(self, df=df.drop(*plan.extra))

    def where(self, formula: str) -> Table:
        """The rows for which a formula is true."""
        mark = fresh("where")
        t = self.with_formula(mark, formula)
        return replace(t, df=t.df.filter(F.col(mark).cast("boolean")).drop(mark))

    # totals -------------------------------------------------------------------------------------------------------

    def agg(self, **formulas: str) -> DataFrame:
        """One row with a column per formula (and ``{name}_err`` where a formula can give an error)."""
        return self.group([], **formulas)

    def group(self, keys: list[str], **formulas: str) -> DataFrame:
        plan = _TotalPlan(self, keys)
        after = [(name, plan.split(p.parse(formula))) for name, formula in formulas.items()]
        aggs = plan.aggs
        base = self.df.groupBy(*keys) if keys else self.df.groupBy()
        out = base.agg(*aggs) if aggs else self.df.select(*keys).distinct() if keys else self.df.sparkSession.range(1).select()
        for side in plan.sides:
            if keys:
                same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
                out = out.join(side, same, "left").drop(*[f"_k_{k}" for k in keys])
            else:
                out = out.join(F.broadcast(side), how="left")  # one row each
        cols, env = [], self.env(False, None)
        for name, tree in after:
            v = compile_node(tree, env)
            cols.append((v.col if v.err is None else F.when(v.err.isNull(), v.col)).alias(name))
            if v.err is not None:
                cols.append(v.err.alias(f"{name}_err"))
        return out.select(*keys, *cols)

    # positions ----------------------------------------------------------------------------------------------------

    def numbered(self, name: str = "row_number") -> Table:
        """With the 1-based position of each row in the table's order; rows that tie there go by their other columns.

        Rows are ranged by the order, counted per range, and numbered inside their range from the prefix sum.
        """
        if not self.order_by:
            raise FormulaError("positions need order_by")
        parts = int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
        order = self.full_order()
        ranged = checkpoint(self.df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
        part = F.shiftright("_at", 33).alias("_part")
        counts = ranged.groupBy(part).agg(F.count("*").alias("_n"))
        ahead = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range
        base = counts.select(F.col("_part"), F.coalesce(F.sum("_n").over(ahead), F.lit(0)).alias("_base"))
        out = ranged.withColumn("_part", F.shiftright("_at", 33)).join(F.broadcast(base), "_part")
        at = F.col("_base") + F.col("_at").bitwiseAND(F.lit((1 << 33) - 1)) + 1
        return replace(self, df=out.withColumn(name, at).drop("_at", "_part", "_base"))

    def full_order(self) -> list[str]:
        """The order's columns, then all others that can be ordered."""
        rest = [f.name for f in self.df.schema.fields if f.name not in self.order_by and "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()]
        return [*self.order_by, *rest]

    @staticmethod
    def spill(spark: SparkSession, formula: str) -> DataFrame:
        """A formula that gives an array of constants, as rows (row, col, value); SEQUENCE is made on the executors."""
        from tabulon.plans.evaluator import Context, evaluate
        from tabulon.plans.values import Err, is_array

        tree = p.parse(formula)
        if isinstance(tree, p.Call) and tree.name == "SEQUENCE" and 1 <= len(tree.args) <= 4:
            args = [evaluate(a, Context()) for a in tree.args]
            if all(isinstance(a, float) for a in args):
                return Table.sequence(spark, *map(math.trunc, args[:2]), *args[2:])
        v = evaluate(tree, Context())
        if isinstance(v, Err):
            raise FormulaError(v.code)
        v = v if is_array(v) else [[v]]
        kind = "double" if all(isinstance(x, float) for r in v for x in r) else "string"
        return spark.createDataFrame([(i, j, x if kind == "double" else None if x is None else str(x)) for i, r in enumerate(v) for j, x in enumerate(r)], f"row long, col long, value {kind}")

    @staticmethod
    def sequence(spark: SparkSession, rows: int, cols: int = 1, start: float = 1.0, step: float = 1.0) -> DataFrame:
        """SEQUENCE as rows (row, col, value), row-major."""
        if rows < 1 or cols < 1 or rows * cols > 1_000_000:
            raise FormulaError("#VALUE!")
        i = F.col("id")
        return spark.range(rows * cols).select(F.floor(i / cols).cast("long").alias("row"), (i % cols).alias("col"), (F.lit(float(start)) + i * F.lit(float(step))).alias("value"))


def _literal(node, what: str) -> float:
    v = node.value if isinstance(node, p.Num) else -node.arg.value if isinstance(node, p.Unary) and isinstance(node.arg, p.Num) else None
    if v is None:
        raise FormulaError(f"{what} needs a literal number here")
    return v


class _RowPlan:
    """Collects what a row formula needs joined to the table first."""

    def __init__(self, table: Table):
        self.table, self.df, self.extra = table, table.df, []
        self.asked: dict[tuple, tuple] = {}

    def planned(self, node: p.Call, env: Env) -> C.Val:
        if node.name == "VLOOKUP":
            return self.vlookup(node, env)
        if node.name == "ROW" and not node.args:
            name = fresh("row")
            self.df = replace(self.table, df=self.df).numbered(name).df
            self.extra.append(name)
            return C.num(F.col(name).cast("double"))
        if node.name == "COLUMN" and len(node.args) == 1 and isinstance(node.args[0], p.Column):
            names = [c.lower() for c in self.table.df.columns]
            return C.lit(float(names.index(node.args[0].name.lower()) + 1))
        if node.name in ("ROWS", "COLUMNS") and isinstance(node.args[0], p.Name):
            return _extent(self.table, node)
        if any(isinstance(x, p.Column) and x.this_row for x in p.walk(node)):
            if node.name == "MATCH":
                return self.match(node, env)
            if node.name == "INDEX" and len(node.args) == 2 and isinstance(node.args[1], p.Call) and node.args[1].name == "MATCH":
                return self.match(node.args[1], env, node.args[0])
            if node.name == "MEDIAN" and not whole_columns(node):
                return C.TABLE["MEDIAN"][2](env, *[compile_node(a, env) for a in node.args])
            return self.per_key(node, env)
        held = fresh("total")
        one = self.table.agg(**{held: node_text(node)})
        self.df = self.df.join(F.broadcast(one), how="left")  # one row
        self.extra += one.columns
        kind = kind_of(one.schema[held].dataType)
        return C.Val(kind, F.col(held), F.col(f"{held}_err") if f"{held}_err" in one.columns else None)

    def per_key(self, node: p.Call, env: Env) -> C.Val:
        """SUMIFS and its family with criteria from this row: a grouped aggregate joined by the keys."""
        name = node.name
        if name not in ("SUMIFS", "COUNTIFS", "AVERAGEIFS", "SUMIF", "COUNTIF", "AVERAGEIF"):
            raise FormulaError(f"{name} over a whole column can't take this row's values")
        args = list(node.args)
        value = None
        if name in ("SUMIFS", "AVERAGEIFS"):
            value = args.pop(0)
        elif name in ("SUMIF", "AVERAGEIF"):
            value = args.pop() if len(args) == 3 else args[0]
        fixed, keys, wide, before = [], [], [], self.df
        for r, c in zip(args[::2], args[1::2], strict=True):
            mine = any(isinstance(x, p.Column) and x.this_row for x in p.walk(c))
            (fixed if not mine else wide if compile_node(c, env).kind == "text" else keys).append((r, c))
        if wide:
            return self.by_criterion(name, value, fixed, keys, wide, env, before)
        inner = self.table.env(True, None)
        aliases = [fresh("k") for _ in keys]

        def norm(v: C.Val) -> Column:
            return C.as_number(v)[0] if v.kind in ("num", "bool") else F.lower(F.trim(C.as_text(v)))

        grouped = self.table.df.select("*", *[norm(compile_node(r, inner)).alias(a) for (r, _), a in zip(keys, aliases)])
        # empty cells of a range never equal a number
        for r, _ in keys:
            grouped = grouped.filter(compile_node(r, inner).col.isNotNull())
        sub = {"SUM": "SUM", "COU": "COUNTIFS", "AVE": "AVERAGE"}[name[:3]]
        if fixed or sub == "COUNTIFS":
            tests = [x for pair in fixed for x in pair]
            first = {"SUM": "SUMIFS", "COU": "COUNTIFS", "AVE": "AVERAGEIFS"}[name[:3]]
            tree = p.Call(first, (*([value] if value is not None else []), *tests)) if fixed else p.Call("ROWS", (keys[0][0],))
        else:
            tree = p.Call(sub, (value,))
        held = fresh("by")
        totals = replace(self.table, df=grouped).group(aliases, **{held: node_text(tree)})
        mine = [fresh("m") for _ in keys]
        for m, (_, c) in zip(mine, keys):
            self.df = self.df.withColumn(m, norm(compile_node(c, env)))
        self.df = self.df.join(totals, [F.col(m) == F.col(a) for m, a in zip(mine, aliases)], "left")
        self.extra += [*mine, *totals.columns]
        if sub == "AVERAGE":
            err = F.when(F.col(aliases[0]).isNull(), F.lit("#DIV/0!"))
            return C.num(F.col(held), C.errs(err, F.col(f"{held}_err")))
        return C.num(F.coalesce(F.col(held), F.lit(0.0)), F.col(f"{held}_err") if f"{held}_err" in totals.columns else None)

    def by_criterion(self, name: str, value, fixed: list, keys: list, wide: list, env: Env, before: DataFrame) -> C.Val:
        """Conditional aggregates whose criterion is a text of this row: a comparison, a number or a pattern.

        Every distinct criterion is answered once: equal numbers and texts by a join with the values' totals,
        comparisons from running totals (by key, or by ranges where a key has more than KEY_ROWS), patterns with
        wildcards (PATTERNS of them at most) against the distinct values; the answers are joined back to the rows. They
        are unique by criterion and key, so the optimiser drops the joins where nothing takes their columns.
        """
        if len(wide) > 1:
            raise FormulaError("one criterion that is a text of this row at a time")
        if not self.table.strict_criteria:
            raise FormulaError("criteria from rows are strict")
        (range_, criterion), inner, one = wide[0], self.table.env(True, None), fresh("one")
        r, c = compile_node(range_, inner), compile_node(criterion, env)
        v = compile_node(value, inner) if value is not None else None
        if any(x is not None and x.err is not None for x in (r, v)):
            raise FormulaError(f"{name} with a criterion of this row takes ranges without errors")
        aliases = [one, *[fresh("k") for _ in keys]]

        def norm(x: C.Val) -> Column:
            return C.as_number(x)[0] if x.kind in ("num", "bool") else F.lower(F.trim(C.as_text(x)))

        ranges = [compile_node(k, inner) for k, _ in keys]
        tests = [C.criterion_test(inner, compile_node(k, inner), compile_node(t, inner)) for k, t in fixed] + [k.col.isNotNull() for k in ranges]
        amount = v.col.cast("double") if v is not None and v.kind == "num" else F.lit(None).cast("double")
        number = r.col.cast("double") if r.kind in ("num", "bool") else F.lit(None).cast("double")
        shown = F.lower(F.trim(C.as_text(replace(r, may_be_empty=True))))
        empty = r.col.isNull() | (r.col == "") if r.kind == "text" else r.col.isNull()
        cells = self.table.df.filter(F.lit(True) if not tests else _all(tests))
        cells = cells.select(F.lit(1).alias(one), *[norm(k).alias(a) for k, a in zip(ranges, aliases[1:])], number.alias("x"), shown.alias("t"), empty.alias("e"), amount.alias("a"))
        totals = {"n": F.count(F.lit(1)).cast("double"), "s": F.coalesce(F.sum("a"), F.lit(0.0)), "m": F.count("a").cast("double")}
        again = {k: F.sum(k) for k in totals}
        by = lambda df, *more: df.groupBy(*aliases, *more).agg(*[x.alias(k) for k, x in totals.items()])

        shown_raw, own_keys = F.trim(C.as_text(replace(c, may_be_empty=True))), [norm(compile_node(k, env)) for _, k in keys]
        same_asked = (criterion, range_, *keys)
        if same_asked not in self.asked:
            raw, mine = fresh("c"), [fresh("m") for _ in keys]
            source = self.table.df if self.df is before else self.df  # without joins, unless a criterion needs them
            asked = source.select(shown_raw.alias("raw"), F.lit(1).alias(one), *[k.alias(a) for k, a in zip(own_keys, aliases[1:])]).distinct()
            op, rest = F.regexp_extract("raw", "^(<>|<=|>=|<|>|=)", 1), F.regexp_replace("raw", "^(<>|<=|>=|<|>|=)", "")
            is_number = rest.rlike(r"^\s*[+-]?(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\s*$")
            kind = F.when(F.col("raw") == "", "empty").when(is_number, F.when(op == "", "=").otherwise(op)).when(F.col("raw").rlike("[*?]"), "glob").otherwise("text")
            asked = checkpoint(asked.withColumns({"kind": kind, "num": F.trim(rest).try_cast("double"), "low": F.lower(F.trim("raw"))}))
            kinds = {k for (k,) in asked.select("kind").distinct().collect()}  # nine at most
            self.df = self.df.withColumns({raw: shown_raw} | dict(zip(mine, own_keys)))
            self.extra += [raw, *mine]
            by_key = False
            if keys and kinds - {"empty", "glob", "text"}:
                sizes = self.table.df.select(*[norm(k).alias(a) for k, a in zip(ranges, aliases[1:])]).unionByName(asked.select(*aliases[1:])).groupBy(*aliases[1:]).count()
                by_key = (sizes.agg(F.max("count")).first()[0] or 0) <= KEY_ROWS
            self.asked[same_asked] = raw, mine, asked, kinds, by_key, aliases
        raw, mine, asked, kinds, by_key, old = self.asked[same_asked]
        asked = asked.withColumnsRenamed(dict(zip(old, aliases)))
        found = []

        known = cells.filter("x is not null")
        points = asked.filter("kind not in ('empty', 'glob', 'text')")

        def numbers() -> DataFrame:
            if by_key:
                cols = [*aliases, "x", "raw", "kind", *totals]
                own = {"n": F.lit(1.0), "s": F.coalesce("a", F.lit(0.0)), "m": F.col("a").isNotNull().cast("double")}
                rows = known.withColumns(own | {x: F.lit(None).cast("string") for x in ("raw", "kind")}).select(*cols)
                rows = rows.unionByName(points.withColumnRenamed("num", "x").withColumns({k: F.lit(0.0) for k in totals}).select(*cols))
                key, here = Window.partitionBy(*aliases[1:]), Window.partitionBy(*aliases[1:], "x")
                upto = key.orderBy("x").rangeBetween(Window.unboundedPreceding, Window.currentRow)
                sums = [F.sum(k).over(w).alias(f"{p}_{k}") for k in totals for p, w in (("own", here), ("upto", upto), ("all", key))]
                return rows.select(*aliases, "raw", "kind", *sums).filter("raw is not null").withColumnsRenamed({f"own_{k}": k for k in totals})
            grid = by(known, "x").unionByName(points.select(*aliases, F.col("num").alias("x"), *[F.lit(0.0).alias(k) for k in totals]).distinct())
            grid = ranks.prefix_totals(grid, aliases, "x", **again)
            whole = by(known).select(*aliases, *[F.col(k).alias(f"all_{k}") for k in totals])
            return points.withColumnRenamed("num", "x").join(grid, [*aliases, "x"]).join(whole, aliases, "left")

        def compared(k: str) -> Column:
            own, upto, total = F.col(k), F.col(f"upto_{k}"), F.coalesce(F.col(f"all_{k}"), F.lit(0.0))
            out = F.when(F.col("kind") == "=", own).when(F.col("kind") == "<>", total - own).when(F.col("kind") == "<=", upto)
            return out.when(F.col("kind") == "<", upto - own).when(F.col("kind") == ">", total - upto).otherwise(total - upto + own).alias(k)

        if kinds - {"empty", "glob", "text"}:
            found.append(numbers().select("raw", *aliases, *[compared(k) for k in totals]))
        texts = checkpoint(by(cells, "t")) if kinds & {"glob", "text"} else None
        if "glob" in kinds:
            globs = asked.filter("kind = 'glob'")
            if globs.limit(PATTERNS + 1).count() > PATTERNS:
                raise FormulaError(f"more than {PATTERNS} patterns")
            regex = F.concat(F.lit("(?s)^(?:"), F.replace(F.replace(F.regexp_replace("low", r"([\\.^$|()\[\]{}+])", r"\\$1"), F.lit("*"), F.lit(".*")), F.lit("?"), F.lit(".")), F.lit(")$"))
            globs = F.broadcast(globs.select("raw", regex.alias("regex"), *[F.col(a).alias(f"g{a}") for a in aliases]))  # PATTERNS rows at most
            same = [F.col(a) == F.col(f"g{a}") for a in aliases]
            found.append(texts.join(globs, [*same, F.regexp_like("t", "regex")]).groupBy("raw", *aliases).agg(*[x.alias(k) for k, x in again.items()]))
        if "text" in kinds:
            found.append(asked.filter("kind = 'text'").join(texts.withColumnRenamed("t", "low"), [*aliases, "low"]).select("raw", *aliases, *totals))
        if "empty" in kinds or not found:
            found.append(asked.filter("kind = 'empty'").join(by(cells.filter("e")), aliases).select("raw", *aliases, *totals))
        found = functools.reduce(DataFrame.unionByName, found)
        out = [fresh("t") for _ in totals]
        names = [fresh("q"), *[f"{a}_" for a in aliases[1:]]]
        found = found.groupBy(F.col("raw").alias(names[0]), *[F.col(a).alias(n) for a, n in zip(aliases[1:], names[1:])]).agg(*[F.max(k).alias(o) for k, o in zip(totals, out)])
        self.df = self.df.join(found, [F.col(m) == F.col(n) for m, n in zip([raw, *mine], names)], "left")
        self.extra += found.columns
        n, total, amounts = (F.coalesce(F.col(o), F.lit(0.0)) for o in out)
        if name.startswith("AVERAGE"):
            return C.num(F.try_divide(total, amounts), C.errs(c, C.when_error(amounts == 0, "#DIV/0!")))
        return C.num(n if name.startswith("COUNT") else total, c.err)

    def match(self, node: p.Call, env: Env, values=None) -> C.Val:
        """MATCH of this row's value in a whole column, or INDEX of another column at that place: a left join with the
        first row of each key in the table's order."""
        if len(node.args) == 3 and _literal(node.args[2], "MATCH") != 0:
            return C.error("#N/A")
        v = compile_node(node.args[0], env)
        if isinstance(node.args[1], p.Array):
            if values is not None:
                raise FormulaError("INDEX takes a whole column here")
            return _among(v, [x for r in node.args[1].rows for x in r], None, env)
        if not self.table.order_by:
            raise FormulaError("positions need order_by")
        k, at, held, mine = fresh("k"), fresh("at"), fresh("v"), fresh("m")
        numbered = self.table.numbered(at)
        inner = numbered.env(False, None)
        there = compile_node(node.args[1], replace(inner, aggregate=True))
        what = C.num(F.col(at).cast("double")) if values is None else compile_node(values, replace(inner, aggregate=True))
        if (there.kind == "num") != (v.kind == "num") or (there.kind == "bool") != (v.kind == "bool"):
            return C.error("#N/A")

        def norm(x: C.Val) -> Column:
            return C.as_number(x)[0] if x.kind == "num" else x.col if x.kind == "bool" else F.lower(C.as_text(x))

        right = numbered.df.filter(there.col.isNotNull()).select(norm(there).alias(k), F.col(at), what.col.alias(held))
        right = right.groupBy(k).agg(F.min(F.struct(at, held)).alias("_first")).select(k, F.col("_first")[at].alias(at), F.col("_first")[held].alias(held))
        self.df = self.df.withColumn(mine, norm(v)).join(right, F.col(mine) == F.col(k), "left")
        self.extra += [mine, k, at, held]
        return C.Val(what.kind, F.col(held), C.errs(v, C.when_error(F.col(at).isNull(), "#N/A")), False, True)

    def vlookup(self, node: p.Call, env: Env) -> C.Val:
        """VLOOKUP(key, table, column number): a left join with the first row of each key; a miss is #N/A."""
        key, source, number = node.args[:3]
        if isinstance(source, p.Array):
            n = math.trunc(_literal(number, "VLOOKUP"))
            if not 1 <= n <= len(source.rows[0]):
                return C.error("#VALUE!" if n < 1 else "#REF!")
            return _among(compile_node(key, env), [r[0] for r in source.rows], [r[n - 1] for r in source.rows], env)
        other = self.table.tables.get(source.name.lower() if isinstance(source, p.Name) else "")
        if other is None:
            raise FormulaError("VLOOKUP needs the name of a table")
        n = math.trunc(_literal(number, "VLOOKUP"))
        if n < 1:
            return C.error("#VALUE!")
        if n > len(other.df.columns):
            return C.error("#REF!")
        v = compile_node(key, env)
        inner = other.env(False, None)
        there, value = (inner.column(other.df.columns[i], False) for i in (0, n - 1))
        k, held, mine, hit = fresh("k"), fresh("v"), fresh("m"), fresh("h")
        numeric = "num" in (there.kind, v.kind) and "bool" not in (there.kind, v.kind)

        def norm(x: C.Val) -> Column:
            if numeric:
                return F.coalesce(x.col.try_cast("double"), F.lit(None).cast("double")) if x.kind == "text" else C.as_number(x)[0]
            return x.col if x.kind == "bool" else F.lower(C.as_text(x))

        if (there.kind == "bool") != (v.kind == "bool"):
            return C.error("#N/A")
        right = other.df.select(norm(there).alias(k), value.col.alias(held), *[F.col(c).alias(f"_o{i}") for i, c in enumerate(other.order_by)])
        right = first_rows(right.filter(F.col(k).isNotNull()), [k], tuple(f"_o{i}" for i in range(len(other.order_by))))
        right = right.select(k, held, F.lit(True).alias(hit))
        self.df = self.df.withColumn(mine, norm(v)).join(right, F.col(mine) == F.col(k), "left")
        self.extra += [mine, k, held, hit]
        return C.Val(value.kind, F.col(held), C.errs(v, C.when_error(F.col(hit).isNull(), "#N/A")), False, True)


def _all(tests: list[Column]) -> Column:
    out = tests[0]
    for t in tests[1:]:
        out = out & t
    return out


def _among(v: C.Val, keys: list, values: list | None, env: Env) -> C.Val:
    """The value beside the first of some literals that equals v, or its place; a miss is #N/A."""
    found = [C.lit(float(i + 1)) if values is None else compile_node(values[i], env) for i in range(len(keys))]
    kind = found[0].kind if len({f.kind for f in found}) == 1 else "text"
    out, hit = F.lit(None).cast({"num": "double", "bool": "boolean"}.get(kind, "string")), F.lit(False)
    for key, f in reversed(list(zip(keys, found, strict=True))):
        same = F.coalesce(compare("=", v, compile_node(key, env)), F.lit(False))
        out, hit = F.when(same, f.col if f.kind == kind else C.as_text(f)).otherwise(out), same | hit
    return C.Val(kind, out, C.errs(v, C.when_error(~hit, "#N/A")))


def _extent(table: Table, node: p.Call) -> C.Val:
    """ROWS or COLUMNS of a table by name; its rows are counted once."""
    other = table.tables.get(node.args[0].name.lower())
    if other is None:
        raise FormulaError(f"#NAME? {node.args[0].name}")
    return C.lit(float(len(other.df.columns) if node.name == "COLUMNS" else other.df.count()))


class _TotalPlan:
    """Splits aggregate formulas: plain totals into one common aggregation, order statistics and positions into frames
    of one row (per key) of their own; what stands around them is evaluated over the joined results."""

    def __init__(self, table: Table, keys: list[str]):
        self.table, self.keys, self.sides, self.aggs = table, keys, [], []

    def split(self, node):
        """The tree with everything that reads the table replaced by held columns."""
        if isinstance(node, p.Name) and isinstance(text := self.table.names.get(node.name, {k.lower(): v for k, v in self.table.names.items()}.get(node.name.lower())), str):
            return self.split(p.parse(text))
        if isinstance(node, p.Call) and (node.name in PLANNED and whole_columns(node) or node.name in ("ROWS", "COLUMNS") and isinstance(node.args[0], p.Name)):
            return Held(self.planned(node, self.table.env(True, self.planned)))
        if any(isinstance(x, p.Call) and x.name in PLANNED and whole_columns(x) for x in p.walk(node)):
            if isinstance(node, p.Unary):
                return replace(node, arg=self.split(node.arg))
            if isinstance(node, p.Binary):
                return replace(node, left=self.split(node.left), right=self.split(node.right))
            return replace(node, args=tuple(self.split(a) for a in node.args))
        v = compile_node(node, self.table.env(True, self.planned))
        if v.array:
            raise FormulaError("a whole column is no total")
        if not any(isinstance(x, (p.Column, p.Name, p.Call)) for x in p.walk(node)):
            return Held(v)
        held, err = fresh("v"), fresh("e")
        self.aggs.append(v.col.alias(held))
        if v.err is not None:
            self.aggs.append(v.err.alias(err))
        return Held(replace(v, col=F.col(held), err=F.col(err) if v.err is not None else None, native=None, literal=None))

    def side(self, df: DataFrame, name: str, kind: str, miss: str, empty: bool = False) -> C.Val:
        """A frame's column as a value; with empty, a null that comes with ``_hit`` is an empty cell, not a miss."""
        held = [name, "_hit"] if empty else [name]
        if self.keys:
            df = df.select(*[F.col(k).alias(f"_k_{k}") for k in self.keys], *held)
        else:
            df = df.groupBy().agg(*[F.first(c).alias(c) for c in held])  # one row, null where there is none
        missing = F.col(name).isNull()
        if empty:
            hit = fresh("hit")
            df, missing = df.withColumnRenamed("_hit", hit), F.col(hit).isNull()
        self.sides.append(df)
        return C.Val(kind, F.col(name), C.when_error(missing, miss), False, empty)

    def number_of(self, node, what: str):
        """A literal number, or a frame of one row (column ``_k``) that a formula over the table gives."""
        try:
            return _literal(node, what)
        except FormulaError:
            if self.keys:
                raise
            got = self.table.agg(_k=node_text(node))
            return got.select(F.col("_k").try_cast("double").alias("_k"))

    def values(self, args, env: Env, held: str) -> DataFrame:
        """The numbers of whole columns and scalars, one column."""
        t, out = self.table, None
        for a in args:
            v = compile_node(a, env)
            if v.kind != "num":
                continue
            col = (v.col if v.err is None else F.when(v.err.isNull(), v.col)).alias(held)
            if v.array:
                x = t.df.select(*self.keys, col)
            elif self.keys:
                x = t.df.select(*self.keys).distinct().select(*self.keys, col)
            else:
                x = t.df.sparkSession.range(1).select(col)
            out = x if out is None else out.unionByName(x)
        return t.df.select(*self.keys, F.lit(None).cast("double").alias(held)) if out is None else out.filter(F.col(held).isNotNull())

    def planned(self, node: p.Call, env: Env) -> C.Val:
        t, name, args = self.table, node.name, node.args
        if name in ("ROWS", "COLUMNS"):
            return _extent(t, node)
        held = fresh("side")
        if name == "MEDIAN":
            return self.side(ranks.quantile(self.values(args, env, held), self.keys, held, 0.5, held), held, "num", "#NUM!")
        if name in ("LARGE", "SMALL"):
            x = self.values(args[:1], env, held)
            k = self.number_of(args[1], name)
            order = F.col(held).desc() if name == "LARGE" else F.col(held).asc()
            if not isinstance(k, float):
                k = k.select((F.ceil("_k") if name == "LARGE" else F.floor("_k")).alias("_k"))
                got = ranks.prefix_totals(x, [], held, n=F.count(F.lit(1)))
                total = got.agg(F.sum("n").alias("_all"))
                got = got.join(F.broadcast(total.join(F.broadcast(k), how="inner")), how="inner")  # one row
                place = F.col("_all") - F.col("_k") + 1 if name == "LARGE" else F.col("_k")
                return self.side(got.filter((F.col("upto_n") >= place) & (F.col("upto_n") - F.col("n") < place)), held, "num", "#NUM!")
            k = math.ceil(k) if name == "LARGE" else math.floor(k)
            if k < 1:
                return C.error("#NUM!")
            if k > TOP:
                place = F.col("total") - k + 1 if name == "LARGE" else F.lit(k)
                return self.side(ranks.at_places(x, self.keys, held, {"v": place}).withColumnRenamed("v", held), held, "num", "#NUM!")
            if self.keys:
                w = Window.partitionBy(*self.keys).orderBy(order)
                return self.side(x.withColumn("_r", F.row_number().over(w)).filter(F.col("_r") == k), held, "num", "#NUM!")
            return self.side(x.orderBy(order).limit(k).offset(k - 1), held, "num", "#NUM!")
        if not t.order_by or self.keys:
            raise FormulaError(f"{name} needs order_by and no keys")
        if name == "INDEX":
            v = compile_node(args[0], env)
            r = self.number_of(args[1], name)
            value, hit = (v.col if v.err is None else F.when(v.err.isNull(), v.col)).alias(held), F.lit(True).alias("_hit")
            if isinstance(r, float):
                r = math.trunc(r)
                if r < 1:
                    return C.error("#VALUE!")
                if r <= TOP:
                    return self.side(t.df.orderBy(*t.full_order()).select(value, hit).limit(r).offset(r - 1), held, v.kind, "#REF!", True)
                r = t.df.sparkSession.range(1).select(F.lit(float(r)).alias("_k"))
            at, bad = fresh("at"), fresh("bad")
            found = t.numbered(at).df.join(F.broadcast(r), F.col(at) == F.floor("_k")).select(value, hit)  # one row
            out = self.side(found, held, v.kind, "#REF!", True)
            self.sides.append(r.groupBy().agg(F.first("_k").alias(bad)))
            return replace(out, err=F.when(F.col(bad).isNull(), "#N/A").when(F.col(bad) < 1, "#VALUE!").otherwise(out.err))
        if name == "MATCH":
            if len(args) == 3 and _literal(args[2], name) != 0:
                return C.error("#N/A")
            order = F.struct(*[F.col(c) for c in t.full_order()])
            r = compile_node(args[1], env)
            target = compile_node(args[0], t.env(False, None))
            hit = C.criterion_test(env, r, replace(target, literal=None)) if r.kind == target.kind or "num" in (r.kind, target.kind) else F.lit(False)
            first = t.df.filter(hit).agg(F.min(order).alias("_first"))
            at = t.df.join(F.broadcast(first), how="inner").agg(F.count_if(order < F.col("_first")).alias("_n"), F.max("_first").alias("_first"))  # one row
            return self.side(at.select(F.when(F.col("_first").isNotNull(), (F.col("_n") + 1).cast("double")).alias(held)), held, "num", "#N/A")
        raise FormulaError(f"{name} has no meaning in an aggregate formula")


def node_text(node) -> str:
    """A tree as formula text."""
    if isinstance(node, p.Num):
        return repr(node.value)
    if isinstance(node, p.Text):
        return '"' + node.value.replace('"', '""') + '"'
    if isinstance(node, p.Bool):
        return "TRUE" if node.value else "FALSE"
    if isinstance(node, p.ErrorLit):
        return node.code
    if isinstance(node, p.Column):
        return f"[{'@' if node.this_row else ''}{node.name}]"
    if isinstance(node, p.Name):
        return node.name
    if isinstance(node, p.Unary):
        return f"({node_text(node.arg)}%)" if node.op == "%" else f"({node.op}{node_text(node.arg)})"
    if isinstance(node, p.Binary):
        return f"({node_text(node.left)}{node.op}{node_text(node.right)})"
    if isinstance(node, p.Call):
        return f"{node.name}({','.join(map(node_text, node.args))})"
    if isinstance(node, p.Ref):
        a = p.cell_name(node.row, node.col) if node.single else f"{p.cell_name(node.row, node.col)}:{p.cell_name(node.row2, node.col2)}"
        return f"'{node.sheet}'!{a}" if node.sheet else a
    if isinstance(node, p.Array):
        return "{" + ";".join(",".join(map(node_text, r)) for r in node.rows) + "}"
    raise FormulaError(str(node))


__all__ = ["Table", "first_rows", "node_text"]
