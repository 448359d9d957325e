"""Conditional formats and validations as predicates over a table.

Rules compare a column with thresholds; those over the whole column (averages, extremes, ranks) read small
aggregates of it: one row that is joined, never a window over all rows in one task. Duplicates are counted per value with map-side combining and joined
back by value.
"""

from __future__ import annotations

import functools
import operator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.operators import ranks
from tabulon.operators.table import TOP, Table, fresh

#: The operators of the rule model.
OPERATORS = {
    "equal": operator.eq, "notEqual": operator.ne, "greaterThan": operator.gt, "lessThan": operator.lt,
    "greaterThanOrEqual": operator.ge, "lessThanOrEqual": operator.le,
}


def compare(col: Column, op: str, a, b=None) -> Column:
    """One of the eight comparisons; null counts as false."""
    if op in ("between", "notBetween"):
        inside = col.between(F.lit(a), F.lit(b))
        return F.coalesce(inside if op == "between" else ~inside, F.lit(False))
    return F.coalesce(OPERATORS[op](col, F.lit(a)), F.lit(False))


def _with_totals(df: DataFrame, **aggs: Column) -> DataFrame:
    return df.join(F.broadcast(df.agg(*[c.alias(n) for n, c in aggs.items()])), how="left")  # one row


def cell_is(df: DataFrame, column: str, op: str, a, b=None, flag: str = "flag") -> DataFrame:
    return df.withColumn(flag, compare(F.col(column), op, a, b))


def expression(df: DataFrame, formula: str, flag: str = "flag") -> DataFrame:
    """A formula per row; errors and empty results are false."""
    out = Table(df).with_formula(flag, formula).df
    return out.withColumn(flag, F.coalesce(F.col(flag).cast("boolean"), F.lit(False)))


def contains_text(df: DataFrame, column: str, text: str, where: str = "contains", flag: str = "flag") -> DataFrame:
    """where: contains, notContains, beginsWith or endsWith; without regard to case."""
    low, part = F.lower(F.coalesce(F.col(column), F.lit(""))), F.lit(text.lower())
    test = {"contains": low.contains(part), "notContains": ~low.contains(part), "beginsWith": low.startswith(part), "endsWith": low.endswith(part)}[where]
    return df.withColumn(flag, test)


def blanks(df: DataFrame, column: str, present: bool = True, flag: str = "flag") -> DataFrame:
    blank = F.trim(F.coalesce(F.col(column).cast("string"), F.lit(""))) == ""
    return df.withColumn(flag, blank if present else ~blank)


def has_error(df: DataFrame, formula: str, present: bool = True, flag: str = "flag") -> DataFrame:
    name = fresh("rule")
    out = Table(df).with_formula(name, formula, errors=True).df
    bad = F.col(f"{name}_err").isNotNull()
    return out.withColumn(flag, bad if present else ~bad).drop(name, f"{name}_err")


def duplicates(df: DataFrame, columns: list[str], unique: bool = False, flag: str = "flag") -> DataFrame:
    """Values that occur more than once (or just once)."""
    n = fresh("n")
    often = df.groupBy(*columns).agg(F.count("*").alias(n)).filter(F.col(n) > 1)
    often = often.select(*[F.col(c).alias(f"_d_{c}") for c in columns], n)
    out = df.join(often, [F.col(c).eqNullSafe(F.col(f"_d_{c}")) for c in columns], "left")
    hit = F.col(n).isNull() if unique else F.col(n).isNotNull()
    return out.withColumn(flag, hit).drop(n, *[f"_d_{c}" for c in columns])


def top(df: DataFrame, column: str, rank: int = 10, percent: bool = False, bottom: bool = False, flag: str = "flag") -> DataFrame:
    """The highest (or lowest) ranks, ties included: all that reach the value at that rank."""
    x, at = F.col(column), fresh("at")
    values = df.filter(x.isNotNull()).select(x.alias(at))
    if percent or rank > TOP:  # a share of all rows: found by running totals of ranges
        n = F.greatest(F.floor(F.col("total") * rank / 100), F.lit(1)) if percent else F.least(F.lit(rank), F.col("total"))
        edge = ranks.at_places(values, [], at, {at: n if bottom else F.col("total") - n + 1})
    else:
        edge = values.orderBy(F.col(at).asc() if bottom else F.col(at).desc()).limit(rank).agg((F.max if bottom else F.min)(at).alias(at))
    out = df.join(F.broadcast(edge), how="left")  # one row
    return out.withColumn(flag, F.coalesce(x <= F.col(at) if bottom else x >= F.col(at), F.lit(False))).drop(at)


def above_average(df: DataFrame, column: str, below: bool = False, equal: bool = False, deviations: float = 0.0, flag: str = "flag") -> DataFrame:
    m, s = fresh("m"), fresh("s")
    out = _with_totals(df, **{m: F.avg(column), s: F.stddev_pop(column)})
    edge = F.col(m) + (-deviations if below else deviations) * F.col(s)
    x = F.col(column)
    test = (x <= edge if equal else x < edge) if below else (x >= edge if equal else x > edge)
    return out.withColumn(flag, F.coalesce(test, F.lit(False))).drop(m, s)


def color_scale(df: DataFrame, column: str, middle: float | None = None, name: str = "scale") -> DataFrame:
    """Place of each value between the least (0) and the greatest (1); with middle (a percentile) that one is 0.5."""
    lo, hi, mid = fresh("lo"), fresh("hi"), fresh("mid")
    aggs = {lo: F.min(column), hi: F.max(column)}
    out = _with_totals(df, **aggs)
    if middle is not None:
        aggs[mid] = None
        out = out.join(F.broadcast(ranks.quantile(df.select(F.col(column).cast("double").alias("_x")), [], "_x", middle / 100, mid)), how="left")  # one row
    x = F.col(column)
    if middle is None:
        at = F.try_divide(x - F.col(lo), F.col(hi) - F.col(lo))
    else:
        at = F.when(x <= F.col(mid), F.coalesce(0.5 * F.try_divide(x - F.col(lo), F.col(mid) - F.col(lo)), F.lit(0.5))).otherwise(0.5 + 0.5 * F.try_divide(x - F.col(mid), F.col(hi) - F.col(mid)))
    return out.withColumn(name, F.when(x.isNotNull(), F.coalesce(at, F.lit(0.0)))).drop(*aggs)


def data_bar(df: DataFrame, column: str, low: float = 0.0, high: float = 100.0, name: str = "bar") -> DataFrame:
    """Bar length in percent, from low for the least value to high for the greatest."""
    out = color_scale(df, column, name=name)
    return out.withColumn(name, F.lit(low) + F.col(name) * (high - low))


def icon_set(df: DataFrame, column: str, thresholds: tuple[float, ...] = (0.0, 33.0, 67.0), reverse: bool = False, name: str = "icon") -> DataFrame:
    """Index of the icon: the last threshold, in percent of the range, that a value reaches."""
    out = color_scale(df, column, name=name)
    at = functools.reduce(lambda acc, t: acc + F.when(F.col(name) * 100 >= t, 1).otherwise(0), thresholds[1:], F.lit(0))
    icon = F.lit(len(thresholds) - 1) - at if reverse else at
    return out.withColumn(name, F.when(F.col(column).isNotNull(), icon))


def time_period(df: DataFrame, column: str, period: str, today: str | None = None, flag: str = "flag") -> DataFrame:
    """today, yesterday, tomorrow, last7Days, this/last/nextWeek (from Sunday), this/last/nextMonth."""
    now = F.lit(today).cast("date") if today else F.current_date()
    d = F.to_date(F.col(column))
    week = lambda x: F.date_sub(x, F.dayofweek(x) - 1)
    month = lambda x: F.trunc(x, "month")
    test = {
        "today": d == now, "yesterday": d == F.date_sub(now, 1), "tomorrow": d == F.date_add(now, 1), "last7Days": d.between(F.date_sub(now, 6), now),
        "thisWeek": week(d) == week(now), "lastWeek": week(d) == F.date_sub(week(now), 7), "nextWeek": week(d) == F.date_add(week(now), 7),
        "thisMonth": month(d) == month(now), "lastMonth": month(d) == F.add_months(month(now), -1), "nextMonth": month(d) == F.add_months(month(now), 1),
    }[period]
    return df.withColumn(flag, F.coalesce(test, F.lit(False)))


def first_rule(df: DataFrame, rules: list[tuple[str, str]], name: str = "format") -> DataFrame:
    """The name of the first rule, by priority, whose flag column is true; (flag column, name) pairs."""
    out = F.lit(None).cast("string")
    for flag, label in reversed(rules):
        out = F.when(F.col(flag), F.lit(label)).otherwise(out)
    return df.withColumn(name, out)


# Validations ------------------------------------------------------------------------------------------------------


def valid(df: DataFrame, column: str, kind: str, op: str = "between", a=None, b=None, values: list | None = None, formula: str | None = None, allow_blank: bool = True, flag: str = "valid") -> DataFrame:
    """Whether each row satisfies a validation: whole, decimal, list, date, time, textLength, custom or any."""
    x = F.col(column)
    if kind == "any":
        test = F.lit(True)
    elif kind == "custom":
        df = expression(df, formula, flag)
        test = F.col(flag)
    elif kind == "list":
        test = F.coalesce(x.cast("string").isin([str(v) for v in values]), F.lit(False))
    elif kind == "textLength":
        test = compare(F.length(x.cast("string")), op, a, b)
    elif kind in ("date", "time"):
        if isinstance(a, str):
            a, b = (F.lit(v).cast("date") if v is not None and kind == "date" else v for v in (a, b))
            if kind == "time":
                x = F.date_format(x, "HH:mm:ss")
        test = compare(x, op, a, b)
    else:
        n = x.try_cast("double") if dict(df.dtypes)[column] == "string" else x.cast("double")
        test = compare(n, op, a, b)
        if kind == "whole":
            test = test & F.coalesce(n == F.floor(n), F.lit(False))
    blank = F.coalesce(F.col(column).cast("string"), F.lit("")) == ""
    return df.withColumn(flag, F.when(blank, F.lit(allow_blank)).otherwise(test))


def violations(df: DataFrame, column: str, kind: str, **rule) -> DataFrame:
    """The rows that break a validation."""
    flag = fresh("ok")
    return valid(df, column, kind, flag=flag, **rule).filter(~F.col(flag)).drop(flag)
