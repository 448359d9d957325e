"""Table mode: compiled columns against the cell-by-cell evaluator, totals, lookups and rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tabulon.cli import main
from tabulon.functions import columns as C
from tabulon.operators import conditional as K
from tabulon.operators.grid import Workbook
from tabulon.operators.table import Table
from tabulon.plans.evaluator import Context, evaluate
from tabulon.plans.parser import FormulaError, parse
from tabulon.plans.values import Err

FORMULAS = [
    "=[@a]+[@b]", "=[@a]/[@b]", "=[@a]^[@b]", "=-[@a]%", "=[@a]&[@s]&[@t]", "=[@a]=[@b]", "=[@a]<[@s]", "=[@s]<>[@u]", "=[@t]>[@a]", "=[@s]>=\"b\"", "=[@s]+1", "=[@t]*2", "=[@s]=[@a]",
    "=ABS([@a])", "=ROUND([@a],1)", "=ROUND([@a],[@n])", "=TRUNC([@a])", "=INT([@a])", "=MOD([@a],[@b])", "=SIGN([@a])", "=SQRT([@a])", "=LN([@a])", "=LOG([@a],[@b])", "=EXP([@a])", "=POWER([@a],[@b])",
    "=ROUNDUP([@a],1)", "=ROUNDDOWN([@a],1)", "=ODD([@a])", "=EVEN([@a])", "=CEILING.MATH([@a],[@b])", "=CEILING.MATH([@a],2,1)", "=FLOOR.MATH([@a],[@b])", "=ATAN2([@a],[@b])", "=ACOS([@a])", "=ABS([@s])",
    '=IF([@a]>1,"big",[@b])', "=IF([@t],[@a],[@s])", "=IF([@a],1,2)", "=AND([@a]>0,[@t])", "=OR([@a]>5,[@b]>5)", "=XOR([@a],[@b])", "=NOT([@a])", "=IFERROR([@a]/[@b],[@s])", "=IFERROR([@s]+1,-1)", '=IFS([@a]>5,"x",[@b]>5,"y")',
    '=SWITCH([@s],"A","one","b","two","none")', "=SWITCH([@n],1,\"one\",2,\"two\")", '=CHOOSE([@n],"x","y")', "=IFNA(IFS([@a]>5,1),0)",
    "=LEN([@s])", "=LEN([@a])", "=LEFT([@s],[@n])", "=RIGHT([@s],2)", "=MID([@s],[@n],2)", "=UPPER([@s])", "=TRIM([@s])", '=FIND("b",[@s])', '=SEARCH("B",[@s],[@n])', "=EXACT([@s],[@u])", "=REPT([@s],[@n])",
    '=SUBSTITUTE([@s],"b","--")', '=SUBSTITUTE([@s],"b","--",[@n])', "=PROPER([@s])", "=CODE([@s])", "=CHAR(64+[@n])", "=CLEAN([@s])", "=VALUE([@s])", "=T([@s])", "=N([@t])", "=CONCAT([@a],\"-\",[@s])",
    "=ISBLANK([@a])", "=ISNUMBER([@a])", "=ISTEXT([@s])", "=ISERROR([@a]/[@b])", "=ISNA(NA())", "=YEAR([@n]+20000)", "=MONTH([@n]+40000)", "=DAY([@n]+59)", "=DATE(2000+[@n],[@n],[@n]*9)", "=DATE(1900,[@n],29)",
    "=SUM([@a],[@b],[@s])", "=MAX([@a],[@b])", "=COUNT([@a],[@s],1)", "=AVERAGE([@a],[@b])",
]
COLUMNS = ["a", "b", "n", "s", "u", "t"]


def rows():
    rng = random.Random(3)
    texts = [None, "", "A", "b", "ab-ba b", "12", " 1e2 ", "hELLO wORLD", "é€", "x\ty"]
    out = []
    for _ in range(120):
        num = lambda: rng.choice([None, 0.0, 1.0, -1.0, 2.5, -2.5, 7.25, 1e10, 0.1, -3.0, rng.uniform(-9, 9)])
        out.append((num(), num(), float(rng.randint(-1, 4)), rng.choice(texts), rng.choice(texts), rng.choice([None, True, False])))
    return out


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows())], "i int, a double, b double, n double, s string, u string, t boolean").coalesce(1).cache()


def same(got, want) -> bool:
    if isinstance(want, bool) or isinstance(got, bool) or isinstance(want, str) or isinstance(got, str):
        return got == want
    got, want = 0.0 if got is None else got, 0.0 if want is None else want
    return math.isclose(got, want, rel_tol=1e-9, abs_tol=1e-12)


@pytest.mark.parametrize("part", range(8))
def test_columns_equal_cells(frame, part):
    data = rows()
    for formula in FORMULAS[part::8]:
        got = {r.i: r for r in Table(frame).with_formula("v", formula, errors=True).df.select("i", "v", "v_err").collect()}
        text = formula
        for j, c in enumerate(COLUMNS):
            text = text.replace(f"[@{c}]", f"{chr(65 + j)}1")
        tree = parse(text)
        for i, row in enumerate(data):
            want = evaluate(tree, Context("S", 0, 0, lambda s, r, c, row=row: row[c], None, ("S",)))
            r = got[i]
            if isinstance(want, Err):
                assert r.v_err == want.code, (formula, row, r, want)
            else:
                assert r.v_err is None, (formula, row, r, want)
                if isinstance(want, float) and isinstance(r.v, str):  # branches of several kinds become text
                    want = evaluate(parse("=A1&\"\""), Context("S", 0, 0, lambda s, a, b, w=want: w, None, ("S",)))
                elif isinstance(r.v, str) and want is None:
                    want = ""
                elif isinstance(r.v, str) and isinstance(want, bool):
                    want = str(want).upper()
                elif r.v is None and want == "":
                    want = None
                assert same(r.v, want), (formula, row, r, want)


def test_totals(spark):
    d = spark.createDataFrame([(1, 10.0, "x"), (2, None, "y"), (3, 30.0, "X"), (4, 5.0, None)], "k int, v double, s string")
    t = Table(d, order_by=("k",))
    r = t.agg(
        total="=SUM([v])", mean="=AVERAGE([v])", n="=COUNT([v])", na="=COUNTA([s])", blank="=COUNTBLANK([v])", x='=SUMIF([s],"x",[v])', none='=AVERAGEIF([v],">99")', big="=LARGE([v],1)", out="=LARGE([v],9)",
        second="=INDEX([v],3)", at='=MATCH("y",[s])', miss='=MATCH("z",[s])', med="=MEDIAN([v])", text="=CONCAT([s])", two="=SUM([v])/COUNT([v])", product="=SUMPRODUCT([v],[k])", empty='=COUNTIF([s],"")', far="=INDEX([v],9)",
    ).first()
    assert (r.total, r.mean, r.n, r.na, r.blank, r.x, r.big, r.second, r.at, r.med, r.text, r.two) == (45, 15, 3, 3, 1, 40, 30, 30, 2, 10, "xyX", 15)
    assert (r.none, r.none_err, r.out_err, r.miss_err, r.far_err) == (None, "#DIV/0!", "#NUM!", "#N/A", "#REF!")
    assert r.product == 10 + 90 + 20 and r.empty == 1
    assert Table(d.limit(0)).agg(v="=SUM([v])", m="=MAX([v])").first() == (0.0, 0.0)


def test_lookup_takes_the_first_row_of_a_key(spark):
    right = spark.createDataFrame([(3, "c", 1), (1, "a", 2), (1, "z", 1), (None, "n", 1)], "k int, v string, o int")
    left = spark.createDataFrame([("1",), ("2",), (None,), ("3",)], "k string")
    t = Table(left, tables={"r": Table(right, order_by=("o",))}).with_formula("v", "=VLOOKUP([@k],r,2)", errors=True)
    assert {r.k: (r.v, r.v_err) for r in t.df.select("k", "v", "v_err").collect()} == {"1": ("z", None), "2": (None, "#N/A"), None: (None, "#N/A"), "3": ("c", None)}
    for formula, code in (("=VLOOKUP([@k],r,0)", "#VALUE!"), ("=VLOOKUP([@k],r,9)", "#REF!")):
        assert {r.v_err for r in Table(left, tables={"r": Table(right)}).with_formula("v", formula, errors=True).df.collect()} == {code}


def test_per_row_totals_and_positions(spark):
    d = spark.createDataFrame([(1, "a", 1.0), (2, "A", 2.0), (3, "b", 4.0), (4, None, 8.0)], "i int, k string, v double")
    t = Table(d, order_by=("i",)).with_formula("s", "=SUMIFS([v],[k],[@k])").with_formula("n", '=COUNTIFS([k],[@k],[v],">1")').with_formula("m", "=AVERAGEIF([k],[@k],[v])").with_formula("r", "=ROW()")
    got = {r.i: (r.s, r.n, r.m, r.r) for r in t.df.collect()}
    assert got[1] == (3, 1, 1.5, 1) and got[2] == (3, 1, 1.5, 2) and got[3] == (4, 1, 4, 3)


def test_refusals(spark):
    t = Table(spark.range(3).withColumn("x", F.lit(1.0)))
    for f in ("=NOPE(1)", "=[@y]", "=unknown", "=ABS(1,2)", "=A1+1"):
        with pytest.raises(FormulaError):
            t.with_formula("v", f)
    with pytest.raises(FormulaError):
        t.agg(v="=[@x]")


def test_one_aggregation_for_all_totals(spark, capsys):
    d = spark.createDataFrame([(1, 2.0)], "k int, v double")
    Table(d).agg(a="=SUM([v])", b='=COUNTIF([v],">1")', c="=AVERAGE([v])", e="=MAX([v])").explain()
    plan = capsys.readouterr().out
    assert plan.count("HashAggregate") == 2 and plan.count("Exchange") == 1


def test_custom_function(spark):
    t = Table(spark.range(1)).register("ADDONE", 1, 1, lambda env, v: C.num(C.pure_number(v)[0] + 1))
    assert t.with_formula("v", "=ADDONE(4)").df.first().v == 5


def test_rules(spark):
    d = spark.createDataFrame([(1, 10.0, "x", "2024-03-10"), (2, 20.0, "xy", "2024-03-03"), (3, 30.0, "", None), (4, None, None, "2024-04-01")], "i int, v double, s string, d string")
    flags = lambda df, c="flag": [r[c] for r in df.orderBy("i").collect()]
    assert flags(K.cell_is(d, "v", "notBetween", 15, 25)) == [True, False, True, False]
    assert flags(K.contains_text(d, "s", "X", "endsWith")) == [True, False, False, False]
    assert flags(K.blanks(d, "s")) == [False, False, True, True]
    assert flags(K.top(d, "v", 1)) == [False, False, True, False] and flags(K.top(d, "v", 1, bottom=True)) == [True, False, False, False]
    assert flags(K.above_average(d, "v", equal=True)) == [False, True, True, False]
    assert flags(K.above_average(d, "v", below=True)) == [True, False, False, False]
    assert flags(K.color_scale(d, "v"), "scale") == [0, 0.5, 1, None]
    assert flags(K.icon_set(d, "v", reverse=True), "icon") == [2, 1, 0, None]
    assert flags(K.data_bar(d, "v", 10, 90), "bar") == [10, 50, 90, None]
    t = d.withColumn("d", F.to_date("d"))
    assert flags(K.time_period(t, "d", "lastWeek", "2024-03-11")) == [False, True, False, False]
    assert flags(K.time_period(t, "d", "thisWeek", "2024-03-11")) == [True, False, False, False]
    assert flags(K.time_period(t, "d", "nextMonth", "2024-03-11")) == [False, False, False, True]
    assert flags(K.duplicates(d, ["s"], unique=True)) == [True] * 4
    assert flags(K.valid(d, "v", "whole", "lessThan", 25), "valid") == [True, True, False, True]
    assert flags(K.valid(d, "s", "list", values=["x"], allow_blank=False), "valid") == [True, False, False, False]
    assert K.violations(d, "v", "decimal", op="greaterThan", a=15).count() == 1


def test_command_line(tmp_path, capsys):
    b = Workbook()
    s = b.add_sheet("One")
    s.set_cell("B2", 2)
    s.set_cell("C2", "=B2*2")
    path = str(tmp_path / "a.xlsx")
    b.save(path)
    assert main(["to-csv", path, "-c", "-d", ";"]) == 0
    assert capsys.readouterr().out == ";;\n;2;4\n"
    assert main(["sheets", path]) == 0 and capsys.readouterr().out == "One\n"
    assert main(["info", path]) == 0 and "B2:C2, 2 cells, 1 formulas" in capsys.readouterr().out
    assert main(["info", str(tmp_path / "none.xlsx")]) == 1
