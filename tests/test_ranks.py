"""Order statistics, row criteria and lookups in table mode against plain Python."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tabulon.functions import columns as C
from tabulon.operators import criteria, ranks
from tabulon.operators.table import Table
from tabulon.plans.parser import FormulaError
from tabulon.sources import csv_files
from tests.test_table import same


def some(n=300, seed=5):
    rng = random.Random(seed)
    return [(i, rng.choice(["a", "b", None]), rng.choice([None, 1.0, 2.0, 2.0, rng.uniform(-5, 5)]), rng.choice(["red", "Reed", "r*d", "", None, "10", "x y"])) for i in range(n)]


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(some(), "i int, k string, q double, s string").repartition(5).cache()


def test_quantiles_and_prefix_totals(frame, spark):
    rows = some()
    for q in (0.0, 0.25, 0.5, 0.9, 1.0):
        got = {r.k: r.v for r in ranks.quantile(frame, ["k"], "q", q, "v").collect()}
        for k in ("a", "b", None):
            x = sorted(r[2] for r in rows if r[1] == k and r[2] is not None)
            at = q * (len(x) - 1)
            lo, hi = x[int(at)], x[min(int(at) + 1, len(x) - 1)]
            assert same(got[k], lo + (at - int(at)) * (hi - lo))
    upto = {r.q: r.upto_n for r in ranks.prefix_totals(frame.filter("q is not null"), [], "q", n=F.count(F.lit(1))).collect()}
    assert all(n == sum(r[2] is not None and r[2] <= x for r in rows) for x, n in upto.items())
    assert ranks.quantile(frame.limit(0), ["k"], "q", 0.5, "v").count() == 0


def test_totals_compose(frame):
    x = sorted((r[2] for r in some() if r[2] is not None), reverse=True)
    t = Table(frame, order_by=("k",))
    one = t.agg(a="=LARGE([q],2)+SUM([q])", b="=MEDIAN([q])*2-SMALL([q],1)", c='=IFERROR(MATCH("zz",[s],0),-1)', d="=INDEX([i],MATCH(7,[i],0))+0", e="=LARGE([q],COUNT([q]))", f="=LARGE([q],COUNT([q])+1)").first()
    assert same(one.a, x[1] + sum(x)) and same(one.b, 2 * statistics.median(x) - x[-1]) and one.c == -1 and one.d == 7 and same(one.e, x[-1])
    assert one.f is None and one.f_err == "#NUM!"
    two = t.agg(g='=IF(MATCH("red",[s],0)>0,"found","no")', h="=INDEX([q],0)", j="=INDEX([q],99999)", m="=MEDIAN([q],100,200)").first()
    assert two.g == "found" and two.h_err == "#VALUE!" and two.j_err == "#REF!" and same(two.m, statistics.median([*x, 100, 200]))
    keyed = {r.k: r.v for r in t.group(["k"], v="=LARGE([q],1)-SMALL([q],1)+COUNT([q])*0").collect()}
    for k in ("a", "b", None):
        own = [r[2] for r in some() if r[1] == k and r[2] is not None]
        assert same(keyed[k], max(own) - min(own))
    none = Table(frame.limit(0), order_by=("i",)).agg(v="=IFERROR(MEDIAN([q]),-1)", w="=IFERROR(LARGE([q],1)+SUM([q]),-2)").first()
    assert none.v == -1 and none.w == -2


def test_match_is_the_first_row_in_order(frame):
    t = Table(frame, order_by=("k",))
    order = sorted(some(), key=lambda r: tuple((v is not None, v) for v in (r[1], r[0])))
    want = next(i for i, r in enumerate(order, 1) if (r[3] or "").lower() == "red")
    assert t.agg(v='=MATCH("red",[s],0)').first().v == want
    place = {r.i: r.v for r in t.with_formula("v", "=MATCH([@s],[s],0)").df.collect()}
    for r in order:
        if r[3]:
            assert place[r[0]] == next(i for i, x in enumerate(order, 1) if (x[3] or "").lower() == r[3].lower())


@pytest.mark.parametrize("criterion", ['">"&[@q]', '"<="&[@q]', '"<>"&[@q]', '"="&[@q]', "[@q]&\"\"", "[@s]", '"?"&MID([@s],2,9)', '"*"'])
def test_row_criteria_equal_cells(frame, criterion):
    rows = some()
    t = Table(frame)
    for cells, at in (("q", 2), ("s", 3)):
        got = t.with_formula("c", f"={criterion}").with_formula("n", f"=COUNTIF([{cells}],{criterion})").with_formula("v", f"=SUMIFS([q],[{cells}],{criterion},[k],\"a\")")
        for r in got.df.collect():
            crit = criteria.parse(r.c or "")
            hit = [x for x in rows if criteria.matches(crit, x[at])]
            assert r.n == len(hit), (criterion, cells, r)
            assert same(r.v, sum(x[2] or 0 for x in hit if x[1] == "a")), (criterion, cells, r)


@pytest.mark.parametrize("limit", [100_000, 10])
def test_row_criteria_of_keys_by_key_and_by_ranges(frame, monkeypatch, limit):
    """Running totals of small keys are added up by key, those of large ones by ranges; both equal the cells."""
    from tabulon.operators import table

    used = []
    monkeypatch.setattr(table, "KEY_ROWS", limit)
    monkeypatch.setattr(ranks, "prefix_totals", lambda *x, f=ranks.prefix_totals, **y: used.append(1) or f(*x, **y))
    rows = some()
    got = Table(frame.withColumn("j", F.col("i") % 3)).with_formula("v", '=SUMIFS([i],[j],[@j],[q],"<"&[@q],[s],"r*")-SUMIFS([i],[j],[@j],[q],"<"&[@q],[s],"red")').with_formula("w", '=AVERAGEIFS([i],[j],[@j],[q],">="&[@q])').with_formula("n", '=COUNTIFS([j],[@j],[q],"<>"&[@q])')
    for r in got.df.collect():
        if r.q is not None:
            own = [x for x in rows if x[0] % 3 == r.i % 3]
            low = [x for x in own if x[2] is not None and x[2] < r.q and (x[3] or "").lower().startswith("r")]
            high = [x[0] for x in own if x[2] is not None and x[2] >= r.q]
            assert same(r.v, sum(x[0] for x in low if x[3].lower() != "red")) and same(r.w, sum(high) / len(high))
            assert r.n == sum(x[2] is not None and x[2] != r.q for x in own) + sum(x[2] is None for x in own) * criteria.matches(criteria.parse("<>1"), None)
    assert bool(used) == (limit == 10)


def test_row_criteria_are_joined_only_where_taken(frame):
    """A formula's joins are not run again to answer the next one."""
    t = Table(frame.withColumn("j", F.col("i") % 3)).with_formula("v", '=SUMIFS([i],[j],[@j],[q],"<"&[@q])')
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" in plan(t.df.select("i", "v")) and "Join" not in plan(t.df.select("i", "j", "q"))


def test_row_criteria_refuse_what_they_cannot(frame):
    with pytest.raises(FormulaError):
        Table(frame).with_formula("v", '=COUNTIFS([q],">"&[@q],[i],"<"&[@i])')
    assert C.TABLE["COUNTIF"]


def test_csv_line_breaks_in_quotes(spark, tmp_path):
    d = spark.createDataFrame([(1, 'a\n"b", c'), (2, None), (3, "")], "i int, t string")
    csv_files.sink(d, f"{tmp_path}/x")
    got = {r.i: r.t for r in csv_files.scan(spark, f"{tmp_path}/x", schema=d.schema).collect()}
    assert got[1] == 'a\n"b", c' and not got[2] and not got[3]
