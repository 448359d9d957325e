"""One query per operator, each beside the SQL that an independent engine runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.table import Table
from tabulon.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


def _rounded(df: DataFrame, digits: int | None, name: str = "v") -> DataFrame:
    return df if digits is None else df.withColumn(name, F.round(F.col(name), digits))


def _per_row(name: str, source: str, keys: str, formula: str, sql: str, digits: int | None = None, errors: bool = False, err_sql: str = "cast(null as varchar)") -> None:
    cols = keys.split()

    def run(spark, sf_dir):
        t = Table(table(spark, sf_dir, source)).with_formula("v", formula, errors)
        return _rounded(t.df.select(*cols, "v", *(["v_err"] if errors else [])), digits)

    value = f"round({sql}, {digits})" if digits is not None else sql
    query(name, f"select {', '.join(cols)}, {value} as v{f', {err_sql} as v_err' if errors else ''} from {source}")(run)


def _total(name: str, source: str, keys: str, formula: str, sql: str, digits: int | None = None, order_by: str = "") -> None:
    cols = keys.split()

    def run(spark, sf_dir):
        t = Table(table(spark, sf_dir, source), order_by=tuple(order_by.split()))
        return _rounded(t.group(cols, v=formula).select(*cols, "v"), digits)

    value = f"round({sql}, {digits})" if digits is not None else sql
    query(name, f"select {''.join(c + ', ' for c in cols)}{value} as v from {source}{' group by ' + ', '.join(cols) if cols else ''}")(run)


CUSTOMER, PART, LINE, ORDERS, DOCS = "c_custkey", "p_partkey", "l_orderkey l_partkey l_linenumber l_extendedprice", "o_orderkey", "doc_id"
_r = "case when c_acctbal >= 0 then floor(c_acctbal * 10 + 0.5::double) else ceil(c_acctbal * 10 - 0.5::double) end / 10::double"

for _q in (
    # operators
    ("op_add", "orders", ORDERS, "=[@o_totalprice]+100-50.5", "o_totalprice + 100::double - 50.5::double"),
    ("op_multiply", "lineitem", LINE, "=[@l_extendedprice]*(1-[@l_discount])", "l_extendedprice * (1::double - l_discount)"),
    ("op_divide", "lineitem", LINE, "=[@l_extendedprice]/[@l_discount]", "case when l_discount <> 0 then l_extendedprice / l_discount end", None, True, "case when l_discount = 0 then '#DIV/0!' end"),
    ("op_power", "part", PART, "=[@p_size]^2", "pow(p_size, 2::double)"),
    ("op_percent", "lineitem", LINE, "=[@l_quantity]%", "l_quantity / 100::double"),
    ("op_negate", "customer", CUSTOMER, "=-[@c_acctbal]", "-c_acctbal"),
    ("op_concat", "customer", CUSTOMER, '=[@c_mktsegment]&"-"&[@c_custkey]', "c_mktsegment || '-' || c_custkey"),
    ("op_equal_text", "orders", ORDERS, '=[@o_orderpriority]="2-high"', "lower(o_orderpriority) = '2-high'"),
    ("op_compare", "lineitem", LINE, "=[@l_quantity]>=25", "l_quantity >= 25"),
    ("op_compare_kinds", "part", PART, "=[@p_size]<[@p_name]", "true"),
    # one number
    ("abs", "customer", CUSTOMER, "=ABS([@c_acctbal])", "abs(c_acctbal)"),
    ("round", "customer", CUSTOMER, "=ROUND([@c_acctbal],1)", _r),
    ("roundup", "customer", CUSTOMER, "=ROUNDUP([@c_acctbal],1)", "case when c_acctbal >= 0 then ceil(c_acctbal * 10) else floor(c_acctbal * 10) end / 10::double"),
    ("rounddown", "customer", CUSTOMER, "=ROUNDDOWN([@c_acctbal],1)", "trunc(c_acctbal * 10) / 10::double"),
    ("trunc", "customer", CUSTOMER, "=TRUNC([@c_acctbal])", "trunc(c_acctbal)"),
    ("int", "customer", CUSTOMER, "=INT([@c_acctbal])", "floor(c_acctbal)"),
    ("mod", "customer", CUSTOMER, "=MOD([@c_acctbal],7)", "c_acctbal - 7::double * floor(c_acctbal / 7::double)", 6),
    ("sign", "customer", CUSTOMER, "=SIGN([@c_acctbal])", "cast(sign(c_acctbal) as double)"),
    ("sqrt", "customer", CUSTOMER, "=SQRT([@c_acctbal])", "case when c_acctbal >= 0 then sqrt(c_acctbal) end", 9, True, "case when c_acctbal < 0 then '#NUM!' end"),
    ("power", "part", PART, "=POWER([@p_size],2)", "pow(p_size, 2::double)"),
    ("log", "part", PART, "=LOG([@p_retailprice],2)", "ln(p_retailprice) / ln(2::double)", 9),
    ("log10", "part", PART, "=LOG10([@p_retailprice])", "log10(p_retailprice)", 9),
    ("ln", "part", PART, "=LN([@p_retailprice])", "ln(p_retailprice)", 9),
    ("exp", "lineitem", LINE, "=EXP([@l_tax])", "exp(l_tax)", 9),
    ("pi", "region", "r_regionkey", "=PI()", "pi()", 12),
    ("sin", "part", PART, "=SIN([@p_retailprice])", "sin(p_retailprice)", 9),
    ("cos", "part", PART, "=COS([@p_retailprice])", "cos(p_retailprice)", 9),
    ("tan", "part", PART, "=TAN([@p_size])", "tan(p_size)", 7),
    ("asin", "lineitem", LINE, "=ASIN([@l_discount])", "asin(l_discount)", 9),
    ("acos", "lineitem", LINE, "=ACOS([@l_discount])", "acos(l_discount)", 9),
    ("atan", "part", PART, "=ATAN([@p_retailprice])", "atan(p_retailprice)", 9),
    ("atan2", "lineitem", LINE, "=ATAN2([@l_discount],[@l_tax])", "case when l_discount <> 0 or l_tax <> 0 then atan2(l_tax, l_discount) end", 9, True, "case when l_discount = 0 and l_tax = 0 then '#DIV/0!' end"),
    ("degrees", "lineitem", LINE, "=DEGREES([@l_discount])", "degrees(l_discount)", 9),
    ("radians", "lineitem", LINE, "=RADIANS([@l_quantity])", "radians(l_quantity)", 9),
    ("ceiling_math", "customer", CUSTOMER, "=CEILING.MATH([@c_acctbal],50)", "ceil(c_acctbal / 50::double) * 50 + 0::double"),
    ("floor_math", "customer", CUSTOMER, "=FLOOR.MATH([@c_acctbal],50)", "floor(c_acctbal / 50::double) * 50 + 0::double"),
    ("odd", "customer", CUSTOMER, "=ODD([@c_acctbal])", "case when c_acctbal < 0 then -1 else 1 end * (ceil(abs(c_acctbal)) + case when ceil(abs(c_acctbal)) % 2 = 0 then 1 else 0 end)"),
    ("even", "customer", CUSTOMER, "=EVEN([@c_acctbal])", "case when c_acctbal < 0 then -1 else 1 end * (ceil(abs(c_acctbal)) + case when ceil(abs(c_acctbal)) % 2 = 1 then 1 else 0 end)"),
    # logical
    ("if", "lineitem", LINE, '=IF([@l_quantity]>25,"Yes","No")', "case when l_quantity > 25 then 'Yes' else 'No' end"),
    ("and", "lineitem", LINE, "=AND([@l_quantity]>10,[@l_discount]<0.05)", "l_quantity > 10 and l_discount < 0.05::double"),
    ("or", "lineitem", LINE, "=OR([@l_quantity]>40,[@l_discount]>0.08)", "l_quantity > 40 or l_discount > 0.08::double"),
    ("xor", "lineitem", LINE, "=XOR([@l_quantity]>25,[@l_tax]>0.04)", "(l_quantity > 25) <> (l_tax > 0.04::double)"),
    ("not", "lineitem", LINE, "=NOT([@l_quantity]>25)", "not (l_quantity > 25)"),
    ("iferror", "lineitem", LINE, "=IFERROR([@l_extendedprice]/[@l_discount],-1)", "case when l_discount = 0 then -1::double else l_extendedprice / l_discount end"),
    ("ifs", "lineitem", LINE, '=IFS([@l_quantity]<10,"S",[@l_quantity]<30,"M")', "case when l_quantity < 10 then 'S' when l_quantity < 30 then 'M' end", None, True, "case when l_quantity >= 30 then '#N/A' end"),
    ("switch", "orders", ORDERS, '=SWITCH([@o_orderstatus],"f",1,"o",2,0)', "case lower(o_orderstatus) when 'f' then 1::double when 'o' then 2 else 0 end"),
    ("true_false", "region", "r_regionkey", "=IF(TRUE(),FALSE(),TRUE)", "false"),
    ("choose", "lineitem", LINE, '=CHOOSE([@l_linenumber],"a","b","c")', "case l_linenumber when 1 then 'a' when 2 then 'b' when 3 then 'c' end", None, True, "case when l_linenumber not between 1 and 3 then '#VALUE!' end"),
    # text
    ("len", "documents", DOCS, "=LEN([@text])", "cast(length(text) as double)"),
    ("left", "part", PART, "=LEFT([@p_name],3)", "left(p_name, 3)"),
    ("right", "part", PART, "=RIGHT([@p_name],3)", "right(p_name, 3)"),
    ("mid", "part", PART, "=MID([@p_name],2,3)", "substring(p_name, 2, 3)"),
    ("lower", "documents", DOCS, "=LOWER([@text])", "lower(text)"),
    ("upper", "part", PART, "=UPPER([@p_name])", "upper(p_name)"),
    ("trim", "documents", DOCS, "=TRIM([@text])", r"trim(regexp_replace(text, '\s+', ' ', 'g'))"),
    ("concat", "part", PART, "=CONCAT([@p_brand],[@p_type])", "p_brand || p_type"),
    ("concatenate", "part", PART, '=CONCATENATE([@p_brand],"/",[@p_type])', "p_brand || '/' || p_type"),
    ("findb", "part", PART, '=FINDB("r",[@p_name],2)', "case when instr(substring(p_name, 2), 'r') > 0 then instr(substring(p_name, 2), 'r') + 1::double end", None, True, "case when instr(substring(p_name, 2), 'r') = 0 then '#VALUE!' end"),
    ("searchb", "part", PART, '=SEARCHB("E",[@p_name])', "cast(nullif(instr(lower(p_name), 'e'), 0) as double)", None, True, "case when instr(lower(p_name), 'e') = 0 then '#VALUE!' end"),
    ("lenb", "documents", DOCS, "=LENB([@text])", "cast(length(text) as double)"),
    ("leftb", "part", PART, "=LEFTB([@p_name],3)", "left(p_name, 3)"),
    ("rightb", "part", PART, "=RIGHTB([@p_name],3)", "right(p_name, 3)"),
    ("midb", "part", PART, "=MIDB([@p_name],2,3)", "substring(p_name, 2, 3)"),
    ("find", "part", PART, '=FIND("r",[@p_name],2)', "case when instr(substring(p_name, 2), 'r') > 0 then instr(substring(p_name, 2), 'r') + 1::double end", None, True, "case when instr(substring(p_name, 2), 'r') = 0 then '#VALUE!' end"),
    ("search", "part", PART, '=SEARCH("E",[@p_name])', "cast(nullif(instr(lower(p_name), 'e'), 0) as double)", None, True, "case when instr(lower(p_name), 'e') = 0 then '#VALUE!' end"),
    ("exact", "part", PART, "=EXACT([@p_type],UPPER([@p_type]))", "p_type = upper(p_type)"),
    ("rept", "part", PART, "=REPT(LEFT([@p_name],2),3)", "repeat(left(p_name, 2), 3)"),
    ("substitute", "part", PART, '=SUBSTITUTE([@p_name],"l","1")', "replace(p_name, 'l', '1')"),
    ("substitute_nth", "part", PART, '=SUBSTITUTE([@p_name],"l","#",2)', "case when length(p_name) - length(replace(p_name, 'l', '')) >= 2 then array_to_string(string_split(p_name, 'l')[1:2], 'l') || '#' || array_to_string(string_split(p_name, 'l')[3:], 'l') else p_name end"),
    ("proper", "part", PART, "=PROPER([@p_brand])", r"array_to_string(list_transform(regexp_extract_all(lower(p_brand), '[\p{L}\p{N}]+|[^\p{L}\p{N}]+'), lambda x: upper(x[1:1]) || x[2:]), '')"),
    ("char", "part", PART, "=CHAR(64+[@p_size])", "chr(64 + p_size)"),
    ("code", "documents", DOCS, "=CODE([@text])", "case when text <> '' then cast(unicode(text) as double) end"),
    ("clean", "documents", DOCS, "=CLEAN([@text])", r"regexp_replace(text, '[\x00-\x1f]', '', 'g')"),
    ("value", "part", PART, '=VALUE(MID([@p_brand],FIND("#",[@p_brand])+1,9))', "try_cast(split_part(p_brand, '#', 2) as double)"),
    ("t", "part", PART, "=T([@p_name])&T([@p_size])", "p_name"),
    ("n", "part", PART, "=N([@p_size]>25)+N([@p_name])", "case when p_size > 25 then 1::double else 0 end"),
    # information
    ("isblank", "part", PART, "=ISBLANK([@p_name])", "p_name is null"),
    ("isnumber", "part", PART, "=ISNUMBER([@p_size])", "p_size is not null"),
    ("istext", "part", PART, "=ISTEXT([@p_name])", "p_name is not null"),
    ("iserror", "lineitem", LINE, "=ISERROR(1/[@l_discount])", "l_discount = 0"),
    ("isna", "lineitem", LINE, '=ISNA(IFS([@l_quantity]<10,"S"))', "l_quantity >= 10"),
    ("na", "region", "r_regionkey", "=IFNA(NA(),[@r_name])", "r_name"),
    # dates
    ("date", "orders", ORDERS, "=DATE(YEAR([@o_orderdate]),MONTH([@o_orderdate])+1,DAY([@o_orderdate]))", "date_diff('day', date '1899-12-30', cast(date_trunc('month', o_orderdate) as date) + interval 1 month) + day(o_orderdate) - 1::double"),
    ("date_serial", "orders", ORDERS, "=[@o_orderdate]+0", "cast(date_diff('day', date '1899-12-30', cast(o_orderdate as date)) as double)"),
    ("year", "orders", ORDERS, "=YEAR([@o_orderdate])", "cast(year(o_orderdate) as double)"),
    ("month", "orders", ORDERS, "=MONTH([@o_orderdate])", "cast(month(o_orderdate) as double)"),
    ("day", "orders", ORDERS, "=DAY([@o_orderdate])", "cast(day(o_orderdate) as double)"),
):
    _per_row(*_q)

for _q in (
    ("sum", "lineitem", "l_returnflag", "=SUM([l_quantity])", "sum(l_quantity)", 2),
    ("average", "lineitem", "l_returnflag", "=AVERAGE([l_quantity])", "avg(l_quantity)", 6),
    ("min", "lineitem", "l_returnflag", "=MIN([l_extendedprice])", "min(l_extendedprice)"),
    ("max", "lineitem", "l_returnflag", "=MAX([l_extendedprice])", "max(l_extendedprice)"),
    ("count", "lineitem", "l_returnflag", "=COUNT([l_quantity])", "cast(count(l_quantity) as double)"),
    ("counta", "part", "p_size", "=COUNTA([p_name])", "cast(count(nullif(p_name, '')) as double)"),
    ("countblank", "part", "p_size", "=COUNTBLANK([p_name])", "cast(count(*) filter (coalesce(p_name, '') = '') as double)"),
    ("sumif", "lineitem", "", '=SUMIF([l_quantity],">40",[l_extendedprice])', "coalesce(sum(l_extendedprice) filter (l_quantity > 40), 0)", 2),
    ("sumifs", "lineitem", "l_linestatus", '=SUMIFS([l_extendedprice],[l_returnflag],"r",[l_discount],">=0.05")', "coalesce(sum(l_extendedprice) filter (lower(l_returnflag) = 'r' and l_discount >= 0.05::double), 0)", 2),
    ("countif", "part", "", '=COUNTIF([p_name],"s*t")', "cast(count(*) filter (regexp_full_match(lower(p_name), 's.*t', 's')) as double)"),
    ("countifs", "lineitem", "l_returnflag", '=COUNTIFS([l_quantity],">10",[l_linenumber],1)', "cast(count(*) filter (l_quantity > 10 and l_linenumber = 1) as double)"),
    ("averageif", "lineitem", "", '=AVERAGEIF([l_quantity],"<=5",[l_extendedprice])', "avg(l_extendedprice) filter (l_quantity <= 5)", 6),
    ("averageifs", "lineitem", "l_returnflag", '=AVERAGEIFS([l_extendedprice],[l_quantity],"<=5",[l_tax],">0.03")', "avg(l_extendedprice) filter (l_quantity <= 5 and l_tax > 0.03::double)", 6),
    ("criteria_not_equal", "lineitem", "", '=COUNTIF([l_linenumber],"<>3")', "cast(count(*) filter (l_linenumber <> 3) as double)"),
    ("criteria_one_letter", "part", "", '=COUNTIF([p_name],"?e*")', "cast(count(*) filter (regexp_full_match(lower(p_name), '.e.*', 's')) as double)"),
    ("criteria_number_text", "lineitem", "", '=COUNTIF([l_linenumber]," 5 ")', "cast(count(*) filter (l_linenumber = 5) as double)"),
    ("criteria_literal_text", "part", "", '=COUNTIF([p_name],">a")+COUNTIF([p_name],"<>red gear")', "cast(count(*) filter (p_name like '>%') as double)"),
    ("criteria_empty", "part", "", '=COUNTIF([p_name],"  ")', "cast(count(*) filter (coalesce(p_name, '') = '') as double)"),
    ("sumproduct", "lineitem", "l_returnflag", "=SUMPRODUCT([l_extendedprice],[l_discount])", "sum(l_extendedprice * l_discount)", 2),
    ("sumproduct_array", "lineitem", "", "=SUMPRODUCT(([l_quantity]>10)*([l_tax]>0.03)*[l_extendedprice])", "sum(case when l_quantity > 10 and l_tax > 0.03::double then l_extendedprice else 0 end)", 2),
    ("median", "lineitem", "l_returnflag", "=MEDIAN([l_extendedprice])", "median(l_extendedprice)", 4),
    ("and_range", "lineitem", "l_returnflag", "=AND([l_quantity]>0)", "bool_and(l_quantity > 0)"),
    ("or_range", "lineitem", "l_returnflag", "=OR([l_quantity]>49)", "bool_or(l_quantity > 49)"),
    ("xor_range", "lineitem", "l_returnflag", "=XOR([l_quantity]>49)", "count(*) filter (l_quantity > 49) % 2 = 1"),
    ("rows", "part", "", "=ROWS([p_name])", "cast(count(*) as double)"),
    ("concat_range", "nation", "n_regionkey", "=CONCAT([n_name])", "string_agg(n_name, '' order by n_nationkey)", None, "n_nationkey"),
):
    _total(*_q)


def _order_statistic(name: str, formula: str, direction: str) -> None:
    for suffix, keys in (("", ()), ("_by_key", ("l_returnflag",))):
        over = f"{'partition by l_returnflag ' if keys else ''}order by l_extendedprice {direction}"
        sql = f"select {''.join(k + ', ' for k in keys)}v from (select *, l_extendedprice as v, row_number() over ({over}) as r from lineitem) where r = 3"
        query(name + suffix, sql)(lambda spark, sf_dir, keys=keys: Table(table(spark, sf_dir, "lineitem")).group(list(keys), v=formula).select(*keys, "v"))


_order_statistic("large", "=LARGE([l_extendedprice],3)", "desc")
_order_statistic("small", "=SMALL([l_extendedprice],3)", "asc")


def _part(spark, sf_dir) -> Table:
    return Table(table(spark, sf_dir, "part"), order_by=("p_partkey",))


@query("index", "select v from (select p_retailprice as v, row_number() over (order by p_partkey) as r from part) where r = 42")
def _index(spark, sf_dir):
    return _part(spark, sf_dir).agg(v="=INDEX([p_retailprice],42)").select("v")


@query("match", "select cast(min(r) as double) as v from (select p_name, row_number() over (order by p_partkey) as r from part) where lower(p_name) = 'red gear'")
def _match(spark, sf_dir):
    return _part(spark, sf_dir).agg(v='=MATCH("red gear",[p_name])').select("v")


@query("row", "select p_partkey, cast(row_number() over (order by p_partkey) as double) as v from part")
def _row(spark, sf_dir):
    return _part(spark, sf_dir).with_formula("v", "=ROW()").df.select("p_partkey", "v")


@query("column", "select p_partkey, 3::double as v from part")
def _column(spark, sf_dir):
    return _part(spark, sf_dir).with_formula("v", "=COLUMN([p_brand])").df.select("p_partkey", "v")


@query("columns", "select p_partkey, 6::double as v, 1::double as w, (select cast(count(*) as double) from nation) as n from part")
def _columns(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    t = Table(part, tables={"parts": Table(part), "nations": Table(table(spark, sf_dir, "nation"))})
    t = t.with_formula("v", "=COLUMNS(parts)").with_formula("w", "=COLUMNS([p_name])").with_formula("n", "=ROWS(nations)")
    return t.df.select("p_partkey", "v", "w", "n")


@query("sequence", "select cast(range // 4 as bigint) as row, cast(range % 4 as bigint) as col, 2.0::double + 3 * range as value from range(0, 20)")
def _sequence(spark, sf_dir):
    return Table.spill(spark, "=SEQUENCE(2+3,4,2,3)")


@query("array_literal", "select l_returnflag, 6::double + sum(l_linenumber) as v, 13::double as w, 2::double as m from lineitem group by l_returnflag")
def _array_literal(spark, sf_dir):
    got = Table(table(spark, sf_dir, "lineitem")).group(["l_returnflag"], v="=SUM({1,2;3,0})+SUM([l_linenumber])", w='=SUMIF({1,5,3,8,2},">3")', m="=MATCH(3,{1,3,5},0)")
    return got.select("l_returnflag", "v", "w", "m")


@query("array_lookup", "select o_orderkey, case o_orderstatus when 'F' then 'final' when 'O' then 'open' end as v, case o_orderstatus when 'F' then 1::double when 'O' then 2 end as w from orders")
def _array_lookup(spark, sf_dir):
    t = Table(table(spark, sf_dir, "orders")).with_formula("v", '=VLOOKUP([@o_orderstatus],{"f","final";"o","open"},2,FALSE)').with_formula("w", '=MATCH([@o_orderstatus],{"f","o"},0)')
    return t.df.select("o_orderkey", "v", "w")


@query("index_match", "select (select p_retailprice from part where lower(p_name) = 'red gear' order by p_partkey limit 1) as v")
def _index_match(spark, sf_dir):
    return _part(spark, sf_dir).agg(v='=INDEX([p_retailprice],MATCH("red gear",[p_name],0))').select("v")


@query("index_match_per_row", "select a.p_partkey, b.p_partkey::double as v from part a join (select p_name, min(p_partkey) as p_partkey from part group by 1) b on a.p_name = b.p_name")
def _index_match_row(spark, sf_dir):
    return _part(spark, sf_dir).with_formula("v", "=INDEX([p_partkey],MATCH([@p_name],[p_name],0))").df.select("p_partkey", "v")


@query("index_far", "select v from (select l_extendedprice as v, row_number() over (order by l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, l_extendedprice) as r from lineitem) where r = 23456")
def _index_far(spark, sf_dir):
    t = Table(table(spark, sf_dir, "lineitem"), order_by=("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"))
    return t.agg(v="=INDEX([l_extendedprice],23456)").select("v")


@query("iferror_match", "select -1::double as v, -2::double as w")
def _iferror_match(spark, sf_dir):
    return _part(spark, sf_dir).agg(v='=IFERROR(MATCH("zz",[p_name],0),-1)', w='=IFNA(INDEX([p_size],MATCH("zz",[p_name],0)),-2)').select("v", "w")


@query("match_ties", "select cast(1 + (select count(*) from orders where o_orderstatus < 'O') as double) as v")
def _match_ties(spark, sf_dir):
    """Rows that tie in the order still have places of their own."""
    return Table(table(spark, sf_dir, "orders"), order_by=("o_orderstatus",)).agg(v='=MATCH("o",[o_orderstatus],0)').select("v")


@query("large_plus_sum", """select l_returnflag, round(max(case when r = 2 then l_extendedprice end) + sum(l_extendedprice), 2) as v, round(median(l_extendedprice) / max(l_extendedprice), 8) as w
    from (select *, row_number() over (partition by l_returnflag order by l_extendedprice desc) as r from lineitem) group by 1""")
def _large_plus_sum(spark, sf_dir):
    got = Table(table(spark, sf_dir, "lineitem")).group(["l_returnflag"], v="=LARGE([l_extendedprice],2)+SUM([l_extendedprice])", w="=MEDIAN([l_extendedprice])/MAX([l_extendedprice])")
    return got.select("l_returnflag", F.round("v", 2).alias("v"), F.round("w", 8).alias("w"))


@query("large_far", "select v from (select l_extendedprice as v, row_number() over (order by l_extendedprice desc) as r from lineitem) where r = (select count(*) // 2 from lineitem)")
def _large_far(spark, sf_dir):
    return Table(table(spark, sf_dir, "lineitem")).agg(v="=LARGE([l_extendedprice],INT(ROWS([l_extendedprice])/2))").select("v")


@query("median_mixed", "select median(x) as v from (select p_size as x from part union all select p_retailprice from part union all select 7)")
def _median_mixed(spark, sf_dir):
    return Table(table(spark, sf_dir, "part")).agg(v="=MEDIAN([p_size],[p_retailprice],7)").select("v")


@query("countif_row_operator", "select p_partkey, (select cast(count(*) as double) from part q where q.p_size > p.p_size) as v, (select cast(count(*) as double) from part q where q.p_size <= p.p_size) as w from part p")
def _countif_operator(spark, sf_dir):
    t = _part(spark, sf_dir).with_formula("v", '=COUNTIF([p_size],">"&[@p_size])').with_formula("w", '=COUNTIF([p_size],"<="&[@p_size])')
    return t.df.select("p_partkey", "v", "w")


@query("sumifs_row_operator", """select o_orderkey, round(coalesce((select sum(q.o_totalprice) from orders q where q.o_custkey = o.o_custkey and q.o_totalprice < floor(o.o_totalprice) and q.o_orderstatus <> 'P'), 0), 2) as v,
    round((select avg(q.o_totalprice) from orders q where q.o_custkey = o.o_custkey and q.o_totalprice >= floor(o.o_totalprice)), 8) as w from orders o""")
def _sumifs_operator(spark, sf_dir):
    t = Table(table(spark, sf_dir, "orders")).with_formula("v", '=SUMIFS([o_totalprice],[o_custkey],[@o_custkey],[o_totalprice],"<"&INT([@o_totalprice]),[o_orderstatus],"?")-SUMIFS([o_totalprice],[o_custkey],[@o_custkey],[o_totalprice],"<"&INT([@o_totalprice]),[o_orderstatus],"p")')
    t = t.with_formula("w", '=AVERAGEIFS([o_totalprice],[o_custkey],[@o_custkey],[o_totalprice],">="&INT([@o_totalprice]))')
    return _rounded(_rounded(t.df.select("o_orderkey", "v", "w"), 2), 8, "w")


@query("countif_row_pattern", "select p_partkey, (select cast(count(*) as double) from part q where starts_with(lower(q.p_name), lower(left(p.p_name, 1)))) as v, (select cast(count(*) as double) from part q where q.p_type = p.p_type) as w from part p")
def _countif_pattern(spark, sf_dir):
    t = _part(spark, sf_dir).with_formula("v", '=COUNTIF([p_name],LEFT([@p_name],1)&"*")').with_formula("w", "=COUNTIF([p_type],[@p_type])")
    return t.df.select("p_partkey", "v", "w")


@query("vlookup", "select l_orderkey, l_partkey, l_linenumber, l_extendedprice, o_totalprice as v from lineitem left join orders on l_orderkey = o_orderkey")
def _vlookup(spark, sf_dir):
    orders = Table(table(spark, sf_dir, "orders"), order_by=("o_orderkey",))
    t = Table(table(spark, sf_dir, "lineitem"), tables={"orders": orders})
    return t.with_formula("v", "=VLOOKUP([@l_orderkey],orders,4)").df.select(*LINE.split(), "v")


@query("ifna", "select c_custkey, coalesce(n_name, 'none') as v from customer left join (select * from nation where n_regionkey = 1) on c_nationkey = n_nationkey")
def _ifna(spark, sf_dir):
    some = Table(table(spark, sf_dir, "nation").filter("n_regionkey = 1"), order_by=("n_nationkey",))
    t = Table(table(spark, sf_dir, "customer"), tables={"nations": some})
    return t.with_formula("v", '=IFNA(VLOOKUP([@c_nationkey],nations,2),"none")').df.select("c_custkey", "v")


@query("vlookup_miss", "select c_custkey, n_name as v, case when n_name is null then '#N/A' end as v_err from customer left join (select * from nation where n_regionkey = 1) on c_nationkey = n_nationkey")
def _vlookup_miss(spark, sf_dir):
    some = Table(table(spark, sf_dir, "nation").filter("n_regionkey = 1"), order_by=("n_nationkey",))
    t = Table(table(spark, sf_dir, "customer"), tables={"nations": some})
    return t.with_formula("v", "=VLOOKUP([@c_nationkey],nations,2)", errors=True).df.select("c_custkey", "v", "v_err")


@query("sumifs_per_row", "select o_orderkey, round(coalesce(s, 0), 2) as v from orders left join (select o_custkey as k, sum(o_totalprice) filter (o_orderstatus = 'F') as s from orders group by 1) on o_custkey = k")
def _sumifs_per_row(spark, sf_dir):
    t = Table(table(spark, sf_dir, "orders")).with_formula("v", '=SUMIFS([o_totalprice],[o_custkey],[@o_custkey],[o_orderstatus],"F")')
    return _rounded(t.df.select("o_orderkey", "v"), 2)


@query("share_of_total", "select o_orderkey, round(o_totalprice / (select sum(o_totalprice) from orders) * 1000000, 4) as v from orders")
def _share(spark, sf_dir):
    return _rounded(Table(table(spark, sf_dir, "orders")).with_formula("v", "=[@o_totalprice]/SUM([o_totalprice])*1000000").df.select("o_orderkey", "v"), 4)


@query("named_values", "select l_orderkey, l_partkey, l_linenumber, l_extendedprice, l_extendedprice * 0.05::double as v from lineitem")
def _names(spark, sf_dir):
    t = Table(table(spark, sf_dir, "lineitem"), names={"Rate": 0.05, "Charge": "=[@l_extendedprice]*rate"})
    return t.with_formula("v", "=charge").df.select(*LINE.split(), "v")


@query("where", "select l_orderkey, l_partkey, l_linenumber, l_extendedprice from lineitem where l_quantity > 45 and lower(l_returnflag) = 'n'")
def _where(spark, sf_dir):
    return Table(table(spark, sf_dir, "lineitem")).where('=AND([@l_quantity]>45,[@l_returnflag]="n")').df.select(*LINE.split())


@query("custom_function", "select p_partkey, p_retailprice * 2 + p_size as v from part")
def _custom(spark, sf_dir):
    from tabulon.functions import columns as C

    def twice(env, v):
        x, e = C.pure_number(v)
        return C.num(x * 2, e)

    t = _part(spark, sf_dir).register("TWICE", 1, 1, twice)
    return t.with_formula("v", "=TWICE([@p_retailprice])+[@p_size]").df.select("p_partkey", "v")


@query("rand", "select c_custkey, true as inside, true as varies from customer")
def _rand(spark, sf_dir):
    """Random numbers can't equal another engine's, but their bounds and that rows differ can."""
    t = Table(table(spark, sf_dir, "customer")).with_formula("v", "=RAND()").with_formula("inside", "=AND([@v]>=0,[@v]<1)").with_formula("varies", "=MIN([v])<MAX([v])")
    return t.df.select("c_custkey", "inside", "varies")


@query("randbetween", "select c_custkey, true as inside from customer")
def _randbetween(spark, sf_dir):
    t = Table(table(spark, sf_dir, "customer")).with_formula("v", "=RANDBETWEEN(1,6)").with_formula("inside", "=AND([@v]>=1,[@v]<=6,INT([@v])=[@v])")
    return t.df.select("c_custkey", "inside")


@query("now_today", "select r_regionkey, true as same_day, cast(date_diff('day', date '1899-12-30', cast(now() at time zone 'UTC' as date)) as double) as d from region")
def _now(spark, sf_dir):
    return Table(table(spark, sf_dir, "region")).with_formula("same_day", "=INT(NOW())=TODAY()").with_formula("d", "=TODAY()").df.select("r_regionkey", "same_day", "d")


@query(
    "flagship",
    """select l_returnflag, l_linestatus, round(sum(l_extendedprice * (1 - l_discount)), 2) as revenue, cast(count(*) as double) as n,
    round(avg(l_discount), 6) as mean_discount, round(coalesce(sum(l_quantity) filter (l_quantity > 10), 0), 2) as large_quantity,
    round(median(l_extendedprice), 4) as middle_price from lineitem where l_shipdate <= timestamp '1998-09-02' group by all""",
)
def flagship(spark, sf_dir):
    """Formulas over lineitem: row expressions, a filter, and all totals in one aggregation."""
    t = Table(table(spark, sf_dir, "lineitem")).where("=[@l_shipdate]<=DATE(1998,9,2)").with_formula("net", "=[@l_extendedprice]*(1-[@l_discount])")
    out = t.group(["l_returnflag", "l_linestatus"], revenue="=SUM([net])", n="=ROWS([net])", mean_discount="=AVERAGE([l_discount])", large_quantity='=SUMIF([l_quantity],">10")', middle_price="=MEDIAN([l_extendedprice])")
    return out.select("l_returnflag", "l_linestatus", F.round("revenue", 2).alias("revenue"), "n", F.round("mean_discount", 6).alias("mean_discount"), F.round("large_quantity", 2).alias("large_quantity"), F.round("middle_price", 4).alias("middle_price"))
