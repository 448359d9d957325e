"""Queries of rules, files, grids and streams, registered beside those of the functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import conditional as K
from tabulon.operators.grid import Workbook
from tabulon.queries import LINE, query
from tabulon.session import shared_folder, table
from tabulon.streaming import formulas as S

_L = ", ".join(LINE.split())


def _rule(name: str, source: str, keys: str, apply, sql: str) -> None:
    cols = keys.split()
    query(name, f"select {', '.join(cols)}, {sql} as flag from {source}")(lambda spark, sf_dir: apply(table(spark, sf_dir, source)).select(*cols, "flag"))


_rule("cf_cell_is", "lineitem", LINE, lambda d: K.cell_is(d, "l_quantity", "between", 10, 20), "l_quantity between 10 and 20")
_rule("cf_expression", "lineitem", LINE, lambda d: K.expression(d, "=[@l_quantity]*[@l_tax]>2"), "l_quantity * l_tax > 2")
_rule("cf_contains", "part", "p_partkey", lambda d: K.contains_text(d, "p_name", "RED"), "contains(lower(p_name), 'red')")
_rule("cf_not_contains", "part", "p_partkey", lambda d: K.contains_text(d, "p_name", "RED", "notContains"), "not contains(lower(p_name), 'red')")
_rule("cf_begins", "part", "p_partkey", lambda d: K.contains_text(d, "p_name", "s", "beginsWith"), "starts_with(lower(p_name), 's')")
_rule("cf_ends", "part", "p_partkey", lambda d: K.contains_text(d, "p_name", "T", "endsWith"), "ends_with(lower(p_name), 't')")
_rule("cf_blanks", "part", "p_partkey", lambda d: K.blanks(d, "p_name"), "trim(coalesce(p_name, '')) = ''")
_rule("cf_errors", "lineitem", LINE, lambda d: K.has_error(d, "=1/[@l_discount]"), "l_discount = 0")
_rule("cf_duplicates", "lineitem", LINE, lambda d: K.duplicates(d, ["l_orderkey", "l_linenumber"]), "count(*) over (partition by l_orderkey, l_linenumber) > 1")
_rule("cf_unique", "lineitem", LINE, lambda d: K.duplicates(d, ["l_orderkey", "l_linenumber"], unique=True), "count(*) over (partition by l_orderkey, l_linenumber) = 1")
_rule("cf_top", "orders", "o_orderkey", lambda d: K.top(d, "o_totalprice", 10), "rank() over (order by o_totalprice desc) <= 10")
_rule("cf_bottom_percent", "orders", "o_orderkey", lambda d: K.top(d, "o_totalprice", 5, percent=True, bottom=True), "rank() over (order by o_totalprice) <= (select count(*) * 5 // 100 from orders)")
_rule("cf_above_average", "orders", "o_orderkey", lambda d: K.above_average(d, "o_totalprice"), "o_totalprice > avg(o_totalprice) over ()")
_rule("cf_deviation", "orders", "o_orderkey", lambda d: K.above_average(d, "o_totalprice", deviations=1), "o_totalprice > avg(o_totalprice) over () + stddev_pop(o_totalprice) over ()")
_rule("cf_time_period", "orders", "o_orderkey", lambda d: K.time_period(d, "o_orderdate", "lastMonth", "1996-03-15"), "date_trunc('month', o_orderdate) = date '1996-02-01'")
for _period, _sql in (
    ("today", "d = date '1996-03-15'"), ("yesterday", "d = date '1996-03-14'"), ("tomorrow", "d = date '1996-03-16'"), ("last7Days", "d between date '1996-03-09' and date '1996-03-15'"),
    ("thisWeek", "d between date '1996-03-10' and date '1996-03-16'"), ("lastWeek", "d between date '1996-03-03' and date '1996-03-09'"), ("nextWeek", "d between date '1996-03-17' and date '1996-03-23'"),
    ("thisMonth", "date_trunc('month', d) = date '1996-03-01'"), ("nextMonth", "date_trunc('month', d) = date '1996-04-01'"),
):
    _rule(f"cf_{_period}", "orders", "o_orderkey", lambda d, period=_period: K.time_period(d, "o_orderdate", period, "1996-03-15"), _sql.replace("d ", "cast(o_orderdate as date) ", 1).replace("', d)", "', cast(o_orderdate as date))"))
_rule("valid_time", "events", "event_id", lambda d: K.valid(d, "ts", "time", "between", "06:00:00", "18:30:00", flag="flag"), "strftime(ts, '%H:%M:%S') between '06:00:00' and '18:30:00'")
_rule("valid_any", "part", "p_partkey", lambda d: K.valid(d, "p_size", "any", flag="flag"), "true")
_rule("valid_whole", "part", "p_partkey", lambda d: K.valid(d, "p_size", "whole", "between", 5, 40, flag="flag"), "p_size between 5 and 40")
_rule("valid_decimal", "customer", "c_custkey", lambda d: K.valid(d, "c_acctbal", "decimal", "greaterThan", 0, flag="flag"), "c_acctbal > 0")
_rule("valid_list", "orders", "o_orderkey", lambda d: K.valid(d, "o_orderstatus", "list", values=["F", "O"], flag="flag"), "o_orderstatus in ('F', 'O')")
_rule("valid_date", "orders", "o_orderkey", lambda d: K.valid(d, "o_orderdate", "date", "between", "1995-01-01", "1996-12-31", flag="flag"), "o_orderdate between date '1995-01-01' and date '1996-12-31'")
_rule("valid_text_length", "part", "p_partkey", lambda d: K.valid(d, "p_name", "textLength", "lessThan", 10, flag="flag"), "length(p_name) < 10")
_rule("valid_custom", "lineitem", LINE, lambda d: K.valid(d, "l_tax", "custom", formula="=[@l_tax]<[@l_discount]", flag="flag"), "l_tax < l_discount")


@query("cf_color_scale", "select o_orderkey, round((o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()), 8) as scale from orders")
def _scale(spark, sf_dir):
    return K.color_scale(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", F.round("scale", 8).alias("scale"))


@query(
    "cf_color_scale_3",
    """with m as (select min(o_totalprice) as lo, max(o_totalprice) as hi, quantile_cont(o_totalprice, 0.5) as mid from orders)
    select o_orderkey, round(case when o_totalprice <= mid then 0.5 * (o_totalprice - lo) / (mid - lo) else 0.5 + 0.5 * (o_totalprice - mid) / (hi - mid) end, 8) as scale from orders, m""",
)
def _scale3(spark, sf_dir):
    return K.color_scale(table(spark, sf_dir, "orders"), "o_totalprice", middle=50).select("o_orderkey", F.round("scale", 8).alias("scale"))


@query("cf_data_bar", "select o_orderkey, round(10 + 80 * (o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()), 6) as bar from orders")
def _bar(spark, sf_dir):
    return K.data_bar(table(spark, sf_dir, "orders"), "o_totalprice", 10, 90).select("o_orderkey", F.round("bar", 6).alias("bar"))


@query(
    "cf_icon_set",
    """with s as (select o_orderkey, (o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()) * 100 as q from orders)
    select o_orderkey, case when q >= 67 then 2 when q >= 33 then 1 else 0 end as icon from s""",
)
def _icons(spark, sf_dir):
    return K.icon_set(table(spark, sf_dir, "orders"), "o_totalprice").select("o_orderkey", "icon")


for _style, _steps in (("4", (0.0, 25.0, 50.0, 75.0)), ("5", (0.0, 20.0, 40.0, 60.0, 80.0))):
    _reached = " + ".join(f"(q >= {t})::int" for t in _steps[1:])
    query(f"cf_icon_set_{_style}", f"""with s as (select o_orderkey, (o_totalprice - min(o_totalprice) over ()) / (max(o_totalprice) over () - min(o_totalprice) over ()) * 100 as q from orders)
    select o_orderkey, cast({_reached} as int) as icon, cast({len(_steps) - 1} - ({_reached}) as int) as turned from s""")(
        lambda spark, sf_dir, steps=_steps: K.icon_set(K.icon_set(table(spark, sf_dir, "orders"), "o_totalprice", steps), "o_totalprice", steps, reverse=True, name="turned").select("o_orderkey", "icon", "turned")
    )


@query("cf_priority", f"select {_L}, case when l_quantity > 40 then 'high' when l_discount > 0.05::double then 'cheap' end as format from lineitem")
def _priority(spark, sf_dir):
    d = K.cell_is(table(spark, sf_dir, "lineitem"), "l_quantity", "greaterThan", 40, flag="a")
    d = K.cell_is(d, "l_discount", "greaterThan", 0.05, flag="b")
    return K.first_rule(d, [("a", "high"), ("b", "cheap")]).select(*LINE.split(), "format")


@query("violations", "select p_partkey, p_size from part where not (p_size between 5 and 40)")
def _violations(spark, sf_dir):
    return K.violations(table(spark, sf_dir, "part"), "p_size", "whole", op="between", a=5, b=40).select("p_partkey", "p_size")


@query("csv_typed_fields", "select n_nationkey, cast(1 as tinyint) as kind, cast(n_nationkey as double) as num from nation")
def _csv(spark, sf_dir):
    from tabulon.sources import csv_files

    d = table(spark, sf_dir, "nation")
    cols = csv_files.typed_columns(F.concat(F.lit(" "), F.col("n_nationkey").cast("string")))
    return d.select("n_nationkey", cols["kind"].alias("kind"), cols["num"].alias("num"))


@query("grid_recalculation", "select n_nationkey, cast(sum(n_nationkey) over (order by n_nationkey) as double) as running from nation")
def _grid(spark, sf_dir):
    """A small sheet whose every row adds to the one above, calculated and read back as rows."""
    book = Workbook()
    sheet = book.add_sheet("Nations")
    keys = [r[0] for r in table(spark, sf_dir, "nation").select("n_nationkey").orderBy("n_nationkey").collect()]  # 25 rows
    for i, k in enumerate(keys):
        sheet.set_cell((i, 0), k)
        sheet.set_formula((i, 1), f"=A{i + 1}" if i == 0 else f"=A{i + 1}+B{i}")
    book.calculate()
    cells = book.cells(spark)
    a, b = (cells.filter(F.col("col") == c).select("row", F.col("num").alias(n)) for c, n in ((0, "k"), (1, "running")))
    return a.join(b, "row").select(F.col("k").cast("int").alias("n_nationkey"), "running")


@query(
    "streaming_windows",
    """select cast(date_trunc('hour', ts) as timestamp) as start, event_type, round(sum(value), 4) as total, cast(count(*) filter (value > 50) as double) as large
    from events group by all""",
)
def _stream(spark, sf_dir):
    """Windowed totals of a stream of events; the finished stream is read from its memory sink."""
    import uuid

    schema = table(spark, sf_dir, "events").schema
    folder, _, file = f"{sf_dir}/events.parquet".rpartition("/")
    stream = spark.readStream.schema(schema).option("pathGlobFilter", file).parquet(folder)
    out = S.windowed(stream, "ts", ["event_type"], "1 hour", "0 seconds", total="=SUM([value])", large='=COUNTIF([value],">50")')
    name = f"events_{uuid.uuid4().hex}"
    base = shared_folder(spark)
    q = out.writeStream.outputMode("complete").format("memory").queryName(name).option("checkpointLocation", f"{base}/{name}").start()
    q.processAllAvailable()
    q.stop()
    return spark.table(name).select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", F.round("total", 4).alias("total"), "large")
