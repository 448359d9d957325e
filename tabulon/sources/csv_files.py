"""CSV: as a sheet on the driver, and as DataFrames of any size.

Fields are typed one by one: empty, TRUE/FALSE (``true``, ``yes``, ``false``, ``no``), numbers, else text. With
compat_types=True the field ``1`` becomes TRUE. A header row stays text. Ragged rows are an error.
"""

from __future__ import annotations

import csv
import io
import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.operators.grid import GridError, Workbook, Worksheet
from tabulon.plans.values import Err, text

NUMERIC = re.compile(r"[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?")


def typed(field: str, compat_types: bool = False):
    """The value of a field."""
    s = field.strip()
    if not s:
        return None
    low = s.lower()
    if low in ("true", "yes") or compat_types and s == "1":
        return True
    if low in ("false", "no"):
        return False
    return float(s) if NUMERIC.fullmatch(s) else field


def read_text(content: str, delimiter: str = ",", quote: str = '"', has_header: bool = True, auto_types: bool = True, compat_types: bool = False) -> Workbook:
    book = Workbook()
    sheet = book.add_sheet("Sheet1")
    width = None
    for r, row in enumerate(csv.reader(io.StringIO(content), delimiter=delimiter, quotechar=quote)):
        if not row:
            continue
        if width is not None and len(row) != width:
            raise GridError(f"row {r + 1} has {len(row)} fields, not {width}")
        width = len(row)
        for c, f in enumerate(row):
            v = (f or None) if has_header and r == 0 or not auto_types else typed(f, compat_types)
            if v is not None:
                cell = sheet._cell((r, c))
                cell.value = v
    return book


def read_file(path: str, **options) -> Workbook:
    with open(path, encoding="utf-8-sig", newline="") as f:
        return read_text(f.read(), **options)


def shown(v) -> str:
    return v.code if isinstance(v, Err) else text(v)


def to_text(sheet: Worksheet, delimiter: str = ",", line_end: str = "\r\n", from_a1: bool = False, write_header: bool = True) -> str:
    """The used range (or all from A1); a formula that was never calculated is written as its text."""
    used = sheet.used_range()
    if used is None:
        return ""
    r, c, r2, c2 = used
    if from_a1:
        r = c = 0
    out = io.StringIO()
    w = csv.writer(out, delimiter=delimiter, lineterminator=line_end)
    for i in range(r if write_header else r + 1, r2 + 1):
        row = []
        for j in range(c, c2 + 1):
            cell = sheet._cells.get((i, j))
            row.append("" if cell is None else cell.formula if cell.value is None and cell.formula else shown(cell.value))
        w.writerow(row)
    return out.getvalue()


def write_file(sheet: Worksheet, path: str, **options) -> None:
    with open(path, "w", encoding="utf-8", newline="") as f:
        f.write(to_text(sheet, **options))


# DataFrames -------------------------------------------------------------------------------------------------------


def scan(spark: SparkSession, path: str, delimiter: str = ",", quote: str = '"', has_header: bool = True, infer: bool = False, schema=None, line_breaks: bool = True) -> DataFrame:
    """CSV files of any size as a table; ragged rows fail the job. infer reads the data once more.

    Quoted fields may hold line breaks, so a file is read whole by one task; without them (line_breaks=False) large
    files are split.
    """
    reader = spark.read.option("sep", delimiter).option("quote", quote).option("escape", quote).option("header", has_header).option("mode", "FAILFAST").option("multiLine", line_breaks)
    return reader.schema(schema).csv(path) if schema is not None else reader.option("inferSchema", infer).csv(path)


def typed_columns(field: Column, compat_types: bool = False) -> dict[str, Column]:
    """kind, num, str and bool of a text column, by the same rules as cells."""
    s = F.trim(F.coalesce(field, F.lit("")))
    low = F.lower(s)
    yes = low.isin("true", "yes") | ((s == "1") if compat_types else F.lit(False))
    no = low.isin("false", "no")
    number = s.rlike(r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$") & ~yes
    kind = F.when(s == "", 0).when(yes | no, 3).when(number, 1).otherwise(2).cast("byte")
    return {"kind": kind, "num": F.when(number, s.try_cast("double")), "str": F.when(kind == 2, field), "bool": F.when(yes, True).when(no, False)}


def sink(df: DataFrame, path: str, delimiter: str = ",", header: bool = True, line_end: str = "\n") -> None:
    df.write.option("sep", delimiter).option("header", header).option("lineSep", line_end).option("escape", '"').mode("errorifexists").csv(path)
