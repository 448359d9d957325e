"""Every function is there in both forms, and every query has what the driver needs."""

import __spark_entry__
from tabulon.functions import cellwise, columns
from tabulon.plans.compiler import PLANNED

#: The names of all functions.
NAMES = """
SUM AVERAGE MIN MAX COUNT COUNTA COUNTBLANK SUMIF SUMIFS COUNTIF COUNTIFS AVERAGEIF AVERAGEIFS SUMPRODUCT MEDIAN LARGE SMALL
RAND RANDBETWEEN ABS ROUND MOD INT TRUNC SIGN SQRT POWER LOG LOG10 LN EXP PI SIN COS TAN ASIN ACOS ATAN ATAN2 DEGREES RADIANS
ROUNDUP ROUNDDOWN CEILING.MATH FLOOR.MATH ODD EVEN IF AND OR NOT XOR IFERROR IFNA TRUE FALSE IFS SWITCH
LEN LEFT RIGHT MID LOWER UPPER TRIM CONCAT CONCATENATE FIND FINDB SEARCH SEARCHB EXACT REPT SUBSTITUTE PROPER CHAR CODE CLEAN VALUE T N LENB LEFTB RIGHTB MIDB
ISBLANK ISNUMBER ISTEXT ISERROR ISNA NA DATE YEAR MONTH DAY NOW TODAY INDEX MATCH VLOOKUP ROWS COLUMNS CHOOSE ROW COLUMN SEQUENCE
""".split()


def test_all_functions():
    assert len(NAMES) == len(set(NAMES)) == 106
    assert set(NAMES) <= set(cellwise.TABLE) | {"ROW", "COLUMN"}
    assert set(NAMES) <= set(columns.TABLE) | PLANNED


def test_queries_and_sql():
    queries, sql = __spark_entry__.queries(), __spark_entry__.oracle_sql()
    assert set(sql) <= set(queries) and callable(__spark_entry__.entry)
    own = [n for n in queries if not n.startswith("op") or n.startswith("op_")]
    assert [n for n in own if n not in sql and n != "pipeline"] == []
