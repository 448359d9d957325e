"""Spreadsheet-style analytics compiled to Spark DataFrames."""

from importlib import import_module

#: Names of this package's front and where they are defined; loaded when first asked for, to keep workers light.
_FRONT = {
    "CalculationOptions": "operators.grid", "CalculationStats": "operators.grid", "CellValue": "operators.grid", "Workbook": "operators.grid",
    "Worksheet": "operators.grid", "Table": "operators.table", "FormulaError": "plans.parser", "parse": "plans.parser",
}
__all__ = list(_FRONT)


def __getattr__(name: str):
    if name not in _FRONT:
        raise AttributeError(name)
    return getattr(import_module(f"tabulon.{_FRONT[name]}"), name)
