"""Files of workbooks: CSV, XLSX and XLS (read only)."""

from __future__ import annotations

from pathlib import Path


def open_workbook(path: str, **options):
    """A workbook by its suffix."""
    suffix = Path(path).suffix.lower()
    if suffix in (".xlsx", ".xlsm"):
        from tabulon.sources import xlsx

        return xlsx.read_file(path)
    if suffix == ".xls":
        from tabulon.sources import xls

        return xls.read_file(path)
    if suffix in (".csv", ".tsv"):
        from tabulon.sources import csv_files

        return csv_files.read_file(path, **({"delimiter": "\t"} if suffix == ".tsv" else {}) | options)
    raise ValueError(f"unsupported format: {suffix or path}")


def save_workbook(book, path: str, **options) -> None:
    """xlsx, or csv of the first sheet."""
    suffix = Path(path).suffix.lower()
    if suffix == ".xlsx":
        from tabulon.sources import xlsx

        return xlsx.write_file(book, path)
    if suffix == ".csv":
        from tabulon.sources import csv_files

        return csv_files.write_file(book.get_sheet(0), path, **options)
    raise ValueError(f"unsupported format: {suffix or path}")
