"""Command line: ``python -m tabulon.cli to-csv|info|sheets FILE``."""

from __future__ import annotations

import argparse
import sys

from tabulon.operators.grid import Workbook
from tabulon.plans.parser import cell_name
from tabulon.sources import csv_files


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="tabulon")
    sub = parser.add_subparsers(dest="command", required=True)
    c = sub.add_parser("to-csv", help="write a sheet as CSV, from A1")
    c.add_argument("file")
    c.add_argument("-c", "--calculate", action="store_true", help="calculate formulas first")
    c.add_argument("-o", "--output", help="file to write; standard output without")
    c.add_argument("-s", "--sheet", default="0", help="name or number of the sheet")
    c.add_argument("-d", "--delimiter", default=",")
    for name in ("info", "sheets"):
        sub.add_parser(name).add_argument("file")
    args = parser.parse_args(argv)
    try:
        book = Workbook.open(args.file)
        if args.command == "sheets":
            print("\n".join(book.sheet_names))
        elif args.command == "info":
            for s in book._sheets:
                used = s.used_range()
                area = f"{cell_name(*used[:2])}:{cell_name(*used[2:])}" if used else "empty"
                print(f"{s.name}: {area}, {s.cell_count} cells, {sum(x.formula is not None for _, x in s.iter_cells())} formulas")
        else:
            if args.calculate:
                book.calculate()
            sheet = book.get_sheet(int(args.sheet) if args.sheet.isdigit() and args.sheet not in book.sheet_names else args.sheet)
            text = csv_files.to_text(sheet, args.delimiter, "\n", from_a1=True)
            if args.output:
                with open(args.output, "w", encoding="utf-8", newline="") as f:
                    f.write(text)
            else:
                sys.stdout.write(text)
    except (OSError, ValueError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0


if __name__ == "__main__":
    sys.exit(main())
