"""XLSX files with the standard library alone: values, formulas (shared ones too), names, layout, comments,
validations, conditional formats and styles.

``scan`` reads any number of files where Spark finds them, one task per file or more, into the long cell rows.
"""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape, quoteattr

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from tabulon.operators.grid import CELL_SCHEMA, Cell, Workbook, Worksheet
from tabulon.plans import parser as p
from tabulon.plans.values import Err, text
from tabulon.session import ship

MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_N, _R = f"{{{MAIN}}}", f"{{{REL}}}"
_V, _F, _IS = f"{_N}v", f"{_N}f", f"{_N}is"
_INSIDE = {f"{_N}c", _V, _F, _IS, f"{_N}t", f"{_N}r"}
_ESCAPE = re.compile(r"_x([0-9A-Fa-f]{4})_")
_UNSAFE = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\r]|_x[0-9A-Fa-f]{4}_")


def decode(s: str) -> str:
    """``_x000d_`` and the like as their characters."""
    return _ESCAPE.sub(lambda m: chr(int(m[1], 16)), s)


def encode(s: str) -> str:
    return _UNSAFE.sub(lambda m: f"_x{ord(m[0]):04x}_" if len(m[0]) == 1 else f"_x005f{m[0]}", s)


def _runs(node) -> str:
    """The text of a string item, phonetic parts left out."""
    out = "".join(t.text or "" for t in node.findall(f"{_N}t"))
    out += "".join(t.text or "" for r in node.findall(f"{_N}r") for t in r.findall(f"{_N}t"))
    return decode(out)


def shift(formula: str, rows: int, cols: int) -> str:
    """A formula moved by rows and columns; absolute parts stay, text and sheet names are left alone."""

    def move(m):
        if m["skip"] is not None:
            return m[0]
        d1, col, d2, row = m["d1"], m["col"], m["d2"], m["row"]
        c = col if d1 else p.column_letters(p.column_index(col) + cols)
        r = row if d2 else str(int(row) + rows)
        return f"{d1}{c}{d2}{r}"

    return re.sub(r"""(?P<skip>"(?:[^"]|"")*"|'(?:[^']|'')*'!|[A-Za-z_][\w.]*[!(])|(?<![\w.])(?P<d1>\$?)(?P<col>[A-Za-z]{1,3})(?P<d2>\$?)(?P<row>[1-9]\d*)(?![\w(.])""", move, formula)


# Reading ----------------------------------------------------------------------------------------------------------


def read_file(path: str) -> Workbook:
    with open(path, "rb") as f:
        return read_bytes(f.read())


def _xml(z: zipfile.ZipFile, name: str):
    return ET.fromstring(z.read(name)) if name in z.namelist() else None


def _rels(z: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    folder, _, name = part.rpartition("/")
    root = _xml(z, f"{folder}/_rels/{name}.rels")
    out = {}
    for r in root if root is not None else ():
        target = r.get("Target")
        full = target.lstrip("/") if target.startswith("/") else f"{folder}/{target}"
        parts: list[str] = []
        for x in full.split("/"):
            parts = parts[:-1] if x == ".." else [*parts, x]
        out[r.get("Id")] = (r.get("Type").rsplit("/", 1)[-1], "/".join(parts))
    return out


def _parts(data: bytes):
    """The package, its workbook part, relations, shared strings and styles."""
    z = zipfile.ZipFile(io.BytesIO(data))
    root = _xml(z, "xl/workbook.xml")
    if root is None or "[Content_Types].xml" not in z.namelist():
        raise ValueError("not a workbook")
    strings = _xml(z, "xl/sharedStrings.xml")
    shared = [_runs(si) for si in strings] if strings is not None else []
    return z, root, _rels(z, "xl/workbook.xml"), shared, _read_styles(_xml(z, "xl/styles.xml"))


def read_bytes(data: bytes) -> Workbook:
    z, root, rels, shared, styles = _parts(data)
    book = Workbook()
    pr = root.find(f"{_N}workbookPr")
    book.date_1904 = pr is not None and pr.get("date1904") in ("1", "true")
    book.styles = styles
    for s in root.iter(f"{_N}sheet"):
        sheet = book.add_sheet(s.get("name"))
        sheet.visible = s.get("state") not in ("hidden", "veryHidden")
        kind, part = rels.get(s.get(f"{_R}id"), ("", ""))
        if part in z.namelist():
            _read_sheet(z, part, sheet, shared)
    names = book.sheet_names
    for d in root.iter(f"{_N}definedName"):
        local = d.get("localSheetId")
        text_ = d.text or ""
        book.define_name(d.get("name"), text_, names[int(local)] if local is not None else None)
    view = root.find(f"{_N}bookViews/{_N}workbookView")
    book.active = int(view.get("activeTab", 0)) if view is not None else 0
    return book


def _value(kind: str, v: str | None, shared: list[str]):
    if v is None:
        return None
    if kind == "s":
        return shared[int(v)] if int(v) < len(shared) else None
    if kind == "b":
        return v == "1"
    if kind == "e":
        return Err(v) if v in p.ERRORS else v
    if kind in ("str", "inlineStr"):
        return decode(v)
    return float(v)


def iter_rows(data: bytes, most: int = 50_000):
    """The cells of a workbook as lists of long rows, sheet by sheet while they are read: a sheet is never held whole."""
    z, root, rels, shared, _ = _parts(data)
    for s in root.iter(f"{_N}sheet"):
        kind, part = rels.get(s.get(f"{_R}id"), ("", ""))
        if part not in z.namelist():
            continue
        sheet = Worksheet(s.get("name"), None)
        for _ in _events(z, part, sheet, shared):
            if len(sheet._cells) >= most:
                yield sheet.rows()
                sheet._cells.clear()
        if sheet._cells:
            yield sheet.rows()


def _read_sheet(z: zipfile.ZipFile, part: str, sheet: Worksheet, shared: list[str]) -> None:
    for _ in _events(z, part, sheet, shared):
        pass
    for kind, target in _rels(z, part).values():
        if kind == "comments" and (root := _xml(z, target)) is not None:
            authors = [a.text or "" for a in root.iter(f"{_N}author")]
            for c in root.iter(f"{_N}comment"):
                sheet.set_comment(c.get("ref"), _runs(c.find(f"{_N}text")), authors[int(c.get("authorId", 0))] if authors else "")


def _events(z: zipfile.ZipFile, part: str, sheet: Worksheet, shared: list[str]):
    """Fills sheet from its part; comes back after every row."""
    masters: dict[str, tuple[str, int, int]] = {}
    columns: dict[str, int] = {}
    row_at = -1

    def take(cells, row: int) -> None:
        """The cells of one row element."""
        col = -1
        for e in cells:
            name = e.get("r")
            if name:
                letters = name.rstrip("0123456789")
                col = columns[letters] if letters in columns else columns.setdefault(letters, p.column_index(letters))
            else:
                col += 1
            kind, style, raw, fx, v = e.get("t", "n"), int(e.get("s", 0)), None, None, None
            for part_ in e:
                if part_.tag == _V:
                    raw = part_.text
                elif part_.tag == _F:
                    fx = part_
                elif part_.tag == _IS:
                    v = _runs(part_)
            if v is None:
                v = float(raw) if raw is not None and kind == "n" else _value(kind, raw, shared)
            formula = None
            if fx is not None:
                formula = fx.text or None
                if fx.get("t") == "shared":
                    if formula:
                        masters[fx.get("si")] = (formula, row, col)
                    elif fx.get("si") in masters:
                        text_, r0, c0 = masters[fx.get("si")]
                        formula = shift(text_, row - r0, col - c0)
            if v is not None or formula or style:
                if not (row < p.MAX_ROWS and col < p.MAX_COLS):
                    raise ValueError(f"cell out of bounds: {row}, {col}")
                sheet._cells[row, col] = Cell(v, f"={decode(formula)}" if formula else None, style)

    with z.open(part) as f:
        for _, e in ET.iterparse(f, ("end",)):
            if e.tag in _INSIDE:
                continue
            tag = e.tag.removeprefix(_N)
            if tag == "row":
                row_at = int(e.get("r", row_at + 2)) - 1
                take(e, row_at)
                if e.get("ht") and e.get("customHeight") in ("1", "true", None):
                    sheet.row_heights[row_at] = float(e.get("ht"))
                if e.get("hidden") in ("1", "true"):
                    sheet.hidden_rows.add(row_at)
                e.clear()
                yield
            elif tag == "col":
                for c in range(int(e.get("min")) - 1, min(int(e.get("max")), p.MAX_COLS)):
                    if e.get("width") and e.get("customWidth") in ("1", "true"):
                        sheet.col_widths[c] = float(e.get("width"))
                    if e.get("hidden") in ("1", "true"):
                        sheet.hidden_cols.add(c)
            elif tag == "mergeCell":
                sheet.merges.append(p.parse_range(e.get("ref")))
            elif tag == "pane" and e.get("state") in ("frozen", "frozenSplit"):
                sheet.freeze = (int(float(e.get("ySplit", 0))), int(float(e.get("xSplit", 0))))
            elif tag == "tabColor":
                sheet.tab_color = e.get("rgb")
            elif tag == "dataValidation":
                rule = {k: e.get(k) for k in ("type", "operator", "allowBlank", "errorStyle", "errorTitle", "error", "promptTitle", "prompt") if e.get(k) is not None}
                rule |= {k: x.text for k in ("formula1", "formula2") if (x := e.find(f"{_N}{k}")) is not None}
                sheet.validations.append({"range": e.get("sqref"), **rule})
            elif tag == "conditionalFormatting":
                for r in e.findall(f"{_N}cfRule"):
                    rule = dict(r.attrib) | {"formulas": [x.text for x in r.findall(f"{_N}formula")]}
                    for scale in ("colorScale", "dataBar", "iconSet"):
                        if (x := r.find(f"{_N}{scale}")) is not None:
                            rule[scale] = dict(x.attrib) | {"cfvo": [dict(y.attrib) for y in x.findall(f"{_N}cfvo")], "colors": [y.get("rgb") for y in x.findall(f"{_N}color")]}
                    sheet.conditional_formats.append({"range": e.get("sqref"), **rule})
            elif tag == "pageSetup":
                sheet.page_setup = dict(e.attrib)


def _attrs(node) -> dict:
    return dict(node.attrib) if node is not None else {}


def _read_styles(root) -> list[dict]:
    if root is None:
        return [{}]

    def block(name):
        found = root.find(f"{_N}{name}")
        return list(found) if found is not None else []

    def part(e) -> dict:
        out = {}
        for x in e:
            key = x.tag.removeprefix(_N)
            inner = part(x) if len(x) else {}
            out[key] = dict(x.attrib) | inner if x.attrib or inner else {}
        return out

    formats = {f.get("numFmtId"): f.get("formatCode") for f in block("numFmts")}
    fonts, fills, borders = ([part(e) for e in block(k)] for k in ("fonts", "fills", "borders"))
    out = []
    for xf in block("cellXfs"):
        pick = lambda items, key: items[int(xf.get(key, 0))] if int(xf.get(key, 0)) < len(items) else {}  # noqa: E731, B023
        style = {"font": pick(fonts, "fontId"), "fill": pick(fills, "fillId"), "border": pick(borders, "borderId")}
        n = xf.get("numFmtId", "0")
        style["number_format"] = formats.get(n, int(n))
        if (a := xf.find(f"{_N}alignment")) is not None:
            style["alignment"] = _attrs(a)
        if (a := xf.find(f"{_N}protection")) is not None:
            style["protection"] = _attrs(a)
        out.append(style)
    return out or [{}]


# Writing ----------------------------------------------------------------------------------------------------------


def _tag(name: str, attrs: dict, inner: str = "") -> str:
    a = "".join(f" {k}={quoteattr(str(v))}" for k, v in attrs.items() if v is not None)
    return f"<{name}{a}>{inner}</{name}>" if inner else f"<{name}{a}/>"


def _tree(d: dict) -> str:
    return "".join(_tag(k, {a: b for a, b in v.items() if not isinstance(b, dict)}, _tree({a: b for a, b in v.items() if isinstance(b, dict)})) for k, v in d.items())


def _styles(book: Workbook) -> str:
    tables: dict[str, list[str]] = {"font": ['<sz val="11"/><name val="Calibri"/>'], "fill": ['<patternFill patternType="none"/>', '<patternFill patternType="gray125"/>'], "border": ["<left/><right/><top/><bottom/><diagonal/>"]}
    custom: list[str] = []
    xfs = []
    for s in book.styles or [{}]:
        at = {}
        for k, items in tables.items():
            inner = _tree(s.get(k) or {}) or items[0]
            if inner not in items:
                items.append(inner)
            at[k] = items.index(inner)
        n = s.get("number_format", 0)
        if isinstance(n, str):
            if n not in custom:
                custom.append(n)
            n = 164 + custom.index(n)
        inner = "".join(_tag(k, s[k]) for k in ("alignment", "protection") if s.get(k))
        xfs.append(_tag("xf", {"numFmtId": n, "fontId": at["font"], "fillId": at["fill"], "borderId": at["border"], "applyNumberFormat": int(n != 0), "applyFont": int(at["font"] > 0), "applyFill": int(at["fill"] > 0), "applyBorder": int(at["border"] > 0), "applyAlignment": int("alignment" in s)}, inner))
    formats = _tag("numFmts", {"count": len(custom)}, "".join(_tag("numFmt", {"numFmtId": 164 + i, "formatCode": c}) for i, c in enumerate(custom))) if custom else ""
    blocks = "".join(_tag(f"{k}s", {"count": len(v)}, "".join(f"<{k}>{x}</{k}>" for x in v)) for k, v in tables.items())
    return f'<styleSheet xmlns="{MAIN}">{formats}{blocks}<cellStyleXfs count="1"><xf/></cellStyleXfs>{_tag("cellXfs", {"count": len(xfs)}, "".join(xfs))}</styleSheet>'


def _cell(row: int, col: int, cell) -> str:
    v = cell.value
    if not cell.formula and not cell.style:  # most cells
        if isinstance(v, float):
            return f'<c r="{p.cell_name(row, col)}"><v>{int(v) if v.is_integer() and abs(v) < 1e15 else repr(v)}</v></c>'
        if isinstance(v, str):
            return f'<c r="{p.cell_name(row, col)}" t="inlineStr"><is><t xml:space="preserve">{escape(encode(v))}</t></is></c>'
    f = f"<f>{escape(encode(cell.formula[1:]))}</f>" if cell.formula else ""
    attrs = {"r": p.cell_name(row, col), "s": cell.style or None}
    if v is None:
        return _tag("c", attrs, f)
    if isinstance(v, bool):
        return _tag("c", attrs | {"t": "b"}, f"{f}<v>{int(v)}</v>")
    if isinstance(v, float):
        return _tag("c", attrs, f"{f}<v>{text(v) if v == int(v) and abs(v) < 1e15 else repr(v)}</v>")
    if isinstance(v, Err):
        return _tag("c", attrs | {"t": "e"}, f"{f}<v>{escape(v.code)}</v>")
    if cell.formula:
        return _tag("c", attrs | {"t": "str"}, f"{f}<v>{escape(encode(v))}</v>")
    return _tag("c", attrs | {"t": "inlineStr"}, f'<is><t xml:space="preserve">{escape(encode(v))}</t></is>')


def _range(r: tuple[int, int, int, int]) -> str:
    return f"{p.cell_name(r[0], r[1])}:{p.cell_name(r[2], r[3])}"


def _sheet(sheet: Worksheet) -> str:
    out = [f'<worksheet xmlns="{MAIN}" xmlns:r="{REL}">']
    if sheet.tab_color:
        out.append(f"<sheetPr>{_tag('tabColor', {'rgb': sheet.tab_color})}</sheetPr>")
    if sheet.freeze:
        rows, cols = sheet.freeze
        pane = _tag("pane", {"xSplit": cols or None, "ySplit": rows or None, "topLeftCell": p.cell_name(rows, cols), "activePane": "bottomRight" if rows and cols else "bottomLeft" if rows else "topRight", "state": "frozen"})
        out.append(f'<sheetViews><sheetView workbookViewId="0">{pane}</sheetView></sheetViews>')
    if cols := sorted({*sheet.col_widths, *sheet.hidden_cols}):
        out.append(_tag("cols", {}, "".join(_tag("col", {"min": c + 1, "max": c + 1, "width": sheet.col_widths.get(c, 8.43), "customWidth": int(c in sheet.col_widths), "hidden": int(c in sheet.hidden_cols) or None}) for c in cols)))
    out.append("<sheetData>")
    rows: dict[int, list[str]] = {r: [] for r in {*sheet.row_heights, *sheet.hidden_rows}}
    for (r, c), cell in sheet.iter_cells():
        rows.setdefault(r, []).append(_cell(r, c, cell) if cell.spilled_from is None else _cell(r, c, type(cell)(cell.value, None, cell.style)))
    for r in sorted(rows):
        out.append(_tag("row", {"r": r + 1, "ht": sheet.row_heights.get(r), "customHeight": 1 if r in sheet.row_heights else None, "hidden": 1 if r in sheet.hidden_rows else None}, "".join(rows[r])))
    out.append("</sheetData>")
    if sheet.merges:
        out.append(_tag("mergeCells", {"count": len(sheet.merges)}, "".join(_tag("mergeCell", {"ref": _range(m)}) for m in sheet.merges)))
    for i, f in enumerate(sheet.conditional_formats):
        inner = "".join(f"<formula>{escape(str(x))}</formula>" for x in f.get("formulas", []))
        for scale in ("colorScale", "dataBar", "iconSet"):
            if scale in f:
                d = f[scale]
                inner += _tag(scale, {k: v for k, v in d.items() if k not in ("cfvo", "colors")}, "".join(_tag("cfvo", x) for x in d.get("cfvo", [])) + "".join(_tag("color", {"rgb": x}) for x in d.get("colors", [])))
        attrs = {k: v for k, v in f.items() if k not in ("range", "formulas", "colorScale", "dataBar", "iconSet")}
        out.append(_tag("conditionalFormatting", {"sqref": f["range"]}, _tag("cfRule", {"priority": i + 1} | attrs, inner)))
    if sheet.validations:
        rules = "".join(_tag("dataValidation", {k: v for k, v in d.items() if k not in ("range", "formula1", "formula2")} | {"sqref": d["range"]}, "".join(f"<{k}>{escape(str(d[k]))}</{k}>" for k in ("formula1", "formula2") if k in d)) for d in sheet.validations)
        out.append(_tag("dataValidations", {"count": len(sheet.validations)}, rules))
    if sheet.page_setup:
        out.append(_tag("pageSetup", {k: v for k, v in sheet.page_setup.items() if "{" not in k}))
    if sheet.comments:
        out.append('<legacyDrawing r:id="rId2"/>')
    out.append("</worksheet>")
    return "".join(out)


def _comments(sheet: Worksheet) -> tuple[str, str]:
    authors = sorted({c["author"] for c in sheet.comments.values()})
    items = "".join(_tag("comment", {"ref": p.cell_name(*at), "authorId": authors.index(c["author"])}, f'<text><t xml:space="preserve">{escape(encode(c["text"]))}</t></text>') for at, c in sorted(sheet.comments.items()))
    xml = f'<comments xmlns="{MAIN}"><authors>{"".join(f"<author>{escape(a)}</author>" for a in authors)}</authors><commentList>{items}</commentList></comments>'
    shapes = "".join(f'<v:shape type="#_x0000_t202" style="visibility:{"visible" if c.get("visible") else "hidden"}"><x:ClientData ObjectType="Note"><x:Row>{at[0]}</x:Row><x:Column>{at[1]}</x:Column></x:ClientData></v:shape>' for at, c in sorted(sheet.comments.items()))
    vml = f'<xml xmlns:v="urn:schemas-microsoft-com:vml" xmlns:x="urn:schemas-microsoft-com:office:excel">{shapes}</xml>'
    return xml, vml


def to_bytes(book: Workbook) -> bytes:
    head = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'
    parts: dict[str, str] = {"xl/styles.xml": _styles(book)}
    types = {"xl/workbook.xml": "spreadsheetml.sheet.main", "xl/styles.xml": "spreadsheetml.styles"}
    links, entries = [], []
    for i, s in enumerate(book._sheets, 1):
        part = f"xl/worksheets/sheet{i}.xml"
        parts[part], types[part] = _sheet(s), "spreadsheetml.worksheet"
        entries.append(_tag("sheet", {"name": s.name, "sheetId": i, "state": None if s.visible else "hidden", "r:id": f"rId{i}"}))
        links.append((f"rId{i}", "worksheet", f"worksheets/sheet{i}.xml"))
        if s.comments:
            parts[f"xl/comments{i}.xml"], parts[f"xl/drawings/vml{i}.vml"] = _comments(s)
            types[f"xl/comments{i}.xml"] = "spreadsheetml.comments"
            parts[f"xl/worksheets/_rels/sheet{i}.xml.rels"] = _relations([("rId1", "comments", f"../comments{i}.xml"), ("rId2", "vmlDrawing", f"../drawings/vml{i}.vml")])
    links.append((f"rId{len(book._sheets) + 1}", "styles", "styles.xml"))
    names = "".join(_tag("definedName", {"name": n, "localSheetId": book.sheet_names.index(s) if s in book.sheet_names else None}, escape(t.removeprefix("="))) for (s, n), t in book._names.items())
    parts["xl/workbook.xml"] = (
        f'<workbook xmlns="{MAIN}" xmlns:r="{REL}">{_tag("workbookPr", {"date1904": int(book.date_1904) or None})}<bookViews>{_tag("workbookView", {"activeTab": book.active})}</bookViews>'
        f"<sheets>{''.join(entries)}</sheets>{f'<definedNames>{names}</definedNames>' if names else ''}</workbook>"
    )
    parts["xl/_rels/workbook.xml.rels"] = _relations(links)
    parts["_rels/.rels"] = _relations([("rId1", "officeDocument", "xl/workbook.xml")])
    overrides = "".join(_tag("Override", {"PartName": f"/{k}", "ContentType": f"application/vnd.openxmlformats-officedocument.{v}+xml"}) for k, v in types.items())
    parts["[Content_Types].xml"] = f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="vml" ContentType="application/vnd.openxmlformats-officedocument.vmlDrawing"/><Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in sorted(parts, key=lambda k: k != "[Content_Types].xml"):
            z.writestr(name, head + parts[name])
    return out.getvalue()


def _relations(links: list[tuple[str, str, str]]) -> str:
    return f'<Relationships xmlns="{PACKAGE}/relationships">{"".join(_tag("Relationship", {"Id": i, "Type": f"{REL}/{k}", "Target": t}) for i, k, t in links)}</Relationships>'


def write_file(book: Workbook, path: str) -> None:
    with open(path, "wb") as f:
        f.write(to_bytes(book))


# DataFrames -------------------------------------------------------------------------------------------------------


def _whole(read):
    """Blocks of rows of a workbook that a reader gives whole."""
    return lambda data: (s.rows() for s in read(data)._sheets)


def cells_of(files: DataFrame, read=None) -> DataFrame:
    """All cells of the workbooks in files (path string, content binary): long rows, read on the executors.

    read gives a workbook from bytes; without it XLSX is read row by row, so a task holds a file's bytes and strings but
    never its cells.
    """
    names = ["file", *[c.split()[0] for c in CELL_SCHEMA.split(", ")]]
    blocks = iter_rows if read is None else _whole(read)

    def run(frames):
        for frame in frames:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                for rows in blocks(bytes(content)):
                    yield pd.DataFrame([(file, *r) for r in rows], columns=names).astype({"bool": object, "num": float})

    ship(files.sparkSession)
    return files.select("path", "content").mapInPandas(run, f"file string, {CELL_SCHEMA}")


def scan(spark: SparkSession, path: str, read=None) -> DataFrame:
    """All cells of all workbooks under path, with their file; one task reads a file or more."""
    return cells_of(spark.read.format("binaryFile").load(path), read)


def workbooks(df: DataFrame, keys: list[str]) -> DataFrame:
    """One workbook per key, made on the executors: the keys and content (binary), one sheet with a header row.

    A key with more rows than a sheet holds fails the job; rows are in the order of all their columns.
    """
    ship(df.sparkSession)
    names = [c for c in df.columns if c not in keys]

    def make(frame):
        frame = frame.sort_values(names)
        if len(frame) >= p.MAX_ROWS:
            raise ValueError(f"more than {p.MAX_ROWS - 1} rows")
        book = Workbook()
        sheet = book.add_sheet("Sheet1")
        for c, n in enumerate(names):
            sheet._cells[0, c] = Cell(n)
            for r, v in enumerate(frame[n].tolist(), 1):
                if v is not None and v == v:
                    sheet._cells[r, c] = Cell(_plain(v))
        return pd.DataFrame([(*(frame[k].iloc[0] for k in keys), to_bytes(book))], columns=[*keys, "content"])

    kinds = dict(df.dtypes)
    return df.groupBy(*keys).applyInPandas(make, ", ".join([f"`{k}` {kinds[k]}" for k in keys] + ["content binary"]))


def _plain(v):
    return v if isinstance(v, (bool, float, str)) else float(v) if isinstance(v, (int, float)) else str(v)


def from_table(df: DataFrame, name: str = "Sheet1", limit: int = p.MAX_ROWS - 1) -> Workbook:
    """A table as a sheet with a header row; refuses one with more rows than a sheet holds."""
    if df.limit(limit + 1).count() > limit:
        raise ValueError(f"more than {limit} rows")
    book = Workbook()
    sheet = book.add_sheet(name)
    for c, n in enumerate(df.columns):
        sheet._cell((0, c)).value = n
    for r, row in enumerate(df.toLocalIterator(), 1):
        for c, v in enumerate(row):
            if v is not None:
                sheet._cell((r, c)).value = _plain(v)
    return book
