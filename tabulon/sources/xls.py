"""XLS (BIFF8) files, values only: the compound file, its record stream, and the cells of each sheet."""

from __future__ import annotations

import struct

from pyspark.sql import DataFrame, SparkSession

from tabulon.operators.grid import Workbook
from tabulon.plans.values import Err

#: Error codes of the format.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}
#: Record numbers of the format.
BOF, EOF, CONTINUE, BOUNDSHEET, SST, DATEMODE = 0x809, 0x0A, 0x3C, 0x85, 0xFC, 0x22
LABELSST, LABEL, NUMBER, RK, MULRK, BOOLERR, FORMULA, STRING, MERGED, ROW, COLINFO = 0xFD, 0x204, 0x203, 0x27E, 0xBD, 0x205, 0x06, 0x207, 0xE5, 0x208, 0x7D
_FREE = 0xFFFFFFF0


def stream_of(data: bytes, names=("Workbook", "Book")) -> bytes:
    """A stream of a compound file."""
    if data[:8] != b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1":
        raise ValueError("not a compound file")
    shift, short_shift = struct.unpack_from("<HH", data, 30)
    fats, first_dir, _, cutoff, first_mini, _, first_difat, difats = struct.unpack_from("<I", data, 44)[0], *struct.unpack_from("<I", data, 48), *struct.unpack_from("<II", data, 52), *struct.unpack_from("<I", data, 60), *struct.unpack_from("<I", data, 64), *struct.unpack_from("<II", data, 68)
    size, short = 1 << shift, 1 << short_shift
    at = lambda n: (n + 1) * size
    ids = list(struct.unpack_from("<109I", data, 76))
    n = first_difat
    for _ in range(difats):
        if n >= _FREE:
            break
        block = struct.unpack_from(f"<{size // 4}I", data, at(n))
        ids += block[:-1]
        n = block[-1]
    fat: list[int] = []
    for i in ids[:]:
        if i < _FREE and len(fat) < fats * size // 4:
            fat += struct.unpack_from(f"<{size // 4}I", data, at(i))

    def chain(n: int, table: list[int]):
        seen = 0
        while n < _FREE and n < len(table) and seen <= len(table):
            yield n
            n = table[n]
            seen += 1

    read = lambda n: b"".join(data[at(i) : at(i) + size] for i in chain(n, fat))
    directory = read(first_dir)
    root_mini, found = b"", None
    for i in range(0, len(directory) - 127, 128):
        length, kind = struct.unpack_from("<HB", directory, i + 64)
        name = directory[i : i + max(length - 2, 0)].decode("utf-16-le", "replace")
        start, bytes_ = struct.unpack_from("<II", directory, i + 116)
        if kind == 5:
            root_mini = read(start)
        elif kind == 2 and name in names and (found is None or name == names[0]):
            found = (start, bytes_)
    if found is None:
        raise ValueError("no workbook stream")
    start, length = found
    if length >= cutoff:
        return read(start)[:length]
    raw = read(first_mini)
    mini = list(struct.unpack(f"<{len(raw) // 4}I", raw))
    return b"".join(root_mini[i * short : (i + 1) * short] for i in chain(start, mini))[:length]


def records(stream: bytes):
    """(number, data, offsets of the continued parts, position) of each record; CONTINUE records are joined."""
    at = 0
    while at + 4 <= len(stream):
        begin = at
        kind, size = struct.unpack_from("<HH", stream, at)
        data, cuts = stream[at + 4 : at + 4 + size], []
        at += 4 + size
        while at + 4 <= len(stream) and struct.unpack_from("<H", stream, at)[0] == CONTINUE:
            more = struct.unpack_from("<H", stream, at + 2)[0]
            cuts.append(len(data))
            data += stream[at + 4 : at + 4 + more]
            at += 4 + more
        yield kind, data, cuts, begin


def rk(n: int) -> float:
    """A packed number: two flag bits, then an integer or the high bits of a double."""
    v = float(struct.unpack("<i", struct.pack("<I", n))[0] >> 2) if n & 2 else struct.unpack("<d", struct.pack("<Q", (n & 0xFFFFFFFC) << 32))[0]
    return v / 100 if n & 1 else v


def shared_strings(data: bytes, cuts: list[int]) -> list[str]:
    """The string table; where a string is continued, a new flag byte says how its characters go on."""
    total = struct.unpack_from("<I", data, 4)[0]
    at, out, borders = 8, [], [*cuts, len(data)]
    for _ in range(total):
        if at + 3 > len(data):
            break
        n, flags = struct.unpack_from("<HB", data, at)
        at += 3
        runs = extra = 0
        if flags & 8:
            runs = struct.unpack_from("<H", data, at)[0]
            at += 2
        if flags & 4:
            extra = struct.unpack_from("<I", data, at)[0]
            at += 4
        parts, left, wide = [], n, flags & 1
        while left and at < len(data):
            border = next(b for b in borders if b > at)
            take = min(left, (border - at) // (1 + wide))
            parts.append(data[at : at + take * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace"))
            at += take * (1 + wide)
            left -= take
            if left and at < len(data):
                wide = data[at] & 1
                at += 1
        out.append("".join(parts))
        at += 4 * runs + extra
    return out


def _text(data: bytes, at: int, short: bool = False) -> str:
    n = data[at] if short else struct.unpack_from("<H", data, at)[0]
    at += 1 if short else 2
    wide = data[at] & 1
    return data[at + 1 : at + 1 + n * (1 + wide)].decode("utf-16-le" if wide else "latin-1", "replace")


def read_bytes(data: bytes) -> Workbook:
    book, strings, starts = Workbook(), [], {}
    sheet = pending = None
    for kind, d, cuts, at in records(stream_of(data)):
        if kind == DATEMODE:
            book.date_1904 = struct.unpack_from("<H", d)[0] == 1
        elif kind == SST:
            strings = shared_strings(d, cuts)
        elif kind == BOUNDSHEET:
            position, state = struct.unpack_from("<IB", d)
            if d[5] == 0:
                starts[position] = book.add_sheet(_text(d, 6, True))
                starts[position].visible = state == 0
        elif kind == BOF:
            sheet = starts.get(at, None if starts else sheet)
        elif sheet is None:
            continue
        elif kind in (LABELSST, LABEL, NUMBER, RK, BOOLERR, FORMULA):
            row, col = struct.unpack_from("<HH", d)
            v = pending = None
            if kind == LABELSST:
                i = struct.unpack_from("<I", d, 6)[0]
                v = strings[i] if i < len(strings) else None
            elif kind == LABEL:
                v = _text(d, 6)
            elif kind == NUMBER:
                v = struct.unpack_from("<d", d, 6)[0]
            elif kind == RK:
                v = rk(struct.unpack_from("<I", d, 6)[0])
            elif kind == BOOLERR:
                v = Err(ERRORS.get(d[6], "#VALUE!")) if d[7] else bool(d[6])
            elif d[12:14] != b"\xff\xff":
                v = struct.unpack_from("<d", d, 6)[0]
            elif d[6] == 0:
                pending = (row, col)
            elif d[6] in (1, 2):
                v = bool(d[8]) if d[6] == 1 else Err(ERRORS.get(d[8], "#VALUE!"))
            if v is not None:
                sheet._cell((row, col)).value = v
        elif kind == STRING and pending:
            sheet._cell(pending).value = _text(d, 0)
            pending = None
        elif kind == MULRK:
            row, col = struct.unpack_from("<HH", d)
            for i in range((len(d) - 6) // 6):
                sheet._cell((row, col + i)).value = rk(struct.unpack_from("<I", d, 6 + 6 * i)[0])
        elif kind == MERGED:
            for i in range(struct.unpack_from("<H", d)[0]):
                r, r2, c, c2 = struct.unpack_from("<4H", d, 2 + 8 * i)
                sheet.merges.append((r, c, r2, c2))
        elif kind == ROW:
            row, _, _, height = struct.unpack_from("<4H", d)
            options = struct.unpack_from("<H", d, 12)[0]
            if options & 0x40:
                sheet.row_heights[row] = (height & 0x7FFF) / 20
            if options & 0x20:
                sheet.hidden_rows.add(row)
        elif kind == COLINFO:
            a, b, width, _, options = struct.unpack_from("<5H", d)
            for c in range(a, min(b, 255) + 1):
                sheet.col_widths[c] = width / 256
                if options & 1:
                    sheet.hidden_cols.add(c)
    return book


def read_file(path: str) -> Workbook:
    with open(path, "rb") as f:
        return read_bytes(f.read())


def scan(spark: SparkSession, path: str) -> DataFrame:
    """All cells of all files under path, read on the executors."""
    from tabulon.sources import xlsx

    return xlsx.scan(spark, path, read_bytes)
