"""Workbooks of the older binary kind (.xls): records of cells in a compound file's one stream."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator

from orrery.sources import compound

# Kinds of records.
BOF, EOF, CONTINUE, SHEET, STRINGS, EPOCH_1904, FORMAT, STYLE, ENCRYPTED = 0x809, 0x0A, 0x3C, 0x85, 0xFC, 0x22, 0x41E, 0xE0, 0x2F
SHARED, NUMBER, SHORT, SHORTS, LABEL, FORMULA, RESULT, TRUTH, MERGED = 0xFD, 0x203, 0x27E, 0xBD, 0x204, 0x06, 0x207, 0x205, 0xE5
# The errors of cells.
ERRORS = {0x00: "#NULL!", 0x07: "#DIV/0!", 0x0F: "#VALUE!", 0x17: "#REF!", 0x1D: "#NAME?", 0x24: "#NUM!", 0x2A: "#N/A"}


def _records(data: bytes, at: int) -> Iterator[tuple[int, list[bytes]]]:
    """Kind and pieces of each record from a place to its part's end; what continues a record is its further pieces."""
    kind, pieces = None, []
    while at + 4 <= len(data):
        k, n = struct.unpack_from("<HH", data, at)
        body = data[at + 4 : at + 4 + n]
        if len(body) < n:
            raise ValueError("a record is cut short")
        at += 4 + n
        if k == CONTINUE:
            pieces.append(body)
            continue
        if kind is not None:
            yield kind, pieces
        if k == EOF:
            return
        kind, pieces = k, [body]
    raise ValueError("the workbook has no end")


class _Pieces:
    """Reads a record's pieces as one; letters that run over into a piece have their width told anew there."""

    def __init__(self, pieces: list[bytes], at: int = 0):
        self.pieces, self.k, self.at = pieces, 0, at

    def take(self, n: int) -> bytes:
        out = b""
        while n > len(out):
            if self.at >= len(self.pieces[self.k]):
                self.k, self.at = self.k + 1, 0
                if self.k >= len(self.pieces):
                    raise ValueError("a string is cut short")
            part = self.pieces[self.k][self.at : self.at + n - len(out)]
            self.at += len(part)
            out += part
        return out

    def letters(self, count: int, flags: int) -> str:
        wide, out = flags & 1, []
        while count:
            if self.at >= len(self.pieces[self.k]):
                wide = self.take(1)[0] & 1
            n = min(count, max(1, (len(self.pieces[self.k]) - self.at) >> wide))
            part = self.take(n << wide)
            out.append(part if wide else part.decode("latin-1").encode("utf-16le"))
            count -= n
        return b"".join(out).decode("utf-16le", "replace")

    def string(self) -> str:
        """A string with its length, width, and the fonts and sounds that are skipped."""
        count, flags = struct.unpack("<HB", self.take(3))
        runs = struct.unpack("<H", self.take(2))[0] if flags & 8 else 0
        more = struct.unpack("<I", self.take(4))[0] if flags & 4 else 0
        said = self.letters(count, flags)
        self.take(4 * runs + more)
        return said


def _short(v: int) -> float:
    """A number in 30 bits: a whole one or the upper half of a double, in hundredths if so marked."""
    number = (v ^ 0x80000000) - 0x80000000 >> 2 if v & 2 else struct.unpack("<d", struct.pack("<Q", (v & 0xFFFFFFFC) << 32))[0]
    return number / 100 if v & 1 else number


def sheets(raw: bytes, built_in: set[int]) -> Iterator[tuple[str, dict[tuple[int, int], object], set[tuple[int, int]], list[tuple[int, int, int, int]], int]]:
    """Of each sheet its name, cells by row and column, those that are dates (as serial numbers), merged ranges, and the days to add to a date.

    ``built_in`` are the formats of dates that no file spells out. Sheets of
    charts and macros are left out. ValueError for files that are encrypted,
    broken or of a make before 1997.
    """
    parts = compound.streams(raw)
    if "Workbook" not in parts:
        raise ValueError("a workbook of a make before 1997" if "Book" in parts else "no workbook")
    data = parts["Workbook"]
    shared, dated, formats, found, days = [], [], set(built_in), [], 0
    for kind, p in _records(data, 0):
        if kind == ENCRYPTED:
            raise ValueError("the workbook is encrypted")
        if kind == EPOCH_1904:
            days = 1462 * (p[0][:2] == b"\1\0")
        elif kind == FORMAT and re.search(r"(?i)[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", _Pieces(p, 2).string())):
            formats.add(struct.unpack_from("<H", p[0])[0])
        elif kind == STYLE:
            dated.append(struct.unpack_from("<H", p[0], 2)[0])
        elif kind == SHEET and p[0][5] == 0:
            found.append((_Pieces(p, 8).letters(p[0][6], p[0][7]), struct.unpack_from("<I", p[0])[0]))
        elif kind == STRINGS:
            reader = _Pieces(p, 8)
            shared = [reader.string() for _ in range(struct.unpack_from("<I", p[0], 4)[0])]
    for name, start in found:
        cells, dates, merged, waiting = {}, set(), [], None
        for kind, p in _records(data, start):
            body = p[0]
            if kind in (SHARED, NUMBER, SHORT, LABEL, FORMULA, TRUTH):
                row, col, style = struct.unpack_from("<HHH", body)
                value = None
                if kind == SHARED:
                    value = shared[struct.unpack_from("<I", body, 6)[0]]
                elif kind == LABEL:
                    value = _Pieces(p, 6).string()
                elif kind == SHORT:
                    value = _short(struct.unpack_from("<I", body, 6)[0])
                elif kind == TRUTH:
                    value = ERRORS.get(body[6], "#N/A") if body[7] else bool(body[6])
                elif kind == FORMULA and body[12:14] == b"\xff\xff":
                    waiting = (row, col) if body[6] == 0 else None
                    value = bool(body[8]) if body[6] == 1 else ERRORS.get(body[8], "#N/A") if body[6] == 2 else None
                else:
                    value = struct.unpack_from("<d", body, 6)[0]
                _put(cells, dates, (row, col), value, style < len(dated) and dated[style] in formats)
            elif kind == SHORTS:
                row, col = struct.unpack_from("<HH", body)
                for k in range((len(body) - 6) // 6):
                    style, v = struct.unpack_from("<HI", body, 4 + 6 * k)
                    _put(cells, dates, (row, col + k), _short(v), style < len(dated) and dated[style] in formats)
            elif kind == RESULT and waiting is not None:
                cells[waiting], waiting = _Pieces(p).string(), None
            elif kind == MERGED:
                ranges = (struct.unpack_from("<HHHH", body, 2 + 8 * k) for k in range(struct.unpack_from("<H", body)[0]))
                merged += [(r0, c0, r1, c1) for r0, r1, c0, c1 in ranges]
        yield name, cells, dates, merged, days


def _put(cells: dict, dates: set, at: tuple[int, int], value: object, date: bool) -> None:
    if value is None or value == "":
        return
    if isinstance(value, float) and value.is_integer() and not date:
        value = int(value)
    cells[at] = value
    if date and isinstance(value, int | float) and not isinstance(value, bool):
        dates.add(at)
