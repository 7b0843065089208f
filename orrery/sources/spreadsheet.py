"""Spreadsheets: cells of zipped XML and of older binary workbooks, merged cells, native tables, and tables found by layout."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from datetime import datetime, timedelta
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from orrery.operators.normalise import clean_names
from orrery.session import ship
from orrery.sources import compound, legacy_sheets
from orrery.sources.files import MAX_COLUMNS, MAX_GRID, MAX_ROWS, _contents

# Number formats of a workbook that are dates.
_DATE_FORMATS = {14, 15, 16, 17, 18, 19, 20, 21, 22, 45, 46, 47}
Grid = list[list[object]]
#: Names of workbooks.
PATTERN = "*.{xls,xlsx,xlsm}"


@dataclass
class Sheet:
    name: str
    grid: Grid
    tables: list[tuple[str, tuple[int, int, int, int]]]
    merged: list[tuple[int, int, int, int]] = field(default_factory=list)


def _name(e) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _place(ref: str) -> tuple[int, int]:
    """Row and column from 0 of a reference such as B3."""
    letters, digits = re.match(r"\$?([A-Z]+)\$?(\d+)", ref).groups()
    column = 0
    for ch in letters:
        column = column * 26 + ord(ch) - 64
    return int(digits) - 1, column - 1


def _area(ref: str) -> tuple[int, int, int, int]:
    first, _, last = ref.partition(":")
    return (*_place(first), *_place(last or first))


def _date(serial: float) -> str:
    at = datetime(1899, 12, 30) + timedelta(days=serial)
    return at.strftime("%Y-%m-%d") if at.time() == datetime.min.time() else at.strftime("%Y-%m-%d %H:%M:%S")


def workbook(raw: bytes) -> list[Sheet]:
    """Sheets with their cells (merged ones filled) and native tables, of which the binary kind has none; a file that is no workbook has no sheets."""
    if raw[:8] == compound.MAGIC:
        return [_legacy(*s) for s in legacy_sheets.sheets(raw, _DATE_FORMATS)]
    try:
        z = zipfile.ZipFile(io.BytesIO(raw))
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []
    names = set(z.namelist())
    xml = lambda p: ElementTree.fromstring(z.read(p)) if p in names else None
    shared = ["".join(t.text or "" for t in s.iter() if _name(t) == "t") for s in (xml("xl/sharedStrings.xml") or []) if _name(s) == "si"] if "xl/sharedStrings.xml" in names else []
    links = {r.get("Id"): r.get("Target") for r in xml("xl/_rels/workbook.xml.rels")} if "xl/_rels/workbook.xml.rels" in names else {}
    dated: list[bool] = []
    if (styles := xml("xl/styles.xml")) is not None:
        own = {int(f.get("numFmtId")): f.get("formatCode", "") for f in styles.iter() if _name(f) == "numFmt"}
        for group in (g for g in styles if _name(g) == "cellXfs"):
            for xf in group:
                i = int(xf.get("numFmtId", 0))
                dated.append(i in _DATE_FORMATS or bool(re.search(r"(?i)[ymd]", re.sub(r'"[^"]*"|\[[^\]]*\]', "", own.get(i, "")))))
    out = []
    for k, s in enumerate(e for e in book.iter() if _name(e) == "sheet"):
        rel = next((v for a, v in s.attrib.items() if a.endswith("}id")), None)
        target = links.get(rel, f"worksheets/sheet{k + 1}.xml").lstrip("/")
        path = target if target.startswith("xl/") else f"xl/{target}"
        if (root := xml(path)) is not None:
            out.append(Sheet(s.get("name", f"Sheet{k + 1}"), *_cells(root, shared, dated, z, path)))
    return out


def _checked(path: str, rows: int, cols: int) -> tuple[int, int]:
    if rows * cols > MAX_GRID:
        raise ValueError(f"{path}: a sheet of {rows} rows and {cols} columns is too large")
    return rows, cols


def _placed(root) -> Iterator[tuple[tuple[int, int], object]]:
    """Cells with their places; a row or cell that does not tell its own follows the one before."""
    row = -1
    for e in (e for e in root.iter() if _name(e) == "row"):
        row = int(e.get("r")) - 1 if e.get("r") else row + 1
        col = -1
        for c in (c for c in e if _name(c) == "c"):
            at = _place(c.get("r")) if c.get("r") else (row, col + 1)
            col = at[1]
            yield at, c


def _legacy(name: str, cells: dict, dates: set, ranges: list, days: int) -> Sheet:
    for at in dates:
        cells[at] = _date(cells[at] + days)
    grid, merged = _grid(cells, ranges, name)
    return Sheet(name, grid, [], merged)


def _grid(cells: dict[tuple[int, int], object], ranges: list[tuple[int, int, int, int]], path: str) -> tuple[Grid, list]:
    """The rows of a sheet with its merged ranges filled, and those that hold a value."""
    extent = lambda: [1 + max((k[i] for k in cells), default=-1) for i in (0, 1)]
    _checked(path, *(used := extent()))
    merged = []
    for r0, c0, r1, c1 in ranges:
        if (r0, c0) in cells:
            merged.append((r0, c0, r1, c1))
            for r in range(r0, min(r1 + 1, max(used[0], MAX_ROWS))):
                for c in range(c0, min(c1 + 1, max(used[1], MAX_COLUMNS))):
                    cells[r, c] = cells[r0, c0]
    rows, cols = _checked(path, *extent())
    return [[cells.get((r, c)) for c in range(cols)] for r in range(rows)], merged


def _cells(root, shared: list[str], dated: list[bool], z: zipfile.ZipFile, path: str) -> tuple[Grid, list, list]:
    cells: dict[tuple[int, int], object] = {}
    for at, c in _placed(root):
        kind, style = c.get("t", "n"), int(c.get("s", 0))
        value = next((v.text for v in c if _name(v) == "v"), None)
        if kind == "s" and value is not None:
            cells[at] = shared[int(value)]
        elif kind == "inlineStr":
            cells[at] = "".join(t.text or "" for t in c.iter() if _name(t) == "t")
        elif kind == "b" and value is not None:
            cells[at] = value == "1"
        elif kind == "n" and value is not None:
            number = float(value)
            cells[at] = _date(number) if style < len(dated) and dated[style] else int(number) if number.is_integer() else number
        elif value is not None:
            cells[at] = value
    grid, merged = _grid(cells, [_area(m.get("ref")) for m in root.iter() if _name(m) == "mergeCell"], path)
    folder, _, leaf = path.rpartition("/")
    tables, rels = [], f"{folder}/_rels/{leaf}.rels"
    if rels in z.namelist():
        for r in ElementTree.fromstring(z.read(rels)):
            if r.get("Type", "").endswith("/table"):
                target = r.get("Target", "").replace("..", "xl").lstrip("/")
                if target in z.namelist():
                    t = ElementTree.fromstring(z.read(target))
                    tables.append((t.get("displayName") or t.get("name") or "table", _area(t.get("ref"))))
    return grid, tables, merged


def _filled(row: list[object]) -> int:
    return sum(v is not None and v != "" for v in row)


def _text(v: object) -> bool:
    return isinstance(v, str) and bool(v.strip()) and not re.fullmatch(r"[-+]?[\d.,]+%?", v.strip())


def header_row(grid: Grid, rows: int = 10) -> int:
    """The row of the first few with the most filled cells plus the most texts; the first of equals."""
    return max(range(min(rows, len(grid))), key=lambda i: (_filled(grid[i]) + sum(map(_text, grid[i])), -i), default=0)


def composite_header(grid: Grid, first: int, count: int) -> list[str]:
    """Names from several header rows: the distinct texts of a column from above, joined."""
    width = max(map(len, grid[first : first + count]))
    names = []
    for c in range(width):
        parts = [str(grid[r][c]).strip() for r in range(first, first + count) if c < len(grid[r]) and grid[r][c] not in (None, "")]
        names.append(" ".join(dict.fromkeys(parts)))
    return names


def dense_table(grid: Grid) -> tuple[list[str], Grid] | None:
    """A wide sheet as one table: at least 4 rows and 10 columns, a run of header rows heavy in text, data until more than 3 sparse rows."""
    if len(grid) < 4 or max(map(len, grid), default=0) < 10:
        return None
    width = max(map(len, grid))
    heavy = lambda row: _filled(row) >= 0.5 * width and sum(map(_text, row)) >= 0.6 * max(1, _filled(row))
    first = next((i for i, r in enumerate(grid[:15]) if heavy(r)), None)
    if first is None:
        return None
    count = 1
    while first + count < len(grid) and count < 4 and heavy(grid[first + count]):
        count += 1
    data, sparse = [], 0
    for row in grid[first + count :]:
        sparse = sparse + 1 if _filled(row) < 0.1 * width else 0
        if sparse > 3:
            break
        data.append(row)
    data = [r for r in data if _filled(r)]
    return (composite_header(grid, first, count), data) if data else None


def blocks(grid: Grid, row_gap: int = 2, column_gap: int = 1, density: float = 0.25) -> list[tuple[int, int, int, int]]:
    """Rectangles of filled cells of at least 3 rows and 2 columns, with small gaps inside."""
    filled = [i for i, r in enumerate(grid) if _filled(r)]
    out = []
    for low, high in _runs(filled, row_gap):
        columns = [c for c in range(max(map(len, grid))) if any(c < len(grid[r]) and grid[r][c] not in (None, "") for r in range(low, high + 1))]
        for left, right in _runs(columns, column_gap):
            rows = [r for r in range(low, high + 1) if _filled(grid[r][left : right + 1]) >= density * (right - left + 1)]
            if len(rows) >= 3 and right - left >= 1:
                out.append((rows[0], left, rows[-1], right))
    return out


def _runs(places: list[int], gap: int) -> list[tuple[int, int]]:
    out: list[list[int]] = []
    for p in places:
        if out and p - out[-1][1] <= gap + 1:
            out[-1][1] = p
        else:
            out.append([p, p])
    return [tuple(x) for x in out]


def invoice_header(grid: Grid, rows: int = 30) -> int | None:
    """The header row of an invoice: distinct texts plus twice the rows with numbers below it, and hints for serial numbers."""
    best, top = None, 0.0
    for i, row in enumerate(grid[:rows]):
        texts = {str(v).strip().lower() for v in row if _text(v)}
        if len(texts) < 3:
            continue
        number = lambda r: sum(isinstance(v, (int, float)) and not isinstance(v, bool) for v in r) >= 2
        below = grid[i + 1 : i + 11]
        score = len(texts) + 2 * sum(map(number, below)) + 5 * any(re.match(r"(s\.?\s*no|sr\.?|item|no\.?)\b", t) for t in texts) + 3 * bool(below and number(below[0]))
        if score > top:
            best, top = i, score
    return best


def header_facts(grid: Grid, before: int) -> dict[str, str]:
    """Labels and values above a table: ``label: value`` in a cell or in neighbours."""
    facts = {}
    for row in grid[:before]:
        for c, v in enumerate(row):
            if isinstance(v, str) and ":" in v:
                label, _, value = v.partition(":")
                value = value.strip() or next((str(x) for x in row[c + 1 :] if x not in (None, "")), "")
                if label.strip() and value:
                    facts[label.strip().lower()] = value
    return facts


def tables_of(sheet: Sheet) -> list[tuple[str, str, list[str], Grid]]:
    """Tables of a sheet as (name, strategy, columns, rows): native ones, else a dense sheet, else blocks, an invoice, the full sheet."""
    cut = lambda a: [r[a[1] : a[3] + 1] for r in sheet.grid[a[0] : a[2] + 1]]
    if sheet.tables:
        return [(n, "native", [str(v or "") for v in cut(a)[0]], cut(a)[1:]) for n, a in sheet.tables]
    if (dense := dense_table(sheet.grid)) is not None:
        return [(sheet.name, "dense", *dense)]
    found = blocks(sheet.grid)
    if len(found) > 1:
        out = []
        for i, a in enumerate(found):
            part = cut(a)
            h = header_row(part)
            out.append((f"{sheet.name}_{i}", "block", [str(v or "") for v in part[h]], part[h + 1 :]))
        return out
    if (i := invoice_header(sheet.grid)) is not None:
        return [(sheet.name, "invoice", [str(v or "") for v in sheet.grid[i]], [r for r in sheet.grid[i + 1 :] if _filled(r)])]
    if not sheet.grid:
        return []
    h = header_row(sheet.grid)
    return [(sheet.name, "sheet", [str(v or "") for v in sheet.grid[h]], sheet.grid[h + 1 :])]


def _each_workbook(files: DataFrame, rows: Callable[[str, bytes], Iterator[tuple]], schema: str) -> DataFrame:
    """Rows of each workbook of ``files(path, content)``; one that cannot be read gives a row of its path and the ``error`` alone, and others are read."""
    ship(files.sparkSession)
    names = [c.split()[0] for c in schema.split(", ")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for p, raw in zip(frame["path"], frame["content"], strict=True):
                try:
                    got = [(*r, None) for r in rows(p, raw)]
                except Exception as broken:  # whatever is wrong with one file
                    got = [(p, *[None] * (len(names) - 2), f"{type(broken).__name__}: {broken}"[:200])]
                yield pd.DataFrame(got, columns=names, dtype=object)

    return files.select("path", "content").mapInPandas(run, schema)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet, row, col, value, error`` of every filled cell of the workbooks at a path."""

    def rows(p: str, raw: bytes) -> Iterator[tuple]:
        for s in workbook(raw):
            yield from ((p, s.name, r, c, str(v)) for r, row in enumerate(s.grid) for c, v in enumerate(row) if v is not None)

    return _each_workbook(_contents(spark, path, PATTERN), rows, "path string, sheet string, row long, col long, value string, error string")


def read_merges(spark: SparkSession, path: str) -> DataFrame:
    """``path, sheet, first_row, first_col, last_row, last_col, value, error`` of every merged range, however far it reaches.

    In grids a range is filled to MAX_ROWS and MAX_COLUMNS where its sheet's own
    cells do not reach further; a join on these bounds tells what lies beyond.
    """

    def rows(p: str, raw: bytes) -> Iterator[tuple]:
        for s in workbook(raw):
            yield from ((p, s.name, r0, c0, r1, c1, str(s.grid[r0][c0])) for r0, c0, r1, c1 in s.merged)

    return _each_workbook(_contents(spark, path, PATTERN), rows, "path string, sheet string, first_row long, first_col long, last_row long, last_col long, value string, error string")


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """:func:`tables` of the workbooks at a path."""
    return tables(_contents(spark, path, PATTERN))


def tables(files: DataFrame) -> DataFrame:
    """``path, table, strategy, row, cells, error`` with one map of clean column name to text a row, for the workbooks of ``files(path, content)``."""

    def rows(p: str, raw: bytes) -> Iterator[tuple]:
        for s in workbook(raw):
            for name, how, columns, body in tables_of(s):
                names = clean_names(columns)
                yield from ((p, name, how, i, {n: str(v) for n, v in zip(names, r, strict=False) if v not in (None, "")}) for i, r in enumerate(body))

    return _each_workbook(files, rows, "path string, table string, strategy string, row long, cells map<string,string>, error string")
