"""Sinks that are single files: a workbook with a sheet for each table, and bytes under any path that Spark knows."""

from __future__ import annotations

import datetime as dt
import io
import zipfile
from collections.abc import Iterable
from decimal import Decimal
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession

#: Rows of a sheet, its header among them: what the format allows, and so what the driver ever holds of one.
MAX_SHEET = 1_048_576
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"


def put(spark: SparkSession, path: str, raw: bytes) -> None:
    """Writes a file, over one of that name."""
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    out = target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).create(target, True)
    try:
        out.write(bytearray(raw))
    finally:
        out.close()


def column_letters(i: int) -> str:
    """The name of column ``i``, from 0: A to Z, then AA."""
    out, i = "", i + 1
    while i:
        i, rest = divmod(i - 1, 26)
        out = chr(65 + rest) + out
    return out


def _cell(row: int, column: int, value: object) -> str:
    at = f"{column_letters(column)}{row}"
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, (int, float, Decimal)):
        return f'<c r="{at}"><v>{value}</v></c>'
    text = value.isoformat() if isinstance(value, (dt.date, dt.datetime)) else str(value)
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


def workbook(sheets: dict[str, tuple[list[str], Iterable[tuple]]]) -> bytes:
    """The bytes of a workbook of named sheets, each with a header and rows; nulls are empty cells."""
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED) as z:
        names = [f'<sheet name="{escape(name[:31], {chr(34): "&quot;"})}" sheetId="{i}" r:id="rId{i}"/>' for i, name in enumerate(sheets, 1)]
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{"".join(names)}</sheets></workbook>')
        links = [f'<Relationship Id="rId{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1)]
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{"".join(links)}</Relationships>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="rId1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        kinds = [f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1)]
        z.writestr("[Content_Types].xml", '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>' + "".join(kinds) + "</Types>")
        for i, (columns, rows) in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as out:
                out.write(f'<worksheet xmlns="{_MAIN}"><sheetData>'.encode())
                for k, row in enumerate([columns, *rows], 1):
                    cells = "".join(_cell(k, j, v) for j, v in enumerate(row) if v is not None)
                    out.write(f'<row r="{k}">{cells}</row>'.encode())
                out.write(b"</sheetData></worksheet>")
    return raw.getvalue()


def export_workbook(spark: SparkSession, path: str, tables: dict[str, DataFrame]) -> None:
    """One workbook with a sheet for each table, in order; a table of more rows than a sheet can have is an error."""
    sheets = {}
    for name, frame in tables.items():
        rows = [tuple(r) for r in frame.limit(MAX_SHEET).toLocalIterator()]
        if len(rows) >= MAX_SHEET:
            raise ValueError(f"{name}: more than {MAX_SHEET - 1} rows do not fit a sheet")
        sheets[name] = (frame.columns, rows)
    put(spark, path, workbook(sheets))
