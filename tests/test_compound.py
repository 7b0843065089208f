"""Compound files: round trips through every kind of chain, messages, older workbooks, and broken ones."""

from __future__ import annotations

import random
import struct
from datetime import UTC, date, datetime

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from orrery.sources import compound, compound_export, files, legacy_sheets, spreadsheet

_SENT = datetime(2024, 2, 29, 12, 30, tzinfo=UTC)


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.sampled_from(["a", "b", "long name", "s/x", "s/y", "s/t/z", "Ü"]), st.integers(0, 9000)))
def test_streams_come_back(sizes):
    parts = {p: random.Random(n).randbytes(n) for p, n in sizes.items()}
    assert compound.streams(compound_export.container(parts)) == parts


def test_a_stream_whose_sectors_fill_more_than_the_header_lists():
    """Over 109 sectors of sector numbers, some seven million bytes."""
    parts = {"big": random.Random(1).randbytes(16_000_001), "small": b"x" * 70}
    raw = compound_export.container(parts)
    assert struct.unpack_from("<I", raw, 72)[0] == 2
    assert compound.streams(raw) == parts


def test_broken_files_are_errors_and_end():
    """Cut anywhere, with chains and directories that run in circles, or with any bytes changed, a file is read or refused."""
    raw = compound_export.message(("A", "a@x"), [(1, "B", "b@x")], "s", _SENT, "body " * 2000)
    r = random.Random(2)
    cases = [raw[:n] for n in range(0, len(raw), 509)] + [b"", b"PK", raw[:8]]
    for _ in range(300):
        bad = bytearray(raw)
        for _ in range(r.randint(1, 20)):
            bad[r.randrange(8, len(bad))] = r.choice([0, 1, 2, 255, r.randrange(256)])
        cases.append(bytes(bad))
    refused = 0
    for bad in cases:
        rows = files.mail_pages(bad) if bad[:8] == compound.MAGIC else []
        refused += any(row[-1] is not None for row in rows)
    assert refused > 20


def test_messages(spark):
    """Recipients by kind, HTML bodies, pages, no body, a broken file, and mail of the other kind beside them."""
    people = [(2, "Cc", "c@x.org"), (1, "Zoë", "z@x.org"), (3, "Blind", "b@x.org"), (1, "", "y@x.org")]
    plain = compound_export.message(("Ann", "a@x.org"), people, "Größe", _SENT, " w" * 1500 + "\n", ["a.pdf", "b.txt"])
    html = compound_export.message(("", "a@x.org"), [], "", _SENT, "<style>p {}</style><p>one</p><p>two</p>", html=True)
    none = compound_export.message(("Ann", ""), [], "s", _SENT, "")
    eml = b"From: e@x.org\nTo: t@x.org\nSubject: old\n\nhi\n"
    other = compound_export.workbook({"S": [["a"]]})
    rows = [("p", plain), ("h", html), ("n", none), ("e", eml), ("b", plain[:900]), ("o", other)]
    got = {(r.path, r.page): r for r in files.mail(spark.createDataFrame(rows, "path string, content binary")).collect()}
    assert set(got) == {("p", 0), ("p", 1), ("h", 0), ("n", 0), ("e", 0), ("b", None), ("o", None)}
    p = got["p", 0]
    assert (p.sender, p.recipients, p.subject, p.date) == ("Ann <a@x.org>", ["Zoë <z@x.org>", "y@x.org", "Cc <c@x.org>"], "Größe", "Thu, 29 Feb 2024 12:30:00 +0000")
    assert len(p.text) == 2000 and len(got["p", 1].text) == 999 and p.attachments == ["a.pdf", "b.txt"] and p.error is None
    assert (got["h", 0].text, got["h", 0].sender) == ("one two", "a@x.org")
    assert (got["n", 0].text, got["n", 0].sender, got["e", 0].subject) == ("", "Ann", "old")
    assert got["b", None].error and "no message" in got["o", None].error


def _record(kind, body):
    return struct.pack("<HH", kind, len(body)) + body


def test_workbooks_with_every_kind_of_cell(spark):
    grid = [["Name", "Größe", "When", "Done"], ["a", 3, date(2024, 2, 29), True], ["b", 2.5, None, False], ["c", -7, date(1999, 12, 31), None], ["d", 1 << 40, None, None]]
    raw = compound_export.workbook({"First": grid, "Второй": [["x" * 9000, "я" * 9000, "z"]], "Merged": [["top", None], [None, None], ["a", "b"]]}, {"Merged": [(0, 0, 1, 1)]})
    first, second, merged = spreadsheet.workbook(raw)
    assert (first.name, second.name) == ("First", "Второй")
    assert first.grid == [grid[0], ["a", 3, "2024-02-29", True], ["b", 2.5, None, False], ["c", -7, "1999-12-31", None], ["d", 1 << 40, None, None]]
    assert second.grid == [["x" * 9000, "я" * 9000, "z"]]
    assert merged.grid == [["top", "top"], ["top", "top"], ["a", "b"]] and merged.merged == [(0, 0, 1, 1)]
    rows = spreadsheet.tables(spark.createDataFrame([("a.xls", raw), ("b.xls", raw[:3000])], "path string, content binary")).collect()
    assert sum(r.error is not None for r in rows) == 1
    assert next(r.cells for r in rows if r.table == "First" and r.row == 0)["name"] == "a"


def test_cells_that_the_writer_does_not_make():
    """Runs of short numbers, hundredths, formulas with texts, truths and errors, labels, days since 1904, formats of a file's own."""
    at = lambda r, c, s=0: struct.pack("<HHH", r, c, s)
    own = _record(legacy_sheets.FORMAT, struct.pack("<HHB", 164, 8, 0) + b"yyyy\\-mm") + b"".join(_record(legacy_sheets.STYLE, struct.pack("<HH16x", 0, n)) for n in (0, 164))
    body = _record(legacy_sheets.BOF, bytes(16))
    body += _record(legacy_sheets.SHORTS, struct.pack("<HHHIHIHIH", 0, 0, 0, 500 << 2 | 3, 0, (-4 << 2 & 0xFFFFFFFF) | 2, 1, 60 << 2 | 2, 2))
    body += _record(legacy_sheets.FORMULA, at(1, 0) + struct.pack("<d", 1.5) + bytes(8)) + _record(legacy_sheets.FORMULA, at(1, 1) + b"\0\0\0\0\0\0\xff\xff" + bytes(8))
    body += _record(legacy_sheets.RESULT, struct.pack("<HB", 3, 0) + b"sum") + _record(legacy_sheets.FORMULA, at(1, 2) + b"\1\0\1\0\0\0\xff\xff" + bytes(8)) + _record(legacy_sheets.FORMULA, at(1, 3) + b"\2\0\x07\0\0\0\xff\xff" + bytes(8))
    body += _record(legacy_sheets.LABEL, at(2, 0) + struct.pack("<HB", 2, 0) + b"ab") + _record(legacy_sheets.TRUTH, at(2, 1) + b"\x2a\1") + _record(legacy_sheets.EOF, b"")
    head = _record(legacy_sheets.BOF, bytes(16)) + own + _record(legacy_sheets.EPOCH_1904, b"\1\0")
    sheet = lambda start: _record(legacy_sheets.SHEET, struct.pack("<IBBBB", start, 0, 0, 1, 0) + b"S")
    start = len(head) + len(sheet(0)) + 4
    make = lambda data: compound_export.container({"Workbook": data})
    (got,) = spreadsheet.workbook(make(head + sheet(start) + _record(legacy_sheets.EOF, b"") + body))
    assert got.grid == [[5, -4, "1904-03-01", None], [1.5, "sum", True, "#DIV/0!"], ["ab", "#N/A", None, None]]
    for broken in (compound_export.container({"Book": b""}), compound_export.container({}), make(b""), make(_record(legacy_sheets.ENCRYPTED, b"\0\0") + head)):
        with pytest.raises(ValueError):
            spreadsheet.workbook(broken)
