"""PDF files made by the writer and by hand: texts, tables, and files that are broken."""

from __future__ import annotations

import zlib

import pytest

from orrery.sources import pdf, pdf_marks
from orrery.sources.pdf_export import Page, document, table_page

MERGED = Page(
    [(45, 705, 8, "Head"), (145, 705, 8, "One"), (245, 705, 8, "Two"), (45, 685, 8, "a"), (145, 685, 8, "over both"), (45, 665, 8, "b"), (145, 665, 8, "x"), (245, 665, 8, "y"), (60, 400, 8, "a line with some words that is no table at all")],
    [(40, 720, 340, 720), (40, 700, 340, 700), (40, 680, 340, 680), (40, 660, 340, 660), (40, 660, 40, 720), (140, 660, 140, 720), (340, 660, 340, 720), (240, 700, 240, 720), (240, 660, 240, 680)],
)


def by_hand(content: bytes, extra: bytes = b"", trailer: bytes = b"") -> bytes:
    """A file without a table of offsets, whose stream has no right length."""
    return (
        b"%PDF-1.4\n1 0 obj <</Type/Catalog/Pages 2 0 R>> endobj 2 0 obj <</Type/Pages/Kids[3 0 R]/Count 1>> endobj\n"
        b"3 0 obj <</Type/Page/MediaBox[0 0 200 200]/Contents 4 0 R/Resources<</Font<</F 5 0 R>>/XObject<</X 6 0 R>>>>>> endobj\n"
        b"4 0 obj <</Length 3>> stream\n" + content + b"\nendstream endobj\n5 0 obj <</Type/Font/BaseFont/Courier/Encoding<</Differences[65/alpha/B 67/comma/uni00E9]>>>> endobj\n" + extra + b"trailer <</Root 1 0 R " + trailer + b">>"
    )


def said(data: bytes) -> list[str]:
    return [m[7] for m in pdf_marks.marks(data) if m[1] == "text"]


@pytest.mark.parametrize(("packed", "wide"), [(False, False), (True, False), (False, True), (True, True)])
def test_marks_are_what_was_written(packed, wide):
    pages = [Page([(10, 700, 10, r"a (nested (one)) \ é"), (10, 650, 12, "second")], [(0, 5, 100, 5), (7, 0, 7, 90)]), Page([], (), [(0, 0, 612, 700)]), Page([(1, 1, 8, "日本")] if wide else [(1, 1, 8, "x")])]
    got = pdf_marks.marks(document(pages, packed, wide))
    runs = [(m[0], m[2], m[3], m[6], m[7]) for m in got if m[1] == "text"]
    assert runs == [(i + 1, x, y, s, t) for i, p in enumerate(pages) for x, y, s, t in p.runs]
    assert [(m[1], *m[2:6]) for m in got if m[1] in "hv"] == [("h", 0, 5, 100, 5), ("v", 7, 0, 7, 90)]
    assert [(m[0], *m[2:6]) for m in got if m[1] == "image"] == [(2, 0, 0, 612, 700)] and sum(m[1] == "page" for m in got) == 3


def test_operators_by_hand():
    content = rb"BT /F 10 Tf 20 TL 1 0 0 1 5 100 Tm [(B) -50 (A) -400 (B\103\104)] TJ T* (\050x\\y\)) Tj (next) ' 3 0 Td <42 4> Tj ET 2 0 0 2 10 20 cm 5 5 40 30 re S BI /W 1 ID \x00(( EI Q Q /X Do"
    form = b"6 0 obj <</Subtype/Form/Matrix[1 0 0 1 3 0]/Filter/FlateDecode>> stream\n" + zlib.compress(b"BT /F 5 Tf 1 1 Td (in a form) Tj ET") + b"\nendstream endobj\n"
    data = by_hand(content, form)
    assert said(data)[:3] == ["B� B,é", "(x\\y)", "next"] and said(data)[-1] == "in a form"
    got = pdf_marks.marks(data)
    assert [m[2:6] for m in got if m[1] == "h"] == [(20, 30, 100, 30), (20, 90, 100, 90)] and [m[2:6] for m in got if m[1] == "v"] == [(20, 30, 20, 90), (100, 30, 100, 90)]
    form = next(m for m in got if m[7] == "in a form")
    assert form[2:4] == (10 + 2 * (3 + 1), 22) and form[6] == 10


def test_broken_files_give_an_error_row(spark):
    whole = document([table_page("t", ["a", "b"], [["1", "2"]] * 3, True)])
    locked = by_hand(b"BT ET", trailer=b"/Encrypt 9 0 R")
    rows = [("whole", whole), ("none", None), ("empty", b""), ("text", b"hello"), ("half", whole[: len(whole) // 3]), ("locked", locked), ("head", b"%PDF-1.4")]
    frame = spark.createDataFrame([(p, None if c is None else bytearray(c), 1) for p, c in rows], "path string, content binary, page int")
    got = {r.path: r for r in pdf.page_texts(pdf.page_marks(frame)).collect()}
    assert got["whole"].text.startswith("t\na b\n1 2") and got["whole"].error is None
    assert all(got[p].error and got[p].text is None for p, _ in rows[1:]) and "encrypted" in got["locked"].error
    assert pdf.page_texts(pdf.page_marks(frame.limit(0))).count() == 0


def test_tables_and_the_gate(spark, tmp_path):
    plain = Page([(50, 700 - 20 * i, 10, "only a paragraph of words here, on one line") for i in range(6)])
    two = table_page("Both", ["Name", "Name", ""], [[f"n{i}", f"m{i}", f"k{i}"] for i in range(4)], True)
    lower = table_page("", ["p", "q"], [["1", "2"], ["3", "4"], ["5", "6"]], True)
    both = Page(two.runs + [(x, y - 300, s, t) for x, y, s, t in lower.runs[1:]], two.lines + [(a, b - 300, c, d - 300) for a, b, c, d in lower.lines])
    image = Page([(50, 50, 8, "a few words under a picture of the page")], (), [(0, 60, 612, 732)])
    (tmp_path / "sub").mkdir()
    for name, data in {"a.pdf": document([plain, both, image]), "sub/b.pdf": document([MERGED], packed=True), "no.txt": b"x"}.items():
        (tmp_path / name).write_bytes(data)
    found = pdf.page_marks(pdf.files_below(spark, str(tmp_path)))
    texts = {(r.path.rsplit("/", 1)[1], r.page): r for r in pdf.page_texts(found).collect()}
    assert [texts["a.pdf", p].needs_ocr for p in (1, 2, 3)] == [False, True, True] or [texts["a.pdf", p].needs_ocr for p in (1, 2, 3)] == [False, False, True]
    assert texts["a.pdf", 3].image_share == pytest.approx(732 / 792)
    rows = [(r.path.rsplit("/", 1)[1], r.page, r.table, r.row, r.cells) for r in pdf.page_tables(found).orderBy("path", "page", "table", "row").collect()]
    want = [("a.pdf", 2, 0, i, {"name": f"n{i}", "name_1": f"m{i}", "col_2": f"k{i}"}) for i in range(4)] + [("a.pdf", 2, 1, i, {"p": str(2 * i + 1), "q": str(2 * i + 2)}) for i in range(3)]
    want += [("b.pdf", 1, 0, 0, {"head": "a", "one": "over both"}), ("b.pdf", 1, 0, 1, {"head": "b", "one": "x", "two": "y"})]
    assert [r for r in rows if r[0] == "b.pdf"] == want[-2:] and [r for r in rows if r[0] == "a.pdf"] == want[:-2]


def test_files_are_dealt_out_by_number_and_maps_of_all_codes_are_not_written_out(spark):
    """Small files go to all cores; a font's range over all codes is read code by code, later maps before earlier ones."""
    data = document([table_page("t", ["a", "b"], [["1", "2"]] * 3, True)], wide=True)
    frame = spark.createDataFrame([(f"{i}", bytearray(data)) for i in range(64)], "path string, content binary").coalesce(1)
    found = pdf.page_marks(frame)
    assert found.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism and found.select("path").distinct().count() == 64
    maps, size = pdf_marks._to_unicode(b"1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfrange <0000> <FFFF> <0000> <0003> <0004> [<0058> <0059005A>] endbfrange 1 beginbfchar <0041> <0062> endbfchar")
    font = pdf_marks.Font(size, {}, {}, 500.0, maps)
    assert len(maps) == 3 and font.read(bytes.fromhex("00410003000400420005")) == [("b", 500.0), ("X", 500.0), ("YZ", 500.0), ("B", 500.0), ("\x05", 500.0)]
