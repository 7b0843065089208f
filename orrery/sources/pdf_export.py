"""Writes small PDF files of text and ruled lines, for reports and for tests of the reader."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

#: Width of every character of the plain font, in thousandths of its size.
WIDTH = 500


@dataclass
class Page:
    """A page's runs ``(x, y, size, text)``, lines ``(x0, y0, x1, y1)`` and images ``(x, y, width, height)``."""

    runs: list[tuple[float, float, float, str]]
    lines: list[tuple[float, float, float, float]] = ()
    images: list[tuple[float, float, float, float]] = ()


def _escaped(text: str) -> bytes:
    return text.encode("cp1252", "replace").replace(b"\\", b"\\\\").replace(b"(", b"\\(").replace(b")", b"\\)")


def _content(page: Page, wide: bool) -> bytes:
    out = [b"q 0.5 w"]
    out += [b"%.2f %.2f m %.2f %.2f l S" % line for line in page.lines]
    out += [b"q %.2f 0 0 %.2f %.2f %.2f cm /I0 Do Q" % (w, h, x, y) for x, y, w, h in page.images]
    out.append(b"Q BT")
    for x, y, size, text in page.runs:
        said = b"<%s> Tj" % text.encode("utf-16-be").hex().encode() if wide else b"(%s) Tj" % _escaped(text)
        out.append(b"/F0 %.2f Tf 1 0 0 1 %.2f %.2f Tm " % (size, x, y) + said)
    return b"\n".join([*out, b"ET"])


def document(pages: list[Page], packed: bool = False, wide: bool = False) -> bytes:
    """A file of pages. ``packed`` puts objects into a compressed stream with a table of offsets in another, as newer files
    have them; ``wide`` writes two bytes a character with a map to Unicode, so any text of the basic plane can be said."""
    if wide:
        font = [b"<< /Type /Font /Subtype /Type0 /BaseFont /Own /Encoding /Identity-H /DescendantFonts [4 0 R] /ToUnicode 5 0 R >>", b"<< /Type /Font /Subtype /CIDFontType2 /BaseFont /Own /DW %d >>" % WIDTH]
        mapped = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange endcmap"
    else:
        widths = b" ".join([b"%d" % WIDTH] * 224)
        font, mapped = [b"<< /Type /Font /Subtype /Type1 /BaseFont /Own /Encoding /WinAnsiEncoding /FirstChar 32 /LastChar 255 /Widths [%s] >>" % widths, b"null"], b""
    bodies: dict[int, bytes] = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 3: font[0], 4: font[1]}
    streams = {5: (b"", mapped), 6: (b"/Type /XObject /Subtype /Image /Width 1 /Height 1 /ColorSpace /DeviceGray /BitsPerComponent 8", b"\0")}
    kids = []
    for i, page in enumerate(pages):
        at = 7 + 2 * i
        kids.append(b"%d 0 R" % at)
        bodies[at] = b"<< /Type /Page /Parent 2 0 R /Contents %d 0 R >>" % (at + 1)
        streams[at + 1] = (b"", _content(page, wide))
    bodies[2] = b"<< /Type /Pages /Count %d /MediaBox [0 0 612 792] /Resources << /Font << /F0 3 0 R >> /XObject << /I0 6 0 R >> >> /Kids [%s] >>" % (len(kids), b" ".join(kids))
    out, offsets = bytearray(b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"), {}

    def put(number: int, head: bytes, raw: bytes) -> None:
        offsets[number] = len(out)
        held = zlib.compress(raw)
        out.extend(b"%d 0 obj\n<< %s /Filter /FlateDecode /Length %d >>\nstream\n%s\nendstream\nendobj\n" % (number, head, len(held), held))

    for number, (head, raw) in streams.items():
        put(number, head, raw)
    top = max([*bodies, *streams]) + 1
    if not packed:
        for number, body in bodies.items():
            offsets[number] = len(out)
            out += b"%d 0 obj\n%s\nendobj\n" % (number, body)
        start = len(out)
        out += b"xref\n0 %d\n0000000000 65535 f \n" % top + b"".join(b"%010d 00000 n \n" % offsets[k] for k in range(1, top))
        return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (top, start))
    index, said = b"", b""
    for number, body in bodies.items():
        index += b"%d %d " % (number, len(said))
        said += body + b" "
    put(top, b"/Type /ObjStm /N %d /First %d" % (len(bodies), len(index)), index + said)
    inside = {number: i for i, number in enumerate(bodies)}
    rows, above = b"", bytes(7)
    for k in range(top + 1):
        row = bytes(7) if not k else b"\2" + top.to_bytes(4, "big") + inside[k].to_bytes(2, "big") if k in inside else b"\1" + offsets[k].to_bytes(4, "big") + bytes(2)
        rows += b"\2" + bytes((a - b) & 255 for a, b in zip(row, above, strict=True))
        above = row
    start = len(out)
    put(top + 1, b"/Type /XRef /Size %d /W [1 4 2] /Root 1 0 R /DecodeParms << /Predictor 12 /Columns 7 >>" % (top + 1), rows)
    return bytes(out + b"startxref\n%d\n%%%%EOF\n" % start)


def table_page(title: str, names: list[str], rows: list[list[str]], ruled: bool, size: float = 8.0) -> Page:
    """A page with a title and a table below it, with lines around each cell or with its columns aligned only."""
    wide = 520 / len(names)
    step = min(15.0, 680 / (len(rows) + 1))
    runs = [(40.0, 750.0, 12.0, title)]
    for i, row in enumerate([names, *rows]):
        runs += [(43 + j * wide, 720 - i * step - 0.75 * step, size, cell) for j, cell in enumerate(row)]
    bottom = 720 - (len(rows) + 1) * step
    lines = [(40, 720 - i * step, 560, 720 - i * step) for i in range(len(rows) + 2)] + [(40 + j * wide, bottom, 40 + j * wide, 720) for j in range(len(names) + 1)]
    return Page(runs, lines if ruled else [])
