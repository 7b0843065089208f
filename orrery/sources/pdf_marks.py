"""What stands on the pages of one PDF file: runs of text with their places, ruled lines, and the share that images cover.

A small helper of :mod:`orrery.sources.pdf`, which does lines, cells and tables
as DataFrames. Objects are found by reading through the file, not by its table
of offsets, so files with a broken one are read as well. Encrypted files are an
error.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass, field

Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)

# numbers, words and all else have a group each
_TOKEN = re.compile(rb"[\x00\t\n\x0c\r ]*(?:%[^\r\n]*[\x00\t\n\x0c\r ]*)*(?:([+-]?(?:\d+\.?\d*|\.\d+)(?=[\x00\t\n\x0c\r ()<>\[\]{}/%]|$))|([^\x00\t\n\x0c\r ()<>\[\]{}/%]+)|(<<|>>|\[|\]|\(|<[0-9A-Fa-f\s]*>|/[^\x00\t\n\x0c\r ()<>\[\]{}/%]*|[{}>]))")
_OBJECT = re.compile(rb"(\d+)[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+obj\b")
_SPECIAL, _OCTAL = re.compile(rb"[()\\]"), re.compile(rb"[0-7]{1,3}")
_REF = re.compile(rb"[\x00\t\n\x0c\r ]+(\d+)[\x00\t\n\x0c\r ]+R(?![A-Za-z])")
# Escapes within strings, and names of characters that fonts use for marks.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
_GLYPHS = {
    "space": " ", "exclam": "!", "quotedbl": '"', "numbersign": "#", "dollar": "$", "percent": "%", "ampersand": "&", "quotesingle": "'", "parenleft": "(", "parenright": ")",
    "asterisk": "*", "plus": "+", "comma": ",", "hyphen": "-", "period": ".", "slash": "/", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5",
    "six": "6", "seven": "7", "eight": "8", "nine": "9", "colon": ":", "semicolon": ";", "less": "<", "equal": "=", "greater": ">", "question": "?", "at": "@",
    "bracketleft": "[", "backslash": "\\", "bracketright": "]", "underscore": "_", "quoteleft": "‘", "quoteright": "’", "quotedblleft": "“", "quotedblright": "”",
    "endash": "–", "emdash": "—", "bullet": "•", "Euro": "€", "fi": "fi", "fl": "fl",
}


@dataclass(frozen=True)
class Ref:
    number: int


@dataclass
class Stream:
    head: dict
    raw: bytes


class Word(str):
    """An operator or keyword, not a name or a string."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A string in brackets from behind its first one: they nest, and a backslash escapes."""
    out, depth = bytearray(), 1
    while m := _SPECIAL.search(data, at):
        out += data[at : m.start()]
        c, at = m[0], m.end()
        if c == b"\\":
            octal = _OCTAL.match(data, at)
            if octal:
                out.append(int(octal[0], 8) & 255)
                at = octal.end()
                continue
            c = data[at : at + 1]
            at += 2 if data[at : at + 2] == b"\r\n" else 1
            out += b"" if c in b"\r\n" else _ESCAPES.get(c, c)
            continue
        depth += (c == b"(") - (c == b")")
        if not depth:
            break
        out += c
    return bytes(out), at


def value(data: bytes, at: int):
    """The value that begins at a place and the place behind it; None at the end. Names are text with a slash, strings bytes."""
    if not (m := _TOKEN.match(data, at)):
        return None, len(data)
    token, at, kind = m[m.lastindex], m.end(), m.lastindex
    if kind == 1:
        if token.isdigit() and (r := _REF.match(data, at)):
            return Ref(int(token)), r.end()
        return float(token), at
    if kind == 2:
        return Word(token.decode("latin-1")), at
    if token == b"(":
        return _string(data, at)
    if token == b"<<" or token == b"[":
        close, items = (">>" if token == b"<<" else "]"), []
        while True:
            item, at = value(data, at)
            if item is None or (isinstance(item, Word) and item == close):
                break
            items.append(item)
        if close == "]":
            return items, at
        return {k: v for k, v in zip(items[::2], items[1::2], strict=False) if isinstance(k, str)}, at
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), at
    if token[:1] == b"/":
        return re.sub(rb"#([0-9A-Fa-f]{2})", lambda h: bytes.fromhex(h[1].decode()), token).decode("latin-1"), at
    return Word(token.decode("latin-1")), at


def times(a: Matrix, b: Matrix) -> Matrix:
    return (a[0] * b[0] + a[1] * b[2], a[0] * b[1] + a[1] * b[3], a[2] * b[0] + a[3] * b[2], a[2] * b[1] + a[3] * b[3], a[4] * b[0] + a[5] * b[2] + b[4], a[4] * b[1] + a[5] * b[3] + b[5])


def point(m: Matrix, x: float, y: float) -> tuple[float, float]:
    return m[0] * x + m[2] * y + m[4], m[1] * x + m[3] * y + m[5]


class File:
    """The objects of a file by number; later ones of a number take the place of earlier ones."""

    def __init__(self, data: bytes) -> None:
        if b"%PDF-" not in data[:1024]:
            raise ValueError("not a PDF file")
        self.objects: dict[int, object] = {}
        self.fonts: dict[int, Font] = {}
        at, late = 0, []
        while m := _OBJECT.search(data, at):
            item, at = value(data, m.end())
            body = re.compile(rb"[\x00\t\n\x0c\r ]*stream\r?\n").match(data, at) if isinstance(item, dict) else None
            if body:
                end = self._end(data, body.end(), item.get("/Length"))
                item, at = Stream(item, data[body.end() : end]), end
                late += [item] if item.head.get("/Type") == "/ObjStm" else []
            self.objects[int(m[1])] = item
        trailers = [value(data, m.end())[0] for m in re.finditer(rb"\btrailer\b", data)] + [o.head for o in self.objects.values() if isinstance(o, Stream) and o.head.get("/Type") == "/XRef"]
        if any(isinstance(t, dict) and "/Encrypt" in t for t in trailers):
            raise ValueError("encrypted")
        for s in late:
            raw, n = self.bytes(s), int(self.get(s.head.get("/N")) or 0)
            first, place, numbers = int(self.get(s.head.get("/First")) or 0), 0, []
            for _ in range(2 * n):
                x, place = value(raw, place)
                numbers.append(int(x))
            for number, offset in zip(numbers[::2], numbers[1::2], strict=True):
                self.objects.setdefault(number, value(raw, first + offset)[0])
        roots = [t["/Root"] for t in trailers if isinstance(t, dict) and "/Root" in t]
        self.root = self.get(roots[-1]) if roots else next((o for o in self.objects.values() if isinstance(o, dict) and o.get("/Type") == "/Catalog"), None)

    def _end(self, data: bytes, start: int, length: object) -> int:
        """Where a stream ends: by its length if that is right, else by the next end mark."""
        if isinstance(length, float) and re.compile(rb"\s*endstream").match(data, start + int(length)):
            return start + int(length)
        end = data.find(b"endstream", start)
        if end < 0:
            raise ValueError("a stream without an end")
        return end - (2 if data[end - 2 : end] == b"\r\n" else data[end - 1 : end] in (b"\n", b"\r"))

    def get(self, item: object):
        """What a reference stands for, through at most sixteen others."""
        for _ in range(16):
            if not isinstance(item, Ref):
                return item
            item = self.objects.get(item.number)
        return None

    def bytes(self, stream: Stream) -> bytes:
        """A stream's contents; filters other than Flate (images) give none."""
        raw, filters, parms = stream.raw, self.get(stream.head.get("/Filter")), self.get(stream.head.get("/DecodeParms"))
        filters = filters if isinstance(filters, list) else [filters] if filters else []
        parms = parms if isinstance(parms, list) else [parms] * len(filters)
        for name, parm in zip(filters, parms, strict=False):
            if self.get(name) not in ("/FlateDecode", "/Fl"):
                return b""
            raw = zlib.decompressobj().decompress(raw)
            parm = self.get(parm) or {}
            if (self.get(parm.get("/Predictor")) or 1) >= 10:
                raw = _unpredicted(raw, int(self.get(parm.get("/Columns")) or 1))
        return raw

    def pages(self) -> list[dict]:
        """Pages in order, with what they inherit."""
        out, seen = [], set()

        def walk(item: object, given: dict) -> None:
            if isinstance(item, Ref):
                if item.number in seen:
                    return
                seen.add(item.number)
            node = self.get(item)
            if not isinstance(node, dict):
                return
            own = given | {k: node[k] for k in ("/Resources", "/MediaBox") if k in node}
            kids = self.get(node.get("/Kids"))
            if isinstance(kids, list):
                for kid in kids:
                    walk(kid, own)
            else:
                out.append(node | own)

        walk(self.root.get("/Pages") if isinstance(self.root, dict) else None, {})
        return out or [o for _, o in sorted(self.objects.items()) if isinstance(o, dict) and o.get("/Type") == "/Page"]


def _unpredicted(raw: bytes, columns: int) -> bytes:
    """Rows of bytes that were written as differences to the row above or the byte before."""
    out, above = bytearray(), bytearray(columns)
    for at in range(0, len(raw) - columns, columns + 1):
        row = bytearray(raw[at + 1 : at + 1 + columns])
        for i in range(columns):
            left = row[i - 1] if i else 0
            row[i] = (row[i] + (left if raw[at] == 1 else above[i] if raw[at] == 2 else (left + above[i]) // 2 if raw[at] == 3 else 0)) & 255
        out += row
        above = row
    return bytes(out)


@dataclass
class Font:
    """How a font's codes read and how wide they are, in thousandths of its size."""

    bytes_each: int = 1
    text: dict[int, str] = field(default_factory=dict)
    widths: dict[int, float] = field(default_factory=dict)
    width: float = 500.0
    maps: list[dict | tuple] = field(default_factory=list)
    known: dict[int, tuple[str, float]] = field(default_factory=dict)

    def read(self, raw: bytes) -> list[tuple[str, float]]:
        n = self.bytes_each
        codes = raw if n == 1 else [int.from_bytes(raw[i : i + n], "big") for i in range(0, len(raw) - n + 1, n)]
        return [self.known.get(c) or self._said(c) for c in codes]

    def _said(self, code: int) -> tuple[str, float]:
        """A code's text and width, by the last map that has it."""
        text = next((s for m in reversed(self.maps) if (s := _mapped(m, code)) is not None), None)
        if text is None:
            text = self.text.get(code, bytes([code]).decode("cp1252", "replace") if self.bytes_each == 1 else "�")
        self.known[code] = text, self.widths.get(code, self.width)
        return self.known[code]


def _mapped(given: dict | tuple, code: int) -> str | None:
    """A code's text by single codes or by a range ``(first, last, to)``, which is not written out, as it may hold all codes."""
    if isinstance(given, dict):
        return given.get(code)
    first, last, to = given
    if not first <= code <= last:
        return None
    k = code - first
    raw = (to[k] if k < len(to) else b"") if isinstance(to, list) else (int.from_bytes(to, "big") + k).to_bytes(len(to) + 1, "big")[-len(to) :] if to else b""
    return raw.decode("utf-16-be", "replace") if isinstance(raw, bytes) else ""


def _to_unicode(data: bytes) -> tuple[list[dict | tuple], int]:
    """What a font's map tells of the text of codes, in order, and the bytes of a code."""
    out, size, at, held = [], 1, 0, []
    number = lambda b: int.from_bytes(b, "big")
    text = lambda b: b.decode("utf-16-be", "replace")
    while True:
        item, at = value(data, at)
        if item is None:
            return out, size
        if not isinstance(item, Word):
            held.append(item)
            continue
        if item == "endcodespacerange":
            size = max([len(b) for b in held if isinstance(b, bytes)], default=1)
        elif item == "endbfchar":
            out.append({number(a): text(b) for a, b in zip(held[::2], held[1::2], strict=False) if isinstance(a, bytes) and isinstance(b, bytes)})
        elif item == "endbfrange":
            out += [(number(a), min(number(b), number(a) + 65_535), to if isinstance(to, bytes | list) else b"") for a, b, to in zip(held[::3], held[1::3], held[2::3], strict=False)]
        held = []


def _font(file: File, item: object) -> Font:
    """A font, read once a file where it is an object of its own."""
    if not isinstance(item, Ref):
        return _read_font(file, item)
    if item.number not in file.fonts:
        file.fonts[item.number] = _read_font(file, item)
    return file.fonts[item.number]


def _read_font(file: File, item: object) -> Font:
    head, font = file.get(item), Font()
    if not isinstance(head, dict):
        return font
    first, widths = file.get(head.get("/FirstChar")), file.get(head.get("/Widths"))
    if isinstance(widths, list):
        font.widths = {int(first or 0) + i: file.get(w) for i, w in enumerate(widths) if isinstance(file.get(w), float)}
    elif "Courier" in str(head.get("/BaseFont")):
        font.width = 600.0
    below = file.get(head.get("/DescendantFonts"))
    if isinstance(below, list) and isinstance(cid := file.get(below[0]), dict):
        font.bytes_each, font.width = 2, file.get(cid.get("/DW")) or 1000.0
        listed, i = file.get(cid.get("/W")) or [], 0
        while i + 1 < len(listed):
            start, then = int(file.get(listed[i])), file.get(listed[i + 1])
            if isinstance(then, list):
                font.widths |= {start + k: file.get(w) for k, w in enumerate(then)}
                i += 2
            elif i + 2 < len(listed):
                font.widths |= dict.fromkeys(range(start, int(then) + 1), file.get(listed[i + 2]))
                i += 3
            else:
                break
    encoding, code = file.get(head.get("/Encoding")), 0
    for x in (file.get(encoding.get("/Differences")) or []) if isinstance(encoding, dict) else []:
        if isinstance(x, float):
            code = int(x)
        else:
            name = str(x)[1:]
            hexed = re.fullmatch(r"uni([0-9A-F]{4})", name)
            font.text[code] = name if len(name) == 1 else chr(int(hexed[1], 16)) if hexed else _GLYPHS.get(name, "�")
            code += 1
    if isinstance(mapped := file.get(head.get("/ToUnicode")), Stream):
        font.maps, size = _to_unicode(file.bytes(mapped))
        font.bytes_each = size if isinstance(below, list) else 1
    return font


@dataclass
class State:
    ctm: Matrix = UNIT
    font: Font = field(default_factory=Font)
    size: float = 0.0
    char: float = 0.0
    word: float = 0.0
    scale: float = 1.0
    lead: float = 0.0
    rise: float = 0.0


#: A gap within one show of text that counts as a space, in thousandths of the size; a box thinner than this, in points, is a line.
SPACE, THIN = 200, 2.5


def _marks_of(file: File, data: bytes, resources: dict, state: State, out: list[tuple], depth: int = 0) -> None:
    """Runs of the operators of a page or form: ``(kind, x0, y0, x1, y1, size, text)``."""
    fonts, forms = (file.get((resources or {}).get(k)) or {} for k in ("/Font", "/XObject"))
    known: dict[str, Font] = {}
    stack, todo, at = [], [], 0
    text, line = UNIT, UNIT
    path, here, first = [], (0.0, 0.0), (0.0, 0.0)

    def show(parts: list) -> None:
        nonlocal text
        said, begin = [], text
        for p in parts:
            if isinstance(p, float):
                text = times((1, 0, 0, 1, -p / 1000 * state.size * state.scale, 0), text)
                if -p > SPACE and said:
                    said.append(" ")
            elif isinstance(p, bytes):
                for c, w in state.font.read(p):
                    said.append(c)
                    text = times((1, 0, 0, 1, (w / 1000 * state.size + state.char + (state.word if c == " " else 0)) * state.scale, 0), text)
        x0, y0 = point(times(begin, state.ctm), 0, state.rise)
        x1, _ = point(times(text, state.ctm), 0, state.rise)
        whole = times(begin, state.ctm)
        size = state.size * (whole[2] ** 2 + whole[3] ** 2) ** 0.5
        if "".join(said).strip():
            out.append(("text", min(x0, x1), y0, max(x0, x1), y0 + size, size, "".join(said)))

    def ruled(points: list[tuple]) -> None:
        for (ax, ay), (bx, by) in points:
            (ax, ay), (bx, by) = point(state.ctm, ax, ay), point(state.ctm, bx, by)
            if abs(ax - bx) < 0.5 < abs(ay - by):
                out.append(("v", ax, min(ay, by), ax, max(ay, by), 0.0, None))
            elif abs(ay - by) < 0.5 < abs(ax - bx):
                out.append(("h", min(ax, bx), ay, max(ax, bx), ay, 0.0, None))

    while True:
        item, at = value(data, at)
        if item is None:
            return
        if not isinstance(item, Word):
            todo.append(item)
            continue
        a, op = todo, str(item)
        n = [x for x in a if isinstance(x, float)]
        todo = []
        if op == "q":
            stack.append(State(**vars(state)))
        elif op == "Q" and stack:
            state = stack.pop()
        elif op == "cm" and len(n) == 6:
            state.ctm = times(tuple(n), state.ctm)
        elif op == "BT":
            text = line = UNIT
        elif op == "Tf" and len(a) == 2:
            if a[0] not in known:
                known[a[0]] = _font(file, fonts.get(a[0]))
            state.font, state.size = known[a[0]], a[1]
        elif op in ("Tc", "Tw", "TL", "Ts", "Tz") and n:
            setattr(state, {"Tc": "char", "Tw": "word", "TL": "lead", "Ts": "rise", "Tz": "scale"}[op], n[0] / (100 if op == "Tz" else 1))
        elif op in ("Td", "TD") and len(n) == 2:
            state.lead = -n[1] if op == "TD" else state.lead
            text = line = times((1, 0, 0, 1, n[0], n[1]), line)
        elif op == "Tm" and len(n) == 6:
            text = line = tuple(n)
        elif op in ("T*", "'", '"'):
            if op == '"' and len(n) == 2:
                state.word, state.char = n
            text = line = times((1, 0, 0, 1, 0, -state.lead), line)
            show(a[-1:])
        elif op == "Tj":
            show(a)
        elif op == "TJ" and a and isinstance(a[0], list):
            show(a[0])
        elif op == "m" and len(n) == 2:
            here = first = tuple(n)
        elif op == "l" and len(n) == 2:
            path.append((here, tuple(n)))
            here = tuple(n)
        elif op == "re" and len(n) == 4:
            x, y, w, h = n
            if abs(w) < THIN or abs(h) < THIN:
                path.append(((x, y), (x + w, y)) if abs(w) >= abs(h) else ((x, y), (x, y + h)))
            else:
                path += [((x, y), (x + w, y)), ((x, y + h), (x + w, y + h)), ((x, y), (x, y + h)), ((x + w, y), (x + w, y + h))]
        elif op == "h":
            path.append((here, first))
        elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
            if op in ("s", "b", "b*"):
                path.append((here, first))
            if op != "n":
                ruled(path)
            path = []
        elif op == "Do" and a and isinstance(form := file.get(forms.get(a[-1])), Stream):
            if form.head.get("/Subtype") == "/Image":
                x, y = zip(*(point(state.ctm, i, j) for i in (0, 1) for j in (0, 1)), strict=True)
                out.append(("image", min(x), min(y), max(x), max(y), 0.0, None))
            elif depth < 8:
                inner = State(**vars(state))
                matrix = file.get(form.head.get("/Matrix"))
                inner.ctm = times(tuple(map(file.get, matrix)), state.ctm) if isinstance(matrix, list) and len(matrix) == 6 else state.ctm
                _marks_of(file, file.bytes(form), file.get(form.head.get("/Resources")) or resources, inner, out, depth + 1)
        elif op == "ID":
            end = re.compile(rb"\sEI\b").search(data, at)
            at = end.end() if end else len(data)


def marks(data: bytes) -> list[tuple]:
    """``(page, kind, x0, y0, x1, y1, size, text)`` of a file, pages from 1; a ``page`` row gives each page's box."""
    file, out = File(data), []
    for number, page in enumerate(file.pages(), 1):
        box = [file.get(x) for x in file.get(page.get("/MediaBox")) or []]
        box = box if len(box) == 4 and all(isinstance(x, float) for x in box) else [0.0, 0.0, 612.0, 792.0]
        found: list[tuple] = [("page", *box, 0.0, None)]
        parts = file.get(page.get("/Contents"))
        parts = [file.get(p) for p in parts] if isinstance(parts, list) else [parts]
        _marks_of(file, b"\n".join(file.bytes(p) for p in parts if isinstance(p, Stream)), file.get(page.get("/Resources")) or {}, State(), found)
        out += [(number, *f) for f in found]
    if not out:
        raise ValueError("no pages")
    return out
