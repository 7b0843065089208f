"""Writes compound files: any streams, mail messages, and workbooks of the older binary kind."""

from __future__ import annotations

import struct
from collections.abc import Sequence
from datetime import UTC, date, datetime

from orrery.sources import compound as c
from orrery.sources import legacy_sheets as x

_FREE, _END, _FAT, _MORE = 0xFFFFFFFF, 0xFFFFFFFE, 0xFFFFFFFD, 0xFFFFFFFC
#: Bytes of a record at most.
_RECORD = 8224


def container(parts: dict[str, bytes]) -> bytes:
    """A compound file of 512-byte sectors with ``parts`` by path; those under 4,096 bytes go to the stream of small sectors."""
    names = sorted({"/".join(p.split("/")[:i]) for p in parts for i in range(1, p.count("/") + 2)}, key=lambda p: (p.count("/"), p))
    number = {"": 0} | {p: i for i, p in enumerate(names, 1)}
    sectors: list[bytes] = []
    table: list[int] = []

    def put(body: bytes) -> int:
        """The first sector of ``body``, whose sectors follow each other."""
        if not body:
            return _END
        first, n = len(sectors), -(-len(body) // 512)
        sectors.extend(body[512 * k : 512 * (k + 1)].ljust(512, b"\0") for k in range(n))
        table.extend([*range(first + 1, first + n), _END])
        return first

    small, small_table, starts = bytearray(), [], {}
    for p, body in parts.items():
        if len(body) >= 4096:
            starts[p] = put(body)
        elif body:
            starts[p], n = len(small_table), -(-len(body) // 64)
            small_table += [*range(starts[p] + 1, starts[p] + n), _END]
            small += body.ljust(64 * n, b"\0")
    first_small = put(bytes(small))
    first_small_table = put(struct.pack(f"<{len(small_table)}I", *small_table) + b"\xff" * (-4 * len(small_table) % 512))
    links = {i: [_FREE, _FREE, _FREE] for i in number.values()}

    def tree(members: list[str]) -> int:
        """The middle one of the sorted members, with the halves below it."""
        if not members:
            return _FREE
        k = len(members) // 2
        links[number[members[k]]][:2] = tree(members[:k]), tree(members[k + 1 :])
        return number[members[k]]

    for folder in ("", *(n for n in names if n not in parts)):
        members = [n for n in names if n.rpartition("/")[0] == folder]
        links[number[folder]][2] = tree(sorted(members, key=lambda n: (len(n.rpartition("/")[2]), n.rpartition("/")[2].upper())))

    def entry(name: str, kind: int, first: int, size: int, own: list[int]) -> bytes:
        wide = name.encode("utf-16le")
        return struct.pack("<64sHBBIII36xIQ", wide, len(wide) + 2, kind, 1, *own, first, size)

    rows = [entry("Root Entry", 5, first_small, len(small), links[0])]
    rows += [entry(n.rpartition("/")[2], 2 if n in parts else 1, starts.get(n, _END if n in parts else 0), len(parts.get(n, b"")), links[number[n]]) for n in names]
    rows += [struct.pack("<64sHBBIII36xIQ", b"", 0, 0, 0, _FREE, _FREE, _FREE, 0, 0)] * (-len(rows) % 4)
    first_entry = put(b"".join(rows))
    n_fat, n_more = 0, 0
    while n_fat * 128 < len(sectors) + n_fat + n_more:
        n_fat += 1
        n_more = -(-max(0, n_fat - 109) // 127)
    at = len(sectors)
    table += [_FAT] * n_fat + [_MORE] * n_more
    table += [_FREE] * (n_fat * 128 - len(table))
    packed = struct.pack(f"<{len(table)}I", *table)
    sectors += [packed[512 * k : 512 * (k + 1)] for k in range(n_fat)]
    places = [*range(at, at + n_fat)]
    listed, rest = places[:109] + [_FREE] * max(0, 109 - n_fat), places[109:]
    for k in range(n_more):
        part = rest[127 * k : 127 * (k + 1)]
        follows = at + n_fat + k + 1 if k + 1 < n_more else _END
        sectors.append(struct.pack("<128I", *part, *[_FREE] * (127 - len(part)), follows))
    head = c.MAGIC + bytes(16) + struct.pack("<HHHHH6xIIIIIIIII", 0x3E, 3, 0xFFFE, 9, 6, 0, n_fat, first_entry, 0, 4096, first_small_table, -(-len(small_table) // 128), at + n_fat if n_more else _END, n_more)
    return b"".join([head + struct.pack("<109I", *listed), *sectors])


def message(sender: tuple[str, str], people: Sequence[tuple[int, str, str]], subject: str, sent: datetime, body: str, files: Sequence[str] = (), html: bool = False) -> bytes:
    """A message from ``sender`` (name, address) to ``people`` (1 to, 2 copy, 3 blind; name, address) with empty attachments of the given names."""
    said = lambda folder, number, text: {f"{folder}__substg1.0_{number:04X}001F": text.encode("utf-16le")}
    fixed = lambda kind, number, value: struct.pack("<HHI8s", kind, number, 6, value)
    ticks = int((sent - datetime(1601, 1, 1, tzinfo=UTC)).total_seconds()) * 10_000_000
    parts = {"__properties_version1.0": bytes(32) + fixed(0x40, c.SUBMITTED, struct.pack("<Q", ticks))}
    parts |= said("", c.SUBJECT, subject) | said("", c.SENDER, sender[0]) | said("", c.SENDER_SMTP, sender[1])
    parts |= {f"__substg1.0_{c.HTML:04X}0102": body.encode()} if html else said("", c.BODY, body)
    for i, (kind, name, address) in enumerate(people):
        folder = f"__recip_version1.0_#{i:08X}/"
        parts |= {folder + "__properties_version1.0": bytes(8) + fixed(3, c.RECIPIENT_KIND, struct.pack("<Q", kind))} | said(folder, c.NAME, name) | said(folder, c.SMTP, address)
    for i, name in enumerate(files):
        folder = f"__attach_version1.0_#{i:08X}/"
        parts |= {folder + "__properties_version1.0": bytes(8)} | said(folder, c.LONG_FILE, name)
    return container(parts)


def workbook(tables: dict[str, list[list[object]]], merged: dict[str, list[tuple[int, int, int, int]]] | None = None) -> bytes:
    """A workbook with a sheet for each of ``tables``: texts, truth values, dates, whole numbers and others; None is an empty cell."""
    record = lambda kind, body: struct.pack("<HH", kind, len(body)) + body
    shared: dict[str, int] = {}
    uses = 0
    bodies = []
    for name, rows in tables.items():
        out = [record(x.BOF, struct.pack("<HHHHII", 0x600, 0x10, 0, 0, 0, 0x600))]
        for r, row in enumerate(rows):
            for k, v in enumerate(row):
                if v is None:
                    continue
                at = struct.pack("<HHH", r, k, isinstance(v, date))
                if isinstance(v, str):
                    uses += 1
                    out.append(record(x.SHARED, at + struct.pack("<I", shared.setdefault(v, len(shared)))))
                elif isinstance(v, bool):
                    out.append(record(x.TRUTH, at + bytes([v, 0])))
                elif isinstance(v, int) and abs(v) < 1 << 29:
                    out.append(record(x.SHORT, at + struct.pack("<i", v << 2 | 2)))
                else:
                    out.append(record(x.NUMBER, at + struct.pack("<d", (v - date(1899, 12, 30)).days if isinstance(v, date) else v)))
        if ranges := (merged or {}).get(name):
            out.append(record(x.MERGED, struct.pack("<H", len(ranges)) + b"".join(struct.pack("<HHHH", r0, r1, c0, c1) for r0, c0, r1, c1 in ranges)))
        bodies.append(b"".join(out) + record(x.EOF, b""))
    head = record(x.BOF, struct.pack("<HHHHII", 0x600, 5, 0, 0, 0, 0x600)) + b"".join(record(x.STYLE, struct.pack("<HH16x", 0, n)) for n in (0, 14))
    labels = [name.encode("utf-16le") for name in tables]
    texts = _strings(list(shared), uses)
    start = len(head) + sum(12 + len(b) for b in labels) + len(texts) + 4
    for label, body in zip(labels, bodies, strict=True):
        head += record(x.SHEET, struct.pack("<IBBBB", start, 0, 0, len(label) // 2, 1) + label)
        start += len(body)
    return container({"Workbook": head + texts + record(x.EOF, b"") + b"".join(bodies)})


def _strings(shared: list[str], uses: int) -> bytes:
    """The table of shared strings, cut where a record is full; letters that run over have their width told anew."""
    out, room = [bytearray(struct.pack("<II", uses, len(shared)))], _RECORD - 8
    for text in shared:
        try:
            body, unit, wide = text.encode("latin-1"), 1, 0
        except UnicodeEncodeError:
            body, unit, wide = text.encode("utf-16le"), 2, 1
        if room < 3 + unit:
            out.append(bytearray())
            room = _RECORD
        out[-1] += struct.pack("<HB", len(body) // unit, wide)
        room -= 3
        while body:
            n = min(len(body), room - room % unit)
            if n <= 0:
                out.append(bytearray([wide]))
                room = _RECORD - 1
                continue
            out[-1] += body[:n]
            body, room = body[n:], room - n
    return b"".join(struct.pack("<HH", x.CONTINUE if i else x.STRINGS, len(b)) + bytes(b) for i, b in enumerate(out))
