"""Compound files, the containers of older office programs: streams by path, and the mail messages that they hold."""

from __future__ import annotations

import struct
from datetime import UTC, datetime, timedelta
from email import message_from_string
from email.policy import default
from email.utils import format_datetime

import numpy as np

# The first bytes of a compound file, and the least sector number with another meaning.
MAGIC = b"\xd0\xcf\x11\xe0\xa1\xb1\x1a\xe1"
_SPECIAL = 0xFFFFFFFA
# Properties of a message, a recipient and an attachment.
SUBJECT, SENDER, SENDER_ADDRESS, SENDER_SMTP, HEADERS, BODY, HTML = 0x0037, 0x0C1A, 0x0C1F, 0x5D01, 0x007D, 0x1000, 0x1013
SUBMITTED, DELIVERED, NAME, ADDRESS, SMTP, RECIPIENT_KIND, LONG_FILE, SHORT_FILE = 0x0039, 0x0E06, 0x3001, 0x3003, 0x39FE, 0x0C15, 0x3707, 0x3704


def streams(raw: bytes) -> dict[str, bytes]:
    """Path to bytes of every stream of a compound file; ValueError for what is none or is broken."""
    if raw[:8] != MAGIC or len(raw) < 512:
        raise ValueError("no compound file")
    shift, mini_shift = struct.unpack_from("<HH", raw, 30)
    first_entry, cutoff, first_mini, first_more = (struct.unpack_from("<I", raw, at)[0] for at in (48, 56, 60, 68))
    if shift not in (9, 12) or mini_shift != 6:
        raise ValueError("sectors of an unknown size")

    def sector(i: int) -> bytes:
        if not (part := raw[(i + 1) << shift : (i + 2) << shift]):
            raise ValueError("a sector beyond the file's end")
        return part

    def numbers(i: int) -> np.ndarray:
        return np.frombuffer(sector(i).ljust(1 << shift, b"\xff"), "<u4")

    def chain(first: int, table: np.ndarray) -> list[int]:
        out = []
        while first < _SPECIAL:
            if first >= len(table) or len(out) == len(table):
                raise ValueError("a broken chain of sectors")
            out.append(first)
            first = int(table[first])
        return out

    places = list(struct.unpack_from("<109I", raw, 76))
    for _ in range(len(raw) >> shift):
        if first_more >= _SPECIAL:
            break
        more = numbers(first_more)
        places += more[:-1].tolist()
        first_more = int(more[-1])
    empty = np.zeros(0, "<u4")
    table = np.concatenate([empty, *(numbers(i) for i in places if i < _SPECIAL)])
    mini_table = np.concatenate([empty, *map(numbers, chain(first_mini, table))])
    whole = lambda first: b"".join(map(sector, chain(first, table)))
    entries = whole(first_entry)
    entry = lambda i: struct.unpack_from("<64sHBBIII36xIQ", entries, 128 * i)
    if len(entries) < 128:
        raise ValueError("no directory")
    root = entry(0)
    minis = whole(root[7])[: root[8] & 0xFFFFFFFF] if root[7] < _SPECIAL else b""
    out, seen, todo = {}, set(), [(root[6], "")]
    while todo:
        i, path = todo.pop()
        if i >= _SPECIAL:
            continue
        if i in seen or 128 * (i + 1) > len(entries):
            raise ValueError("a broken directory")
        seen.add(i)
        name, size, kind, _, left, right, child, first, length = entry(i)
        name = path + name[: max(size - 2, 0)].decode("utf-16le", "replace")
        length = length & 0xFFFFFFFF if shift == 9 else length
        todo += [(left, path), (right, path)]
        if kind == 1:
            todo.append((child, name + "/"))
        elif kind == 2:
            body = b"" if not length else whole(first) if length >= cutoff else b"".join(minis[k << 6 : (k + 1) << 6] for k in chain(first, mini_table))
            if len(body) < length:
                raise ValueError(f"{name} is cut short")
            out[name] = body[:length]
    return out


def _fixed(data: bytes, head: int) -> dict[int, bytes]:
    """Property number to its eight bytes."""
    return {struct.unpack_from("<H", data, at + 2)[0]: data[at + 8 : at + 16] for at in range(head, len(data) - 15, 16)}


def message(raw: bytes) -> tuple[str, list[str], str, str, str, bool, list[str]]:
    """Sender, recipients (copies last, blind ones left out), subject, date, body, whether that is HTML, and the attachments' names of a message."""
    parts = streams(raw)
    if "__properties_version1.0" not in parts:
        raise ValueError("no message")

    def text(number: int, folder: str = "") -> str:
        name = f"{folder}__substg1.0_{number:04X}"
        if (wide := parts.get(f"{name}001F")) is not None:
            return wide.decode("utf-16le", "replace").rstrip("\0")
        return parts.get(f"{name}001E", b"").decode("cp1252", "replace").rstrip("\0")

    own = _fixed(parts["__properties_version1.0"], 32)
    headers = message_from_string(text(HEADERS), policy=default) if text(HEADERS) else None
    address = text(SENDER_SMTP) or (text(SENDER_ADDRESS) if "@" in text(SENDER_ADDRESS) else "")
    sender = (str(headers["from"] or "") if headers else "") or _named(text(SENDER), address)
    date = str(headers["date"] or "") if headers else ""
    if not date and (ticks := int.from_bytes(own.get(SUBMITTED) or own.get(DELIVERED) or b"", "little")):
        date = format_datetime(datetime(1601, 1, 1, tzinfo=UTC) + timedelta(microseconds=ticks // 10))
    folders = sorted({p.split("/")[0] + "/" for p in parts if "/" in p})
    people: dict[int, list[str]] = {1: [], 2: []}
    for f in (f for f in folders if f.startswith("__recip_version1.0_#")):
        kind = int.from_bytes(_fixed(parts.get(f + "__properties_version1.0", b""), 8).get(RECIPIENT_KIND, b"\1")[:4], "little")
        people.get(kind, []).append(_named(text(NAME, f), text(SMTP, f) or text(ADDRESS, f)))
    files = [text(LONG_FILE, f) or text(SHORT_FILE, f) or "unnamed" for f in folders if f.startswith("__attach_version1.0_#")]
    body, html = text(BODY), False
    if not body:
        body, html = parts.get(f"__substg1.0_{HTML:04X}0102", b"").decode("utf-8", "replace") or text(HTML), True
    return sender, [p for k in (1, 2) for p in people[k] if p], text(SUBJECT), date, body, html, files


def _named(name: str, address: str) -> str:
    return f"{name} <{address}>" if name and address and name != address else address or name
