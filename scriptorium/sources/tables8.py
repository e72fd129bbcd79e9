"""What the table stream of a version 8 document says besides pieces: styles, lists, sections and document properties."""

from __future__ import annotations

import struct
from dataclasses import dataclass, replace

NIL = (0x0FFF, 0x0FFE)
DEPTH = 25


def u16(raw: bytes, at: int) -> int:
    return struct.unpack_from("<H", raw, at)[0] if len(raw) >= at + 2 else 0


def u32(raw: bytes, at: int) -> int:
    return struct.unpack_from("<I", raw, at)[0] if len(raw) >= at + 4 else 0


#: The number format of bullets, those without a number, and the level bytes of lists that go on and that pause.
BULLET, UNNUMBERED, SEQUENCE, PAUSE = 23, (8, 23, 255), 11, 12
#: Symbol-font codes of list marks as Unicode.
MARKS = {
    0x0000: "\u2022", 0x0096: "\u2013", 0x00A8: "\u2666", 0x00B7: "\u2022", 0x00DE: "\u21d2", 0x00E0: "\u25ca", 0x00E1: "\u2329", 0x00FE: "\u2022",
    0xF020: " ", 0xF021: "\u2022", 0xF02D: "\u2013", 0xF041: "\u270c", 0xF043: "\u2022", 0xF066: "\u03d5", 0xF06C: "\u2022", 0xF06E: "\u25a0",
    0xF06F: "\u25a1", 0xF070: "\u25a1", 0xF071: "\u2751", 0xF074: "\u25ca", 0xF075: "\u25c6", 0xF076: "\u2756", 0xF077: "\u25c6", 0xF093: "\u2022",
    0xF0A7: "\u25aa", 0xF0A8: "\u25a1", 0xF0B7: "\u2022", 0xF0D8: "\u27a2", 0xF0E5: "\u2199", 0xF0F0: "\u21e8", 0xF0FC: "\u2713",
}


def list_mark(nfc: int, code: int) -> str:
    """The mark after a list's number, or its bullet."""
    if 0x20 <= code < 0x7F:
        return chr(code)
    if nfc not in UNNUMBERED:
        return "."
    unknown = 0xE000 <= code < 0xF900 or code < 0x80
    return MARKS.get(code) or ("\u2022" if nfc == BULLET else "\u2190") * unknown or chr(code)


@dataclass(frozen=True)
class Style:
    """A style as stored: what it is based on, and its property lists."""

    base: int
    following: int
    paragraph: bytes = b""
    character: bytes = b""


def stylesheet(raw: bytes) -> dict[int, Style]:
    """Styles by number; empty records and a missing sheet give none."""
    out: dict[int, Style] = {}
    count, fixed, at = u16(raw, 2), u16(raw, 4), 2 + u16(raw, 0)
    for i in range(count if len(raw) > 6 else 0):
        n = u16(raw, at)
        record, at = raw[at : at + 2 + n], at + 2 + n
        if not n:
            continue
        kind, base = u16(record, 4) % 16, u16(record, 4) // 16
        parts, following = u16(record, 6) % 16, u16(record, 6) // 16
        pos = 2 + fixed
        pos += 2 + 2 * u16(record, pos) + 2  # the name and its end
        upx = []
        for _ in range(parts):
            pos += pos % 2
            size = u16(record, pos)
            if pos >= n or pos + size > n + 2:
                break
            upx.append(record[pos + 2 : pos + 2 + size])
            pos += 2 + size
        if kind == 1:
            out[i] = Style(base, following, upx[0][2:] if upx else b"", upx[1] if len(upx) > 1 else b"")
        else:
            out[i] = Style(base, following, b"", upx[0] if upx else b"")
    return out


def chain(styles: dict[int, Style], istd: int) -> list[Style]:
    """A style and what it is based on, the root first; a chain that runs in a circle is cut."""
    out: list[Style] = []
    seen: set[int] = set()
    while istd in styles and istd not in seen and len(out) < DEPTH:
        seen.add(istd)
        out.append(styles[istd])
        istd = styles[istd].base
        if istd in NIL:
            break
    return out[::-1]


@dataclass(frozen=True)
class Level:
    """A level of a list."""

    start_at: int = 1
    nfc: int = 0
    no_restart: bool = False
    mark: str = "."
    istd: int = 0
    left: int = 0


def list_levels(table: bytes, at: int, n: int) -> dict[tuple[int, int], Level]:
    """Levels by (list, level); their records follow the table of lists."""
    head, out = table[at : at + n], {}
    records, pos = u16(head, 0), at + n
    if 2 + records * 28 > n:
        return out
    for i in range(records):
        own = head[2 + 28 * i : 30 + 28 * i]
        for level in range(1 if own[26] & 1 else 9):
            body = table[pos : pos + 28]
            if len(body) < 28:
                return out
            found = Level(istd=u16(own, 8 + 2 * level))
            if any(body):
                found = replace(found, start_at=u32(body, 0), nfc=body[4], no_restart=bool(body[5] & 8))
            pos += 28
            left = indent_of(table[pos : pos + body[25]])
            pos += body[25] + body[24]
            chars = u16(table, pos)
            text = table[pos + 2 : pos + 2 + 2 * chars]
            pos += 2 + 2 * chars
            places = [b for b in body[6:15]]
            last = 0
            for b in places:
                if not b:
                    break
                last = b
            mark = found.mark
            if text and found.nfc in (0x17, 0xFF):
                mark = list_mark(found.nfc, u16(text, 0))
            elif last and 2 * last < len(text):
                mark = list_mark(found.nfc, u16(text, 2 * last))
            out[u32(own, 0), level] = replace(found, mark=mark, left=left)
    return out


def indent_of(props: bytes) -> int:
    """The left indent of a level's paragraph properties, or 0."""
    at = 0
    while at + 4 <= len(props):
        op = u16(props, at)
        if op == 0x840F:
            x = u16(props, at + 2)
            return x if x < 0x8000 else 0
        top = op >> 13
        at += 3 + props[at + 2] if top == 6 else {0: 3, 1: 3, 2: 4, 4: 4, 5: 4, 7: 5, 3: 6}[top]
    return 0


def list_overrides(raw: bytes) -> list[int]:
    """Lists by override, the first being number 1."""
    n = u32(raw, 0)
    return [u32(raw, 4 + 16 * i) for i in range(min(n, max(0, len(raw) - 4) // 16))]


def level_of(levels: dict, overrides: list[int], index: int, level: int) -> Level | None:
    """The level of a list, or else its first level."""
    if not 1 <= index <= len(overrides) or level > 8:
        return None
    number = overrides[index - 1]
    return levels.get((number, level), levels.get((number, 0)))


def document_properties(raw: bytes) -> dict:
    """Header specification, default tab and times as packed dates; fewer than 28 bytes give none."""
    if len(raw) < 28:
        return {}
    return {"hdrftr_spec": u16(raw, 0) >> 8, "default_tab": u16(raw, 0x0A), "created_dttm": u32(raw, 0x14), "revised_dttm": u32(raw, 0x18)}


def sections(table_part: bytes, main: bytes) -> list[dict]:
    """(char_pos, new_page) of each section; those without properties begin a new page."""
    n = (len(table_part) - 4) // 16
    out = []
    for i in range(max(0, n)):
        at = u32(table_part, 4 * (n + 1) + 12 * i + 2)
        new_page = True
        if at != 0xFFFFFFFF:
            props = main[at + 2 : at + 2 + u16(main, at)]
            pos = 0
            while pos + 3 <= len(props):
                op = u16(props, pos)
                if op == 0x3009:
                    new_page = props[pos + 2] not in (0, 1)
                top = op >> 13
                pos += 3 + props[pos + 2] if top == 6 else {0: 3, 1: 3, 2: 4, 4: 4, 5: 4, 7: 5, 3: 6}[top]
        out.append({"char_pos": u32(table_part, 4 * i), "new_page": new_page})
    return out
