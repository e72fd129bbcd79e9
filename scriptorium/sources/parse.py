"""One file's bytes to paragraphs, rows, notes and summary.  Errors are data: a bad file gives an error code, never an exception."""

from __future__ import annotations

import re
import struct
from bisect import bisect_right
from dataclasses import dataclass, field, replace
from functools import cache

from scriptorium.functions import codepages
from scriptorium.functions.binary import COUNTED6 as COUNTED
from scriptorium.functions.binary import FIVE, FOUR, THREE, TWELVE, TWO
from scriptorium.functions.binary import TABS6 as TABS
from scriptorium.functions.text import SHOWN, UPPER
from scriptorium.sources import tables8
from scriptorium.sources.container import Container, Damaged
from scriptorium.sources.tables8 import BULLET, PAUSE, SEQUENCE, UNNUMBERED, list_mark

LISTS = ("text", "footnote", "hdrftr", "macro", "annotation", "endnote", "textbox", "hdrtextbox")
#: Lists that are printed, in order.
PRINTED = ("text", "footnote", "endnote", "textbox", "hdrtextbox")
BOLD, ITALIC, UNDERLINE, CAPITALS, SMALL_CAPS, STRIKE, HIDDEN, SUPER, SUB, DELETED, NOTE = (1 << i for i in range(11))
#: Headers and footers of a section, in their order in version 8.
HEADERS = ("hdr_even", "hdr_odd", "ftr_even", "ftr_odd", "hdr_first", "ftr_first")
#: Bits of a section's specification in versions 6 and 7 from the highest, and bits of the document's that come before.
HEADER_BITS6, DOCUMENT_BITS6 = {7: "hdr_even", 6: "hdr_odd", 5: "ftr_even", 4: "ftr_odd", 3: "hdr_first", 2: "ftr_first"}, (7, 6, 5)
#: Opcodes of versions 6 and 7 for the break before a section and for its headers and footers.
BREAK6, HEADERS6 = 142, 153
#: Twips that a heading has before and after it at least.
HEADING_GAP = 120
#: Identifiers of files whose text has two bytes a character.
FAR_EAST = (0x8098, 0x8099, 0xA697, 0xA699)
#: Stands for characters that don't show, so that the others keep their places.
GONE = "\0"
FIELD = re.compile("\x13[^\x14\x15]*[\x14\x15]?|[\x14\x15]")


class Refused(Exception):
    """A file that can't be read, with its code."""

    def __init__(self, code: str, message: str):
        super().__init__(message)
        self.code = code


@dataclass
class Run:
    """Properties from a place in the file on."""

    istd: int = 0
    alignment: int = 0
    left: int = 0
    before: int = 0
    after: int = 0
    right: int = 0
    list_index: int = 0
    level: int = 0
    nfc: int = 0
    mark: int = 0
    start_at: int = 0
    pause: bool = False
    in_table: bool = False
    row_end: bool = False
    widths: tuple[int, ...] = ()


@dataclass
class Parsed:
    guess: int = -1
    version: int = -1
    old_mac: bool = False
    fast_saved: bool = False
    error_code: str | None = None
    error_msg: str | None = None
    paragraphs: list[dict] = field(default_factory=list)
    pieces: list[dict] = field(default_factory=list)
    summary: dict = field(default_factory=dict)
    sections: list[dict] = field(default_factory=list)
    headers: list[dict] = field(default_factory=list)


def u16(raw: bytes, at: int) -> int:
    return struct.unpack_from("<H", raw, at)[0] if len(raw) >= at + 2 else 0


def u32(raw: bytes, at: int) -> int:
    return struct.unpack_from("<I", raw, at)[0] if len(raw) >= at + 4 else 0


def guess(raw: bytes) -> int:
    n = len(raw)
    if n >= 128 and raw.startswith(b"\x31\xbe\0\0\0\xab"):
        return 0
    if n >= 384 and raw[:4] in (b"\x9b\xa5\x21\0", b"\xdb\xa5\x2d\0"):
        return 2
    if raw[:6] in (b"\xfe\x37\0\x1c\0\0", b"\xfe\x37\0\x23\0\0"):
        return 5
    tail = n % 512
    if n >= 1536 and (tail == 0 or tail in (1, 2) and n % 3 != tail) and raw.startswith(bytes.fromhex("d0cf11e0a1b11ae1")):
        return 6
    return -1


def version(head: bytes) -> tuple[int, bool]:
    fib = u16(head, 2)
    if fib >= 0x1000:
        fib = struct.unpack_from(">H", head, 2)[0]
    known = {0: (0, False), 28: (4, True), 33: (1, False), 35: (5, True), 45: (2, False), 101: (6, False), 102: (6, False)}
    if fib in known:
        return known[fib]
    if fib in (103, 104):
        chse = u16(head, 0x14)
        return (7, False) if chse == 0 or chse != 256 and head[5] == 0xE0 else (6, True)
    return (8, False) if fib >= 192 else (-1, False)


def text_lengths(head: bytes, ver: int) -> list[int]:
    """Characters of the eight lists."""
    if ver in (1, 2):
        return [u32(head, at) for at in (0x34, 0x38, 0x3C, 0x40, 0x44)] + [0, 0, 0]
    first = 0x34 if ver < 8 else 0x4C
    return [u32(head, first + 4 * i) for i in range(8)]


def piece_table(clx: bytes, wide: bool, new: bool) -> tuple[list[tuple[int, int, bool, int]], list[bytes]]:
    """(stream offset, bytes, 16-bit, property modifier) of each piece in order, and the modifiers' property lists."""
    at, mods = 0, []
    while at < len(clx):
        kind = clx[at]
        at += 1
        if kind == 0:
            at += 1
        elif kind == 1:
            n = u16(clx, at)
            mods.append(clx[at + 2 : at + 2 + n])
            at += n + 2
        elif kind == 2:
            n = (u32(clx, at) - 4) // 12 if new else (u16(clx, at) - 4) // 12
            at += 4
            out = []
            for i in range(n):
                chars = u32(clx, at + 4 * i + 4) - u32(clx, at + 4 * i)
                offset, mod = u32(clx, at + 4 * (n + 1) + 8 * i + 2), u16(clx, at + 4 * (n + 1) + 8 * i + 6)
                is_wide = wide
                if new:
                    is_wide = not offset & 0x40000000
                    if not is_wide:
                        offset = (offset & ~0x40000000) // 2
                out.append((offset, chars * (2 if is_wide else 1), is_wide, mod))
            return out, mods
        else:
            raise Refused("piece_table", "unknown kind of fast-saved format")
    return [], mods


def steps8(raw: bytes):
    """(opcode, operand) of a version 8 property list."""
    at = 0
    while at + 2 <= len(raw):
        op = u16(raw, at)
        top = op >> 13
        if top == 6:
            n = raw[at + 2] if at + 2 < len(raw) else 0
            if op == 0xC615 and n == 255:
                gone = raw[at + 3] if at + 3 < len(raw) else 0
                more = raw[at + 4 + gone * 4] if at + 4 + gone * 4 < len(raw) else 0
                n = 2 + gone * 4 + more * 3
            size = 3 + n
        else:
            size = {0: 3, 1: 3, 2: 4, 4: 4, 5: 4, 7: 5, 3: 6}[top]
        yield op, raw[at + 2 : at + size]
        at += size


#: Bytes that follow an opcode of versions 6 and 7; those not named have one.
OPERANDS6 = {op: n for n, ops in ((2, TWO), (3, THREE), (4, FOUR), (5, FIVE), (12, TWELVE)) for op in ops}


def byte(raw: bytes, at: int) -> int:
    return raw[at] if at < len(raw) else 0


def steps6(raw: bytes):
    """(opcode, what follows) of a property list of versions 6 and 7."""
    at = 0
    while at < len(raw):
        op = raw[at]
        n = OPERANDS6.get(op, 1)
        if op in COUNTED or op == TABS:
            n = 1 + byte(raw, at + 1)
        if op == TABS and n == 256:
            gone = byte(raw, at + 2)
            n = 3 + 4 * gone + 3 * byte(raw, at + 3 + 4 * gone)
        yield op, raw[at + 1 : at + 1 + n]
        at += 1 + n


def signed(x: int) -> int:
    return x - 0x10000 if x >= 0x8000 else x


#: What paragraph opcodes of version 8 and of versions 6 and 7 set.
PARAGRAPH8 = {0x2403: "alignment", 0x260A: "level", 0x460B: "list_index", 0x840E: "right", 0x840F: "left", 0x4610: "nest", 0xA413: "before", 0xA414: "after", 0x2416: "in_table", 0x2417: "row_end", 0x244B: "in_table", 0x244C: "row_end", 0xD608: "widths"}
PARAGRAPH6 = {5: "alignment", 12: "number", 13: "old_level", 16: "right", 17: "left", 18: "nest", 21: "before", 22: "after", 24: "in_table", 25: "row_end", 190: "widths"}
def old_number(run: Run, body: bytes) -> None:
    """The number description of versions 6 and 7: format, length of the text before, start and mark; short ones leave the rest as it is."""
    if body:
        run.nfc = body[0]
    ahead = body[1] if len(body) >= 2 and run.nfc != BULLET else 0
    if len(body) >= 12:
        run.start_at = u16(body, 10)
    if len(body) >= ahead + 21:
        run.mark = body[ahead + 20]


def paragraph_run(istd: int, raw: bytes, ver: int, run: Run | None = None) -> Run:
    """Properties of a paragraph on top of those of its style."""
    run = replace(run, istd=istd) if run else Run(istd=istd)
    steps, names = (steps8, PARAGRAPH8) if ver >= 8 else (steps6, PARAGRAPH6)
    for op, arg in steps(raw):
        name, b, w = names.get(op), byte(arg, 0), u16(arg, 0)
        if name in ("alignment", "level"):
            setattr(run, name, b)
        elif name == "list_index":
            run.list_index = w
        elif name == "number":
            old_number(run, arg[1:])
        elif name == "old_level":
            run.level, run.pause = b, b == PAUSE
        elif name == "left":
            run.left = max(0, signed(w))
        elif name == "nest":
            run.left = max(0, run.left + signed(w))
        elif name == "right":
            run.right = signed(w)
        elif name in ("before", "after"):
            setattr(run, name, 0 if w > 0x7FFF else min(w, 2160))
        elif name in ("in_table", "row_end"):
            setattr(run, name, bool(b))
        elif name == "widths":
            body = arg[2:]
            edges = [signed(u16(body, 1 + 2 * i)) for i in range(byte(body, 0) + 1)]
            run.widths = tuple(max(0, z - a) for a, z in zip(edges, edges[1:], strict=False))
    return run


#: Opcodes of version 8, and of versions 6 and 7, that switch a property of characters.
TOGGLES8 = {0x0835: BOLD, 0x0836: ITALIC, 0x0837: STRIKE, 0x083A: SMALL_CAPS, 0x083B: CAPITALS, 0x083C: HIDDEN, 0x0800: DELETED}
TOGGLES6 = {85: BOLD, 86: ITALIC, 87: STRIKE, 90: SMALL_CAPS, 91: CAPITALS, 92: HIDDEN, 65: DELETED}


def character_style(raw: bytes, ver: int, base: int = 0) -> int:
    """Style bits: 0 clears, 1 sets, 128 keeps and 129 turns over the paragraph's."""
    style = base
    toggles = TOGGLES8 if ver >= 8 else TOGGLES6
    for op, arg in (steps8 if ver >= 8 else steps6)(raw):
        b = arg[0] if arg else 0
        if op in toggles:
            bit = toggles[op]
            style = style & ~bit if b == 0 else style ^ bit if b == 129 and bit != DELETED else style if b == 128 else style | bit
        elif op == (0x2A3E if ver >= 8 else 94):
            style = style & ~UNDERLINE if b in (0, 5) else style | UNDERLINE | (BOLD if b == 6 else 0)
        elif op == (0x2A48 if ver >= 8 else 104):
            style = style & ~(SUPER | SUB) | {1: SUPER, 2: SUB}.get(b, 0)
        elif op == (0x2A32 if ver >= 8 else 82):
            style &= HIDDEN
        elif op == (0x2A33 if ver >= 8 else 83):
            style = base
    return style


def pages(stream: bytes, plc: bytes, ver: int, first_page: int = 0, n_pages: int = 0) -> list[bytes]:
    """512-byte pages of runs that a position table names."""
    size = 4 if ver >= 8 else 2
    n = (len(plc) - 4) // (4 + size)
    if n < 0 or len(plc) < 4:
        return []
    numbers = [u32(plc, 4 * (n + 1) + 4 * i) if size == 4 else u16(plc, 4 * (n + 1) + 2 * i) for i in range(n)]
    if ver < 8 and n < n_pages:  # the others follow on
        numbers += [first_page + i for i in range(len(numbers), n_pages)]
    return [stream[512 * p : 512 * p + 512] for p in numbers if len(stream) >= 512 * p + 512]


def run_list(found: list[bytes], stride: int, fill) -> tuple[list[int], list]:
    """Starts of runs and their properties, by place."""
    out = {}
    for page in found:
        n = page[511]
        for i in range(n):
            at = 2 * page[4 * (n + 1) + i * stride] if 4 * (n + 1) + i * stride < 511 else 0
            out[u32(page, 4 * i)] = fill(page, at)
        if n:
            out.setdefault(u32(page, 4 * n), fill(page, 0))
    starts = sorted(out)
    return starts, [out[s] for s in starts]


def at_or_before(starts: list[int], values: list, place: int, default):
    i = bisect_right(starts, place) - 1
    return values[i] if i >= 0 else default


SUMMARY = {2: "title", 3: "subject", 4: "author", 18: "app_name"}
MORE = {14: "manager", 15: "company"}


def property_set(raw: bytes | None, names: dict[int, str]) -> dict:
    """Strings and times of a property set stream."""
    out: dict = {}
    if not raw or u16(raw, 0) != 0xFFFE or len(raw) < 48:
        return out
    base = u32(raw, 44)
    for i in range(min(u32(raw, base + 4), 256)):
        pid, at = u32(raw, base + 8 + 8 * i), base + u32(raw, base + 12 + 8 * i)
        kind = u32(raw, at)
        if pid in names and kind == 30:
            text = raw[at + 8 : at + 8 + u32(raw, at + 4)].split(b"\0")[0].decode("cp1252", "replace").strip(" ")
            if text:
                out[names[pid]] = text
        elif pid in (12, 13) and kind == 64 and names is SUMMARY:
            steps = u32(raw, at + 8) * 2**32 + u32(raw, at + 4) - 116_444_736_000_000_000
            if abs(steps) < 2**31 * 10**7:
                out["created" if pid == 12 else "last_saved"] = (abs(steps) + 5_000_000) // 10_000_000 * (1 if steps >= 0 else -1)
    return out


class Assembler:
    """Cuts segments of text into paragraphs and table rows, in order."""

    def __init__(self, notes: tuple[set[int], set[int]] = (set(), set())):
        self.out: list[dict] = []
        self.runs: list[tuple[str, int]] = []
        self.cells: list[str] = []
        self.notes, self.count = notes, {"footnote": 0, "endnote": 0}
        self.began = self.here = 0  # character positions: of the paragraph, and after what was read

    def note(self, kind: str | None) -> str:
        if kind is None:
            return "[?]"
        self.count[kind] += 1
        n = self.count[kind]
        return f"[{n}]" if kind == "footnote" else f"[{small_roman(n)}]"

    def add(self, text: str, style: int, run: Run, list_id: str, cp: int) -> None:
        at = 0
        for i, c in enumerate(text):
            if c in "\r\x07\x0c\x0e\x02\x01":
                self.runs.append((cleaned(text[at:i]), style))
                at = i + 1
                self.here = cp + at
                if c == "\x02":
                    foot, end = self.notes
                    kind = list_id if list_id in ("footnote", "endnote") else "footnote" if not end and foot else "endnote" if end and not foot else "footnote" if cp + i in foot else "endnote" if cp + i in end else None
                    self.runs.append((self.note(kind), NOTE if kind == "footnote" else 0))
                elif c == "\x01":
                    self.runs.append(("[pic]", 0))
                elif c == "\x07":
                    self.cell(run, list_id)
                elif run.in_table and c == "\r":
                    self.runs.append(("\n", 0))
                else:
                    self.end(run, list_id)
        if text[at:]:
            self.runs.append((cleaned(text[at:]), style))
        self.here = cp + len(text)

    def taken(self) -> list[dict]:
        out: list[dict] = []
        for t, s in self.runs:
            if t and out and out[-1]["style"] == s != NOTE:
                out[-1]["text"] += t
            elif t:
                out.append({"text": t, "style": s})
        self.runs = []
        return out

    def cell(self, run: Run, list_id: str) -> None:
        if run.row_end or not run.in_table and self.cells:
            rest = "".join(r["text"] for r in self.taken())
            if rest:
                self.cells.append(rest)
            self.append("row", run, list_id, [])
        elif run.in_table:
            self.cells.append("".join(r["text"] for r in self.taken()))
        else:
            self.runs.append((" |", 0))

    def end(self, run: Run, list_id: str) -> None:
        self.append("para", run, list_id, self.taken())

    def append(self, kind: str, run: Run, list_id: str, runs: list[dict]) -> None:
        cells, self.cells = (self.cells, []) if kind == "row" else ([], self.cells)
        gap = HEADING_GAP if 1 <= run.istd <= 9 else 0
        self.out.append({"seq": len(self.out), "char_pos": self.began, "list_id": list_id, "kind": kind, "istd": run.istd, "alignment": run.alignment, "left_twips": run.left, "before_twips": max(run.before, gap), "after_twips": max(run.after, gap), "right_twips": min(0, run.right), "list_index": run.list_index, "list_level": run.level, "nfc": run.nfc, "mark": list_mark(run.nfc, run.mark), "start_at": run.start_at, "pause": run.pause, "label": "", "runs": runs, "cells": cells, "widths": list(run.widths)})
        self.began = self.here


def small_roman(n: int) -> str:
    out, n = "", n % 4000
    for value, sign in ((1000, "m"), (900, "cm"), (500, "d"), (400, "cd"), (100, "c"), (90, "xc"), (50, "l"), (40, "xl"), (10, "x"), (9, "ix"), (5, "v"), (4, "iv"), (1, "i")):
        out, n = out + sign * (n // value), n % value
    return out


_CLEAN = dict.fromkeys(map(ord, "\x00\x03\x04\x05\x08\x0a\x1f‧")) | SHOWN


def upper(text: str) -> str:
    return text.translate(UPPER)


def cleaned(text: str) -> str:
    """Without characters that never show, and symbols of the private area as Unicode; hard line ends are line feeds, hard hyphens hyphens."""
    return text.translate(_CLEAN).replace("\x0b", "\n").replace("\x1e", "-")


def assemble(stream: bytes, pieces: list[tuple[int, int, bool, int]], lengths: list[int], page: str, paragraphs=((), ()), characters=((), ()), notes=(set(), set()), keep: int = 0, style_of=None, text_compat: bool = False) -> tuple[list[dict], list[dict]]:
    """Paragraphs and pieces.  Pieces are cut wherever a list ends or a property run begins, so each segment has one set of properties."""
    asm, listed, cp, total = Assembler(notes), [], 0, 0
    ends, known = [], 0
    for n in lengths:
        known += n
        ends.append(known)
    cuts = sorted({*paragraphs[0], *characters[0]})
    skipping = False
    last = Run(), "text"
    for offset, n_bytes, wide, mod in pieces:
        width = 2 if wide else 1
        listed.append({"seq": len(listed), "file_offset": offset, "char_pos": total, "length": n_bytes, "is_unicode": wide, "prop_mod": mod})
        total += n_bytes
        marks = {offset, offset + n_bytes} | {c for c in cuts[bisect_right(cuts, offset) : bisect_right(cuts, offset + n_bytes)] if (c - offset) % width == 0}
        marks |= {offset + (e - cp) * width for e in ends if 0 < (e - cp) * width < n_bytes}
        edges = sorted(marks)
        for a, b in zip(edges, edges[1:], strict=False):
            at = cp + (a - offset) // width
            number = bisect_right(ends, at) if ends else 0
            if number >= len(LISTS):
                continue
            raw = stream[a:b]
            text = codepages.decode_wide(raw, page) if wide else codepages.decode(raw, page)
            if LISTS[number] != last[1]:
                if asm.runs:
                    asm.end(*last)
                asm.count = {"footnote": 0, "endnote": 0}  # notes count anew before their own lists
            run = at_or_before(*paragraphs, a, Run())
            style = style_of(run.istd, at_or_before(*characters, a, b"")) if style_of else 0
            if skipping:
                m = re.search("[\x14\x15]", text)
                end = m.end() if m else len(text)
                text, skipping = GONE * end + text[end:], not m
            tail = text.rfind("\x13")
            if tail >= 0 and not re.search("[\x14\x15]", text[tail:]):
                skipping, text = True, text[:tail].ljust(len(text), GONE)
            text = FIELD.sub(lambda m: GONE * len(m[0]), text)
            counted = style_of(run.istd, b"") if style_of and text_compat else style
            if counted & (HIDDEN | DELETED) & ~keep:
                text = "".join(c if c in "\r\x07\x0c\x0e" else GONE for c in text)
            if counted & CAPITALS:
                text = upper(text)
            asm.add(text, style, run, LISTS[number], at)
            last = run, LISTS[number]
        cp += n_bytes // width
    if "".join(t for t, _ in asm.runs):
        asm.end(*last)
    return asm.out, listed


def number_lists(paragraphs: list[dict], levels: dict, overrides: list[int]) -> None:
    """Labels of list paragraphs: each level counts by itself and, unless it says otherwise, makes deeper ones of its list begin anew."""
    values: dict[tuple[int, int], int] = {}
    for p in paragraphs:
        index, depth = p["list_index"], p["list_level"]
        level = tables8.level_of(levels, overrides, index, depth)
        if level is None or 1 <= p["istd"] <= 9:
            continue
        values[index, depth] = values[index, depth] + 1 if (index, depth) in values else level.start_at
        p["nfc"] = level.nfc
        if not level.no_restart:
            values = {k: v for k, v in values.items() if k[0] != index or k[1] <= depth}
        p["left_twips"] = p["left_twips"] or level.left
        if p["left_twips"] > 0:
            p["label"] = number_text(values[index, depth], level.nfc) + level.mark[:3] + " "


def number_old_lists(paragraphs: list[dict]) -> None:
    """Labels of versions 6 and 7: a run of list paragraphs counts by ones, a list that goes on where the last one ended too."""
    serial, last, value, inside = 0, 0, 0, False
    for p in paragraphs:
        listed = p["list_level"] != 0 and not 1 <= p["istd"] <= 9
        serial += listed and not inside
        inside = listed
        p["list_index"] = serial * listed
        if not listed or p["pause"]:
            continue
        value = value + 1 if serial == last or serial == last + 1 and p["list_level"] == SEQUENCE else p["start_at"]
        last = serial
        if p["left_twips"] > 0:
            p["label"] = number_text(value, p["nfc"]) + p["mark"] + " "


def number_text(n: int, nfc: int) -> str:
    if nfc in (1, 2):
        text = small_roman(n)
        return text.upper() if nfc == 1 else text
    if nfc in (3, 4):
        text, k = "", n
        while 0 < k and n <= 26 + 26**2 + 26**3:
            text, k = chr(97 + (k - 1) % 26) + text, (k - 1) // 26
        return text.upper() if nfc == 3 else text
    if nfc == 5:
        return str(n) + ({1: "st", 2: "nd", 3: "rd"}.get(n % 10, "th") if n not in (11, 12, 13) else "th")
    return f"{n:02d}" if nfc == 22 else "" if nfc in UNNUMBERED else str(n)


def sections6(plc: bytes, main: bytes) -> tuple[list[dict], list[int]]:
    """(char_pos, new_page) of each section of versions 6 and 7, and which headers and footers it has."""
    n = max(0, (len(plc) - 4) // 16)
    out, named = [], []
    for i in range(n):
        at = u32(plc, 4 * (n + 1) + 12 * i + 2)
        own = {op: byte(arg, 0) for op, arg in steps6(main[at + 2 : at + 2 + u16(main, at)])} if at != 0xFFFFFFFF else {}
        out.append({"char_pos": u32(plc, 4 * i), "new_page": own.get(BREAK6) not in (0, 1)})
        named.append(own.get(HEADERS6, 0))
    return out, named


def header_places(plc: bytes, ver: int, spec: int, sections: list[int]) -> list[tuple[int, str, int, int]]:
    """(section, kind, from, to) of headers and footers, counted from the start of their own text.

    Version 8 has twelve places a section, of which the first six count.  Before, a section has those that its specification
    names; the document's come first."""
    ends = [u32(plc, 4 * i) for i in range(len(plc) // 4 - 1)] if len(plc) >= 8 else []
    ends.append(ends[-1] if ends else 0)
    if len(ends) <= 2:
        return []
    named = []
    if ver >= 8:
        named = [(i // 12, HEADERS[i % 12], i) for i in range(len(ends) - 1) if i % 12 < 6]
    else:
        order = [(n, kind) for n, bits in enumerate(sections or [0]) for bit, kind in HEADER_BITS6.items() if bits >> bit & 1]
        first = sum(spec >> bit & 1 for bit in DOCUMENT_BITS6)
        named = [(n, kind, first + i) for i, (n, kind) in enumerate(order) if first + i < len(ends) - 1]
    return [(n, kind, ends[i], ends[i + 1]) for n, kind, i in named]


def header_texts(found: list[dict], places: list[tuple[int, str, int, int]]) -> list[dict]:
    """Headers and footers as lines: the paragraphs of their list that begin inside each place; an empty place has no text."""
    own = [(p["char_pos"], "".join(r["text"] for r in p["runs"]) or " ".join(p["cells"])) for p in found if p["list_id"] == "hdrftr"]
    known = {(n, kind): "\n".join(t for cp, t in own if a <= cp < z) if a != z else None for n, kind, a, z in places}
    last = max((n for n, _ in known), default=-1)
    return [{"section": n, "kind": kind, "text": known.get((n, kind))} for n in range(last + 1) for kind in HEADERS]


def note_places(stream: bytes, at: int, n: int) -> set[int]:
    count = (n - 4) // 6
    return {u32(stream, at + 4 * i) for i in range(count)} if n >= 10 else set()


def parse_ole(raw: bytes, out: Parsed, keep: int, text_compat: bool) -> None:
    box = Container(raw)
    main = box.stream("WordDocument")
    if main is None:
        sheet = box.find("Workbook") or box.find("Book")
        raise Refused("spreadsheet" if sheet else "not_a_document", "a spreadsheet" if sheet else "no document stream")
    if len(main) < 4096:
        raise Refused("text_too_small", "the document stream is too small")
    head = main[:768]
    ver, out.old_mac = version(head)
    out.version = ver
    if ver < 6:
        raise Refused("version", "unexpected version in a container")
    flags = u16(head, 0x0A)
    out.fast_saved = bool(flags & 4)
    if flags & 0x100:
        raise Refused("encrypted", "encrypted documents aren't supported")
    page = codepages.code_page(ver, out.old_mac)
    lengths = text_lengths(head, ver)
    part = lambda s, at: s[u32(head, at) : u32(head, at) + u32(head, at + 4)] if s else b""
    if ver >= 8:
        table = box.stream("1Table" if flags & 0x200 else "0Table") or b""
        pieces, mods = piece_table(part(table, 0x1A2), False, True)
        paps, chps, stride = part(table, 0x102), part(table, 0xFA), 13
        notes = note_places(table, u32(head, 0xAA), u32(head, 0xAE)), note_places(table, u32(head, 0x20A), u32(head, 0x20E))
        extra = (0, 0), (0, 0)
    else:
        pieces, mods = piece_table(part(main, 0x160), u16(head, 0) in FAR_EAST, False) if out.fast_saved else ([], [])
        paps, chps, stride = part(main, 0xC0), part(main, 0xB8), 7
        notes = note_places(main, u32(head, 0x68), u32(head, 0x6C)), note_places(main, u32(head, 0x1D2), u32(head, 0x1D6))
        extra = (u16(head, 0x18C), u16(head, 0x190)), (u16(head, 0x18A), u16(head, 0x18E))
    if not pieces:
        wide = ver < 8 and u16(head, 0) in FAR_EAST
        pieces = [(u32(head, 0x18), sum(lengths) * (2 if wide else 1), wide, 0)]

    styles = tables8.stylesheet(part(table, 0xA2)) if ver >= 8 else {}

    @cache
    def base_run(istd: int) -> Run:
        run = Run(istd=istd)
        for style in tables8.chain(styles, istd):
            run = paragraph_run(istd, style.paragraph, ver, run)
        return run

    @cache
    def style_of(istd: int, raw: bytes) -> int:
        base = 0
        for style in tables8.chain(styles, istd):
            base = character_style(style.character, ver, base)
        return character_style(raw, ver, base)

    def paragraph(p: bytes, at: int) -> Run:
        if at <= 0 or at >= 511:
            return base_run(0)
        n = 2 * p[at]
        if ver >= 8 and n == 0:
            at += 1
            n = 2 * p[at]
        istd = u16(p, at + 1) if ver >= 8 else p[at + 1]
        return paragraph_run(istd, p[at + 3 : at + 1 + n], ver, base_run(istd))

    def character(p: bytes, at: int) -> bytes:
        return bytes(p[at + 1 : at + 1 + p[at]]) if 0 < at < 511 else b""

    paragraphs = run_list(pages(main, paps, ver, *extra[0]), stride, paragraph)
    characters = run_list(pages(main, chps, ver, *extra[1]), 1, character)
    out.paragraphs, out.pieces = assemble(main, pieces, lengths, page, paragraphs, characters, notes, keep, style_of, text_compat)
    if ver >= 8:
        levels = tables8.list_levels(table, u32(head, 0x2E2), u32(head, 0x2E6))
        number_lists(out.paragraphs, levels, tables8.list_overrides(part(table, 0x2EA)))
        out.sections = tables8.sections(part(table, 0xCA), main)
        properties, plc, named = tables8.document_properties(part(table, 0x192)), part(table, 0xF2), []
    else:
        number_old_lists(out.paragraphs)
        out.sections, named = sections6(part(main, 0x88), main)
        properties, plc = tables8.document_properties(part(main, 0x150)), part(main, 0xB0)
    places = header_places(plc, ver, properties.get("hdrftr_spec", 0), named)
    base = sum(lengths[:2])
    out.headers = header_texts(out.paragraphs, [(n, kind, base + a, base + z) for n, kind, a, z in places])
    out.summary = property_set(box.stream("\x05SummaryInformation"), SUMMARY) | property_set(box.stream("\x05DocumentSummaryInformation"), MORE)
    out.summary |= properties
    out.summary["lid"] = u16(head, 0x3C) if ver >= 8 and flags & 0x4000 else u16(head, 6)


def parse_flat(raw: bytes, out: Parsed, keep: int, text_compat: bool) -> None:
    """DOS, Windows 1 and 2, and Macintosh files: one run of text in the file itself."""
    out.version, out.old_mac = version(raw)
    lengths: list[int] = []
    if out.guess == 0:
        out.fast_saved = bool(raw[0x75] & 2)
        start, n = 128, u32(raw, 0x0E) - 128
    elif out.guess == 2:
        flags = u16(raw, 0x0A)
        out.fast_saved = bool(flags & 4)
        if flags & 0x100:
            raise Refused("encrypted", "encrypted documents aren't supported")
        lengths = text_lengths(raw, out.version)
        start, n = u32(raw, 0x18), sum(lengths)
    else:
        if len(raw) < 256:
            raise Refused("text_too_small", "the file is too small")
        out.fast_saved = bool(raw[0x0A] & 0x20)
        start, stop = struct.unpack_from(">2I", raw, 0x14)
        n = stop - start
    if out.fast_saved:
        raise Refused("fast_saved", "fast-saved documents of this version aren't supported")
    if n < 0 or start + n > len(raw):
        raise Refused("damaged", "the text reaches beyond the file")
    out.paragraphs, out.pieces = assemble(raw, [(start, n, False, 0)], lengths or [n], codepages.code_page(out.version, out.old_mac), keep=keep)


def parse(raw: bytes | None, show_hidden: bool = False, show_removed: bool = False, text_compat: bool = False) -> Parsed:
    """Everything that is read from one file.  text_compat: only styles, not runs, hide, remove or capitalise text."""
    out, raw = Parsed(), raw or b""
    out.guess = guess(raw)
    keep = (HIDDEN if show_hidden else 0) | (DELETED if show_removed else 0)
    try:
        if out.guess < 0:
            kind = "rtf" if raw.startswith(b"{\\rtf1") else "wordperfect" if raw.startswith(b"\xffWPC") else "not_a_document"
            raise Refused(kind, {"rtf": "a rich text file", "wordperfect": "a WordPerfect file"}.get(kind, "not a document of a known kind"))
        (parse_ole if out.guess == 6 else parse_flat)(raw, out, keep, text_compat)
    except Refused as e:
        out.error_code, out.error_msg = e.code, str(e)
    except (Damaged, struct.error, IndexError, ValueError) as e:
        out.error_code, out.error_msg = "damaged", str(e)
    if out.error_code:
        out.paragraphs, out.pieces, out.sections, out.headers = [], [], [], []
    return out
