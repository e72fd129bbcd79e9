"""Code pages of 8-bit text: Python's codecs with a few entries of their own."""

from __future__ import annotations

from functools import cache

#: Entries that differ from Python's codecs.
CHANGES = {
    "cp1250": {0x81: "?", 0x83: "?", 0x88: "?", 0x90: "?", 0x98: "?"},
    "cp1251": {0x98: "ó"},
    "cp1252": {0x81: "?", 0x8D: "?", 0x8F: "?", 0x90: "?", 0x9D: "?"},
    "mac_roman": {0xBD: "Ω", 0xDB: "¤", 0xF0: "?"},
    "cp850": {},
}


def code_page(version: int, old_mac: bool, encoding: str = "latin1") -> str:
    if old_mac:
        return "mac_roman"
    if version == 0:
        return "cp850"
    return {"latin2": "cp1250", "cyrillic": "cp1251"}.get(encoding, "cp1252")


@cache
def table(name: str) -> str:
    """256 characters of a code page; control characters stay."""
    out = [bytes([i]).decode(name, "replace").replace("�", "?") if i >= 0x80 else chr(i) for i in range(256)]
    for at, c in CHANGES[name].items():
        out[at] = c
    return "".join(out)


def decode(raw: bytes, name: str) -> str:
    return raw.decode("latin-1").translate(table(name))


def decode_wide(raw: bytes, name: str) -> str:
    """16-bit text; codes from 0x80 to 0x9f are of the 8-bit page."""
    text = raw.decode("utf-16-le", "replace")
    return text.translate({i: table(name)[i] for i in range(0x80, 0xA0)}) if any("\x80" <= c < "\xa0" for c in text) else text
