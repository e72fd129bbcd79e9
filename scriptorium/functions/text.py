"""Characters and strings, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters that never reach the output.
IGNORED = "\x00\x03\x04\x05\x08\x0a\x1f‧"
#: Characters and what shows for them as US-ASCII in 8-bit output; empty: nothing does.
LOOKALIKES = {
    "«": "<", "»": ">", "ƒ": "f", "ˆ": "^", "˜": "~", "Χ": "X", "υ": "v", "\u2000": " ", "\u2001": " ", "\u2002": " ", "\u2003": " ", "\u2004": " ", "\u2005": " ", "\u2006": " ",
    "\u2007": " ", "\u2008": " ", "\u2009": " ", "\u200a": "", "\u200b": "", "\u200c": "", "\u200d": "", "\u200e": "", "\u200f": "", "‐": "-", "‑": "-", "‒": "-", "–": "-", "—": "-",
    "―": "-", "‖": "|", "‗": "_", "‘": "'", "’": "'", "‚": "'", "‛": "'", "“": '"', "”": '"', "„": '"', "‟": '"', "†": "+", "‡": "#", "•": ".",
    "‣": "<", "․": ".", "‥": ".", "…": "...", "\u202a": "", "\u202b": "", "\u202c": "", "\u202d": "", "\u202e": "", "\u202f": " ", "′": "'", "″": '"', "‹": "<", "›": ">",
    "‿": "-", "⁄": "/", "€": "E", "№": "N", "™": "", "K": "K", "←": "<", "↑": "^", "→": ">", "↓": "v", "∑": "S", "−": "-", "∕": "/", "∗": "*",
    "∙": ".", "∶": ":", "∼": "~", "─": "-", "│": "|", "┌": "+", "┐": "+", "└": "+", "┘": "+", "├": "+", "┤": "+", "┬": "+", "┴": "+", "┼": "+",
    "═": "-", "║": "|", "╔": "+", "╗": "+", "╚": "+", "╝": "+", "╠": "+", "╣": "+", "╦": "+", "╩": "+", "╬": "+", "░": " ", "▒": " ", "▓": " ",
    "■": "+", "□": "O", "○": "O", "♣": ".", "\ufeff": "",
}
#: Characters of the symbol font as Unicode; those of SAME stand for themselves, all others for nothing known.
SAME = ' !#%&()+,./0123456789:;<>?[]_{|}°±'
SYMBOLS = {
    0x22: "∀", 0x24: "∃", 0x27: "∍", 0x2A: "∗", 0x2D: "−", 0x3D: "’", 0x40: "”", 0x41: "“", 0x42: "Β", 0x43: "Χ", 0x44: "Δ", 0x45: "Ε", 0x46: "Φ", 0x47: "Γ",
    0x48: "Η", 0x49: "Ι", 0x4A: "ϑ", 0x4B: "Κ", 0x4C: "Λ", 0x4D: "Μ", 0x4E: "Ν", 0x4F: "Ο", 0x50: "Π", 0x51: "Θ", 0x52: "Ρ", 0x53: "Σ", 0x54: "Τ", 0x55: "Υ",
    0x56: "ς", 0x57: "Ω", 0x58: "Ξ", 0x59: "Ψ", 0x5A: "Ζ", 0x5C: "∴", 0x5E: "⊥", 0x61: "α", 0x62: "β", 0x63: "χ", 0x64: "δ", 0x65: "ε", 0x66: "φ", 0x67: "γ",
    0x68: "η", 0x69: "ι", 0x6A: "ϕ", 0x6B: "κ", 0x6C: "λ", 0x6D: "μ", 0x6E: "ν", 0x6F: "ο", 0x70: "π", 0x71: "θ", 0x72: "ρ", 0x73: "σ", 0x74: "τ", 0x75: "υ",
    0x76: "ϖ", 0x77: "ω", 0x78: "ξ", 0x79: "ψ", 0x7A: "ζ", 0x7E: "∼", 0x93: "•", 0xA0: "€", 0xA1: "ϒ", 0xA2: "′", 0xA3: "≤", 0xA4: "⁄", 0xA5: "∞", 0xA6: "ƒ",
    0xA7: "♣", 0xA8: "♦", 0xA9: "♥", 0xAA: "♠", 0xAB: "↔", 0xAC: "←", 0xAD: "↑", 0xAE: "→", 0xAF: "↓", 0xB2: "″", 0xB3: "≥", 0xB4: "×", 0xB5: "∝", 0xB6: "∂",
    0xB7: "•", 0xB8: "÷", 0xB9: "≠", 0xBA: "≡", 0xBB: "≈", 0xBC: "…", 0xBD: "|", 0xBE: "⎯", 0xBF: "↵", 0xC0: "ℵ", 0xC1: "ℑ", 0xC2: "ℜ", 0xC3: "℘", 0xC4: "⊗",
    0xC5: "⊕", 0xC6: "∅", 0xC7: "∩", 0xC8: "∪", 0xC9: "⊃", 0xCA: "⊇", 0xCB: "⊄", 0xCC: "⊂", 0xCD: "⊆", 0xCE: "∈", 0xCF: "∉", 0xD0: "∠", 0xD1: "∇", 0xD2: "®",
    0xD3: "©", 0xD4: "™", 0xD5: "∏", 0xD6: "√", 0xD7: "⋅", 0xD8: "¬", 0xD9: "∧", 0xDA: "∨", 0xDB: "⇔", 0xDC: "⇐", 0xDD: "⇑", 0xDE: "⇒", 0xDF: "⇓", 0xE0: "⋄",
    0xE1: "〈", 0xE2: "®", 0xE3: "©", 0xE4: "™", 0xE5: "∑", 0xE6: "⎛", 0xE7: "⎜", 0xE8: "⎝", 0xE9: "⎡", 0xEA: "⎢", 0xEB: "⎣", 0xEC: "⎧", 0xED: "⎨", 0xEE: "⎩",
    0xEF: "⎪", 0xF1: "〉", 0xF2: "∫", 0xF3: "⌠", 0xF4: "⎮", 0xF5: "⌡", 0xF6: "⎞", 0xF7: "⎟", 0xF8: "⎠", 0xF9: "⎤", 0xFA: "⎥", 0xFB: "⎦", 0xFC: "⎫", 0xFD: "⎬",
    0xFE: "⎭",
}
#: The symbol font's characters lie in the private area from here on.
PRIVATE = 0xF000
#: Characters of the private area by their code points, as shown: those that aren't known are question marks.
SHOWN = {PRIVATE + c: SYMBOLS.get(c, chr(c) if chr(c) in SAME else "?") for c in range(0x20, 0x100)}
#: First and last characters that take two columns.
WIDE_RANGES = (
    (0x1100, 0x115F), (0x2E80, 0x3009), (0x300C, 0x3019), (0x301C, 0x303E), (0x3040, 0xA4CF), (0xAC00, 0xD7A3),
    (0xF900, 0xFAFF), (0xFE30, 0xFE6F), (0xFF00, 0xFF5F), (0xFFE0, 0xFFE6), (0x20000, 0x2FFFF),
)
#: First and last characters of no width beside marks: soft hyphen, formats and medial Hangul.
ZERO_RANGES = ((0x1160, 0x11FF), (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0xFEFF, 0xFEFF), (0xFFF9, 0xFFFB))


def ranges(pairs: tuple, code: str) -> str:
    """Ranges as the inside of a regular expression's class; `code` formats a character."""
    return "".join(code.format(a) + "-" + code.format(z) for a, z in pairs)


WIDE = "[" + ranges(WIDE_RANGES, "\\x{{{:x}}}") + "]"
ZERO = r"[\p{Mn}\p{Me}" + ranges(ZERO_RANGES, "\\x{{{:x}}}") + "]"


def upper_of(c: str) -> str | None:
    """The one capital of a character, if there is one: sharp s, y with diaeresis and the micro sign have none in 8 bits."""
    found = c.upper() if len(c.upper()) == 1 else c.title()
    return found if len(found) == 1 and found != c and c not in "ßÿµ" else None


#: Capitals of the basic plane by their small letters, from the Unicode data.
UPPER = {n: up for n in range(0x10000) if not 0xD800 <= n < 0xE000 and (up := upper_of(chr(n)))}


def strip_fields(text: Column) -> Column:
    """Field instructions go, results stay; any of the two end marks ends an instruction, so fields don't nest."""
    return F.regexp_replace(F.regexp_replace(text, "\x13[^\x14\x15]*[\x14\x15]?", ""), "[\x14\x15]", "")


def strip_ignored(text: Column) -> Column:
    return F.translate(text, IGNORED, "")


def lookalikes(text: Column) -> Column:
    """Typographic characters as US-ASCII, an ellipsis as three dots."""
    single = {c: x for c, x in LOOKALIKES.items() if len(x) == 1}
    gone = "".join(c for c, x in LOOKALIKES.items() if not x)
    out = F.translate(text, "".join(single) + gone, "".join(single.values()))
    for c, x in LOOKALIKES.items():
        if len(x) > 1:
            out = F.replace(out, F.lit(c), F.lit(x))
    return out


def private_symbols(text: Column) -> Column:
    """Characters that a symbol font puts in the private area, as Unicode."""
    return F.translate(text, "".join(map(chr, SHOWN)), "".join(SHOWN.values()))


def upper(text: Column) -> Column:
    """Upper case, one character for one."""
    return F.translate(text, "".join(map(chr, UPPER)), "".join(UPPER.values()))


def nbsp_to_space(text: Column) -> Column:
    return F.translate(text, " ", " ")


def basename(path: Column) -> Column:
    """What follows the last slash; an empty or null path gives `null`."""
    return F.when(F.coalesce(path, F.lit("")) == "", F.lit("null")).otherwise(F.regexp_extract(path, "[^/]*$", 0))


def xml_escape(text: Column) -> Column:
    """Quotes stay as they are."""
    return F.replace(F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


#: Characters that are blanks in strings of PostScript and of PDF.
PS_BLANK, PDF_BLANK = "[\\x00-\\x1f\\x7f-\\x8b]", "[\\x00-\\x1f\\x7f\\x81-\\x8b]"


def ps_escape(text: Column, blank: str = PS_BLANK) -> Column:
    """An 8-bit text as a string: parentheses and backslashes get a backslash, control characters are blanks, others beyond ASCII octal."""
    plain = F.regexp_replace(F.regexp_replace(text, r"([()\\])", r"\\$1"), blank, " ")
    octal = lambda c: F.when(F.ascii(c).between(0x80, 0xFF), F.concat(F.lit("\\"), F.lpad(F.conv(F.ascii(c), 10, 8), 3, "0"))).otherwise(c)
    return F.when(F.regexp_like(plain, F.lit("[\\x80-\\xff]")), F.array_join(F.transform(F.split(plain, ""), octal), "")).otherwise(plain)


def fold_full_width(text: Column) -> Column:
    """Full-width ASCII as ASCII, for 8-bit output."""
    return F.translate(text, "".join(map(chr, range(0xFF01, 0xFF5F))), "".join(map(chr, range(0x21, 0x7F))))


def display_width(text: Column) -> Column:
    """Columns on a terminal: wide characters take two; marks and control characters none."""
    wide, zero = F.regexp_count(text, F.lit(WIDE)), F.regexp_count(text, F.lit(ZERO))
    control = F.regexp_count(text, F.lit("[\\x00-\\x1f\\x7f-\\x9f]"))
    return (F.length(text) + wide - zero - control).cast("long")


def trimmed(text: Column) -> Column:
    """A summary's string: without blanks at its ends; null if nothing is left."""
    return F.nullif(F.trim(text), F.lit(""))


def has_text(text: Column) -> Column:
    return F.regexp_like(text, F.lit("[^ \\t-\\r]"))


def box_has_text(text: Column) -> Column:
    """Whether a text box holds more than breaks and blanks."""
    return F.regexp_replace(text, "[\\x00\\r\\n\\f\\t\\x0b ]", "") != ""


def bullet(unicode_output: bool) -> str:
    return "•" if unicode_output else "."
