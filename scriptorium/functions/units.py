"""Measures, clamps and fixed tables, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Width and height of paper sizes in points.
PAPERS = {
    "10x14": (720, 1008), "a3": (842, 1191), "a4": (595, 842), "a5": (420, 595), "b4": (729, 1032), "b5": (516, 729), "executive": (540, 720),
    "folio": (612, 936), "legal": (612, 1008), "letter": (612, 792), "note": (540, 720), "quarto": (610, 780), "statement": (396, 612), "tabloid": (792, 1224),
}
#: Red, green and blue of the font colours 0 to 16.
COLOURS = ["000000", "000000", "0000ff", "00ffff", "00ff00", "ff00ff", "ff0000", "ffff00", "ffffff", "000080", "008080", "008000", "800080", "800000", "808000", "808080", "c0c0c0"]
#: Language tags of whole identifiers, then of their low bytes.
LANGUAGES = {
    0x0404: "zh_TW", 0x0804: "zh_CN", 0x0C04: "zh_HK", 0x1004: "zh_SG", 0x0807: "de_CH", 0x0409: "en_US", 0x0809: "en_GB", 0x0C09: "en_AU", 0x080A: "es_MX",
    0x080C: "fr_BE", 0x0C0C: "fr_CA", 0x100C: "fr_CH", 0x0810: "it_CH", 0x0813: "nl_BE", 0x0416: "pt_BR", 0x081A: "sr", 0x0C1A: "sr", 0x081D: "sv_FI",
}
PRIMARY = {
    0x01: "ar", 0x02: "bg", 0x03: "ca", 0x04: "zh", 0x05: "cs", 0x06: "da", 0x07: "de", 0x08: "el", 0x09: "en", 0x0A: "es", 0x0B: "fi", 0x0C: "fr", 0x0D: "he",
    0x0E: "hu", 0x0F: "is", 0x10: "it", 0x11: "ja", 0x12: "ko", 0x13: "nl", 0x14: "no", 0x15: "pl", 0x16: "pt", 0x17: "rm", 0x18: "ro", 0x19: "ru", 0x1A: "hr",
    0x1B: "sk", 0x1C: "sq", 0x1D: "sv", 0x1E: "th", 0x1F: "tr", 0x20: "ur", 0x21: "id", 0x22: "uk", 0x23: "be", 0x24: "sl", 0x25: "et", 0x26: "lv", 0x27: "lt",
    0x29: "fa", 0x2A: "vi", 0x2B: "hy", 0x2C: "az", 0x2D: "eu", 0x2F: "mk", 0x36: "af", 0x37: "ka", 0x38: "fo", 0x39: "hi", 0x3E: "ms", 0x3F: "kk",
}
MIN_WIDTH, DEFAULT_WIDTH, MAX_WIDTH = 45, 76, 145
#: Millipoints of a default character.
CHAR = 6400
TAB = 36_000


def truncated(a: Column, b: Column | int) -> Column:
    """Quotient of integers towards zero."""
    b = F.lit(b) if isinstance(b, int) else b
    return F.when((a < 0) != (b < 0), -F.floor(F.abs(a) / F.abs(b))).otherwise(F.floor(F.abs(a) / F.abs(b))).cast("long")


def twips_to_millipoints(x: Column) -> Column:
    return x * 50


def twips_to_points(x: Column) -> Column:
    return x / F.lit(20.0)


def chars_to_millipoints(x: Column) -> Column:
    return x * CHAR


def millipoints_to_chars(x: Column) -> Column:
    return truncated(x + CHAR // 2, CHAR)


def draw_to_chars(x: Column) -> Column:
    return truncated(x + 2048, 4096)


def draw_to_millipoints(x: Column) -> Column:
    return truncated(x * 25 + 8, 16)


def millipoints_to_draw(x: Column) -> Column:
    return truncated(x * 16 + 12, 25)


def points_to_draw(x: Column) -> Column:
    return x * 640


def paper(name: Column, side: int) -> Column:
    """Width (0) or height (1) of a paper size, whatever its case; unknown names give null."""
    return F.element_at(F.create_map(*[F.lit(x) for k, v in PAPERS.items() for x in (k, v[side])]), F.lower(name)).cast("long")


def leading(half_points: Column) -> Column:
    """Line height in draw units of a font size in half points."""
    rate = F.when(half_points < 18, 112).when(half_points < 28, 124).when(half_points < 48, 104).otherwise(100)
    return truncated(millipoints_to_draw(half_points.cast("long") * 500 * rate) + 50, 100)


def colour(index: Column) -> Column:
    """RGB in hex; unknown colours are black."""
    known = F.array(*[F.lit(c) for c in COLOURS])
    return F.when(index.between(0, len(COLOURS) - 1), F.get(known, index.cast("int"))).otherwise(F.lit(COLOURS[0]))


def language(lid: Column) -> Column:
    """Tag of a language identifier; those below 999 are locales and give null."""
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    lid = lid.cast("int")
    return F.when((lid >= 999) & (lid != 0xFFFF), F.coalesce(F.element_at(table(LANGUAGES), lid), F.element_at(table(PRIMARY), lid.bitwiseAND(F.lit(0xFF)))))


def before_after(twips: Column, heading: Column) -> Column:
    """Space before or after a paragraph: negative ones are 0, at most 2160; a heading's is at least 120."""
    x = F.when(twips > 0x7FFF, 0).when(twips > 2160, 2160).otherwise(twips)
    return F.when(heading & (x < 120), 120).otherwise(x).cast("long")


def left_indent(twips: Column) -> Column:
    return F.greatest(twips, F.lit(0))


def right_indent(twips: Column) -> Column:
    return F.least(twips, F.lit(0))


def font_size(size: Column, small_caps: Column, script: Column) -> Column:
    """Half points of a run: small capitals 4/5, super- and subscript 2/3, between 8 and 240."""
    size = F.when(small_caps, truncated(size * 4, 5)).otherwise(size)
    size = F.when(script, truncated(size * 2, 3)).otherwise(size)
    return F.greatest(F.lit(8), F.least(F.lit(240), size)).cast("long")


def font_colour(index: Column) -> Column:
    """White would be invisible and becomes light gray."""
    return F.when(index == 8, 16).otherwise(index).cast("long")


def table_font_size(half_points: Column) -> Column:
    return F.greatest(F.lit(16), F.least(F.lit(20), truncated(half_points * 5, 6))).cast("long")


def style_number(stc: Column) -> Column:
    """Style index of a one-byte style code."""
    return F.when(stc == 222, 0x0FFF).when(stc.between(1, 9) | stc.between(246, 254), 255 - stc).otherwise(stc).cast("long")


def level_type(level: Column) -> Column:
    return F.when(level.between(1, 9), "outline").when(level == 10, "numbering").when(level == 11, "sequence").when(level == 12, "pause").otherwise("none")


def implies_list(istd: Column, version: Column, num_level: Column, list_index: Column) -> Column:
    return F.when(istd.between(1, 9), False).when(version < 8, num_level != 0).otherwise(list_index != 0)


def screen_width(chars: Column) -> Column:
    """Millipoints of a line; 0 is without end."""
    return F.when(chars == 0, F.lit(2**31 - 1)).otherwise(F.greatest(F.lit(MIN_WIDTH), F.least(F.lit(MAX_WIDTH), chars)) * CHAR).cast("long")


def column_chars(twips: Column, line_break: Column) -> Column:
    """Characters of a table column, less one for the bar, in a text of `line_break` characters a line."""
    wide = F.when((line_break == 0) | (line_break >= MAX_WIDTH), MAX_WIDTH).when(line_break <= MIN_WIDTH, MIN_WIDTH).otherwise(line_break)
    n = F.floor((twips * 50 * (wide.cast("double") / F.lit(float(DEFAULT_WIDTH))) + F.lit(CHAR / 2)) / F.lit(float(CHAR)))
    return F.when(n <= 1, 1).otherwise(n - 1).cast("long")


def tab_width(twips: Column) -> Column:
    """Millipoints of a default tab; 0 or missing is half an inch."""
    return F.coalesce(F.nullif(twips, F.lit(0)) * 50, F.lit(TAB)).cast("long")

