"""Positions: of headers, pictures and data in a file, of pages in a document, and the widths and heights of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import display_width
from scriptorium.functions.units import CHAR, leading, millipoints_to_draw
from scriptorium.operators.relations import first_match, locate, running_start

#: Style numbers that no list has: the invalid one, none, and the user's own.
NO_STYLE = (0xFFFF, 0x0FFF, 0x0FFE)
#: Languages of DOS code pages, and of the country codes of version 1; others are American English.
CODEPAGE_LANGUAGES = {850: 0x0809, 862: 0x040D, 866: 0x0419}
COUNTRY_LANGUAGES = {
    1: 0x0409, 2: 0x0C0C, 31: 0x0413, 33: 0x040C, 34: 0x040A, 36: 0x040E, 39: 0x0410, 44: 0x0809,
    45: 0x0406, 46: 0x041F, 47: 0x0414, 48: 0x0415, 49: 0x0407, 351: 0x0816, 358: 0x040B,
}
AMERICAN = 0x0409
#: Lists whose characters make a document's length.
COUNTED = ("text", "footnote", "endnote", "textbox", "hdrtextbox")
#: Lists without a style of their own to print.
UNSTYLED = ("hdrftr", "macro", "annotation")


def located_best(points: DataFrame, pieces: DataFrame, key: list[str], position: str, start: str, length: str, carried: list[str]) -> DataFrame:
    """`locate`, and for places that no piece holds but one ends at: the start of the piece after that one."""
    w = Window.partitionBy(*key).orderBy(start)
    after = pieces.select(*key, (F.col(start) + F.col(length)).alias("_end"), *[F.lead(c).over(w).alias(f"_{c}") for c in carried], F.lead(start).over(w).alias("_next"))
    after = after.filter(F.col("_next").isNotNull()).groupBy(*key, "_end").agg(F.min_by(F.struct(*[f"_{c}" for c in carried]), "_next").alias("_after"))
    found = locate(points, pieces, key, position, start, length, carried)
    joined = found.join(after, [found[k].eqNullSafe(after[k]) for k in key] + [found[position] == after["_end"]], "left")
    guess = F.col("delta").isNull() & F.col("_after").isNotNull()
    return joined.select(*[found[c] for c in points.columns], *[F.when(guess, F.col(f"_after._{c}")).otherwise(found[c]).alias(c) for c in carried], F.when(guess, F.lit(0)).otherwise(found["delta"]).cast("long").alias("delta"))


def offset_to_position(points: DataFrame, blocks: DataFrame, key: list[str], offset: str, order: list[str], length: str, char_pos: str) -> DataFrame:
    """Character position of an offset into a list's blocks, which follow each other in `order`."""
    numbered = running_start(blocks, key, order, length, "_start").select(*key, "_start", F.col(length).alias("_length"), F.col(char_pos).alias("_base"))
    return locate(points, numbered, key, offset, "_start", "_length", ["_base"]).select(*points.columns, (F.col("_base") + F.col("delta")).alias(char_pos))


def list_of_style(paragraphs: DataFrame, lists: DataFrame, style: str, order: list[str], value: str) -> DataFrame:
    """`value` of the first list of a paragraph's style."""
    known = lists.filter(~F.col(style).isin(*NO_STYLE))
    return first_match(paragraphs, known, [style], order, value, None)


def codepage_language(codepage: Column) -> Column:
    return _looked_up(CODEPAGE_LANGUAGES, codepage)


def country_language(code: Column) -> Column:
    """Version 1 has a country's code below 999 where later ones have the language."""
    return F.when(code < 999, _looked_up(COUNTRY_LANGUAGES, code)).otherwise(code).cast("int")


def _looked_up(table: dict[int, int], key: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key.cast("int")), F.lit(AMERICAN))


def all_zero(content: Column) -> Column:
    """Whether a block holds nothing but zero bytes."""
    return F.regexp_like(F.hex(content), F.lit("^0*$"))


def valid_blocks(rows: DataFrame, offset: str, length: str, is_unicode: str) -> DataFrame:
    """Pieces with a place and a length; a length of 16-bit text is even."""
    bad = (F.col(offset) < 0) | (F.col(length) <= 0) | (F.col(is_unicode) & (F.col(length) % 2 != 0))
    return rows.filter(~F.coalesce(bad, F.lit(True)))


def string_width(text: Column) -> Column:
    """Millipoints of a text in a fixed pitch."""
    return display_width(text) * CHAR


def line_width(parts: Column) -> Column:
    """Millipoints of a line's parts."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, t: n + string_width(t))


def net_width(parts: Column) -> Column:
    """The same without white space at the end of the last part."""
    return line_width(F.slice(parts, 1, F.size(parts) - 1)) + string_width(F.regexp_replace(F.element_at(parts, -1), "[ \\t-\\r]+$", ""))


def height(lines: DataFrame, key: list[str], size: str, ends_paragraph: str) -> DataFrame:
    """(key, height) in draw units of headers or footers: the leading of each line by its largest font, and a fifth of the size of the
    sign that ends a paragraph."""
    own = leading(F.col(size)) + F.when(F.col(ends_paragraph), millipoints_to_draw(F.col(size).cast("long") * 200)).otherwise(0)
    return lines.groupBy(*key).agg(F.sum(own).cast("long").alias("height"))


def page_numbers(lines: DataFrame, key: list[str], order: list[str], new_section: str, per_page: int) -> DataFrame:
    """`lines` with their section, page and whether the page is the section's first: pages hold `per_page` lines, and a section begins
    a new one."""
    w = Window.partitionBy(*key).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    rows = lines.withColumn("section", (F.row_number().over(w) > 1) & F.col(new_section))
    rows = rows.withColumn("section", F.sum(F.col("section").cast("long")).over(up_to))
    rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "section").orderBy(*order)) - 1)
    rows = rows.withColumn("page", F.sum((F.col("_n") % per_page == 0).cast("long")).over(up_to))
    return rows.withColumn("first_in_section", F.col("_n") < per_page).drop("_n")
