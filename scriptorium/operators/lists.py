"""List labels and indents, tabs, sections and headers on pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.numbers import BULLET, numbered
from scriptorium.functions.text import display_width

CHAR = 6400


def label(number: Column, nfc: Column, mark: Column, left: Column) -> Column:
    """Number, mark of up to three characters and a blank; nothing without a left indent."""
    text = F.concat(F.when(nfc == BULLET, F.lit("")).otherwise(numbered(number, nfc)), F.substring(mark, 1, 3), F.lit(" "))
    return F.when(left > 0, text).otherwise(F.lit(""))


def indent(left: Column, shown: Column) -> Column:
    """Characters before a label, which hangs to the left of the text."""
    return F.greatest(F.floor((left * 50 - F.length(shown) * CHAR) / CHAR), F.lit(0)).cast("long")


def list_mark(code: Column) -> Column:
    """A list's mark in plain text: printable ASCII as it is, else a full stop."""
    return F.when(code.between(0x21, 0x7E), F.char(code)).otherwise(F.lit("."))


def on_page(pages: DataFrame, sections: DataFrame, key: list[str], section: str, first: Column, odd: Column, kinds: list[str]) -> DataFrame:
    """`pages` with the header and footer that each shows: `kinds` of its section, or of the last section if it has a later number.

    sections: (key, section, a column for each of `kinds`, hdr_first to ftr_even); sections are numbered from 0.
    """
    last = sections.groupBy(*key).agg(F.max(section).alias("_last"))
    held = sections.select(*key, F.col(section).alias("_section"), *[F.col(k).alias(f"_{k}") for k in kinds])
    found = pages.join(last, key, "left").withColumn("_section", F.greatest(F.least(section, "_last"), F.lit(0))).join(held, [*key, "_section"], "left")
    shown = lambda header: F.coalesce(*[F.when(shown_kind(first, odd, F.lit(header)) == k, F.col(f"_{k}")) for k in kinds if k.startswith("hdr") == header])
    return found.select(*pages.columns, shown(True).alias("header"), shown(False).alias("footer"))


def section_at(breaks: DataFrame, sections: DataFrame, key: list[str], position: str, char_pos: str, value: str) -> DataFrame:
    """At each break the section that begins there or right after it; else that of the break before."""
    a = sections.select(*key, F.col(char_pos).alias("_p"), F.col(value).alias("_here"))
    b = sections.select(*key, (F.col(char_pos) - 1).alias("_p"), F.col(value).alias("_next"))
    from scriptorium.operators.relations import carry_forward

    found = breaks.withColumn("_p", F.col(position)).join(a, [*key, "_p"], "left").join(b, [*key, "_p"], "left")
    return found.withColumn("_v", F.coalesce("_here", "_next")).select(*breaks.columns, carry_forward(F.col("_v"), key, [position]).alias(value))


def shown_kind(first_in_section: Column, odd_page: Column, header: Column) -> Column:
    """Which of a section's headers or footers a page shows."""
    side = F.when(header, F.lit("hdr")).otherwise(F.lit("ftr"))
    return F.concat(side, F.when(first_in_section, F.lit("_first")).when(odd_page, F.lit("_odd")).otherwise(F.lit("_even")))


def property_modifier(mod: Column, lists: DataFrame | None = None) -> tuple[Column, Column]:
    """Kind and number of a piece's property modifier: none, an inline code with its operand, or an index into the lists."""
    kind = F.when(mod == 0, "none").when(mod % 2 == 0, "inline").otherwise("index")
    return kind, F.when(mod != 0, F.shiftright(mod, 1)).cast("long")


def expanded(text: Column, tab_chars: int) -> Column:
    """A text whose tabs are blanks up to the next stop, at least one each; wide characters take two columns, and each line begins anew."""

    def line(value: Column) -> Column:
        pieces = F.split(value, "\t")
        first = F.struct(F.get(pieces, F.lit(0)).alias("text"), display_width(F.get(pieces, F.lit(0))).alias("column"))

        def step(a: Column, piece: Column) -> Column:
            blanks = expanded_tab(a["column"], tab_chars)
            return F.struct(F.concat(a["text"], blanks, piece).alias("text"), (a["column"] + F.length(blanks) + display_width(piece)).alias("column"))

        folded = F.aggregate(F.slice(pieces, 2, F.greatest(F.size(pieces) - 1, F.lit(0))), first, step, lambda a: a["text"])
        return F.when(F.contains(value, F.lit("\t")), folded).otherwise(value)

    return F.when(F.contains(text, F.lit("\t")), F.array_join(F.transform(F.split(text, "\n"), line), "\n")).otherwise(text)


def expanded_tab(column: Column, tab_chars: int) -> Column:
    """Blanks from a column to the next multiple of a tab."""
    return F.repeat(F.lit(" "), (F.lit(tab_chars) - column % tab_chars).cast("int"))
