"""Marks of formatted text and DocBook, in column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import xml_escape


def marked(text: Column, bold: Column, italic: Column, underline: Column) -> Column:
    """*bold*, /italic/ and _underline_ in that order; blanks at a run's ends stay outside."""
    head = F.regexp_extract(text, "^ *", 0)
    body = F.trim(text)
    tail = F.regexp_extract(F.substring(text, F.length(head) + 1, F.length(text)), " *$", 0)
    on = lambda flag, c: F.when(flag, F.lit(c)).otherwise(F.lit(""))
    inner = F.concat(on(bold, "*"), on(italic, "/"), on(underline, "_"), body, on(underline, "_"), on(italic, "/"), on(bold, "*"))
    return F.when(body == "", text).otherwise(F.concat(head, inner, tail))


def emphasised(text: Column, bold: Column, italic: Column, underline: Column, strike: Column, raised: Column, lowered: Column) -> Column:
    """A run in DocBook: of several styles the first of bold, italic, underline and strikethrough counts."""
    body = xml_escape(text)
    role = F.when(bold, ' role="bold"').when(italic, "").when(underline, ' role="underline"').when(strike, ' role="strikethrough"')
    body = F.when(role.isNotNull(), F.concat(F.lit("<emphasis"), role, F.lit(">"), body, F.lit("</emphasis>"))).otherwise(body)
    return F.when(raised, F.concat(F.lit("<superscript>"), body, F.lit("</superscript>"))).when(lowered, F.concat(F.lit("<subscript>"), body, F.lit("</subscript>"))).otherwise(body)


def paragraph(runs: Column) -> Column:
    return F.concat(F.lit("<para>"), runs, F.lit("</para>"))


def column_points(twips: Column) -> Column:
    """Width of a column in points, at least one."""
    return F.format_string("%.2f", F.greatest(twips / F.lit(20.0), F.lit(1.0)))
