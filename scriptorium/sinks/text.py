"""Plain text: a document's lines in order, each with its end."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Millipoints of space that show as a blank line.
GAP = 6000
#: Two inches in millipoints, and a character's width.
RULE, CHAR = 144_000, 6400


def blank_lines(twips: Column) -> Column:
    return F.when(twips * 50 >= GAP, 1).otherwise(0)


def separator() -> Column:
    """The line between a text and its notes."""
    return F.repeat(F.lit("-"), F.lit((RULE + CHAR // 2) // CHAR))


def joined(lines: DataFrame, key: list[str], order: str, text: str) -> DataFrame:
    """(key, text): the lines of each key, in order; a document is one row in the end, so its lines meet in one task."""
    rows = lines.groupBy(*key).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), F.col(text).alias("t")))).alias("l"))
    return rows.select(*key, F.concat(F.array_join(F.transform("l", lambda x: x["t"]), "\n"), F.lit("\n")).alias("text"))


def banner(path: Column) -> Column:
    """The line before each of several files."""
    rule = F.lit(":" * 14)
    return F.concat(rule, F.lit("\n"), F.regexp_extract(path, "[^/]*$", 0), F.lit("\n"), rule)


def save(texts: DataFrame, path: str, text: str = "text") -> None:
    texts.select(F.col(text).alias("value")).write.option("lineSep", "\n").text(path)
