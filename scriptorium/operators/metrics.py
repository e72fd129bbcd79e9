"""Widths of text by the metrics of fonts.

A font's metrics are an array: the width of each character code in thousandths of the font's size.  Arrays are joined to text by font and
emphasis; a line's width and its breaks are sums over the array's entries, without a row a character.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CODES = 256
#: Width of a character that the metrics don't have.
MISSING = 600


def read_metrics(spark: SparkSession, path: str) -> DataFrame:
    """(font, widths) of the Adobe font metrics files under a path: one row a font, widths[code] in thousandths; 0 for codes it lacks."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(F.col("value"), F.col("_metadata.file_path").alias("path"))
    name = lines.select("path", F.regexp_extract("value", r"^FontName\s+(\S+)", 1).alias("font")).filter("font <> ''")
    code = F.regexp_extract("value", r"^C\s+(-?\d+)\s*;", 1)
    width = F.regexp_extract("value", r";\s*WX\s+(-?[\d.]+)", 1)
    known = lines.filter(code != "").select("path", code.cast("int").alias("code"), F.round(width.cast("double")).cast("int").alias("width")).filter(F.col("code").between(0, CODES - 1))
    by_font = known.join(name, "path").groupBy("font", "code").agg(F.max("width").alias("width")).groupBy("font").agg(F.map_from_entries(F.collect_list(F.struct("code", "width"))).alias("m"))  # 256 entries at most
    return by_font.select("font", F.transform(F.sequence(F.lit(0), F.lit(CODES - 1)), lambda c: F.coalesce(F.try_element_at("m", c), F.lit(0))).alias("widths"))


def with_metrics(rows: DataFrame, fonts: DataFrame, on: list[str]) -> DataFrame:
    """`rows` with the widths of their font and emphasis; null where there are none.  Fonts: as many rows as a system has, 2 KB each."""
    return rows.join(fonts.select(*on, "widths"), on, "left")


def code_width(char: Column, widths: Column) -> Column:
    return F.coalesce(F.get(widths, F.ascii(char)), F.lit(MISSING))


def relative(text: Column, widths: Column) -> Column:
    """Width of a text in thousandths of the font's size."""
    return F.aggregate(F.split(F.coalesce(text, F.lit("")), ""), F.lit(0).cast("long"), lambda n, c: n + F.when(c == "", 0).otherwise(code_width(c, widths)))


def absolute(width: Column, size: Column) -> Column:
    """Millipoints of a width in thousandths; the size is in half points."""
    return F.floor((width * size + 1) / 2).cast("long")


def text_width(text: Column, widths: Column, size: Column) -> Column:
    """Millipoints of a text."""
    return absolute(relative(text, widths), size)


def line_width(parts: Column) -> Column:
    """Millipoints of a line's parts, array<struct<text, widths, size>>."""
    return F.aggregate(parts, F.lit(0).cast("long"), lambda n, p: n + text_width(p["text"], p["widths"], p["size"]))


def net_width(parts: Column) -> Column:
    """The same without white space at the end of the last part."""
    last = F.element_at(parts, -1)
    return F.when(F.size(parts) == 0, 0).otherwise(line_width(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))) + text_width(F.regexp_replace(last["text"], "[ \\t-\\r]+$", ""), last["widths"], last["size"])).cast("long")


def broken(text: Column, widths: Column, size: Column, room: Column | int) -> Column:
    """array<struct<text, width>>: the lines of a paragraph, broken at blanks so that each is at most `room` millipoints wide.

    A word that is wider has a line of its own.  Lines take words while the running width, blanks included, fits.
    """
    room = F.lit(room) if isinstance(room, int) else room
    return F.arrow_udf(_broken, "array<struct<text:string,width:bigint>>")(F.coalesce(text, F.lit("")), widths, size.cast("long"), room.cast("long"))


def _broken(text: pa.Array, widths: pa.Array, size: pa.Array, room: pa.Array) -> pa.Array:
    return pa.array([lines_of(*row) for row in zip(text.to_pylist(), widths.to_pylist(), size.to_pylist(), room.to_pylist(), strict=True)], pa.list_(pa.struct([("text", pa.string()), ("width", pa.int64())])))


def lines_of(text: str, widths: list[int | None] | None, size: int | None, room: int | None) -> list[dict]:
    """The lines of one text by running sums of its characters' widths: a search for each line.  What can't be measured is broken at each blank."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    known = np.array([MISSING if w is None else w for w in widths or []] + [MISSING], np.int64)
    total = np.append(0, np.cumsum(known[np.minimum(codes, len(known) - 1)]))
    blanks = np.flatnonzero(codes == 32)
    ends = np.append(blanks, len(codes))
    at = total[ends]
    can = size is not None and room is not None and len(widths or []) > 32 and widths[32] is not None
    # the greatest width that fits: (width * size + 1) // 2 <= room
    most = (int(room * 2 // size) if size > 0 else np.iinfo(np.int64).max // 2 if room >= 0 else -1) if can else -1
    lines, i, start = [], 0, 0
    rising = not (known < 0).any()
    while i < len(ends):
        if not can:
            j = i
        elif rising:
            j = max(int(np.searchsorted(at, total[start] + most, "right")) - 1, i)
        else:
            over = np.flatnonzero(at[i + 1 :] - total[start] > most)
            j = i + int(over[0]) if len(over) else len(ends) - 1
        end = int(ends[j])
        lines.append({"text": text[start:end], "width": None if size is None else (int(at[j] - total[start]) * size + 1) // 2})
        i, start = j + 1, end + 1
    return lines
