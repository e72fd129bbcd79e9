"""The text blocks of complex files: piece tables, and the property modifiers that pieces refer to.

A file's text information is a sequence of parts: property lists, counted from 0, then one table of pieces.  The parts are walked by a
fold over the bytes of one column; pieces and lists then are rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.binary import body, let, records6, records8, u8, u16, u32, walk

PADDING, PROPERTIES, TABLE = 0, 1, 2
#: Set in an offset of 8-bit text, which counts half bytes.
NARROW = 1 << 30
#: Opcodes that say that a paragraph is in a table, in a table in a table, that it ends a row, and columns' widths.
ROW8 = {"cell": (0x2416, 0x244B), "ends": (0x2417,), "widths": (0xD608,)}
ROW6 = {"cell": (24,), "ends": (25,), "widths": (190,)}


def parts(content: Column) -> Column:
    """array<struct<at, size, kind>>: paddings, property lists and the table; what follows the table, or an unknown kind, is one last part."""

    def size_at(at: Column) -> Column:
        def by_kind(kind: Column) -> Column:
            return F.when(kind == PADDING, 2).when(kind == PROPERTIES, u16(content, at + 1) + 3).otherwise(F.length(content) - at)

        return let(u8(content, at), by_kind)

    return F.transform(walk(content, size_at, 2), lambda p: F.struct(p["at"].alias("at"), p["size"].alias("size"), u8(content, p["at"]).alias("kind")))


def pieces(content: Column) -> Column:
    """array<struct<start, file_offset, length, is_unicode, prop_mod>> of a version 8 file: start and length count characters and bytes.

    Null if a part is of an unknown kind or the table is too short; empty if there is no table.
    """

    def of_table(t: Column) -> Column:
        return let(F.struct((t["at"] + 5).alias("first"), u32(content, t["at"] + 1).alias("size")), of_size)

    def of_size(t: Column) -> Column:
        first = t["first"]
        n = F.floor((t["size"] - 4) / 12).cast("int")

        def piece(i: Column) -> Column:
            at = first + (n + 1) * 4 + i * 8
            read = F.struct(u32(content, first + i * 4).alias("start"), u32(content, first + i * 4 + 4).alias("end"), u32(content, at + 2).alias("raw"), u16(content, at + 6).alias("mod"))
            return let(read, described)

        def described(x: Column) -> Column:
            chars, wide = x["end"] - x["start"], x["raw"].bitwiseAND(NARROW) == 0
            place = F.when(wide, x["raw"]).otherwise(F.floor(x["raw"].bitwiseAND(~NARROW) / 2))
            return F.struct(x["start"].alias("start"), place.cast("long").alias("file_offset"), F.when(wide, chars * 2).otherwise(chars).alias("length"), wide.alias("is_unicode"), x["mod"].alias("prop_mod"))

        return F.when(t["size"] < 4, F.lit(None)).otherwise(F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), piece)).otherwise(none))

    none = F.expr("cast(array() as array<struct<start:bigint,file_offset:bigint,length:bigint,is_unicode:boolean,prop_mod:int>>)")
    last = lambda p: F.filter(p, lambda x: ~x["kind"].isin(PADDING, PROPERTIES))
    return let(last(parts(content)), lambda p: F.when(F.size(p) == 0, none).when(F.get(p, F.lit(0))["kind"] == TABLE, of_table(F.get(p, F.lit(0)))))


def property_lists(content: Column) -> Column:
    """array<binary>: the property lists, in the order that modifiers count them."""
    lists = F.filter(parts(content), lambda p: p["kind"] == PROPERTIES)
    return F.transform(lists, lambda p: body(content, p["at"] + 3, p["size"] - 3))


def modifiers(rows: DataFrame, lists: DataFrame, key: list[str], mod: str, index: str = "index", properties: str = "properties") -> DataFrame:
    """`rows` with the property list that the modifier means: none for 0; for even numbers an opcode and its operand; for odd ones the list
    of half the number, null if the file has none."""
    held = lists.select(*key, F.col(index).alias("_index"), F.col(properties).alias("_list"))
    number = F.when(F.col(mod) % 2 == 1, F.shiftright(mod, 1))
    byte = lambda x: F.lpad(F.hex(x), 2, "0")
    inline = F.unhex(F.concat(byte(F.shiftright(F.col(mod).bitwiseAND(0xFE), 1)), byte(F.shiftright(F.col(mod), 8).bitwiseAND(0xFF))))
    joined = rows.withColumn("_index", number).join(held, [*key, "_index"], "left")
    return joined.select(*rows.columns, F.when(F.col(mod) % 2 == 1, F.col("_list")).when(F.col(mod) != 0, inline).alias(properties))


def row_info(properties: Column, version: int) -> Column:
    """What a property list says of its paragraph: end_of_row, not_end_of_row, cell, not_cell; null if nothing.

    A row ends where the list says so and has the widths of the columns.
    """
    ops, width, records = (ROW8, 2, records8(properties)) if version >= 8 else (ROW6, 1, records6(properties))
    said = lambda r, kind, value: F.exists(r, lambda x: x["op"].isin(*ops[kind]) & (u8(properties, x["at"] + width) % 2 == value))

    def found(r: Column) -> Column:
        widths = F.exists(r, lambda x: x["op"].isin(*ops["widths"]))
        return F.when(said(r, "ends", 1) & widths, "end_of_row").when(said(r, "ends", 0) & ~widths, "not_end_of_row").when(said(r, "cell", 1), "cell").when(said(r, "cell", 0), "not_cell")

    return let(records, found)


def row_ends(rows: DataFrame, own: Column, properties: Column, version: int) -> DataFrame:
    """`rows` with ends_row: by the row's own position, or by the modifier of a fast-saved piece."""
    return rows.withColumn("ends_row", own | F.coalesce(row_info(properties, version) == "end_of_row", F.lit(False)))
