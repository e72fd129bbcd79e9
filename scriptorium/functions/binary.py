"""Numbers and records in binary columns, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Records of a walk that are kept apart, so that adding one doesn't copy all.
NEAR = 64
#: Operand bytes by the three highest bits of an opcode of version 8; six has a count.
OPERANDS8 = {0: 1, 1: 1, 2: 2, 3: 4, 4: 2, 5: 2, 7: 3}
COUNTED8, TABS8 = 6, 0xC615
#: Bytes that follow an opcode of versions 6 and 7.  Those not named have one.
TWO = (2, 16, 17, 18, 19, 21, 22, 26, 27, 28, 30, 31, 32, 33, 34, 35, 36, 38, 39, 40, 41, 42, 43, 45, 46, 47, 48, 49, 69, 72, 80, 93, 96, 97, 99, 101, 105, 106, 107, 109, 110, 121, 122, 123, 124,
       140, 141, 144, 145, 148, 149, 154, 155, 156, 157, 160, 161, 164, 165, 166, 167, 168, 169, 170, 171, 182, 183, 184, 189, 195, 197, 198)
THREE, FOUR, FIVE, TWELVE = (73, 95, 136, 137), (20, 70, 74, 192, 194, 196, 200), (68, 193, 199), (120, 187)
#: The next byte says how many follow it; of 23 it is 255 if counts of tabs say so.
COUNTED6, TABS6 = (3, 12, 15, 81, 103, 108, 188, 190, 191), 23


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def u8(content: Column, at: Column) -> Column:
    """The byte at a place, counted from 0; beyond the end 0."""
    return F.coalesce(F.ascii(F.decode(F.substring(content, (at + 1).cast("int"), 1), "ISO-8859-1")), F.lit(0))


def u16(content: Column, at: Column) -> Column:
    """Two bytes, the low one first."""
    return u8(content, at) + u8(content, at + 1) * 256


def u32(content: Column, at: Column) -> Column:
    return u16(content, at).cast("long") + u16(content, at + 2).cast("long") * 65536


def walk(content: Column, size_at: Callable[[Column], Column], least: int) -> Column:
    """array<struct<at, size>>: records that follow each other to the content's end; size_at(at) is the size of the one at a place.

    least: bytes of the smallest record, so that the fold has enough steps.  A size below one counts as one.
    """
    length = F.coalesce(F.length(content), F.lit(0))
    none = F.expr("cast(array() as array<struct<at:int,size:int>>)")
    zero = F.struct(F.lit(0).alias("at"), none.alias("near"), F.expr("cast(array() as array<array<struct<at:int,size:int>>>)").alias("far"))

    def step(a: Column, _: Column) -> Column:
        def added(size: Column) -> Column:
            near = F.concat(a["near"], F.array(F.struct(a["at"].alias("at"), size.alias("size"))))
            full = F.size(a["near"]) >= NEAR - 1
            return F.struct((a["at"] + size).alias("at"), F.when(full, none).otherwise(near).alias("near"), F.when(full, F.concat(a["far"], F.array(near))).otherwise(a["far"]).alias("far"))

        return F.when(a["at"] >= length, a).otherwise(let(F.greatest(size_at(a["at"]), F.lit(1)).cast("int"), added))

    steps = F.when(length > 0, F.sequence(F.lit(1), F.ceil(length / least).cast("int"))).otherwise(F.expr("cast(array() as array<int>)"))
    return F.aggregate(steps, zero, step, lambda a: F.concat(F.flatten(a["far"]), a["near"]))


def records8(content: Column) -> Column:
    """array<struct<at, size, op>>: the property records of version 8; opcodes have two bytes."""

    def size_at(at: Column) -> Column:
        def by_op(op: Column) -> Column:
            gone = u8(content, at + 3)
            tabs = gone * 4 + u8(content, at + 4 + gone * 4) * 3 + 5
            count = u8(content, at + 2)
            counted = F.when((op == TABS8) & (count == 255), tabs).otherwise(count + 3)
            top = F.shiftright(op, 13)
            fixed = F.element_at(F.create_map(*[F.lit(x) for k, n in OPERANDS8.items() for x in (k, n + 2)]), top)
            return F.when(top == COUNTED8, counted).otherwise(fixed)

        return let(u16(content, at), by_op)

    return F.transform(walk(content, size_at, 3), lambda r: F.struct(r["at"].alias("at"), r["size"].alias("size"), u16(content, r["at"]).alias("op")))


def records6(content: Column) -> Column:
    """array<struct<at, size, op>>: the property records of versions 6 and 7; opcodes have one byte."""
    fixed = F.create_map(*[F.lit(x) for n, ops in ((3, TWO), (4, THREE), (5, FOUR), (6, FIVE), (13, TWELVE)) for op in ops for x in (op, n)])

    def size_at(at: Column) -> Column:
        def by_op(op: Column) -> Column:
            count, gone = u8(content, at + 1), u8(content, at + 2)
            tabs = gone * 4 + u8(content, at + 3 + gone * 4) * 3 + 4
            return F.when((op == TABS6) & (count == 255), tabs).when(op.isin(*COUNTED6, TABS6), count + 2).otherwise(F.coalesce(F.try_element_at(fixed, op), F.lit(2)))

        return let(u8(content, at), by_op)

    return F.transform(walk(content, size_at, 2), lambda r: F.struct(r["at"].alias("at"), r["size"].alias("size"), u8(content, r["at"]).alias("op")))


def body(content: Column, at: Column, size: Column) -> Column:
    return F.substring(content, (at + 1).cast("int"), size.cast("int"))
