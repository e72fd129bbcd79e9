"""Joins, islands, running values and set operations over a document's relations.

All of them are keyed by a document (or another key) and ordered by an explicit column; none gathers more than a key's own rows
in a task, and range joins are running values over a union, so nothing is compared pairwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.rounds import cut

BLOCK = 512


def coalesce_runs(df: DataFrame, key: list[str], order: list[str], start: str, length: str, same: list[str]) -> DataFrame:
    """Adjacent pieces that continue each other, alike in `same`, become one: (key, same, start, length, n_pieces)."""
    w = Window.partitionBy(*key).orderBy(*order)
    new = F.lag(start).over(w).isNull() | (F.lag(F.col(start) + F.col(length)).over(w) != F.col(start))
    for c in same:
        new = new | ~F.lag(c).over(w).eqNullSafe(F.col(c))
    island = F.sum(new.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    return df.withColumn("_island", island).groupBy(*key, "_island", *same).agg(F.min(start).alias(start), F.sum(length).alias(length), F.count(F.lit(1)).alias("n_pieces")).drop("_island")


def keep_last_of_run(df: DataFrame, key: list[str], order: list[str], offset: str) -> DataFrame:
    """Of consecutive rows with one offset the last."""
    after = F.lead(offset).over(Window.partitionBy(*key).orderBy(*order))
    return df.withColumn("_next", after).filter(F.col("_next").isNull() | (F.col("_next") != F.col(offset))).drop("_next")


def running_start(df: DataFrame, key: list[str], order: list[str], length: str, name: str = "start") -> DataFrame:
    """The sum of the lengths before each row."""
    w = Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(name, F.coalesce(F.sum(length).over(w), F.lit(0)).cast("long"))


def split_by_totals(df: DataFrame, length: str, start: str, bounds: list[tuple[str, Column, Column]]) -> DataFrame:
    """Cut pieces at the bounds of lists: for each list (name, from, to) the part of a piece inside it; empty parts go."""
    parts = F.array(*[F.struct(F.lit(n).alias("list"), F.greatest(F.col(start), a).alias("from"), F.least(F.col(start) + F.col(length), b).alias("to")) for n, a, b in bounds])
    return df.withColumn("_p", F.explode(F.filter(parts, lambda p: p["from"] < p["to"]))).select(*df.columns, F.col("_p.list").alias("list_id"), F.col("_p.from").alias("from_pos"), F.col("_p.to").alias("to_pos"))


def rounded_blocks(length: Column, is_last: Column) -> Column:
    """Lengths of all but the last block go up to a multiple of BLOCK."""
    return F.when(~is_last & (length % BLOCK != 0), (F.floor(length / BLOCK) + 1) * BLOCK).otherwise(length).cast("long")


def locate(points: DataFrame, pieces: DataFrame, key: list[str], position: str, start: str, length: str, carried: list[str]) -> DataFrame:
    """Range join: each point gets `carried` of the piece that holds it, or null.

    Points and piece starts are merged in order and the last start is carried forward, so a key's rows are sorted once.
    """
    fields = F.struct(F.col(start).alias("_s"), F.col(length).alias("_l"), *carried)
    left = points.select(*key, F.col(position).alias("_at"), F.lit(1).alias("_kind"), F.struct(*points.columns).alias("_point"), F.lit(None).cast(pieces.select(fields.alias("x")).schema["x"].dataType).alias("_piece"))
    right = pieces.select(*key, F.col(start).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(points.select(F.struct(*points.columns).alias("x")).schema["x"].dataType).alias("_point"), fields.alias("_piece"))
    w = Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    held = left.unionByName(right).withColumn("_held", F.last("_piece", ignorenulls=True).over(w)).filter("_kind = 1")
    inside = F.col("_at") < F.col("_held._s") + F.col("_held._l")
    return held.select("_point.*", *[F.when(inside, F.col(f"_held.{c}")).alias(c) for c in carried], F.when(inside, F.col("_at") - F.col("_held._s")).alias("delta"))


def as_of(left: DataFrame, right: DataFrame, key: list[str], order: str, value: str, default) -> DataFrame:
    """The last `value` of `right` at or before each row of `left`, else the default."""
    a = left.select(*key, F.col(order).alias("_at"), F.lit(1).alias("_kind"), F.struct(*left.columns).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_value"))
    b = right.select(*key, F.col(order).alias("_at"), F.lit(0).alias("_kind"), F.lit(None).cast(left.select(F.struct(*left.columns).alias("x")).schema["x"].dataType).alias("_row"), F.col(value).alias("_value"))
    w = Window.partitionBy(*key).orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    return a.unionByName(b).withColumn("_found", F.last("_value", ignorenulls=True).over(w)).filter("_kind = 1").select("_row.*", F.coalesce("_found", F.lit(default)).alias(value))


def exact_or_near(left: DataFrame, right: DataFrame, key: list[str], level: str, value: str) -> DataFrame:
    """`value` of the row of the same key and level, else of level 0."""
    exact = right.select(*key, F.col(level).alias("_level"), F.col(value).alias("_exact"))
    near = right.filter(F.col(level) == 0).select(*key, F.col(value).alias("_near"))
    return left.withColumn("_level", F.col(level)).join(exact, [*key, "_level"], "left").join(near, key, "left").select(*left.columns, F.coalesce("_exact", "_near").alias(value))


def first_match(left: DataFrame, right: DataFrame, key: list[str], order: list[str], value: str, default) -> DataFrame:
    """`value` of the first of the matching rows, else the default."""
    first = right.groupBy(*key).agg(F.min_by(value, F.struct(*order)).alias("_v"))
    return left.join(first, key, "left").select(*left.columns, F.coalesce("_v", F.lit(default)).alias(value))


def carry_forward(value: Column, key: list[str], order: list[str]) -> Column:
    return F.last(value, ignorenulls=True).over(Window.partitionBy(*key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))


def effective(explicit: Column, default: Column, at_end: Column, key: list[str], order: list[str]) -> Column:
    """What holds at each row: an explicit value; at a paragraph's end the default takes over unless there is one; else the last."""
    return carry_forward(F.when(explicit.isNotNull(), explicit).when(at_end, default), key, order)


def paired_rows(df: DataFrame, key: list[str], order: list[str], opens: Column, closes: Column, at: str) -> DataFrame:
    """(key, start, end): from the first opening after the last close to the next close."""
    w = Window.partitionBy(*key).orderBy(*order)
    number = F.sum(closes.cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)) - closes.cast("long")
    grouped = df.withColumn("_n", number).withColumn("_o", opens).withColumn("_c", closes).groupBy(*key, "_n")
    return grouped.agg(F.min(F.when(F.col("_o"), F.col(at))).alias("start"), F.max(F.when(F.col("_c"), F.col(at))).alias("end")).filter("start is not null and end is not null and start <= end").select(*key, "start", "end")


def list_sequence(df: DataFrame, in_list: Column, key: list[str], order: list[str]) -> DataFrame:
    """`df` with list_no: how many lists have begun so far."""
    w = Window.partitionBy(*key).orderBy(*order)
    df = df.withColumn("_began", (in_list & ~F.coalesce(F.lag(in_list).over(w), F.lit(False))).cast("long"))
    return df.withColumn("list_no", F.sum("_began").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("_began")


def inherited(df: DataFrame, key: list[str], section: str, kinds: list[str]) -> DataFrame:
    """Headers and footers: in the first section odd and even ones fall back to the first page's, later ones to the section before.

    `kinds`: columns of texts named hdr_even, hdr_odd, ftr_even, ftr_odd, hdr_first and ftr_first.
    """
    w = Window.partitionBy(*key).orderBy(section)
    first = F.row_number().over(w) == 1
    df = df.withColumn("_first", first)
    for kind in kinds:
        side = kind[:3]
        if not kind.endswith("first"):
            df = df.withColumn(kind, F.when(F.col("_first"), F.coalesce(F.col(kind), F.col(f"{side}_first"))).otherwise(F.col(kind)))
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    return df.select(*[c for c in df.columns if c not in kinds and c != "_first"], *[F.last(k, ignorenulls=True).over(up_to).alias(k) for k in kinds])


def note_marks(df: DataFrame, key: list[str], order: list[str], kind: str, roman) -> DataFrame:
    """Footnotes count [1], [2], endnotes [i], [ii]; notes of unknown kind are [?]."""
    n = F.row_number().over(Window.partitionBy(*key, kind).orderBy(*order))
    return df.withColumn("mark", F.when(F.col(kind) == "footnote", F.concat(F.lit("["), n, F.lit("]"))).when(F.col(kind) == "endnote", F.concat(F.lit("["), roman(n), F.lit("]"))).otherwise("[?]"))


def note_kind(found_in: Column, n_footnotes: Column, n_endnotes: Column) -> Column:
    """With one kind of notes only, all are of it; else where the reference was found, a footnote before an endnote."""
    return F.when((n_footnotes == 0) & (n_endnotes == 0), "unknown").when(n_endnotes == 0, "footnote").when(n_footnotes == 0, "endnote").otherwise(F.coalesce(found_in, F.lit("unknown")))


def base_chain(styles: DataFrame, key: list[str], style: str, base: str, value: str, circular: str | None = None) -> DataFrame:
    """Each style's value, or that of the nearest style it is based on; null at the end of a chain without one.

    Pointers double until none is left that could still find a value, so a chain of n styles takes log n rounds, whatever n is.  Only styles that
    others are based on take part; the others look their base up at the end.  Styles whose bases run in a circle without a value keep a
    pointer for ever: after enough rounds for a chain through all that take part they are unresolved, and the column `circular`, if named,
    says so.  All joins are by shuffle, so no round sends a table through the driver.
    """
    rows = styles.select(*key, style, F.col(base).alias("_b"), F.col(value).alias("_v"))
    on = [*key, "_b"]
    bases = rows.filter("_v is null and _b is not null").select(*key, F.col("_b").alias(style)).distinct()
    df = cut(rows.join(bases.hint("merge"), [*key, style], "left_semi"))
    n, reach = None, 1
    while True:
        up = df.select(*key, F.col(style).alias("_b"), F.col("_b").alias("_b2"), F.col("_v").alias("_v2"))
        joined = df.join(up.hint("merge"), on, "left").select(*key, style, F.when(F.col("_v").isNull(), F.col("_b2")).alias("_b"), F.coalesce("_v", "_v2").alias("_v"))
        df, reach = cut(joined.withColumn("_b", F.when(F.col("_v").isNull(), F.col("_b")))), reach * 2
        state = df.agg(F.count(F.lit(1)).alias("n"), F.count("_b").alias("open")).first()
        n = n or state.n
        if not state.open or reach > n:
            break
    found = df.select(*key, F.col(style).alias("_b"), F.col("_v").alias("_v2"), F.col("_b").isNotNull().alias("_open"))
    out = rows.withColumn("_b", F.when(F.col("_v").isNull(), F.col("_b"))).join(found.hint("merge"), on, "left")
    return out.select(*key, style, F.coalesce("_v", "_v2").alias(value), *([F.coalesce("_open", F.lit(False)).alias(circular)] if circular else []))


def concatenated(lists: list[tuple[str, DataFrame]]) -> DataFrame:
    """Lists one after another, with their place in `list_order`."""
    out = None
    for i, (name, df) in enumerate(lists):
        part = df.withColumn("list_id", F.lit(name)).withColumn("list_order", F.lit(i).cast("long"))
        out = part if out is None else out.unionByName(part)
    return out


def list_lengths(pieces: DataFrame, key: list[str], length: str, wide: Column) -> DataFrame:
    """Characters of each list: 16-bit pieces count half their bytes."""
    return pieces.groupBy(*key).agg(F.sum(F.when(wide, F.floor(F.col(length) / 2)).otherwise(F.col(length))).cast("long").alias("n_chars"))
