"""Pages filled by height.

Each page takes the lines that fit, so where a page begins depends on all pages before.  Instead of a fold over a document's lines, every
line is asked where the page would end if it began there: a range search over running heights, one sort.  That makes a chain of
pages from each section's first line, which `followed` ranks by doubling.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.operators.chains import followed


def paged(lines: DataFrame, key: list[str], order: list[str], section: str, height: str, room: int | Column) -> DataFrame:
    """`lines` with page (from 1, through a key's sections in order), page_in_section (from 1) and top (height above it on its page).

    room: height of a page's text, one for a section.  A section begins a page; a line higher than the room has a page of its own.
    Heights aren't negative; a null one is 0.
    """
    part = [*key, section]
    w = Window.partitionBy(*part).orderBy(*order)
    up_to = w.rowsBetween(Window.unboundedPreceding, 0)
    tall = F.coalesce(F.col(height), F.lit(0))
    rows = lines.withColumn("_i", (F.row_number().over(w) - 1).cast("long")).withColumn("_end", F.sum(tall).over(up_to)).withColumn("_start", F.col("_end") - tall)
    rows = rows.withColumn("_room", room if isinstance(room, Column) else F.lit(room))
    # the first later line whose end is beyond the room: of the line ends above the limit the nearest, so limits follow the ends in falling order
    limits = rows.select(*part, (F.col("_start") + F.col("_room")).alias("_at"), F.lit(0).alias("_kind"), F.col("_i"), F.lit(None).cast("long").alias("_j"))
    ends = rows.select(*part, F.col("_end").alias("_at"), F.lit(1).alias("_kind"), F.col("_i"), F.col("_i").alias("_j"))
    falling = Window.partitionBy(*part).orderBy(F.desc("_at"), F.asc("_kind"), F.desc("_i")).rowsBetween(Window.unboundedPreceding, 0)
    beyond = limits.unionByName(ends).withColumn("_next", F.last("_j", ignorenulls=True).over(falling)).filter("_kind = 0")
    count = rows.groupBy(*part).agg(F.count(F.lit(1)).alias("_n"))
    step = F.greatest(F.col("_next"), F.col("_i") + 1)  # null, and so i + 1, if all the rest fits: the chain ends
    entries = beyond.join(count, part).select(*part, F.col("_i").alias("block"), F.when(F.col("_next").isNotNull() & (step < F.col("_n")), step).alias("next"))
    chains = followed(entries, count.select(*part, F.lit(0).cast("long").alias("start")), part)
    tops = chains.select(*part, F.col("block").alias("_i"), F.lit(1).alias("_new"))
    marked = rows.join(tops, [*part, "_i"], "left")
    whole = Window.partitionBy(*key).orderBy(section, "_i").rowsBetween(Window.unboundedPreceding, 0)
    inner = Window.partitionBy(*part).orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)
    out = marked.withColumn("page", F.sum(F.coalesce("_new", F.lit(0)).cast("long")).over(whole)).withColumn("page_in_section", F.sum(F.coalesce("_new", F.lit(0)).cast("long")).over(inner))
    first = F.last(F.when(F.col("_new") == 1, F.col("_start")), ignorenulls=True).over(inner)
    return out.withColumn("top", F.col("_start") - first).select(*lines.columns, "page", "page_in_section", "top")
