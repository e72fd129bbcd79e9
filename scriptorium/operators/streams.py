"""Several streams of properties merged by offset."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merged(streams: dict[str, DataFrame], key: list[str], at: str, end: str | None = None) -> DataFrame:
    """(key, at, until, one struct a stream): a segment between any two neighbouring bounds of the streams, with what is in force in it.

    streams: (key, at, values...) each; a row holds from its offset to the stream's next one.  Of rows of one stream at one offset the last by its
    values counts.  Before a stream's first row its struct is null.  `end`, a stream without values, closes the last segments;
    without it `until` of the last one is null.  All streams are united and sorted once by key and offset.
    """
    types = {n: df.select(F.struct(*[c for c in df.columns if c not in (*key, at)]).alias("x")).schema["x"].dataType for n, df in streams.items() if n != end}
    rows = []
    for name, df in streams.items():
        held = F.struct(*[c for c in df.columns if c not in (*key, at)]) if name != end else None
        rows.append(df.select(*key, F.col(at).alias(at), *[(held if n == name else F.lit(None).cast(t)).alias(n) for n, t in types.items()]))
    bounds = reduce(DataFrame.unionByName, rows).repartition(*key)  # the only shuffle: both steps below keep it
    order = Window.partitionBy(*key).orderBy(at)
    # rows of one offset lie side by side: the greatest of each stream there, then the last so far
    point = bounds.groupBy(*key, at).agg(*[F.max(n).alias(n) for n in types])
    up_to = order.rowsBetween(Window.unboundedPreceding, 0)
    out = point.select(*key, F.col(at), F.lead(at).over(order).alias("until"), *[F.last(n, ignorenulls=True).over(up_to).alias(n) for n in types])
    return out.filter(F.col("until").isNotNull()) if end else out
