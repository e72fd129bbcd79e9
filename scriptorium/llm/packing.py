"""Packing into length buckets of least padding.

The histogram holds every length there is, however many rows: k different lengths need k (k + 1) / 2 tokens at least, so 100 TB of
bytes have at most 14 million and the driver's share stays small.  A dynamic program over all of them chooses the boundaries that
minimise the padding of all rows; the best predecessor of a boundary is found on the lower hull of lines, in linear time a bucket, with
whole numbers.  Inside a bucket
rows are numbered without gathering the bucket in one task: SHARDS shards by hash are counted, a prefix sum over at
most buckets * SHARDS counts gives each shard its offset, and rows are numbered inside (bucket, shard).  A batch takes
as many rows as fit the token budget at the bucket's padded length.

Defined results: a null text has length 1 (its end mark) like an empty one; a row longer than the budget gets a batch
of its own; ties in length share a bucket; repeated rows take a place each; no rows give no rows; `pack` replaces columns that have the
names of its own (bucket, bucket_len, batch, place, padding, and some that begin with an underscore), `pack_documents` reads none but
doc_id and text.
"""

from __future__ import annotations

from itertools import accumulate
from operator import mul

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import cut

BUCKETS = 16
#: Padded tokens in a batch.
BUDGET = 262_144
SHARDS = 1024


def byte_tokens(text: Column) -> Column:
    """Tokens under a byte-level vocabulary: one for each UTF-8 byte, and an end mark."""
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def boundaries(length: list[int], count: list[int], buckets: int) -> list[int]:
    """Upper bounds of at most `buckets` buckets, of least padding; length: the different lengths, ascending; count: their rows."""
    n = len(length)
    if not n:
        return []
    rows, tokens = [0, *accumulate(count)], [0, *accumulate(map(mul, length, count))]
    # the last bucket of lengths i to j - 1 costs length[j - 1] * (rows[j] - rows[i]) - (tokens[j] - tokens[i])
    least: list[int | None] = [0] + [None] * n
    came = []
    for _ in range(min(buckets, n)):
        now: list[int | None] = [0] + [None] * n
        back, hull, best = [0] * (n + 1), [], 0  # hull: (slope, intercept, i) of the lines that are least somewhere
        for j in range(1, n + 1):
            if least[j - 1] is not None:
                line = (-rows[j - 1], least[j - 1] + tokens[j - 1], j - 1)
                while len(hull) - best > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                    hull.pop()
                hull.append(line)
            x = length[j - 1]
            while best + 1 < len(hull) and hull[best + 1][0] * x + hull[best + 1][1] <= hull[best][0] * x + hull[best][1]:
                best += 1
            if hull:
                slope, intercept, back[j] = hull[best]
                now[j] = slope * x + intercept + x * rows[j] - tokens[j]
        least = now
        came.append(back)
    out, j = [], n
    for back in reversed(came):
        if not j:
            break
        out.append(length[j - 1])
        j = back[j]
    return out[::-1]


def pack(rows: DataFrame, key: str = "doc_id", length: str = "n_tokens", buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """`rows` with bucket, bucket_len, batch (numbered in its bucket), place (in its batch) and padding."""
    found = rows.groupBy(F.col(length).cast("long").alias("length")).agg(F.count(F.lit(1)).alias("n")).orderBy("length").toArrow()  # a row for each different length
    ends = boundaries(found["length"].to_pylist(), found["n"].to_pylist(), buckets)
    bucket = F.lit(0)
    for e in ends:
        bucket = bucket + (F.col(length) > e).cast("int")
    ends_column = F.array(*[F.lit(e).cast("long") for e in ends]) if ends else F.array(F.lit(1).cast("long"))
    dealt = rows.withColumn("bucket", bucket).withColumn("_shard", F.pmod(F.xxhash64(key, length), F.lit(SHARDS)).cast("int"))
    counts = dealt.groupBy("bucket", "_shard").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy("bucket").orderBy("_shard").rowsBetween(Window.unboundedPreceding, -1)
    offsets = cut(counts.select("bucket", "_shard", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before")))  # at most buckets * SHARDS rows
    own = F.row_number().over(Window.partitionBy("bucket", "_shard").orderBy(key, length)) - 1
    placed = dealt.withColumn("_own", own).join(F.broadcast(offsets), ["bucket", "_shard"])
    size = F.greatest(F.lit(1).cast("long"), F.expr(f"{int(budget)}L div bucket_len"))
    at = F.col("_own") + F.col("_before")
    return (
        placed.withColumn("bucket_len", F.element_at(ends_column, F.col("bucket") + 1))
        .withColumn("_size", size)
        .withColumn("batch", F.floor(at / F.col("_size")).cast("long"))
        .withColumn("place", F.pmod(at, F.col("_size")).cast("int"))
        .withColumn("padding", F.col("bucket_len") - F.col(length))
        .drop("_shard", "_own", "_before", "_size")
    )


def pack_documents(docs: DataFrame, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    return pack(docs.select(F.col("doc_id").cast("long"), byte_tokens(F.col("text").cast("string")).alias("n_tokens")), buckets=buckets, budget=budget)
