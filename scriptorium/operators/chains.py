"""Chains of blocks: list ranking over the entries of allocation tables.

An entry says which block follows a block.  Chains are followed from all starts of all files at once by doubling: what a block's
2 ^ k-th successor is gives the 2 ^ (k + 1)-th, and ranks up to 2 ^ k give those up to 2 ^ (k + 1).  So a chain of a million blocks takes
20 rounds of equi-joins instead of a million steps, and each round is cut.  Blocks that several chains share have a row for each.

Null keys and blocks match nothing; a `next` that is null or negative ends a chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.binary import u32
from scriptorium.operators.rounds import cut

BIG, SMALL = 512, 64
#: Small blocks in a big one.
RATIO = BIG // SMALL
#: Block numbers in a file's header, where they begin there, and numbers in each block that continues them.
IN_HEADER, HEADER_AT, IN_BLOCK = 109, 0x4C, 127


def followed(entries: DataFrame, starts: DataFrame, key: list[str], block: str = "block", following: str = "next", start: str = "start") -> DataFrame:
    """(key, start, rank, block): the blocks of the chain from each start, from rank 0.

    entries: one row a block; starts: first blocks.  A chain goes on as far as entries are known.  One that runs in a circle ends after as many
    blocks as its key has entries; `damaged` names it.
    """
    entries = cut(entries.select(*key, block, following))
    size = entries.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    step = entries.filter(F.col(following) >= 0).select(*key, F.col(block).alias("_block"), F.col(following).cast("long").alias("_to"))
    known = entries.select(*key, F.col(block).cast("long").alias(block))
    found = starts.select(*key, F.col(start).cast("long").alias(start)).distinct().withColumn(block, F.col(start)).join(known, [*key, block], "left_semi")
    found = cut(found.join(size, key).select(*key, start, F.lit(0).cast("long").alias("rank"), block, "_n"))
    # only steps to blocks that have entries
    jump = cut(step.join(known.withColumnRenamed(block, "_to"), [*key, "_to"], "left_semi").select(*key, "_block", "_to"))
    reach, none = 1, lambda c: F.lit(None).cast("long").alias(c)
    while True:
        # chains so far and steps go on together: both take the steps that begin where they end
        both = found.select(*key, start, "rank", "_n", none("_from"), F.col(block).alias("_at"))
        both = both.unionByName(jump.select(*key, none(start), none("rank"), none("_n"), F.col("_block").alias("_from"), F.col("_to").alias("_at")))
        went = both.join(jump.withColumnRenamed("_block", "_at"), [*key, "_at"]).select(*key, start, (F.col("rank") + reach).alias("rank"), "_n", "_from", "_to")
        went = cut(went.filter("_from is not null or rank < _n"))
        more = went.filter("_from is null").select(*key, start, "rank", F.col("_to").alias(block), "_n")
        if more.isEmpty():
            break
        found = found.unionByName(more)  # one table a round
        jump, reach = went.filter("_from is not null").select(*key, F.col("_from").alias("_block"), "_to"), reach * 2
    return found.drop("_n")


def damaged(entries: DataFrame, chains: DataFrame, key: list[str], block: str = "block", following: str = "next", start: str = "start") -> DataFrame:
    """(key, start, reason) of chains that run in a circle, or reach a block that the table doesn't have."""
    last = chains.groupBy(*key, start).agg(F.max_by(block, "rank").alias(block), F.count(F.lit(1)).alias("_n"), F.count_distinct(block).alias("_distinct"))
    next_of = last.join(entries.select(*key, block, F.col(following).alias("_next")), [*key, block]).filter("_next >= 0")
    known = entries.select(*key, F.col(block).alias("_next"), F.lit(True).alias("_known"))
    return next_of.join(known, [*key, "_next"], "left").select(*key, start, F.when(F.col("_known").isNull(), "outside").otherwise("circle").alias("reason"))


def read(chains: DataFrame, contents: DataFrame, key: list[str], size: int, offset: Column, length: Column, block: str = "block", content: str = "content", start: str = "start") -> DataFrame:
    """(key, start, content): `length` characters, or bytes, from `offset` on of each chain; null if the chain is shorter.

    offset and length: over the columns of `chains`.  Only the blocks in question are joined.
    """
    wanted = chains.withColumn("_from", offset.cast("long")).withColumn("_n", length.cast("long"))
    wanted = wanted.filter((F.col("rank") >= F.floor(F.col("_from") / size)) & (F.col("rank") * size < F.col("_from") + F.col("_n")))
    rows = wanted.join(contents.select(*key, block, F.col(content).alias("_content")), [*key, block])
    skip = F.greatest(F.col("_from") - F.col("rank") * size, F.lit(0))
    left = F.least(F.col("_from") + F.col("_n") - F.col("rank") * size, F.lit(size)) - skip
    part = F.substring(F.col("_content"), (skip + 1).cast("int"), left.cast("int"))
    binary = dict(contents.dtypes)[content] == "binary"
    parts = rows.groupBy(*key, start).agg(F.array_sort(F.collect_list(F.struct("rank", (F.hex(part) if binary else part).alias("p")))).alias("x"), F.sum(F.length(part)).alias("_got"), F.max("_n").alias("_n"))
    text = F.array_join(F.transform("x", lambda x: x["p"]), "")
    got = parts.select(*key, start, F.when(F.col("_got") == F.col("_n"), F.unhex(text) if binary else text).alias(content))
    return chains.select(*key, start).distinct().join(got, [*key, start], "left").select(*key, start, content)


def offset_of_big(block: Column) -> Column:
    """Offset of a big block in its file, after the header."""
    return (block + 1) * BIG


def small_offsets(rows: DataFrame, chains: DataFrame, key: list[str], index: str, block: str = "block") -> DataFrame:
    """`rows` with the file offset of the small block `index`: the chain of the small blocks says which big block holds it; 0 if none does."""
    held = chains.select(*key, F.col("rank").alias("_rank"), F.col(block).alias("_big"))
    found = rows.withColumn("_rank", F.floor(F.col(index) / RATIO)).join(held, [*key, "_rank"], "left")
    return found.select(*rows.columns, F.coalesce(((F.col("_big") + 1) * RATIO + F.col(index) % RATIO) * SMALL, F.lit(0)).cast("long").alias("file_offset"))


def header_blocks(headers: DataFrame, blocks: DataFrame, key: list[str], n: str, first: str, header: str = "header", block: str = "block", content: str = "content") -> DataFrame:
    """(key, place, block): the `n` block numbers that a header and the chain of blocks after it list.

    headers: (key, n, first, header): the header's bytes, and the first further block; blocks: (key, block, content).
    """
    numbers = lambda c, count, at: F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: u32(F.col(c), i * 4 + at))
    own = headers.select(*key, n, F.posexplode(numbers(header, IN_HEADER, HEADER_AT)).alias("place", block))
    further = headers.filter(F.col(n) > IN_HEADER).select(*key, F.col(first).cast("long").alias("start"))
    entries = blocks.select(*key, block, u32(F.col(content), F.lit(4 * IN_BLOCK)).cast("long").alias("next")).withColumn("next", F.when(F.col("next") < 0x80000000, F.col("next")))
    chain = followed(entries, further, key, block).join(blocks.select(*key, block, content), [*key, block]).join(headers.select(*key, n), key)
    more = chain.select(*key, n, "rank", F.posexplode(numbers(content, IN_BLOCK, 0)).alias("_at", "_block")).select(*key, n, (F.col("rank") * IN_BLOCK + F.col("_at") + IN_HEADER).alias("place"), F.col("_block").alias(block))
    return own.unionByName(more).filter(F.col("place") < F.col(n)).select(*key, F.col("place").cast("long").alias("place"), block)
