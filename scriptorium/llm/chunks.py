"""Substring dedup by content-defined chunking.

A gear hash rolls over the code points, h' = 2 h + G[c]; its bits from 40 on depend on the last WINDOW characters
only.  A candidate is a blank whose hash has DIVISOR - 1 as its masked bits; a chunk ends after each candidate whose hash is the
largest of those less than LEAST characters away, of equal ones the first.  Text without blanks (Chinese, Japanese, encoded lines)
has none: characters FAR or more from any such end, or from the text's own ends, are all candidates, under the same rule.  So cuts
depend on the text around them alone, chunks are of about 40 characters in any script, and an insertion moves none but its
neighbours.  Only where the hash itself repeats, as in a run of one sign, a chunk ends after MOST characters.

Chunks are compared by a digest of 96 bits.  A chunk is a duplicate if an earlier one, by doc_id, the text's digest and position,
has its digest.  Runs of adjacent duplicates of at least RUN characters are cut from the text; shorter ones are phrases that any
two texts may share.

Each task first compares the chunks of its own rows, so a digest leaves a task once at most, however frequent it is, and the
shuffle by digest gets no hot group.  The result doesn't depend on how rows are dealt to tasks.

Defined results: a row is known by its doc_id and its text's digest, so other texts under one doc_id, or without any, are rows of
their own; null and empty texts have no chunks and stay as they are; of repeated rows (one doc_id, or none, and one text) all stay,
since an equal place isn't earlier; ties go to the smaller doc_id, then the smaller digest, then the smaller position; rows without
a doc_id count as later than all others; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

WINDOW = 16
DIVISOR = 2
LEAST, FAR, MOST = 20, 64, 512
RUN = 80
#: Chunks that a task holds at once.
HELD = 2_000_000
#: A row: whether it has no doc_id, the doc_id, the digest of its text.
ROW = np.dtype([("none", "?"), ("id", "<i8"), ("th", "<i8")])


def _gear() -> np.ndarray:
    """256 values of the splitmix64 sequence."""
    x = (np.arange(1, 257, dtype=np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


GEAR = _gear()


def gear_hashes(points: np.ndarray) -> np.ndarray:
    """At each position the gear hash of the last WINDOW characters, by doubling."""
    h, k = GEAR[points & 0xFF], 1
    while k < min(WINDOW, len(points)):
        more = h.copy()
        more[k:] += h[:-k] << np.uint64(k)
        h, k = more, 2 * k
    return h


def largest(at: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Of sorted candidates those whose value is the largest of all less than LEAST away, of equal ones the first."""
    keep, k = np.ones(len(at), bool), 1
    while k < len(at) and (near := at[k:] - at[:-k] < LEAST).any():
        left, right = value[:-k], value[k:]
        keep[k:] &= ~(near & (left >= right))
        keep[:-k] &= ~(near & (right > left))
        k += 1
    return at[keep]


def cuts(points: np.ndarray) -> list[int]:
    """Ends of the chunks, exclusive; the last is the text's end."""
    n = len(points)
    if not n:
        return []
    h = gear_hashes(points) >> np.uint64(40)
    at = np.flatnonzero((points <= 32) & ((h & np.uint64(DIVISOR - 1)) == DIVISOR - 1))
    ends = largest(at, h[at]) + 1
    bounds = np.concatenate([[0], ends, [n]])
    bare = [np.arange(a + FAR, b - FAR) for a, b in zip(bounds[:-1], bounds[1:], strict=True) if b - a > 2 * FAR]
    if bare:
        ends = np.sort(np.concatenate([ends, *(largest(x, h[x]) + 1 for x in bare)]))
    out, last = [], 0
    for e in [*ends.tolist(), n]:
        while e - last > MOST:
            last += MOST
            out.append(last)
        if e > last:
            out.append(e)
            last = e
    return out


def chunk_digests(text: str) -> tuple[list[int], list[bytes]]:
    """Ends of a text's chunks and their digests of 12 bytes."""
    raw = text.encode("utf-32-le", "surrogatepass")
    ends, digest = cuts(np.frombuffer(raw, np.uint32)), xxhash.xxh3_128_digest
    return ends, [digest(raw[4 * a : 4 * b])[:12] for a, b in zip([0, *ends], ends, strict=False)]


def chunk_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, th, start, end, d1, d2, later): a task's first chunk of each digest, and with `later` those that follow it there."""

    def out(doc: list, start: list, end: list, digests: list) -> pa.RecordBatch:
        d = np.frombuffer(b"".join(digests), np.dtype([("a", "<i8"), ("b", "<i4")]))
        doc, start, end = np.concatenate(doc), np.concatenate(start), np.concatenate(end)
        order = np.lexsort((start, doc["th"], doc["id"], doc["none"], d["b"], d["a"]))
        doc, start, end, d = doc[order], start[order], end[order], d[order]
        first = np.append(True, d[1:] != d[:-1])
        holder = np.maximum.accumulate(np.where(first, np.arange(len(d)), 0))
        later = ~first & ((doc != doc[holder]) | (start != start[holder]))
        key = np.where(later, np.arange(len(d)) * np.int64(0x9E3779B97F4A7C15 - 2**64), d["a"])  # spread: nothing is compared with these
        columns = [pa.array(doc["id"], mask=doc["none"]), doc["th"], start, end, key, np.where(later, 0, d["b"]).astype(np.int32), later]
        return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c) for c in columns], ["doc_id", "th", "start", "end", "d1", "d2", "later"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        doc, start, end, digests, n = [], [], [], [], 0
        for b in batches:
            for i, th, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
                ends, d = chunk_digests(t.as_py() or "")
                if ends:
                    e = np.array(ends, np.int32)
                    doc.append(np.full(len(e), np.array((i is None, i or 0, th), ROW)))
                    start.append(np.append(np.int32(0), e[:-1]))
                    end.append(e)
                    digests += d
                    n += len(e)
                if n >= HELD:
                    yield out(doc, start, end, digests)
                    doc, start, end, digests, n = [], [], [], [], 0
        if n:
            yield out(doc, start, end, digests)

    rows = docs.select(F.col("doc_id").cast("long"), digest_of(docs), F.col("text").cast("string"))
    return rows.mapInArrow(run, "doc_id long, th long, start int, end int, d1 long, d2 int, later boolean")


def digest_of(docs: DataFrame) -> Column:
    return F.xxhash64(F.coalesce(docs["text"].cast("string"), F.lit(""))).alias("th")


def repeats(docs: DataFrame, run: int = RUN) -> DataFrame:
    """(doc_id, th, spans): runs of at least `run` characters of chunks that an earlier place has, as array<struct<start, end>>."""
    w = Window.partitionBy("d1", "d2").orderBy(F.col("doc_id").asc_nulls_last(), "th", "start")
    rows = chunk_rows(docs).withColumn("_k", F.rank().over(w))
    dup = rows.filter(F.col("later") | (F.col("_k") > 1)).select("doc_id", "th", F.struct("start", "end").alias("c"))
    sorted_chunks = dup.groupBy("doc_id", "th").agg(F.sort_array(F.collect_set("c")).alias("cs"))
    # neighbours meet: a run starts where no chunk ends, and ends where none starts
    starts, ends = F.transform("cs", lambda c: c["start"]), F.transform("cs", lambda c: c["end"])
    open_at, close_at = F.array_sort(F.array_except(starts, ends)), F.array_sort(F.array_except(ends, starts))
    runs = F.zip_with(open_at, close_at, lambda a, b: F.struct(a.alias("start"), b.alias("end")))
    return sorted_chunks.select("doc_id", "th", F.filter(runs, lambda s: s["end"] - s["start"] >= run).alias("spans")).filter(F.size("spans") > 0)


def with_spans(rows: DataFrame, found: DataFrame) -> DataFrame:
    """(row, th, spans): `rows`, a struct and its text's digest, with the spans of its doc_id and digest, if any."""
    found = found.select(F.col("doc_id").alias("id"), F.col("th").alias("own"), "spans")
    return rows.join(found, F.col("row.doc_id").cast("long").eqNullSafe(F.col("id")) & (F.col("th") == F.col("own")), "left").select("row", "spans")


def without(text, spans):
    """The text less the spans."""
    gaps = F.zip_with(F.concat(F.array(F.lit(0)), F.transform(spans, lambda s: s["end"])), F.concat(F.transform(spans, lambda s: s["start"]), F.array(F.length(text))), lambda a, b: F.substring(text, a + 1, b - a))
    return F.array_join(gaps, "")


def dedup_substrings(docs: DataFrame, run: int = RUN) -> DataFrame:
    """`docs` with later repeats cut from the text."""
    joined = with_spans(docs.select(F.struct("*").alias("row"), digest_of(docs)), repeats(docs, run))
    text = F.col("row.text")
    new = F.when(F.col("spans").isNull(), text).otherwise(without(text, F.col("spans")))
    return joined.select(*[(new if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def report(docs: DataFrame, run: int = RUN) -> DataFrame:
    """For each row doc_id, n_chars, dup_chars, n_spans and spans (`start:end`, comma-joined, code points, end exclusive)."""
    n_chars = F.length(F.coalesce(F.col("text").cast("string"), F.lit(""))).cast("long")
    joined = with_spans(docs.select(F.struct(F.col("doc_id").cast("long").alias("doc_id"), n_chars.alias("n_chars")).alias("row"), digest_of(docs)), repeats(docs, run))
    cut_chars = F.coalesce(F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["end"] - s["start"])), F.lit(0).cast("long"))
    listed = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["start"], s["end"])), ",")
    return joined.select("row.*", cut_chars.alias("dup_chars"), F.coalesce(F.size("spans"), F.lit(0)).alias("n_spans"), F.coalesce(listed, F.lit("")).alias("spans"))
