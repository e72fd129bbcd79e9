"""Document fingerprints by winnowing.

A text's characters above U+0020, with A-Z lower-cased, form k-grams, whose hashes are polynomials that double in length step by
step.  Of each window of W consecutive hashes the least is chosen, of equal ones the rightmost.  So any passage of at least
K + W - 1 such characters that two texts share gives both a common hash.  The place of a chosen k-gram in the original text is
kept: a fingerprint is a row of 16 hex digits for each choice, eight for the place (code points) and eight for the hash.
Likeness is the Jaccard index of the hashes in the fingerprints.

Defined results: a text of fewer than K such characters is one k-gram as long as it is; a text without any has an empty
fingerprint, of likeness 1 to another empty one and 0 to others; null is empty; documents of one doc_id follow one another by
text; rows without a doc_id come last; repeated rows get equal fingerprints; a single document is its own next one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

K, W = 20, 41
#: Places that fit the low bits of a key; longer texts are taken in blocks that overlap by W - 1 k-grams.
BLOCK = 1 << 24
#: Documents that follow one another are dealt in ranges of about RANGE, of at most RANGES.
RANGE, RANGES = 5000, 4096
BASE, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of the k-grams at each place, from those of half the length."""
    power, h, done, out, out_n = BASE, (points + np.uint64(1)) * MIX, 1, None, 0
    while True:
        if k & done:
            if out is None:
                out, out_n = h, done
            else:  # the part hashed so far, then these `done` characters
                n = min(len(out), len(h) - out_n)
                out = out[:n] * power + h[out_n : out_n + n]
                out_n += done
        if done * 2 > k:
            break
        h = h[:-done] * power + h[done:]
        power, done = np.uint64(int(power) ** 2 % 2**64), done * 2
    out = out[: len(points) - k + 1]
    out = (out ^ (out >> np.uint64(31))) * MIX
    return out ^ (out >> np.uint64(29))


def least_of_windows(keys: np.ndarray, w: int) -> np.ndarray:
    """The least key of each window, each run of equal ones once."""
    if len(keys) <= w:
        return keys.min(keepdims=True)
    m, s = keys, 1
    while s * 2 <= w:
        m, s = np.minimum(m[:-s], m[s:]), s * 2
    m = np.minimum(m[: len(keys) - w + 1], m[w - s : w - s + len(keys) - w + 1])
    return m[np.append(True, m[1:] != m[:-1])]


def winnow(text: str, k: int = K, w: int = W) -> tuple[np.ndarray, np.ndarray]:
    """Places and 40-bit hashes of the chosen k-grams, by place."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    where = np.flatnonzero(points > 32)
    points = points[where].astype(np.uint64)
    if not len(points):
        return np.zeros(0, np.uint32), np.zeros(0, np.uint64)
    points += np.where((points >= 65) & (points <= 90), np.uint64(32), np.uint64(0))
    h = gram_hashes(points, min(k, len(points))) >> np.uint64(24)
    places, low = [], np.uint64(BLOCK - 1)
    with np.errstate(over="ignore"):
        for at in range(0, max(1, len(h) - w + 1), BLOCK - w):
            part = h[at : at + BLOCK - 1]
            keys = (part << np.uint64(24)) | (low - np.arange(len(part), dtype=np.uint64))  # of equal hashes the rightmost is least
            places.append(at + (low - (least_of_windows(keys, w) & low)).astype(np.int64))
    at = np.unique(np.concatenate(places))
    return where[at].astype(np.uint32), h[at]


def printed(found: tuple[np.ndarray, np.ndarray]) -> str:
    out = np.empty((len(found[0]), 2), ">u4")
    out[:, 0], out[:, 1] = found[0], found[1] >> np.uint64(8)
    return out.tobytes().hex()


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Jaccard index of two sets of sorted, distinct hashes."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 1.0 if not len(a) and not len(b) else both / (len(a) + len(b) - both)


def ordered(docs: DataFrame) -> DataFrame:
    """(range, guest, k, doc_id, text): sorted inside its range by descending k; a range's guests are the first of the next range.

    Only the bounds of the ranges, at most RANGES, reach the driver; the text is shuffled once.
    """
    low = -(2**63)
    rows = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(low)).alias("k"), F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = rows.count()
    parts = min(RANGES, -(-n // RANGE))
    bounds = sorted(set(rows.approxQuantile("k", [i / parts for i in range(1, parts)], 0.2 / parts))) if parts > 1 else []  # the bounds decide who works, not the result
    number = F.lit(0)
    if bounds:
        # binary search by nested comparisons
        def search(a: int, b: int):
            if a == b:
                return F.lit(len(bounds) - a)
            m = (a + b) // 2
            return F.when(F.col("k") < F.lit(int(bounds[m])), search(a, m)).otherwise(search(m + 1, b))

        number = search(0, len(bounds))
    rows = rows.withColumn("range", number)
    tops = [(r["range"], r.top) for r in rows.select("range", "k").groupBy("range").agg(F.max("k").alias("top")).orderBy("range").collect()]  # at most RANGES rows
    if not tops:
        return rows.withColumn("guest", F.lit(False))
    goes = {top: before for (before, _), (_, top) in zip(tops, tops[1:] + tops[:1], strict=True)}
    guest = F.array(*[F.struct(F.lit(top).alias("top"), F.lit(at).alias("at")) for top, at in goes.items()])
    seats = F.when(F.col("k").isin(list(goes)), F.concat(F.array(F.struct(F.col("range"), F.lit(False).alias("guest"))), F.transform(F.filter(guest, lambda g: g["top"] == F.col("k")), lambda g: F.struct(g["at"].alias("range"), F.lit(True).alias("guest"))))).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("guest"))))
    dealt = rows.select("k", "doc_id", "text", F.explode(seats).alias("s")).select("s.range", "s.guest", "k", "doc_id", "text")
    return dealt.repartition("range").sortWithinPartitions("range", "guest", F.desc("k"), "text")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, the two fingerprints, the digest of the edited text and the two likenesses of each row."""
    schema = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def measured(text: str) -> tuple[str, str, np.ndarray]:
        found = winnow(text)
        return text, printed(found), np.unique(found[1] >> np.uint64(8))  # as printed

    def row(doc_id: int | None, own: tuple, after: tuple) -> tuple:
        text = own[0]
        m = len(text) // 3
        edited = measured(text[: len(text) - m] + after[0][:m])
        return doc_id, len(text), hashlib.sha256(edited[0].encode("utf-8", "surrogatepass")).hexdigest(), own[1], edited[1], likeness(own[2], edited[2]), likeness(own[2], after[2])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row whose next one hasn't come yet
        for b in batches:
            out = []
            for number, guest, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if guest and (held is None or held[0] != number):
                    continue  # a further copy of the guest
                now = measured(text)
                if held is not None and held[0] == number:
                    out.append(row(held[1], held[2], now))
                held = None if guest else (number, doc_id, now)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered(docs).select("range", "guest", "doc_id", "text").mapInArrow(run, schema)
