"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints of 64 bits link at RADIUS or fewer differing bits.  The bits are grouped into m partitions,
correlated bits together, and partition i gets a threshold T_i >= -1 with sum(T_i + 1) = RADIUS + 1.  Then two
fingerprints that link differ by at most T_i bits in some partition i: else they would differ by at least
sum(T_i + 1) = RADIUS + 1 bits.  Thresholds and m come from a dynamic program over estimated costs, which use
statistics of the bits of all fingerprints.  A probe is a row (partition, value within T_i bits of the own one);
fingerprints that meet under a probe are verified.

No pairs of a group are listed.  Copies fold to one distinct fingerprint; inside a bucket a breadth-first search
gives a spanning forest of the verified links, at most one edge for each member.  Buckets above BUCKET members
are split by a further pigeonhole step on the bits that are still free, again and again; a bucket with few free
bits is small by itself, since its fingerprints are distinct.  So every task's groups are bounded and no link
between different fingerprints that matters for the components is lost.

Defined results: a null or empty text, and one without words, has fingerprint zero and links like any other;
repeated rows get equal results; a table without rows gives none; other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, lookup

BITS = 64
RADIUS = 4
SHINGLE = 4
SEED = 42
#: Members of a bucket that one search takes; larger buckets are split.
BUCKET = 4096
#: Cost of comparing two fingerprints, as a part of the cost of one shuffled probe.
COMPARE = 0.05
#: Buckets with so few free bits aren't split.
FEW = 10
#: So many edges are connected in one task.
SMALL = 100_000


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Unsigned SimHash of the word shingles of a text, with A-Z lower-cased."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    n = max(1, len(words) - shingle + 1)
    joined, ends = b" ".join(words), []
    at = -1
    for w in words:
        at += 1 + len(w)
        ends.append(at)
    starts = [0, *[e + 1 for e in ends[: n - 1]]]
    last = ends[len(words) - n :]
    digest = xxhash.xxh64_intdigest
    counts, step = np.zeros(BITS, np.int64), 65536
    for k in range(0, n, step):
        h = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[k : k + step], last[k : k + step], strict=True)], np.uint64)
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) of each row; fp is the fingerprint as a signed long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), shingle) for t in b.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "doc_id long, fp long")


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """How many fingerprints there are, and in how many of them bits i and j are both set: at most 4,096 rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, both = 0, np.zeros((BITS, BITS), np.int64)
        for b in batches:
            values = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for k in range(0, len(values), 65536):
                x = np.unpackbits(values[k : k + 65536].copy().view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
                n, both = n + len(x), both + (x.T @ x).astype(np.int64)
        if n:
            i = np.repeat(np.arange(BITS), BITS)
            yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(np.tile(np.arange(BITS), BITS)), pa.array(both.ravel()), pa.array(np.where(np.arange(BITS * BITS) == 0, n, 0))], ["i", "j", "c", "n"])

    rows = fps.select("fp").mapInArrow(run, "i long, j long, c long, n long").groupBy("i", "j").agg(F.sum("c").alias("c"), F.sum("n").alias("n")).collect()
    both = np.zeros((BITS, BITS), np.int64)
    for r in rows:
        both[r.i, r.j] = r.c
    return sum(r.n for r in rows), both


def grouped(bits: list[int], likeness: np.ndarray, m: int) -> list[list[int]]:
    """Deal bits into m partitions of even size, the most correlated ones together."""
    left, out = list(bits), []
    for k in range(m, 0, -1):
        size = math.ceil(len(left) / k)
        if not size:
            break
        first = max(left, key=lambda b: (likeness[b, [x for x in left if x != b]].max(initial=0), -b))
        part = [first]
        left.remove(first)
        while len(part) < size:
            best = max(left, key=lambda b: (likeness[b, part].mean(), -b))
            part.append(best)
            left.remove(best)
        out.append(sorted(part))
    return out


def plan(n: int, both: np.ndarray, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """Partitions with their thresholds, of the least estimated cost.

    A partition under threshold t costs each fingerprint as many probes as there are values within t bits, and
    COMPARE times the n * P(t) fingerprints expected there; P comes from how often two fingerprints agree on each bit.
    """
    p = both.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    likeness = np.abs(both / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread)
    agree = p * p + (1 - p) * (1 - p)
    best: tuple[float, list[tuple[list[int], int]]] = (math.inf, [])
    for m in range(1, radius + 2):
        parts, cost = grouped(list(range(BITS)), likeness, m), []
        for part in parts:
            differ = np.array([1.0])  # differ[d]: probability of d differing bits
            for b in part:
                differ = np.append(differ * agree[b], 0) + np.append(0, differ * (1 - agree[b]))
            probes = np.cumsum([math.comb(len(part), t) for t in range(radius + 1)])
            cost.append([0.0, *(probes[t] + COMPARE * n * differ[: t + 1].sum() for t in range(radius + 1))])
        # least[s]: cost of the partitions so far if their T_i + 1 sum to s
        least: list[tuple[float, list[int]]] = [(0.0, [])] + [(math.inf, [])] * (radius + 1)
        for row in cost:
            least = [min(((least[s - t][0] + row[t], [*least[s - t][1], t - 1]) for t in range(s + 1)), key=lambda x: x[0]) for s in range(radius + 2)]
        if least[-1][0] < best[0]:
            best = (least[-1][0], [(part, t) for part, t in zip(parts, least[-1][1], strict=True) if t >= 0])
    return best[1]


def _mask(bits: list[int]) -> int:
    return sum(1 << b for b in bits)


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _probe(own):
    return lambda flip: F.struct(own["used"].alias("used"), own["own"].bitwiseXOR(flip).alias("key"))


def probes(fps: DataFrame, parts: list[tuple[list[int], int]]) -> DataFrame:
    """(used, key, fp): a row for each value within T_i bits of fp's value in partition i; used: the partition's bits."""
    rows = []
    for part, t in parts:
        flips, mask = [0], F.lit(_signed(_mask(part)))
        for _ in range(t):
            flips = sorted({f ^ x for f in flips for x in (0, *(1 << b for b in part))})
        own = F.struct(mask.alias("used"), F.col("fp").bitwiseAND(mask).alias("own"))
        rows.append(F.transform(F.array(*[F.lit(_signed(f)) for f in flips]), _probe(own)))
    return fps.select("fp", F.explode(F.concat(*rows)).alias("p")).select(F.col("p.used").alias("used"), F.xxhash64("p.used", "p.key").alias("key"), "fp")


def free_bits(used: int) -> list[int]:
    return [b for b in range(BITS) if not used >> b & 1]


def _finer(rows: DataFrame) -> DataFrame:
    """A row for each of RADIUS + 1 groups of the free bits, keyed by the group's value too; `used` null: no free bits to split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            used, key, fp = (c.to_numpy(zero_copy_only=False) for c in b.columns)
            for u in np.unique(used):
                own, free = used == u, free_bits(int(u))
                if len(free) <= FEW:
                    yield pa.RecordBatch.from_arrays([pa.nulls(own.sum(), pa.int64()), pa.array(key[own]), pa.array(fp[own])], ["used", "key", "fp"])
                    continue
                for k in range(RADIUS + 1):
                    mask = _signed(_mask(free[k :: RADIUS + 1]))
                    keys = [xxhash.xxh64_intdigest(x.tobytes(), k) for x in np.stack([key[own], fp[own] & mask], axis=1)]
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(own.sum(), int(u) | mask)), pa.array(np.array(keys, np.uint64).view(np.int64)), pa.array(fp[own])], ["used", "key", "fp"])

    return rows.select("used", "key", "fp").mapInArrow(run, "used long, key long, fp long")


def split_large(rows: DataFrame, most: int = BUCKET) -> DataFrame:
    """Split buckets of more than `most` members by the values of RADIUS + 1 groups of their free bits.

    Members that link agree on one such group at least.  Buckets of FEW free bits stay as they are: each has at
    most 2 ** FEW fingerprints for each of its probes' values.
    """
    done = []
    while True:
        large = cut(rows.groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > most).select("key"))
        if large.isEmpty():
            break
        done.append(rows.join(large, "key", "left_anti"))
        finer = cut(_finer(rows.join(large, "key", "left_semi")))
        done.append(finer.filter("used is null"))
        rows = finer.filter("used is not null")
    for d in done:
        rows = rows.unionByName(d)
    return rows


def forest(fps: np.ndarray, radius: int = RADIUS) -> list[tuple[int, int]]:
    """Edges (positions) of a spanning forest of the fingerprints that link."""
    left, edges = np.arange(len(fps)), []
    while len(left) > 1:
        stack, left = [left[0]], left[1:]
        while stack and len(left):
            x = stack.pop()
            near = np.bitwise_count(fps[left] ^ fps[x]) <= radius
            if near.any():
                found, left = left[near], left[~near]
                edges += [(x, y) for y in found]
                stack.extend(found)
    return edges


def links(rows: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): for each bucket, a spanning forest of its verified links."""

    def found(key: np.ndarray, fp: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        sizes = np.diff(np.append(starts, len(key)))
        a, b = [], []
        pairs = starts[sizes == 2]
        near = np.bitwise_count(fp[pairs] ^ fp[pairs + 1]) <= radius
        a.append(fp[pairs[near]])
        b.append(fp[pairs[near] + 1])
        for s, n in zip(starts[sizes > 2], sizes[sizes > 2], strict=True):
            own = fp[s : s + n]
            if (e := forest(own, radius)):
                e = np.array(e)
                a.append(own[e[:, 0]])
                b.append(own[e[:, 1]])
        return np.concatenate(a), np.concatenate(b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, fp = np.zeros(0, np.int64), np.zeros(0, np.uint64)

        def out(k: np.ndarray, f: np.ndarray) -> pa.RecordBatch:
            a, b = found(k, f)
            return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            key = np.append(key, batch.column(0).to_numpy(zero_copy_only=False))
            fp = np.append(fp, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            at = int(np.searchsorted(key == key[-1], True))  # the last bucket may go on: sorted, so its first row
            if at:
                yield out(key[:at], fp[:at])
                key, fp = key[at:], fp[at:]
        if len(key):
            yield out(key, fp)

    dealt = rows.select("key", "fp").repartition("key").sortWithinPartitions("key", "fp")
    return dealt.mapInArrow(run, "a long, b long").filter("a != b").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root): the smallest node of each connected component, by alternating large and small stars.  SMALL edges or fewer take one task."""
    edges = cut(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    few = edges.count() <= SMALL
    dealt = lambda df: df.coalesce(1) if few else df  # noqa: E731  else each round leaves as many small files as there are partitions
    seen = None
    while True:
        both = dealt(edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.filter("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").union(low.select("u", F.col("m").alias("v")))
        edges = cut(dealt(small).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == seen:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
        seen = now


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) of each row; component_id: the smallest doc_id that links reach, the own one included."""
    fps = cut(fingerprints(docs, shingle))
    distinct = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")))
    n, both = bit_counts(distinct)
    rows = split_large(probes(distinct.select("fp"), plan(n, both, radius)))
    roots = components(links(rows, radius))
    of = distinct.join(roots, distinct.fp == roots.node, "left")
    least = of.filter("root is not null").groupBy("root").agg(F.min("least").alias("component_id"))
    known = of.join(least, "root", "left").filter("root is not null or n > 1").select("fp", "n", F.coalesce("component_id", "least").alias("component_id"))
    out = lookup(fps, cut(known), "fp", "doc_id", fps.count())
    return out.select("doc_id", "fp", F.coalesce("component_id", "doc_id").alias("component_id"))


def hexed(fp: str = "fp"):
    return F.lower(F.lpad(F.hex(F.col(fp)), 16, "0"))
