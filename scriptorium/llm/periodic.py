"""Periodic runs of words, found by a suffix automaton, and texts without the repetitions.

A run is a stretch of words with smallest period q, at least EXPONENT periods and LEAST words long, that no neighbouring word
continues.  The automaton's states are classes of factors that end at the same places.  From the longest states to the shortest
each state's ordered set of end positions is merged into its suffix link's, the smaller into the larger.  Two places that become
neighbours in a state of length n, d apart, are ends of the same n words, so if d <= n the words between have period d: a square.
It is extended to both sides, once for each run.  A run of q * e words shows up where its words but the last q are a factor: that
factor ends q before the run's end and there, and nowhere between, or q weren't its smallest period.  So only neighbours with
d (e - 1) <= n need to be looked at.

Before that the texts are cut, without loss: a word of a run of e periods occurs e times in it, so a word rarer than that in a
stretch lies in no run of it.  What lies between such words is cut again by the counts of its own; most texts vanish.

One document is one unit of work and nothing is shuffled.  A document needs 120 to 390 bytes a word of what the cuts leave.

Defined results: null, empty and blank texts have no words, no runs and an empty collapsed text; each of repeated rows and of rows
without a doc_id is its own; of equal exponents the smallest start, then the smallest period is the strongest run; no rows give no
rows; other columns aren't read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_left, bisect_right, insort
from collections import Counter
from collections.abc import Callable, Iterator
from zlib import crc32

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import dealt

EXPONENT, LEAST = 4, 6
#: Cuts by rare words go so many levels deep; what is left then goes to the automaton as it is.
LEVELS = 12
#: An ordered set's chunk is split at so many places.
CHUNK = 512


class Places:
    """An ordered set of places in chunks, so that an insertion moves a chunk and not the set."""

    __slots__ = ("chunks", "n", "tops")

    def __init__(self, place: int):
        self.chunks, self.tops, self.n = [[place]], [place], 1

    def add(self, place: int) -> None:
        at = min(bisect_left(self.tops, place), len(self.tops) - 1)
        chunk = self.chunks[at]
        insort(chunk, place)
        self.tops[at] = chunk[-1]
        self.n += 1
        if len(chunk) > CHUNK:
            half = len(chunk) // 2
            self.chunks.insert(at + 1, chunk[half:])
            del chunk[half:]
            self.tops[at : at + 1] = chunk[-1], self.chunks[at + 1][-1]

    def beside(self, place: int) -> tuple[int, int]:
        """The neighbours of a place in the set, -1 where there is none."""
        at = bisect_left(self.tops, place)
        chunk = self.chunks[at]
        i = bisect_left(chunk, place)
        before = chunk[i - 1] if i else self.tops[at - 1] if at else -1
        after = chunk[i + 1] if i + 1 < len(chunk) else self.chunks[at + 1][0] if at + 1 < len(self.chunks) else -1
        return before, after

    def __iter__(self) -> Iterator[int]:
        for chunk in self.chunks:
            yield from chunk


def automaton(seq: list) -> tuple[array, array, array]:
    """Lengths, suffix links and own end positions (-1: a clone) of the states of a sequence's suffix automaton; state 0 is the root.

    Most states have one transition, which arrays hold; dictionaries hold the others.
    """
    length, link, own = array("q", [0]), array("q", [-1]), array("q", [-1])
    letter, target, more = [None], array("q", [-1]), {}

    def put(state: int, c, to: int) -> None:
        if target[state] < 0 or letter[state] == c:
            letter[state], target[state] = c, to
        else:
            more.setdefault(state, {})[c] = to

    last = 0
    for i, c in enumerate(seq):
        new, p = len(length), last
        length.append(i + 1), link.append(0), own.append(i), letter.append(None), target.append(-1)
        q = -1
        while p >= 0:
            q = target[p] if letter[p] == c else more[p].get(c, -1) if p in more else -1
            if q >= 0:
                break
            put(p, c, new)
            p = link[p]
        if q >= 0:
            if length[q] == length[p] + 1:
                link[new] = q
            else:
                clone = len(length)
                length.append(length[p] + 1), link.append(link[q]), own.append(-1), letter.append(letter[q]), target.append(target[q])
                if q in more:
                    more[clone] = dict(more[q])
                while p >= 0 and (target[p] if letter[p] == c else more[p].get(c, -1) if p in more else -1) == q:
                    put(p, c, clone)
                    p = link[p]
                link[q] = link[new] = clone
        last = new
    return length, link, own


def runs_of(seq: list, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a sequence, by start and period."""
    length, link, own = automaton(seq)
    n, sets, fresh, known = len(seq), {}, {}, {}
    for v in sorted(range(1, len(length)), key=length.__getitem__, reverse=True):
        mine, added, size = sets.pop(v, None), fresh.pop(v, []), length[v]
        if own[v] >= 0:
            if mine is None:
                mine = Places(own[v])
            else:
                mine.add(own[v])
                added.append(own[v])
        most = min(size // (exponent - 1), n)
        for place in added:
            before, after = mine.beside(place)
            for end, d in ((before, place - before), (place, after - place)):
                if 0 < d <= most and end >= 0 and size + d >= least:
                    extend(seq, end - size + 1, end + d, d, known)
        parent = link[v]
        if not parent:
            continue
        if parent not in sets:
            sets[parent] = mine
            continue
        large, small = sets[parent], mine
        if large.n < small.n:
            large, small = small, large
        come = list(small)
        for place in come:
            large.add(place)
        sets[parent] = large
        fresh.setdefault(parent, []).extend(come)
    return sorted((a, b - a + 1, d) for d, found in known.items() for a, b in found if b - a + 1 >= max(least, exponent * d))


def extend(seq: list, a: int, b: int, d: int, known: dict[int, list[tuple[int, int]]]) -> None:
    """Note the longest stretch of period d around [a, b], unless one that holds it is known."""
    found = known.setdefault(d, [])
    at = bisect_right(found, (a, len(seq)))
    if at and found[at - 1][1] >= b:
        return
    while a and seq[a - 1] == seq[a - 1 + d]:
        a -= 1
    while b + 1 < len(seq) and seq[b + 1] == seq[b + 1 - d]:
        b += 1
    insort(found, (a, b))


def stretches(seq: list, exponent: int = EXPONENT, least: int = LEAST) -> Iterator[tuple[int, int]]:
    """Bounds of the stretches outside of which no run has a word."""
    work = [(0, len(seq), 0)]
    while work:
        a, b, level = work.pop()
        if b - a < least:
            continue
        part = seq[a:b]
        count = Counter(part)
        cuts = [i for i, w in enumerate(part, a) if count[w] < exponent] if min(count.values()) < exponent else []
        if not cuts or level == LEVELS:
            yield a, b
        else:
            work += [(x + 1, y, level + 1) for x, y in zip([a - 1, *cuts], [*cuts, b], strict=True) if y - x > least]


def word_runs(words: list, exponent: int = EXPONENT, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of a text's words, by start and period."""
    return sorted((a + start, size, q) for a, b in stretches(words, exponent, least) for start, size, q in runs_of(words[a:b], exponent, least))


def kept_words(words: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that lie in no run after its first period."""
    out, at = [], 0
    for a, b in sorted((start + q, start + size) for start, size, q in runs):
        out += words[at:a]
        at = max(at, b)
    return out + words[at:]


def collapsed(docs: DataFrame, exponent: int = EXPONENT, least: int = LEAST, prepare: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs: array of start, length, period, text: the kept words) of each row; `prepare` may change a row's words before."""
    schema = "doc_id long, runs array<struct<start:long,length:long,period:long>>, text string"
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found, texts = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).cast(pa.binary()).to_pylist(), strict=True):
                words = (text or b"").split()  # at U+0020 and U+0009 to U+000D
                if prepare:
                    words = prepare(doc_id, words)
                runs = word_runs(words, exponent, least)
                found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                texts.append(b" ".join(kept_words(words, runs)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, kind), pa.array(texts, pa.binary()).cast(pa.string())], ["doc_id", "runs", "text"])

    return dealt(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))).mapInArrow(run, schema)


def repeated(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The contract's repetitions: in one of ten documents all words from some place on repeat the first few of them."""
    h, n = crc32(str(doc_id).encode()), len(words)
    if doc_id is None or h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


def report(docs: DataFrame) -> DataFrame:
    """doc_id, number of runs, the strongest run and digests of the runs and of the collapsed text, of documents with the contract's repetitions."""
    out = collapsed(docs, prepare=repeated)

    def stronger(a: Column, b: Column) -> Column:
        return F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)

    # exact: lengths are multiplied crosswise; runs come by start and period, so the first of equals stays
    best = F.aggregate("runs", F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), stronger)
    lines = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    out = out.withColumn("best", best)
    return out.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *[F.col("best").getField(c).alias(c) for c in ("start", "length", "period")],
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(lines, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("text").cast("binary"), 256).alias("collapsed_sha256"),
    )
