"""Language-model scores by deleted interpolation of word n-grams.

The probability of a word after two others mixes four parts: its maximum-likelihood estimates after two words, after one and after
none, and an even share of the vocabulary.  The mixture weights depend on how often the context was seen: one set for each power of
two of the count of the two words, or of the one word where the two were never seen.  Expectation-maximisation learns them on deleted text:
one in DELETED training documents, whose n-grams are looked up in the counts of the others.  The final counts are of all training
documents.  Where a context was never seen, the estimate of the shorter one stands in, so each part sums to 1 at most.

Texts become blocks (see blocks.py).  A block sends each of its distinct n-grams once, as a hash, to the owner of the hash's range; the owner adds
up counts and answers.  Owners grow in number with the corpus, so each holds about OWNED n-grams; hashes keep 48 bits beside the
owner's number (words: all 64), so the chance that an n-gram meets a foreign one is the same at every size, below 1e-7.  A frequent
n-gram is one entry a block.  Tables cut the lineage, and only sums of the parts by context class, at most 128 rows, reach the driver.

Defined results: null, empty and blank texts are one token, the end; a null doc_id counts as an empty one, so it is training text;
repeated rows count as often as they occur and are scored each; without training text all weights are even and the vocabulary is
the end alone; no rows give no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import blocks
from scriptorium.llm.common import written

#: Documents with this remainder modulo FOLDS are held out; one in DELETED of the others teaches the weights.
FOLDS, HELD_OUT, DELETED = 7, 2, 10
ORDER = 3
#: Words of a block: a task holds several arrays of as many numbers.
BLOCK = 1 << 19
#: N-grams an owner holds, about.
OWNED = 1 << 22
#: Expectation-maximisation ends when the mean log-likelihood gains less, or after so many rounds.
GAIN, ROUNDS = 1e-4, 20
KEPT, DROPPED, HELD = 0, 1, 2
#: The end of a text and the place before its first word, as hashes.
END, BEGIN = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1B54A32D192ED03)
MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def class_of(doc_id: Column) -> Column:
    h = F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary"))
    return F.when(h % FOLDS == HELD_OUT, HELD).when(F.floor(h / FOLDS) % DELETED == 0, DROPPED).otherwise(KEPT)


def mixed(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """64-bit hashes of pairs of hashes."""
    h = a * MIX[0] + b
    h ^= h >> np.uint64(31)
    h *= MIX[1]
    h ^= h >> np.uint64(29)
    return h


class Tokens:
    """A block's tokens: hashes of the n-grams that end at each, place in the row, row.  The last word before a row that goes on comes first, uncounted."""

    def __init__(self, t: dict, bits: int):
        self.sizes = np.array(t["sizes"], np.int64)
        lead, before = t["lead"], t["before"]
        hashes = blocks.unpacked(t["words"], t["n_words"], 8, np.uint64)
        words = hashes[blocks.unpacked(t["ids"], int(self.sizes.sum()) + lead, 4, np.uint32)]
        self.ends = np.ones(len(self.sizes), np.int64)
        self.ends[-1:] = t["ended"]
        self.tokens = self.sizes + self.ends
        self.row = np.repeat(np.arange(len(self.sizes), dtype=np.int32), self.tokens)
        last = np.cumsum(self.tokens)
        inside = np.ones(len(self.row), bool)
        inside[last[self.ends > 0] - 1] = False
        h = np.full(len(self.row), END)
        h[inside] = words[lead:]
        place = np.arange(len(h)) - (last - self.tokens)[self.row]
        place[self.row == 0] += before
        place = np.minimum(place, 2).astype(np.int8)  # only the first two differ from those after
        self.extra = 1 if lead else 0
        h = np.concatenate([np.full(3, BEGIN), words[:lead], h])  # two words before the first token, or places before the text
        del words, inside
        n = len(self.row) + self.extra
        place = np.concatenate([np.full(self.extra, min(before - 1, 2), np.int8), place])
        x, one, two = h[-n:] if n else h[:0], h[len(h) - n - 1 : -1], h[len(h) - n - 2 : -2]
        one = np.where(place < 1, BEGIN, one)
        two = np.where(place < 2, BEGIN, two)
        pair = mixed(one, x)
        self.place, drop = place, np.uint64(dropped(bits))
        # a text's first word has no n-gram of three words; its pair stands there
        self.keys = [x, pair >> drop, mixed(two, pair) >> drop][:ORDER]

    def distinct(self, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct keys in order, their counts, and each token's index among them."""
        keys = self.keys[order]
        by = np.argsort(keys)
        s = keys[by]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.empty(len(s), np.int32)
        at[by] = np.cumsum(new, dtype=np.int32) - 1
        starts = np.flatnonzero(new)
        counts = np.diff(np.append(starts, len(s)))
        if self.extra:
            counts[at[0]] -= 1
        return s[new], counts, at


def dropped(bits: int) -> int:
    """Low bits that keys of pairs and triples lose: 48 are left beside the owner's number."""
    return max(0, 16 - bits)


def small(numbers: np.ndarray) -> tuple[bytes, int]:
    """Whole numbers in as few bytes each as hold the largest."""
    width = next(w for w in (1, 2, 4, 8) if not len(numbers) or int(numbers.max()) < 1 << 8 * w)
    return blocks.packed(numbers.astype(np.uint64), width), width


def asked(tokens: DataFrame, bits: int, orders: tuple[int, ...]) -> DataFrame:
    """(n_gram, owner, of, class, n, keys, counts, width): each block's distinct n-grams of some lengths, by owner."""
    schema = "n_gram int, owner int, of long, class int, n int, keys binary, counts binary, width int"
    kinds = pa.schema([("n_gram", pa.int32()), ("owner", pa.int32()), ("of", pa.int64()), ("class", pa.int32()), ("n", pa.int32()), ("keys", pa.binary()), ("counts", pa.binary()), ("width", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for t in b.to_pylist():
                own, out = Tokens(t, bits), []
                for order in orders:
                    keys, counts, _ = own.distinct(order)
                    for owner, a, z in owned(keys, order, bits):
                        data, width = small(counts[a:z])
                        out.append({"n_gram": order, "owner": owner, "of": t["block"], "class": t["class"], "n": z - a, "keys": blocks.packed(keys[a:z], 8 if order == 0 else 6), "counts": data, "width": width})
                yield pa.RecordBatch.from_pylist(out, kinds)

    return tokens.drop("rows", "doc_ids", "counts").mapInArrow(run, schema)


def owned(keys: np.ndarray, order: int, bits: int) -> Iterator[tuple[int, int, int]]:
    """(owner, from, to) of sorted keys; an owner has a range of hashes, given by their highest bits."""
    shift = 64 - bits - (dropped(bits) if order else 0)
    if not bits:
        bounds = np.array([0, len(keys)])
    else:
        bounds = np.append(np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(shift)), len(keys))
    for owner in np.flatnonzero(np.diff(bounds)).tolist():
        yield owner, int(bounds[owner]), int(bounds[owner + 1])


def answered(requests: DataFrame) -> DataFrame:
    """(of, n_gram, owner, total, total_width, kept, kept_width) for each request, in the order of its keys: counts of training text, and of
    what is not deleted (for deleted blocks only).  Rows of block -1 hold the distinct words of both in n and n_kept."""
    schema = "of long, n_gram int, owner int, n long, n_kept long, total binary, total_width int, kept binary, kept_width int"
    kinds = pa.schema([("of", pa.int64()), ("n_gram", pa.int32()), ("owner", pa.int32()), ("n", pa.int64()), ("n_kept", pa.int64()), ("total", pa.binary()), ("total_width", pa.int32()), ("kept", pa.binary()), ("kept_width", pa.int32())])

    def merge(group: pa.Table) -> pa.Table:
        order, owner = group["n_gram"][0].as_py(), group["owner"][0].as_py()
        n, classes = group["n"].to_numpy(), group["class"].to_numpy()
        wide = 8 if order == 0 else 6
        keys = np.concatenate([blocks.unpacked(k.as_py(), size, wide, np.uint64) for k, size in zip(group["keys"], n.tolist(), strict=True)])
        counts = np.concatenate([blocks.unpacked(c.as_py(), size, w, np.uint64).astype(np.int64) for c, size, w in zip(group["counts"], n.tolist(), group["width"].to_pylist(), strict=True)])
        by = np.argsort(keys, kind="stable")  # runs that are sorted already
        s = keys[by]
        new = np.ones(len(s), bool)
        new[1:] = s[1:] != s[:-1]
        at = np.empty(len(s), np.int32)
        at[by] = np.cumsum(new, dtype=np.int32) - 1
        del keys, s
        kind = np.repeat(classes, n)
        starts = np.flatnonzero(new)
        kept = np.add.reduceat(np.where(kind == KEPT, counts, 0)[by], starts)
        total = np.add.reduceat(np.where(kind == HELD, 0, counts)[by], starts)
        out, begin = [], 0
        for block, size, c in zip(group["of"].to_pylist(), n.tolist(), classes.tolist(), strict=True):
            mine = at[begin : begin + size]
            begin += size
            (a, a_width), (b, b_width) = small(total[mine]), small(kept[mine]) if c == DROPPED else (None, None)
            out.append({"of": block, "n_gram": order, "owner": owner, "n": size, "n_kept": None, "total": a, "total_width": a_width, "kept": b, "kept_width": b_width})
        out.append({"of": -1, "n_gram": order, "owner": owner, "n": int((total > 0).sum()), "n_kept": int((kept > 0).sum())})
        return pa.Table.from_pylist(out, kinds)

    return requests.groupBy("n_gram", "owner").applyInArrow(merge, schema)


def looked_up(t: dict, answers: list[dict], bits: int, column: str) -> tuple[Tokens, list[np.ndarray]]:
    """A block's tokens and the counts of the n-grams that end at each."""
    own, counts = Tokens(t, bits), []
    by = {(a["n_gram"], a["owner"]): a for a in answers}
    for order in range(ORDER):
        keys, _, at = own.distinct(order)
        known = [blocks.unpacked((a := by[order, owner])[column], z - x, a[f"{column}_width"], np.uint64) for owner, x, z in owned(keys, order, bits)]
        counts.append(np.concatenate(known).astype(np.int64)[at] if known else np.zeros(0, np.int64))
    return own, counts


def parts(own: Tokens, counts: list[np.ndarray], n_texts: int) -> tuple[np.ndarray, ...]:
    """Of each counted token: count, count and context of two words, count and context of three; where there is no such context 0 of 0."""
    one, two, three = counts
    before = lambda c: np.concatenate([np.zeros(1, np.int64), c[:-1]])
    after_one = np.where(own.place == 0, n_texts, before(one))
    after_two = np.where(own.place == 0, 0, before(two))
    three = np.where(own.place == 0, 0, three)
    return tuple(x[own.extra :] for x in (one, two, after_one, three, after_two))


def context_class(of1: np.ndarray, of2: np.ndarray) -> np.ndarray:
    """The power of two of the count of the two words before, from 64 on, or of the one word."""
    size = np.frexp(np.where(of2 > 0, of2, of1).astype(float))[1].astype(np.int32)
    return np.minimum(size, 63) + np.where(of2 > 0, np.int32(64), np.int32(0))


def estimates(c1, c2, of1, c3, of2, n: int, words: int) -> Iterator[np.ndarray]:
    """The even share, and the estimates after none, one and two words."""
    p = np.full(len(c1), 1.0 / (words + 1))
    yield p
    p = c1 / n if n else p
    yield p
    p = np.where(of1 > 0, c2 / np.maximum(of1, 1), p)
    yield p
    yield np.where(of2 > 0, c3 / np.maximum(of2, 1), p)


def deleted_tokens(tokens: DataFrame, answers: DataFrame, bits: int, n: int, texts: int, words: int) -> DataFrame:
    """(class, p0 to p3) of each deleted token, by the counts of what was kept."""
    kinds = [("context", pa.int32()), *[(f"p{i}", pa.float64()) for i in range(4)]]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for t in left.to_pylist():
            own, counts = looked_up(t, right.to_pylist(), bits, "kept")
            found = parts(own, counts, texts)
            out.append(pa.table([pa.array(context_class(found[2], found[4])), *map(pa.array, estimates(*found, n, words))], schema=pa.schema(kinds)))
        return pa.concat_tables(out) if out else pa.schema(kinds).empty_table()

    mine = tokens.filter(F.col("class") == DROPPED).drop("rows", "doc_ids", "counts")
    return mine.groupBy("block").cogroup(answers.filter("kept IS NOT NULL").groupBy("of")).applyInArrow(run, "context int, p0 double, p1 double, p2 double, p3 double")


def learned(events: DataFrame, parts: int = 4, classes: int = 128) -> np.ndarray:
    """Mixture weights of each context class by expectation-maximisation.

    A prior of one observation for each part keeps all weights positive; a class without any observation has the weights of the class of
    next smaller contexts of its kind, or even ones.
    """
    weights, last = np.full((classes, parts), 1.0 / parts), -math.inf
    for _ in range(ROUNDS):
        table = F.array(*[F.lit(float(w)) for w in weights.ravel()])
        of = [F.get(table, F.col("context") * parts + i) * F.col(f"p{i}") for i in range(parts)]
        total = sum(of[1:], of[0])
        rows = events.withColumn("_p", total).groupBy("context").agg(F.count(F.lit(1)).alias("n"), F.sum(F.log("_p")).alias("gain"), *[F.sum(of[i] / F.col("_p")).alias(f"r{i}") for i in range(parts)]).collect()  # a row a context class
        n = sum(r.n for r in rows)
        if not n:
            return weights
        seen = set()
        for r in rows:
            weights[r.context] = [(r[f"r{i}"] + 1) / (r.n + parts) for i in range(parts)]
            seen.add(r.context)
        for c in range(1, classes):
            if c not in seen and c % 64:
                weights[c] = weights[c - 1]
        mean = math.fsum(r.gain for r in rows) / n
        if mean - last < GAIN:
            break
        last = mean
    return weights


def scored(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of each row."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    tokens = written(blocks.token_blocks(rows.withColumn("class", class_of(F.col("doc_id"))), blocks.spaced(), lead=ORDER - 1, hashed=True, block=BLOCK), "tokens")
    ends = F.size("rows") - F.when(F.col("ended"), 0).otherwise(1)
    words = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    sizes = {r["class"]: (r.n, r.texts) for r in tokens.groupBy("class").agg(F.sum(words + ends).alias("n"), F.sum(ends).alias("texts")).collect()}  # three rows
    n_kept, texts_kept = sizes.get(KEPT, (0, 0))
    n, texts = (x + y for x, y in zip(sizes.get(KEPT, (0, 0)), sizes.get(DROPPED, (0, 0)), strict=True))
    bits = max(0, math.ceil(math.log2(max(1, sum(x for x, _ in sizes.values())) / OWNED)))
    # in two steps, of which the first one's shuffle files are gone when the second begins
    answers = written(answered(asked(tokens, bits, (0, 1))), "answers").unionByName(written(answered(asked(tokens, bits, (2,))), "answers"))
    vocabulary = answers.filter("of = -1 AND n_gram = 0").agg(F.sum("n").alias("n"), F.sum("n_kept").alias("kept")).first()
    v, v_kept = vocabulary.n or 0, vocabulary.kept or 0
    events = written(deleted_tokens(tokens, answers, bits, n_kept, texts_kept, v_kept), "deleted")
    weights = learned(events)

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for t in left.to_pylist():
            own, counts = looked_up(t, right.to_pylist(), bits, "total")
            found = parts(own, counts, texts)
            del counts, own.keys
            context, score = context_class(found[2], found[4]), np.zeros(len(own.row))
            for i, p in enumerate(estimates(*found, n, v)):
                score += weights[context, i] * p
            score = np.log10(score)
            base = np.log10((found[0] + 1) / (n + v + 1))
            by = lambda x: np.bincount(own.row, x, len(own.tokens))
            out.append(pa.table({"row": pa.array(t["rows"], pa.int64()), "doc_id": pa.array(t["doc_ids"], pa.int64()), "held_out": pa.array([t["class"] == HELD] * len(own.tokens)), "n_tokens": own.tokens, "n_known": by(found[0] > 0).astype(np.int64), "base_score": by(base), "score": by(score)}))
        return pa.concat_tables(out) if out else pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]).empty_table()

    found = tokens.drop("counts").groupBy("block").cogroup(answers.filter("of >= 0").select("of", "n_gram", "owner", "total", "total_width").groupBy("of")).applyInArrow(run, "row long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    by_text = found.groupBy("row", "doc_id", "held_out").agg(*[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return by_text.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")
