"""Deleted interpolation against a plain model over dictionaries, and its worth on held-out text."""

import math
import re
import sys
import zlib
from collections import Counter
from pathlib import Path

import numpy as np
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers
from pyspark.sql import functions as F

from scriptorium.llm import blocks, interpolation, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain(rows):
    def kind(i):
        h = zlib.crc32(("" if i is None else str(i)).encode())
        return 2 if h % 7 == 2 else 1 if h // 7 % 10 == 0 else 0

    texts = [(kind(i), re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) + ["\n"]) for i, t in rows]

    def model(kinds):
        c = Counter()
        for k, w in texts:
            if k in kinds:
                padded = [" ", " ", *w]  # the blank stands before the text
                c.update((x,) for x in w)
                c.update(zip(padded[1:], padded[2:]))
                c.update(z for z in zip(padded, padded[1:], padded[2:]) if z[1] != " ")
                c[" "] += 1
        n = sum(c[x] for x in c if len(x) == 1 and x != " ")
        return c, n, sum(1 for x in c if len(x) == 1 and x != " " and c[x])

    def parts(words, c, n, v):
        for a, b, x in zip([" ", " ", *words], [" ", *words], words):
            p0 = 1 / (v + 1)
            p1 = c[x,] / n if n else p0
            of1 = c[" "] if b == " " else c[b,]
            of2 = 0 if b == " " else c[a, b]
            p2 = c[b, x] / of1 if of1 else p1
            p3 = c[a, b, x] / of2 if of2 else p2
            yield 64 + of2.bit_length() if of2 else of1.bit_length(), (p0, p1, p2, p3)

    kept = model({0})
    events = [e for k, w in texts if k == 1 for e in parts(w, *kept)]
    weights, last = np.full((128, 4), 0.25), -math.inf
    for _ in range(interpolation.ROUNDS):
        if not events:
            break
        gain, seen = 0.0, {}
        for b, p in events:
            of = weights[b] * p
            gain += math.log(of.sum())
            n, r = seen.get(b, (0, 0))
            seen[b] = n + 1, r + of / of.sum()
        for b, (n, r) in seen.items():
            weights[b] = (r + 1) / (n + 4)
        for b in range(1, 128):
            if b not in seen and b % 64:
                weights[b] = weights[b - 1]
        if gain / len(events) - last < interpolation.GAIN:
            break
        last = gain / len(events)
    c, n, v = model({0, 1})
    out = []
    for (i, _), (k, w) in zip(rows, texts):
        out.append((i, k == 2, len(w), sum(c[x,] > 0 for x in w), n, sum(math.log10((c[x,] + 1) / (n + v + 1)) for x in w), sum(math.log10(float(weights[b] @ p)) for b, p in parts(w, c, n, v))))
    return out


def same(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[2], round(r[5], 6))
    got, want = sorted(map(tuple, got), key=key), sorted(want, key=key)
    assert [r[:5] for r in got] == [r[:5] for r in want]
    assert np.allclose([r[5:] for r in got], [r[5:] for r in want], rtol=1e-9, atol=1e-9) if want else not got


@pytest.mark.parametrize("which, block, owned", [("docs", 1 << 20, 1 << 22), ("docs", 300, 200), ("odd", 1 << 20, 1 << 22), ("odd", 40, 100), ("empty", 40, 100), ("untrained", 40, 100)])
def test_scores(spark, monkeypatch, which, block, owned):
    monkeypatch.setattr(interpolation, "BLOCK", block)
    monkeypatch.setattr(blocks, "PIECE", 1 << 22 if block > 300 else 150)
    monkeypatch.setattr(interpolation, "OWNED", owned)
    rows = {"docs": [], "odd": helpers.AWKWARD, "empty": [], "untrained": [(2, "a b a"), (7, None)]}[which]
    if which == "docs":
        rows = [(r.doc_id, r.text and r.text[:3000]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()][: None if block > 1000 else 60]
    if which == "untrained":
        rows = [(i, t) for i, (_, t) in zip([x for x in range(100) if zlib.crc32(str(x).encode()) % 7 == 2], rows)]
    same(interpolation.scored(helpers.frame(spark, rows)).collect(), plain(rows))


def test_hash_ranges(spark):
    keys = np.sort(np.random.default_rng(1).integers(0, 2**63, 1000, dtype=np.uint64) * np.uint64(2))
    for bits in (0, 1, 5, 16, 20):
        for order in (0, 1):
            own = keys >> np.uint64(interpolation.dropped(bits) if order else 0)
            ranges = list(interpolation.owned(own, order, bits))
            assert [i for _, a, z in ranges for i in range(a, z)] == list(range(1000)) and all(o < 1 << bits for o, _, _ in ranges)
            assert bits == 0 or [o for o, _, _ in ranges] == sorted(set((keys >> np.uint64(64 - bits)).tolist()))


def test_weights_find_a_mixture(spark):
    """Events whose parts come from known weights give these weights back."""
    rng = np.random.default_rng(2)
    true, rows = {1: [0.1, 0.2, 0.3, 0.4], 70: [0.5, 0.3, 0.1, 0.1]}, []
    for context, w in true.items():
        tables = rng.dirichlet(np.full(50, 0.05), 4)
        for x in rng.choice(50, 20_000, p=np.array(w) @ tables):
            rows.append((context, *map(float, tables[:, x])))
    events = spark.createDataFrame(rows, "context int, p0 double, p1 double, p2 double, p3 double")
    weights = interpolation.learned(events)
    for context, w in true.items():
        assert np.abs(weights[context] - w).max() < 0.05
    assert (weights[71] == weights[70]).all() and (weights[0] == 0.25).all()


def test_held_out_text_is_likelier_than_by_words(spark):
    out = queries.QUERIES["op11_interpolation"](spark, "/root/testdata/sf0.01").filter("held_out").agg(F.sum("n_tokens").alias("n"), F.sum("base_score").alias("base"), F.sum("score").alias("score")).first()
    assert out.score / out.n > out.base / out.n + 0.5  # more than three times as likely a token
