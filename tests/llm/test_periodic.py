"""Periodic runs against comparison of all words with those a period on."""

import hashlib
import random
import re
import sys
import time
import zlib
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers

from scriptorium.llm import periodic, queries

SF = "/root/testdata/sf0.001"


def plain_runs(x, exponent=4, least=6):
    out, n = [], len(x)
    for q in range(1, n // exponent + 1):
        j = 0
        while j < n - q:
            if x[j] != x[j + q]:
                j += 1
                continue
            k = j
            while k < n - q and x[k] == x[k + q]:
                k += 1
            size = k - j + q
            if size >= max(least, exponent * q):
                s = x[j : j + size]
                if not any(s[d:] == s[: size - d] for d in range(1, q)):
                    out.append((j, size, q))
            j = k
    return sorted(out)


def test_runs_of_random_words():
    rng = random.Random(3)
    for _ in range(1500):
        x = [rng.randrange(rng.randint(1, 5)) for _ in range(rng.randint(0, 60))]
        for _ in range(rng.randint(0, 2)):
            a, p = rng.randint(0, len(x)), rng.randint(1, 8)
            x = x[:a] + (x[a : a + p] * rng.randint(0, 30))[:40] + x[a:]
        for exponent, least in ((4, 6), (2, 2), (3, 1)):
            assert periodic.word_runs(x, exponent, least) == plain_runs(x, exponent, least)


def test_cuts_lose_no_run():
    rng = random.Random(5)
    for _ in range(300):
        x = [rng.randrange(4) for _ in range(80)]
        held = list(periodic.stretches(x))
        assert all(any(a <= s and s + n <= b for a, b in held) for s, n, _ in plain_runs(x))


@pytest.mark.parametrize("words", [["a"] * 150_000, [str(i % 999) for i in range(150_000)], [str(bin(i).count("1") % 2) for i in range(60_000)]])
def test_long_texts(words):
    """One word, a long period, and a sequence without cubes: no case is quadratic."""
    began = time.time()
    found = periodic.word_runs(words)
    assert time.time() - began < 60
    assert found == ([(0, len(words), len(set(words)))] if len(set(words)) != 2 else [])


def test_kept_words():
    assert periodic.kept_words(list("xababababyababababz"), [(1, 8, 2), (10, 8, 2)]) == list("xabyabz")
    # overlapping runs: what either drops goes
    assert periodic.kept_words(list("aaaaaabababab"), [(0, 6, 1), (5, 8, 2)]) == list("ab")


def plain_row(doc_id, text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    n = len(words)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    runs = plain_runs(words)
    gone = {i for s, size, q in runs for i in range(s + q, s + size)}
    best = None
    for s, size, q in runs:
        if best is None or size * best[2] > best[1] * q:
            best = (s, size, q)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return (doc_id, len(runs), *(best or (None,) * 3), best and 1000 * best[1] // best[2], digest("".join(f"{s},{size},{q}\n" for s, size, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


@pytest.mark.parametrize("which", ["docs", "odd", "empty"])
def test_report(which, spark):
    df = {"docs": lambda: spark.read.parquet(f"{SF}/documents.parquet").filter("length(text) < 6000"), "odd": lambda: helpers.frame(spark), "empty": lambda: helpers.frame(spark, [])}[which]()
    key = lambda r: (r[0] is None, r[0] or 0, r[-1])
    assert sorted(map(tuple, periodic.report(df).collect()), key=key) == sorted((plain_row(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=key)


def test_query_reads_all_rows(spark):
    out = queries.QUERIES["op12_periodic"](spark, SF)
    assert out.count() == spark.read.parquet(f"{SF}/documents.parquet").count() and out.filter("n_runs > 0").count() > 0
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]


def test_operator_returns_texts(spark):
    rows = periodic.collapsed(helpers.frame(spark, [(1, "x " + "a b c " * 5 + "y"), (2, None)])).collect()
    assert {r.doc_id: (r.text, [tuple(x) for x in r.runs]) for r in rows} == {1: ("x a b c y", [(1, 15, 3)]), 2: ("", [])}
