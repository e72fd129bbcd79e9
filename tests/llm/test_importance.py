"""Token blocks and importance resampling against plain counts."""

import collections
import hashlib
import math
import re
import sys
import zlib
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest

sys.path.insert(0, str(Path(__file__).parent))
import helpers
from pyspark.sql import functions as F

from scriptorium.llm import blocks, importance, queries

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def words_of(text, pattern=importance.WORD):
    return re.findall(pattern, (text or "").translate(LOWER))


@pytest.mark.parametrize("block, piece", [(1 << 20, 1 << 22), (50, 64), (7, 1)])
@pytest.mark.parametrize("kind", ["spaced", "alphanumeric"])
def test_blocks_hold_all_words_in_order(spark, monkeypatch, block, piece, kind):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "PIECE", piece)
    rows = [t for _, t in helpers.AWKWARD] if block > 7 else [t and t[:300] for _, t in helpers.AWKWARD]
    df = spark.createDataFrame([(i, t, i % 3) for i, t in enumerate(rows)], "doc_id long, text string, class int").repartition(2)
    got, begun = collections.defaultdict(list), collections.Counter()
    for r in blocks.token_blocks(df, getattr(blocks, kind)(), lead=2).orderBy("block").collect():
        ids = blocks.unpacked(r.ids, sum(r.sizes) + r.lead, 4, np.uint32)
        text = [r.words[i] for i in ids]
        assert sorted(set(text)) == sorted(r.words) and len(r.words) == r.n_words
        at = r.lead
        for k, (row, doc_id, size) in enumerate(zip(r.rows, r.doc_ids, r.sizes, strict=True)):
            assert doc_id % 3 == r["class"]
            if k == 0 and r.before:
                assert len(got[doc_id]) == r.before and text[: r.lead] == got[doc_id][-2:]
            else:
                begun[row] += 1
            got[doc_id] += text[at : at + size]
            at += size
    pattern = r"[^\x20\x09-\x0D]+" if kind == "spaced" else importance.WORD
    assert dict(got) == {i: words_of(t, pattern) for i, t in enumerate(rows)}
    assert set(begun.values()) == {1} and len(begun) == len(rows)


def test_packing_of_numbers():
    for dtype, width in ((np.uint32, 4), (np.uint64, 6), (np.uint64, 8)):
        x = np.array([0, 1, 5, 2**30, 77], dtype)
        assert (blocks.unpacked(blocks.packed(x, width), len(x), width, dtype) == x).all()
    assert len(blocks.unpacked(blocks.packed(np.zeros(0, np.uint32)), 0, 4, np.uint32)) == 0


def test_a_word_longer_than_a_piece(monkeypatch):
    monkeypatch.setattr(blocks, "PIECE", 10)
    found = list(blocks.pieces(pa.array(["ab " + "x" * 95 + " cd", "", "Tail"]), blocks.spaced()))
    assert [w for _, words, _, _ in found for w in words.to_pylist()] == ["ab", "x" * 95, "cd", "tail"]
    assert [done for *_, done in found][-1]


def plain(docs, target, low, high, buckets):
    def grams(text):
        w = words_of(text)
        return [" ".join(w[i : i + k]) for k in range(low, high + 1) for i in range(len(w) - k + 1)]

    bucket = lambda g: zlib.crc32(g.encode()) % buckets
    s, t = (collections.Counter(bucket(g) for x in texts for g in grams(x)) for texts in ([x for _, x in docs], target))
    S, T = s.total(), t.total()
    out = []
    for i, x in docs:
        own = grams(x)
        gain = [math.floor(1000 * math.log((t[b] + 1) * (S + buckets) / ((s[b] + 1) * (T + buckets)))) for b in map(bucket, own)]
        out.append((i, len(words_of(x)), len(own), sum(gain) // len(own) if own else 0))
    return out


key = lambda r: tuple((x is None, x) for x in r)


@pytest.mark.parametrize("low, high, buckets, block", [(1, 1, 10_000, 1 << 20), (1, 1, 97, 50), (1, 3, 1009, 60), (2, 2, 10_000, 1 << 20)])
def test_weights(spark, monkeypatch, low, high, buckets, block):
    monkeypatch.setattr(blocks, "BLOCK", block)
    monkeypatch.setattr(blocks, "PIECE", 1 << 22 if block > 100 else 500)
    rows = [r for r in helpers.AWKWARD if block > 100 or len(r[1] or "") < 3000] + [(100 + i, f"Tie {i % 3} of {PASSAGE}") for i in range(9)]
    target = [PASSAGE, None, "tie one is not tie two"]
    out = importance.weighted(helpers.frame(spark, rows), spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string"), low, high, buckets)
    assert sorted(map(tuple, out.drop("row").collect()), key=key) == sorted(plain(rows, target, low, high, buckets), key=key)


PASSAGE = helpers.PASSAGE


@pytest.mark.parametrize("which", ["docs", "odd", "empty", "no target"])
def test_resampled(spark, which):
    docs = {"docs": lambda: spark.read.parquet(f"{SF}/documents.parquet"), "empty": lambda: helpers.frame(spark, [])}.get(which, lambda: helpers.frame(spark))()
    target = spark.read.parquet(f"{SF}/benchmark.parquet").limit(0 if which == "no target" else 1000)  # all rows or none
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = []
    for i, words, n, weight in plain(rows, [r.text for r in target.collect()], 1, 1, 10_000):
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        want.append([i, words, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))])
    able = sorted((r for r in want if r[1] >= 20), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    rank = {id(r): k for k, r in enumerate(able[: 10 * len(able) // 100], 1)}
    got = importance.resampled(docs, target).collect()
    assert sorted(map(tuple, got), key=key) == sorted(((i, n, w, s, rank.get(id(r))) for r in want for i, _, n, w, s in [r]), key=key)


def test_ranks_of_equal_scores(spark):
    """Half the rows share a doc_id, so score and doc_id don't part them; ranks are 1, 2, 3... all the same."""
    rows = spark.range(4000).select(F.col("id").alias("row"), F.when(F.col("id") % 2 == 0, 7).otherwise(F.col("id")).alias("doc_id"), F.lit(30).cast("long").alias("n_words"), F.lit(30).cast("long").alias("n_features"), F.lit(0).cast("long").alias("weight"))
    out = importance.drawn(rows, share=60).collect()
    ranked = sorted((r for r in out if r["rank"]), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, 2401)) and len(out) == 4000
    assert all((a.score, -a.doc_id) >= (b.score, -b.doc_id) for a, b in zip(ranked, ranked[1:]))
    assert min(r.score for r in ranked) >= max(r.score for r in out if not r["rank"]) - 0


def test_query_matches_its_sql(spark):
    import duckdb

    con = duckdb.connect()
    for name in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{name}.parquet')")
    want = con.execute(queries.ORACLE["op13_importance"])
    names = [c[0] for c in want.description]
    assert sorted(want.fetchall(), key=key) == sorted((tuple(r[c] for c in names) for r in queries.QUERIES["op13_importance"](spark, SF).collect()), key=key)
