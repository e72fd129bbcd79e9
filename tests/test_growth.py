"""What keeps the work of queries in proportion to their input."""

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium.operators import chains, metrics, numbering, relations, textblocks


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def counted(monkeypatch, module):
    """The tables that `module` writes in rounds."""
    calls, cut = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df: calls.append(df) or cut(df))
    return calls


def test_pieces_read_each_byte_once(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\x00"),)], "content binary").select(textblocks.pieces(F.col("content")).alias("p"))
    assert df._jdf.queryExecution().optimizedPlan().toString().count("substring") < 40


def test_lines_are_broken_in_arrow(spark):
    df = spark.createDataFrame([("aa b  c", [10] * 256), ("a b", None), (None, [10] * 256)], "t string, w array<int>")
    df = df.select(metrics.broken(F.col("t"), F.col("w"), F.lit(2), 40).alias("l"))
    assert "ArrowEvalPython" in plan(df)
    assert [[tuple(x) for x in r.l] for r in df.collect()] == [[("aa b", 40), (" c", 20)], [("a", 600), ("b", 600)], [("", 0)]]


def test_negative_widths():
    widths = [10] * 256
    widths[ord("-")] = -10
    assert [x["text"] for x in metrics.lines_of("aaaa -- a", widths, 2, 40)] == ["aaaa --", "a"]


def test_circles_take_rounds_by_their_own_size(spark, monkeypatch):
    calls = counted(monkeypatch, relations)
    rows = spark.range(3, 2000).select(F.col("id").alias("k"), (F.col("id") % 3).alias("b"), F.lit(None).cast("long").alias("v"))
    rows = rows.union(spark.createDataFrame([(0, 1, None), (1, 0, None), (2, 9999, 7)], "k long, b long, v long"))
    out = {r.k: (r.v, r.circular) for r in relations.base_chain(rows, [], "k", "b", "v", "circular").collect()}
    assert len(out) == 2000 and all(x == ((7, False) if k % 3 == 2 else (None, True)) for k, x in out.items())
    assert len(calls) <= 4 and all("BroadcastExchange" not in plan(df) for df in calls)


def test_list_values_take_one_sort(spark):
    rows = spark.createDataFrame([(1, 1, 1, 0, 5, False)], "k int, list int, o int, l int, s int, r boolean")
    df = numbering.list_values(rows, ["k"], "o", "list", "l", "s", "r")
    df = df.withColumn("n", F.row_number().over(Window.partitionBy("k", "list").orderBy("o")))
    assert plan(df).split("== Initial Plan ==")[-1].count("Sort [") == 1


@pytest.mark.parametrize("n", [1, 2, 40])
def test_chains_write_one_table_a_round(spark, monkeypatch, n):
    calls = counted(monkeypatch, chains)
    entries = spark.range(n).select(F.lit(1).alias("k"), F.col("id").alias("block"), (F.col("id") + 1).alias("next"))
    found = chains.followed(entries, spark.createDataFrame([(1, 0)], "k int, start long"), ["k"]).collect()
    assert sorted((r.rank, r.block) for r in found) == [(i, i) for i in range(n)]
    assert len(calls) <= 3 + (n - 1).bit_length() + 1
