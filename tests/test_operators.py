"""Operators on literal cases, and queries against their SQL."""

import os
import textwrap

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from scriptorium import plans
from scriptorium.functions import dates, numbers, text, units
from scriptorium.operators import layout
from scriptorium.operators import relations as ops

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def one(spark, column, **values):
    df = spark.range(1)
    for k, v in values.items():
        df = df.withColumn(k, v if not isinstance(v, (str, int, float, type(None))) else F.lit(v))
    return df.select(column.alias("x")).first().x


def test_numbers(spark):
    n = [0, 1, 4, 9, 26, 27, 702, 703, 1994, 4000, 4001, 18278, 18279, 11, 111, 112, 113, 12]
    rows = {r.n: r for r in spark.createDataFrame([(x,) for x in n], "n long").select("n", numbers.roman(F.col("n")).alias("r"), numbers.alpha(F.col("n")).alias("a"), numbers.ordinal(F.col("n")).alias("o"), numbers.outline(F.col("n")).alias("l")).collect()}
    assert [rows[x].r for x in (0, 4, 9, 1994, 4000, 4001)] == ["", "iv", "ix", "mcmxciv", "", "i"]
    assert [rows[x].a for x in (0, 1, 26, 27, 702, 703, 18278, 18279)] == ["", "a", "z", "aa", "zz", "aaa", "zzz", ""]
    assert [rows[x].o for x in (1, 11, 111, 112, 113, 12)] == ["1st", "11th", "111st", "112nd", "113rd", "12th"]
    assert (rows[4].l, rows[26].l, rows[111].l) == ("04", "26", "111")


def test_dates(spark):
    rows = [r.d for r in spark.createDataFrame([("3/7/05",), ("3/7/85",), ("0/7/85",), ("3/32/85",), ("x",), (None,)], "t string").select(dates.dos_date(F.col("t")).alias("d")).collect()]
    assert [str(d) if d else None for d in rows] == ["2005-03-07", "1985-03-07", None, None, None, None]
    assert one(spark, dates.dttm(F.lit(0))) is None


def test_text(spark):
    assert one(spark, text.upper(F.lit("straße ÿ é ÷"))) == "STRAßE ÿ É ÷"
    assert one(spark, text.strip_fields(F.lit("a\x13B\x14c\x15d\x13e"))) == "acd"
    assert one(spark, text.basename(F.lit("a/b.doc"))) == "b.doc" and one(spark, text.basename(F.lit(""))) == "null"
    assert one(spark, text.lookalikes(F.lit("“a”—b…​"))) == '"a"-b...'
    assert one(spark, text.display_width(F.lit("日本á"))) == 5


def test_units(spark):
    lid = [0x0409, 0x0407, 0x0807, 1, 0xFFFF]
    assert [r.x for r in spark.createDataFrame([(x,) for x in lid], "l int").select(units.language(F.col("l")).alias("x")).collect()] == ["en_US", "de", "de_CH", None, None]
    false, true = F.lit(False), F.lit(True)
    assert one(spark, units.font_size(F.lit(20), true, false)) == 16 and one(spark, units.font_size(F.lit(20), false, true)) == 13
    assert one(spark, units.before_after(F.lit(0x8000), false)) == 0 and one(spark, units.before_after(F.lit(3000), false)) == 2160 and one(spark, units.before_after(F.lit(0), true)) == 120


def test_wrap():
    assert layout.wrap("a" * 80) == ["a" * 76, "aaaa"]
    assert layout.wrap("a" * 70 + " bbbbbbbb") == ["a" * 70, "bbbbbbbb"]
    assert layout.wrap("a" * 70 + "-bbbbbbbb") == ["a" * 70 + "-", "bbbbbbbb"]
    assert layout.wrap("a" * 68 + " - bbbbbbbb")[0] == "a" * 68 + " -"
    assert layout.wrap("") == [""] and layout.wrap("x", 0) == ["x"]


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab -日́", max_size=300))
def test_wrap_keeps_words(s):
    lines = layout.wrap(s, 20)
    assert "".join(lines).replace(" ", "") == s.replace(" ", "")
    assert all(layout.columns(x) <= 21 for x in lines)


def test_justify_and_cells():
    line = layout.justify("aa bb cc", 12)
    assert line == "aa  bb  cc" + "" or len(line) <= 12
    assert layout.render_row(["a b", "x"], [1, 3]) == ["|a|x  |", "|b|   |"]
    assert layout.render_row(["", "y"], [2, 2]) == ["|  |y |"]
    words = "the quick brown fox jumps over the lazy dog"
    rendered = [x.strip("|").rstrip() for x in layout.render_row([words], [12])]
    assert rendered == textwrap.wrap(words, 12)


def test_locate_and_as_of(spark):
    pieces = spark.createDataFrame([(1, 0, 10, "a"), (1, 10, 5, "b"), (1, 20, 5, "c")], "k int, start long, len long, v string")
    points = spark.createDataFrame([(1, p) for p in (0, 9, 10, 15, 19, 20, 24, 25)], "k int, pos long")
    got = {r.pos: r.v for r in ops.locate(points, pieces, ["k"], "pos", "start", "len", ["v"]).collect()}
    assert got == {0: "a", 9: "a", 10: "b", 15: None, 19: None, 20: "c", 24: "c", 25: None}


def test_base_chain(spark):
    rows = spark.createDataFrame([(i, i - 1 if i else None, 7 if i == 0 else None) for i in range(20)], "k int, b int, v int")
    assert {r.v for r in ops.base_chain(rows, [], "k", "b", "v").collect()} == {7}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, duck, name):
    df = plans.QUERIES[name](spark, SF)
    rows = df.collect()
    if name not in plans.ORACLE:
        assert rows
        return
    q = duck.execute(plans.ORACLE[name])
    names = [d[0] for d in q.description]
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    assert sorted(repr([r[c] for c in order]) for r in rows) == sorted(repr([v[names.index(c)] for c in order]) for v in q.fetchall())


def test_flagship_against_plain_python(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    expected = set()
    for d in docs:
        found = [x for p in d.text.split("\n") if p.strip() for x in layout.wrap(p)]
        expected |= {(d.doc_id, i + 1, x) for i, x in enumerate(found)}
    assert {tuple(r) for r in plans.QUERIES["L3_flagship_paragraph_lines"](spark, SF).collect()} == expected
