"""Chains, records, piece tables, merged streams, pages, metrics and tags against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import binary
from scriptorium.operators import chains, lists, metrics, paging, relations, streams, textblocks
from scriptorium.sinks import docbook
from scriptorium.sources import parse


def test_chains(spark):
    """Two files of shuffled blocks; a shared tail; a start without an entry; a chain of 1,000."""
    rng, rows, want = random.Random(1), [], {}
    for path, length in (("a", 1000), ("b", 37)):
        order = rng.sample(range(length + 50), length)
        rows += [(path, x, y) for x, y in zip(order, [*order[1:], -2])]
        want |= {(path, order[0]): order, (path, order[20]): order[20:]}
    starts = spark.createDataFrame([*want, ("a", 5000), ("b", None)], "path string, start long")
    found = chains.followed(spark.createDataFrame(rows, "path string, block long, next long"), starts, ["path"]).collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        assert len(got.setdefault((r.path, r.start), [])) == r["rank"]
        got[r.path, r.start].append(r.block)
    assert got == want


def test_damaged_chains(spark):
    entries = spark.createDataFrame([("f", 0, 1), ("f", 1, 2), ("f", 2, 1), ("f", 3, 4), ("f", 4, 99), ("f", 5, -2)], "path string, block long, next long")
    found = chains.followed(entries, spark.createDataFrame([("f", 0), ("f", 3), ("f", 5)], "path string, start long"), ["path"])
    assert {tuple(r) for r in chains.damaged(entries, found, ["path"]).collect()} == {("f", 0, "circle"), ("f", 3, "outside")}
    assert found.count() == 6 + 2 + 1  # the circle ends after as many blocks as there are


@pytest.mark.parametrize("kind", ["string", "binary"])
def test_chained_read(spark, kind):
    blocks = spark.createDataFrame([(1, 2, 0, "abcd"), (1, 0, 1, "efgh"), (1, 1, -2, "ij")], "k int, block long, next long, content string").withColumn("content", F.col("content").cast(kind))
    found = chains.followed(blocks, spark.createDataFrame([(1, 2)], "k int, start long"), ["k"])
    read = lambda at, n: chains.read(found, blocks, ["k"], 4, F.lit(at), F.lit(n)).first().content
    expected = {(0, 10): "abcdefghij", (3, 3): "def", (4, 4): "efgh", (7, 3): "hij", (7, 4): None, (11, 1): None, (5, 1): "f"}
    for (at, n), text in expected.items():
        got = read(at, n)
        assert (bytes(got).decode() if isinstance(got, bytearray | bytes) else got) == text


def test_small_blocks(spark):
    chain = spark.createDataFrame([("f", 9, 0, 9), ("f", 9, 1, 4)], "path string, start long, rank long, block long")
    rows = spark.createDataFrame([("f", 0), ("f", 7), ("f", 8), ("f", 15), ("f", 16), ("g", 0)], "path string, i long")
    got = {(r.path, r.i): r.file_offset for r in chains.small_offsets(rows, chain, ["path"], "i").collect()}
    assert got == {("f", 0): 10 * 512, ("f", 7): 10 * 512 + 7 * 64, ("f", 8): 5 * 512, ("f", 15): 5 * 512 + 7 * 64, ("f", 16): 0, ("g", 0): 0}


RAW = [b"", b"\x16\x24\x01", b"\x15\xc6\xff\x02" + b"x" * 8 + b"\x01yyyend", b"\x08\xd6\x04\0\0\0\0\x17\x24\x01", b"\x17\xff\x01abcd\x01xyz\x05\x01", b"\x03\x05hello\x18\x01", b"\x01", bytes(range(256)) * 3]


def test_records(spark):
    rng = random.Random(2)
    raws = RAW + [bytes(rng.randrange(256) for _ in range(rng.randrange(400))) for _ in range(60)]
    rows = spark.createDataFrame([(i, bytearray(r)) for i, r in enumerate(raws)], "i int, c binary")
    for column, steps, width in ((binary.records8, parse.steps8, 2), (binary.records6, parse.steps6, 1)):
        for r in rows.select("i", column(F.col("c")).alias("r")).collect():
            raw = raws[r.i]
            got = [(x.op, raw[x["at"] + width : x["at"] + x["size"]]) for x in r.r]
            want = list(steps(raw))
            assert got[: len(want)] == want and all(x["at"] >= len(raw) - 1 for x in r.r[len(want) :])  # a lone last byte is no opcode of two


def test_piece_tables(spark):
    u16, u32 = (lambda x: x.to_bytes(2, "little")), (lambda x: x.to_bytes(4, "little"))
    table = lambda pieces: b"\x02" + u32(12 * len(pieces) + 4) + b"".join(u32(sum(n for n, _, _ in pieces[:i])) for i in range(len(pieces) + 1)) + b"".join(b"\0\0" + u32(at) + u16(mod) for _, at, mod in pieces)
    files = {
        "plain": table([(5, 1 << 30 | 2048, 0), (7, 4096, 3)]), "lists": b"\0\0\x01" + u16(3) + b"abc" + b"\x01" + u16(0) + table([(1, 64, 0)]),
        "none": b"", "only lists": b"\x01" + u16(2) + b"xy", "empty": table([]), "short": b"\x02" + u32(3), "unknown": b"\x09abc",
    }
    rows = spark.createDataFrame([(k, bytearray(v)) for k, v in files.items()], "k string, c binary")
    out = {r.k: (r.p and [tuple(x) for x in r.p], [bytes(x) for x in r.l]) for r in rows.select("k", textblocks.pieces(F.col("c")).alias("p"), textblocks.property_lists(F.col("c")).alias("l")).collect()}
    for k in ("plain", "lists", "only lists", "empty"):
        pieces, held = parse.piece_table(files[k], False, True)
        assert [p[1:] for p in out[k][0] or []] == pieces and out[k][1] == held
    assert out["plain"][0][1] == (5, 4096, 14, True, 3)
    assert out["none"][0] == out["only lists"][0] == out["empty"][0] == [] and out["short"][0] is None and out["unknown"][0] is None


def test_row_info(spark):
    lists_ = {
        "18 01 19 00": "not_end_of_row", "18 01 19 01": "cell", "18 00 19 01 BE 02 00 00": "end_of_row", "18 00": "not_cell", "05 FF": None, "": None, "19 00 BE 02 00 00 18 01": "cell", "19 00 BE 02 00 00": None,
    }
    rows = spark.createDataFrame([(k, bytearray.fromhex(k)) for k in lists_], "k string, c binary")
    assert {r.k: r.i for r in rows.select("k", textblocks.row_info(F.col("c"), 6).alias("i")).collect()} == lists_
    new = {"16 24 01": "cell", "4B 24 00": "not_cell", "17 24 01 08 D6 02 00 00": "end_of_row", "17 24 00": "not_end_of_row", "16 24 01 17 24 01": "cell"}
    rows = spark.createDataFrame([(k, bytearray.fromhex(k)) for k in new], "k string, c binary")
    assert {r.k: r.i for r in rows.select("k", textblocks.row_info(F.col("c"), 8).alias("i")).collect()} == new


def test_merged_streams(spark):
    a = spark.createDataFrame([(1, 0, "x"), (1, 5, "y"), (1, 5, "z"), (2, 3, "w")], "k int, at int, font string")
    b = spark.createDataFrame([(1, 2, 7, None), (1, 8, None, 1)], "k int, at int, size int, n int")
    end = spark.createDataFrame([(1, 9), (2, 4)], "k int, at int")
    out = streams.merged({"a": a, "b": b, "end": end}, ["k"], "at", "end")
    assert sorted((r.k, r["at"], r.until, r.a and r.a.font, r.b and tuple(r.b)) for r in out.collect()) == [
        (1, 0, 2, "x", None), (1, 2, 5, "x", (7, None)), (1, 5, 8, "z", (7, None)), (1, 8, 9, "z", (None, 1)), (2, 3, 4, "w", None)
    ]
    plan = streams.merged({"a": a, "b": b, "end": end}, ["k"], "at", "end")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1  # one shuffle


@pytest.mark.parametrize("room", [1, 100, 777, 10**9])
def test_pages(spark, room):
    rng = random.Random(room)
    lines = [(k, i, i // 20, rng.choice([0, 5, 60, 100, 101, 900, None])) for k in range(4) for i in range(60)]
    want = {}
    for k in range(4):
        page = top = used = in_section = 0
        section = None
        for _, i, s, h in (x for x in lines if x[0] == k):
            if s != section:
                section, in_section, used, top, page = s, 1, 0, 0, page + 1
            elif used + (h or 0) > room:
                page, in_section, used = page + 1, in_section + 1, 0
            want[k, i] = (page, in_section, used)
            used += h or 0
    out = paging.paged(spark.createDataFrame(lines, "k int, i int, s int, h long"), ["k"], ["i"], "s", "h", room)
    assert {(r.k, r.i): (r.page, r.page_in_section, r.top) for r in out.collect()} == want


def test_metrics(spark, tmp_path):
    (tmp_path / "One.afm").write_text("StartFontMetrics 2.0\nFontName One-Bold\nStartCharMetrics 3\nC 32 ; WX 250 ; N space ; B 0 0 0 0 ;\nC 65 ; WX 722.4 ; N A ; B 15 0 706 674 ;\nC -1 ; WX 999 ; N Aacute ; B 0 0 0 0 ;\nEndCharMetrics\n")
    (tmp_path / "Two.afm").write_text("FontName Two\nC 65 ; WX 600 ; N A ;\n")
    fonts = metrics.read_metrics(spark, str(tmp_path))
    widths = {r.font: r.widths for r in fonts.collect()}
    assert set(widths) == {"One-Bold", "Two"} and widths["One-Bold"][65] == 722 and widths["One-Bold"][32] == 250 and widths["Two"][32] == 0 and len(widths["Two"]) == 256
    rows = metrics.with_metrics(spark.createDataFrame([("One-Bold", "A A", 21), ("Two", "", 21), ("Two", None, 20), ("One-Bold", "A一 ", 20), ("none", "A", 20)], "font string, t string, size int"), fonts, ["font"])
    width = {(r.font, r.t): r.w for r in rows.select("font", "t", metrics.text_width(F.col("t"), F.col("widths"), F.col("size")).alias("w")).collect()}
    assert width == {("One-Bold", "A A"): (1694 * 21 + 1) // 2, ("Two", ""): 0, ("Two", None): 0, ("One-Bold", "A一 "): 15720, ("none", "A"): 6000}
    part = F.array(F.struct(F.lit("A ").alias("text"), "widths", "size"), F.struct(F.lit("A \t").alias("text"), "widths", "size"))
    one = rows.filter("t = 'A A'").select(metrics.line_width(part).alias("l"), metrics.net_width(part).alias("n")).first()
    assert (one.l, one.n) == ((972 * 21 + 1) // 2 + (972 * 21 + 1) // 2, (972 * 21 + 1) // 2 + (722 * 21 + 1) // 2)


def test_lines_by_metrics(spark):
    rng = random.Random(4)
    widths = [rng.randrange(100, 900) for _ in range(256)]
    texts = [" ".join("".join(rng.choice("abcXYZ") for _ in range(rng.randrange(0, 12))) for _ in range(rng.randrange(1, 30))) for _ in range(40)] + ["", "  ", "w" * 300]
    rows = spark.createDataFrame([(i, t, widths) for i, t in enumerate(texts)], "i int, t string, widths array<int>")
    points = lambda t: (sum(widths[ord(c)] for c in t) * 20 + 1) // 2
    for r in rows.select("i", metrics.broken(F.col("t"), F.col("widths"), F.lit(20), 30_000).alias("l")).collect():
        out = []
        for word in texts[r.i].split(" "):
            if out and points(f"{out[-1]} {word}") <= 30_000:
                out[-1] += f" {word}"
            else:
                out.append(word)
        assert [tuple(x) for x in r.l] == [(x, points(x)) for x in out]


def test_tabs(spark):
    cases = {"a\tb": "a   b", "abcd\tx": "abcd    x", "\t\t": " " * 8, "日\tx": "日  x", "ab\tc\n\td": "ab  c\n    d", "plain": "plain", "": "", "é\tx": "é   x"}
    rows = spark.createDataFrame([(k,) for k in [*cases, None]], "t string")
    assert {r.t: r.x for r in rows.select("t", lists.expanded(F.col("t"), 4).alias("x")).collect()} == {**cases, None: None}


def test_headers_on_pages(spark):
    sections = spark.createDataFrame([("d", 0, "first", "odd", "foot"), ("d", 1, None, "odd1", None)], "k string, section long, hdr_first string, hdr_odd string, ftr_even string")
    pages = spark.createDataFrame([("d", 0, True, True), ("d", 0, False, True), ("d", 0, False, False), ("d", 7, False, True), ("d", -1, True, False), ("e", 0, True, True)], "k string, section long, first boolean, odd boolean")
    out = lists.on_page(pages, sections, ["k"], "section", F.col("first"), F.col("odd"), ["hdr_first", "hdr_odd", "ftr_even"]).collect()
    assert {(r.k, r.section, r.first, r.odd): (r.header, r.footer) for r in out} == {
        ("d", 0, True, True): ("first", None), ("d", 0, False, True): ("odd", None), ("d", 0, False, False): (None, "foot"), ("d", 7, False, True): ("odd1", None), ("d", -1, True, False): ("first", None), ("e", 0, True, True): (None, None)
    }


def test_long_chain_of_bases(spark):
    """1,000 styles, the last of which has the value; two that are based on each other; one on a style that isn't there; one on itself."""
    rows = [(i, i + 1, None) for i in range(999)] + [(999, None, 5), (2000, 2001, None), (2001, 2000, None), (2002, 2000, None), (3000, 9999, None), (4000, 4000, None)]
    out = {r.k: (r.v, r.c) for r in relations.base_chain(spark.createDataFrame(rows, "k int, b int, v int"), [], "k", "b", "v", "c").collect()}
    assert all(out[i] == (5, False) for i in range(1000)) and out[2000] == out[2001] == out[2002] == out[4000] == (None, True) and out[3000] == (None, False)


def test_tags_without_a_stack(spark):
    rng, rows, want = random.Random(1), [], {}
    for k in range(300):
        book = docbook.Book()
        for o in range(rng.randint(1, 9)):
            kind, text = rng.choice(["h1", "h2", "h3", "h6", "h7", "item:bullet", "item:arabic", "para", "h2", "item:bullet"]), rng.choice(["", "x", "a<b", "y & z"])
            rows.append((k, o, kind, text))
            docbook.add(book, kind, text)
        want[k] = docbook.HEAD + book.finish()
    out = docbook.documents(spark.createDataFrame(rows, "k long, o int, kind string, t string"), "k", "o", "kind", "t")
    assert {r.k: r.xml for r in out.collect()} == want
