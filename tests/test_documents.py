"""The parser of binary documents against files that the tests write."""

import struct
import xml.etree.ElementTree as ET

import pytest
from files import container, dos, mac, summary, win, word6, word8

from scriptorium.functions import text as functions_text
from scriptorium.sources import documents, parse, tables8


def lines(p):
    return ["".join(r["text"] for r in x["runs"]) for x in p.paragraphs]


def sprm(op, value, kind="B"):
    return struct.pack("<H" + kind, op, value)


def test_flat_files():
    p = parse.parse(dos("Zürich\rÉté\r".encode("cp850")))
    assert (p.guess, p.version, p.error_code, lines(p)) == (0, 0, None, ["Zürich", "Été"])
    assert parse.parse(dos(b"x\r", fast=True)).error_code == "fast_saved"
    for five, ver in ((False, 4), (True, 5)):
        p = parse.parse(mac("café\r".encode("mac_roman"), five))
        assert (p.guess, p.version, p.old_mac, lines(p)) == (5, ver, True, ["café"])
    assert parse.parse(mac(b"x\r", fast=True)).error_code == "fast_saved"
    p = parse.parse(win("naïve\rtwo".encode("cp1252")))
    assert (p.guess, p.version, lines(p)) == (2, 2, ["naïve", "two"])
    assert parse.parse(win(b"x\r", one=True)).version == 1
    assert parse.parse(win(b"x\r", flags=4)).error_code == "fast_saved"
    assert parse.parse(win(b"x\r", flags=0x100)).error_code == "encrypted"


@pytest.mark.parametrize(("raw", "code"), [(None, "not_a_document"), (b"", "not_a_document"), (b"{\\rtf1 x}", "rtf"), (b"\xffWPC....", "wordperfect"), (b"\x31\xbe\0\0\0\xab" + b"\0" * 121, "not_a_document"), (dos(b"x")[:100] + b"\0" * 10, "not_a_document")])
def test_refused(raw, code):
    assert parse.parse(raw).error_code == code


def test_sizes_of_containers():
    head = bytes.fromhex("d0cf11e0a1b11ae1")
    assert [parse.guess(head.ljust(n, b"\0")) for n in (1535, 1536, 1537, 1538, 2049, 2051)] == [-1, 6, -1, -1, 6, -1]


def test_word8_pieces():
    p = parse.parse(word8([("Hello\r".encode("cp1252"), False)], [6]))
    assert (p.version, lines(p), p.error_code) == (8, ["Hello"], None)
    p = parse.parse(word8([("Žluť\r".encode("utf-16-le"), True)], [5]))
    assert lines(p) == ["Žluť"]
    mixed = [(b"one ", False), ("dva\r".encode("utf-16-le"), True), (b"three\r", False)]
    p = parse.parse(word8(mixed, [14], flags=4, order=[2, 0, 1], mods=b"\x01\x02\x00ab"))
    assert lines(p) == ["one dva", "three"] and p.fast_saved
    assert [x["char_pos"] for x in p.pieces] == [0, 4, 12] and [x["is_unicode"] for x in p.pieces] == [False, True, False]


def test_word8_errors():
    assert parse.parse(word8([(b"x\r", False)], [2], flags=0x100)).error_code == "encrypted"
    assert parse.parse(container({"Workbook": b"\0" * 4096})).error_code == "spreadsheet"
    assert parse.parse(container({"WordDocument": b"\0" * 600})).error_code in ("text_too_small", "damaged")
    raw = bytearray(word8([(b"x\r", False)], [2]))
    struct.pack_into("<I", raw, 0x30, 99999)
    assert parse.parse(bytes(raw)).error_code == "damaged"
    for cut in range(0, len(raw), 517):  # no prefix may raise
        parse.parse(word8([(b"x\r", False)], [2])[:cut])


def test_fields_and_specials():
    text = b"a \x13PAGE \x147\x15 b\x13GONE\x15c\x0bd\x1ee\x1f\r"
    assert lines(parse.parse(word8([(text, False)], [len(text)]))) == ["a 7 bc\nd-e"]


def test_runs():
    text = b"plain bold gone hidden\r"
    runs = [(0, 6, b""), (6, 10, sprm(0x0835, 1)), (10, 15, sprm(0x0800, 1)), (15, 22, sprm(0x083C, 1)), (22, 23, b"")]
    raw = word8([(text, False)], [len(text)], characters=runs)
    p = parse.parse(raw)
    assert p.paragraphs[0]["runs"] == [{"text": "plain ", "style": 0}, {"text": "bold", "style": parse.BOLD}]
    assert lines(parse.parse(raw, show_hidden=True, show_removed=True)) == ["plain bold gone hidden"]
    assert documents.text_of(p.paragraphs, formatted=True) == "plain *bold*\n"


def test_headings_and_alignment():
    text = b"Head\rcentred\r"
    runs = [(0, 5, struct.pack("<H", 1)), (5, 13, struct.pack("<H", 0) + sprm(0x2403, 1))]
    p = parse.parse(word8([(text, False)], [len(text)], paragraphs=runs))
    assert [(x["istd"], x["alignment"]) for x in p.paragraphs] == [(1, 0), (0, 1)]
    assert documents.text_of(p.paragraphs).split("\n") == ["", "Head", "", " " * 34 + "centred", ""]
    tree = ET.fromstring(documents.book_of(p.paragraphs, {"title": "A & B", "author": "C"}).split("\n", 2)[2])
    assert tree.find("chapter/title").text == "Head" and tree.find("chapter/para").text == "centred" and tree.find("title").text == "A & B"


def test_tables():
    text = b"a\x07b\x07\x07after\r"
    cell, widths = struct.pack("<H", 0) + sprm(0x2416, 1), struct.pack("<4h", 0, 1280, 2560, 0)[:6]
    row = cell + sprm(0x2417, 1) + struct.pack("<HHB", 0xD608, 1 + 1 + 6, 2) + widths
    p = parse.parse(word8([(text, False)], [len(text)], paragraphs=[(0, 2, cell), (2, 4, cell), (4, 5, row), (5, 11, b"")]))
    assert [(x["kind"], x["cells"], x["widths"]) for x in p.paragraphs] == [("row", ["a", "b"], [1280, 1280]), ("para", [], [])]
    assert documents.text_of(p.paragraphs) == "|a        |b        |\nafter\n"


def test_notes():
    body, foot, end = b"x\x02 y\x02 z\x02\r", b"\x02 first\r\x02 second\r", b"\x02 end\r"
    whole = body + foot + end
    p = parse.parse(word8([(whole, False)], [len(body), len(foot), 0, 0, 0, len(end), 0, 0], footnotes=[1, 4], endnotes=[7]))
    assert lines(p)[0] == "x[1] y[2] z[i]"
    assert [x["list_id"] for x in p.paragraphs] == ["text", "footnote", "footnote", "endnote"]
    assert documents.text_of(p.paragraphs).count("-" * 23) == 2
    assert lines(p)[1:] == ["[1] first", "[2] second", "[i] end"]


def test_summary_and_frames(spark, tmp_path):
    raw = word8([(b"Text one\r", False)], [9], extra={"\x05SummaryInformation": summary("My title", "Me", 1_000_000_000)})
    for name, content in {"a.doc": raw, "b.doc": dos(b"dos text\r"), "c.doc": b"junk"}.items():
        (tmp_path / name).write_bytes(content)
    docs = documents.parsed(documents.files(spark, str(tmp_path))).cache()
    meta = {r.path[-5:]: r for r in documents.metadata(docs).collect()}
    assert meta["a.doc"].title == "My title" and meta["a.doc"].author == "Me" and str(meta["a.doc"].created) == "2001-09-09 01:46:40"
    assert meta["c.doc"].error_code == "not_a_document" and meta["b.doc"].version == 0
    texts = {r.path[-5:]: r.text for r in documents.rendered(docs).collect()}
    assert texts == {"a.doc": "Text one\n", "b.doc": "dos text\n"}
    assert documents.runs(docs).count() == 2 and documents.pieces(docs).count() == 2
    assert documents.rendered(docs, "docbook").count() == 2
    assert documents.unmatched_rows(docs).count() == 0


def test_streaming(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "b.doc").write_bytes(dos(b"dos text\r"))
    stream = documents.rendered(documents.parsed(documents.stream_files(spark, str(tmp_path / "in"))))
    q = stream.writeStream.format("memory").queryName("streamed").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    assert [r.text for r in spark.sql("select text from streamed").collect()] == ["dos text\n"]


def test_stylesheet_and_lists():
    def std(base, paragraph=b"", character=b""):
        body = struct.pack("<4H", 0, base * 16 + 1, 2, 0) + b"\0\0" + struct.pack("<H", 1) + "x".encode("utf-16-le") + b"\0\0"
        upx = struct.pack("<H", 0) + paragraph
        for x in (upx, character):
            body += struct.pack("<H", len(x)) + x + b"\0" * (len(x) % 2)
        return struct.pack("<H", len(body)) + body

    sheet = struct.pack("<9H", 18, 12, 10, 0, 0, 0, 0, 0, 0) + b"\0\0"
    sheet += std(0xFFF, sprm(0x2403, 1), sprm(0x0835, 1)) + b"\0\0" * 9 + std(0, sprm(0x840F, 720, "h")) + std(10, b"", sprm(0x0836, 1))
    level = lambda start, nfc, text, places=b"\1": struct.pack("<IBB", start, nfc, 0) + places.ljust(9, b"\0") + b"\0" * 9 + b"\0\0\0\0" + struct.pack("<H", len(text)) + text.encode("utf-16-le")
    lst = struct.pack("<H", 1) + struct.pack("<I", 77) + b"\0" * 22 + b"\0\0"
    levels = b"".join(level(4 if i == 0 else 1, 0 if i == 0 else 2, "\0)") for i in range(9))
    text = b"a\rb\rc\rd\re\r"
    item = lambda ilvl: struct.pack("<H", 10) + sprm(0x260A, ilvl) + sprm(0x460B, 1, "H")
    runs = [(0, 2, item(0)), (2, 4, item(1)), (4, 6, item(1)), (6, 8, item(0)), (8, 10, struct.pack("<H", 11))]
    lfo = struct.pack("<I", 1) + struct.pack("<I", 77) + b"\0" * 12
    p = parse.parse(word8([(text, False)], [10], paragraphs=runs, tables={0xA2: sheet, 0x2E2: lst + levels, 0x2EA: lfo}, sizes={0x2E2: len(lst)}))
    assert p.error_code is None
    assert [x["label"] for x in p.paragraphs] == ["4) ", "i) ", "ii) ", "5) ", ""]
    assert [x["alignment"] for x in p.paragraphs] == [1] * 5 and [x["left_twips"] for x in p.paragraphs] == [720] * 5
    assert p.paragraphs[4]["runs"][0]["style"] == parse.BOLD | parse.ITALIC and p.paragraphs[0]["runs"][0]["style"] == parse.BOLD


def test_document_properties():
    dop = bytearray(28)
    struct.pack_into("<H", dop, 0x0A, 720)
    struct.pack_into("<I", dop, 0x14, 30 | 14 << 6 | 7 << 11 | 3 << 16 | 105 << 20)
    sect = struct.pack("<2I", 0, 2) + struct.pack("<HIHI", 0, 0xFFFFFFFF, 0, 0)
    p = parse.parse(word8([(b"x\r", False)], [2], tables={0x192: bytes(dop), 0xCA: sect}))
    assert p.summary["default_tab"] == 720 and p.summary["created_dttm"] and p.sections == [{"char_pos": 0, "new_page": True}]


def papx6(*steps):
    """Style 0 and a property list of version 6, which follow each other after two more bytes of the paragraph's own."""
    return b"\0\0" + b"".join(bytes([op]) + arg for op, arg in steps)


#: An opcode of each length of versions 6 and 7 with operands that would be read as others if its length were wrong.
LENGTHS = [(2, 2), (3, 1 + 4), (20, 4), (23, 1 + 6), (68, 5), (70, 4), (73, 3), (74, 4), (82, 1), (95, 3), (106, 2), (112, 1), (120, 12), (133, 1), (136, 3), (137, 3), (156, 2), (157, 2), (187, 12), (191, 1 + 3), (192, 4), (193, 5), (199, 5), (200, 4), (4, 1), (250, 1)]


@pytest.mark.parametrize(("op", "n"), LENGTHS)
def test_lengths_of_old_opcodes(op, n):
    counted = op in (3, 23, 191)
    body = (bytes([n - 1]) if counted else b"") + b"\x05" * (n - counted)
    assert list(parse.steps6(bytes([op]) + body + b"\x05\x02")) == [(op, body), (5, b"\x02")]


def test_tabs_of_old_opcodes():
    body = b"\xff\x01" + b"\x05" * 4 + b"\x02" + b"\x05" * 6
    assert [op for op, _ in parse.steps6(b"\x17" + body + b"\x05\x02")][0] == 23
    assert len(list(parse.steps6(b"\x17" + body[:-2]))) == 1


def test_word6_lists_and_indents():
    anld = lambda nfc, start, mark: (12, bytes([21, nfc, 0]) + b"\0" * 8 + struct.pack("<H", start) + b"\0" * 8 + mark)
    left, numbered = (17, struct.pack("<H", 720)), (13, b"\x0a")
    text = b"one\rtwo\rplain\rthree\rpaused\rfour\rdot\r"
    runs, at = [], 0
    props = [papx6((74, b"\5\5\5\5"), left, anld(0, 4, b")"), numbered), papx6(left, anld(2, 4, b"."), numbered), b"", papx6(left, anld(1, 7, b"\0"), (13, b"\x0b")), papx6(left, anld(1, 7, b"\0"), (13, b"\x0c")), papx6(left, anld(1, 7, b"\0"), (13, b"\x0b")), papx6(left, anld(23, 1, b"\xb7"), (13, b"\x0b"))]
    for line, p in zip(text.split(b"\r"), props, strict=False):
        runs.append((at, at + len(line) + 1, p))
        at += len(line) + 1
    p = parse.parse(word6(text, [len(text)], runs))
    assert p.error_code is None and p.version == 6
    assert [x["label"] for x in p.paragraphs] == ["4) ", "v. ", "", "VI. ", "", "VII. ", "• "]
    assert documents.text_of(p.paragraphs).split("\n")[:3] == ["  4) one", "  v. two", "plain"]
    tree = ET.fromstring(documents.book_of(p.paragraphs, None).split("\n", 2)[2])
    assert [(x.tag, x.get("numeration")) for x in tree.find("chapter")] == [("title", None), ("orderedlist", "arabic"), ("para", None), ("orderedlist", "upperroman")]
    assert [x.get("override") for x in tree.iter("listitem")] == [None, None, None, "none", None, None]


def test_justified_and_right_indent():
    words = b"The quick brown fox jumps over the lazy dog, and after that it jumps over the dog again until evening.\r"
    p = parse.parse(word8([(words, False)], [len(words)], paragraphs=[(0, len(words), struct.pack("<H", 0) + sprm(0x2403, 3) + sprm(0x840E, -1280, "h"))]))
    first, second, _ = documents.text_of(p.paragraphs, 60).split("\n")[:3]
    assert len(first) == 50 and "  " in first and first.split() + second.split() == words.decode().split()[: len(first.split() + second.split())]
    p.paragraphs[0]["alignment"] = 0
    plain = documents.text_of(p.paragraphs, 60).split("\n")[0]
    assert "  " not in plain and plain.split() == first.split()


def test_book_of_styles_tables_and_notes():
    body = b"a\x02 bold up\rx\x07y\x07\x07z\r"
    notes = b"\x02 the\tnote\rmore \r"
    cell = struct.pack("<H", 0) + sprm(0x2416, 1)
    row = cell + sprm(0x2417, 1) + struct.pack("<HHB", 0xD608, 8, 2) + struct.pack("<3h", 0, 1280, 2560)
    raw = word8([(body + notes, False)], [len(body), len(notes)], paragraphs=[(0, 11, b""), (11, 13, cell), (13, 15, cell), (15, 16, row), (16, len(body + notes), b"")], characters=[(0, 2, b""), (2, 8, sprm(0x0835, 1)), (8, 10, sprm(0x2A48, 1)), (10, 30, b"")], footnotes=[1])
    p = parse.parse(raw)
    xml = documents.book_of(p.paragraphs, None)
    assert '<para>a<footnote><para>the note</para><para>more</para></footnote><emphasis role="bold"> bold </emphasis><superscript>up</superscript></para>' in xml
    assert '<informaltable frame="none" colsep="0" rowsep="0"><tgroup cols="2"><colspec colwidth="64.00pt"/><colspec colwidth="64.00pt"/><tbody><row><entry>x</entry><entry>y</entry></row></tbody></tgroup></informaltable><para>z</para>' in xml
    ET.fromstring(xml.split("\n", 2)[2])


def test_headers(spark, tmp_path):
    body, texts = b"text\r", [b"even\r", b"", b"foot\r", b"", b"first\r", b""]
    ends = [sum(map(len, texts[:i])) for i in range(7)]
    total = ends[-1]
    whole = body + b"".join(texts) + b"later\r"
    plc = struct.pack("<20I", *ends, *[total] * 6, *[total + 6] * 7)  # the first place of section 1 has six characters
    p = parse.parse(word8([(whole, False)], [len(body), 0, len(whole) - len(body)], tables={0xF2: plc}))
    found = {(h["section"], h["kind"]): h["text"] for h in p.headers}
    assert (found[0, "hdr_even"], found[0, "hdr_odd"], found[0, "ftr_even"], found[0, "hdr_first"]) == ("even", None, "foot", "first")
    assert {k: v for k, v in found.items() if k[0] == 1 and v} == {(1, "hdr_even"): "later"}
    (tmp_path / "a.doc").write_bytes(word8([(whole, False)], [len(body), 0, len(whole) - len(body)], tables={0xF2: plc}))
    wide = documents.headers(documents.parsed(documents.files(spark, str(tmp_path)))).cache()
    rows = {r.section: r for r in wide.collect()}
    assert (rows[0].hdr_even, rows[0].hdr_odd, rows[0].ftr_odd, rows[1].hdr_even, rows[1].hdr_odd, rows[1].hdr_first) == ("even", "first", None, "later", "first", "first")
    pages = wide.select("path").distinct().crossJoin(spark.createDataFrame([(0, 1, True), (0, 2, False), (7, 3, False)], "section int, page int, first_in_section boolean"))
    assert [(r.header, r.footer) for r in documents.header_on_page(pages, wide).orderBy("page").collect()] == [("first", None), ("even", "foot"), ("first", None)]


def test_word6_headers_and_sections():
    body, head = b"text\r", b"sep\rodd\rfirst\r"
    main_at = 768 + len(body + head)
    sepx = struct.pack("<H", 6) + bytes([142, 0, 153, 1 << 6 | 1 << 3, 5, 0])
    sect = struct.pack("<2I", 0, len(body)) + struct.pack("<HIHI", 0, main_at, 0, 0)
    dop = bytearray(28)
    struct.pack_into("<H", dop, 0, (1 << 7) << 8)
    plc = struct.pack("<5I", 0, 4, 8, 14, 15)
    p = parse.parse(word6(body + head, [len(body), 0, len(head)], tables={0x10: sepx, 0x88: sect, 0x150: bytes(dop), 0xB0: plc}))
    assert p.sections == [{"char_pos": 0, "new_page": False}]
    assert {h["kind"]: h["text"] for h in p.headers if h["text"]} == {"hdr_odd": "odd", "hdr_first": "first"}


def test_text_compat():
    raw = word8([(b"a secret\r", False)], [9], characters=[(0, 2, b""), (2, 9, sprm(0x083C, 1))])
    assert lines(parse.parse(raw)) == ["a "] and lines(parse.parse(raw, text_compat=True)) == ["a secret"]


def test_capitals():
    raw = word8([("stra\xdfe \xff\r".encode("cp1252"), False)], [9], characters=[(0, 9, sprm(0x083B, 1))])
    assert lines(parse.parse(raw)) == ["STRA\xdfE \xff"]


def test_files_above_the_limit(spark, tmp_path):
    """They are rows with an error, and their bytes aren't read."""
    (tmp_path / "small.doc").write_bytes(dos(b"small\r"))
    (tmp_path / "large.doc").write_bytes(dos(b"large " * 500 + b"\r"))
    found = documents.files(spark, str(tmp_path), 2000)
    assert {r.path[-9:]: r.content is None for r in found.collect()} == {"small.doc": False, "large.doc": True}
    codes = {r.path[-9:]: r.error_code for r in documents.metadata(documents.parsed(found)).collect()}
    assert codes == {"small.doc": None, "large.doc": "too_large"}


def test_list_marks():
    """Bullets by the symbol table, also those of version 8; other marks beyond ASCII are full stops."""
    assert [tables8.list_mark(23, c) for c in (0x2A, 0xF0B7, 0xF0A7, 0xF0FC, 0xF0FF, 0x3B1)] == ["*", "\u2022", "\u25aa", "\u2713", "\u2022", "\u03b1"]
    assert [tables8.list_mark(0, c) for c in (0x29, 0xF0B7)] == [")", "."] and tables8.list_mark(255, 0xF0FF) == "\u2190"


def test_symbols_of_the_private_area(spark):
    text = "a\uf061\uf0a3\uf020\uf042\uf080 \uf0b7"
    (docs,) = [parse.cleaned(text)]
    assert docs == "a\u03b1\u2264 \u0392? \u2022"
    assert spark.createDataFrame([(text,)], "t string").select(functions_text.private_symbols("t").alias("x")).first().x == docs
