"""Binary documents to DataFrames: files are read by Spark, each is parsed in one pass in a Python worker, and what it holds comes
back as one nested row.  Relations are explode()s of it."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import asdict

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.operators.layout import columns, justify, render_row, wrap
from scriptorium.operators.relations import inherited
from scriptorium.sinks.docbook import HEAD, Book, add, escaped, inline
from scriptorium.sources import parse as parser

RUN = "struct<text:string,style:int>"
PARAGRAPH = f"struct<seq:int,char_pos:bigint,list_id:string,kind:string,istd:int,alignment:int,left_twips:int,before_twips:int,after_twips:int,right_twips:int,list_index:int,list_level:int,nfc:int,mark:string,start_at:int,pause:boolean,label:string,runs:array<{RUN}>,cells:array<string>,widths:array<int>>"
PIECE = "struct<seq:int,file_offset:bigint,char_pos:bigint,length:bigint,is_unicode:boolean,prop_mod:int>"
SUMMARY = "struct<title:string,subject:string,author:string,app_name:string,manager:string,company:string,created:bigint,last_saved:bigint,lid:int,hdrftr_spec:int,default_tab:int,created_dttm:bigint,revised_dttm:bigint>"
SECTION = "struct<char_pos:bigint,new_page:boolean>"
HEADER = "struct<section:int,kind:string,text:string>"
SCHEMA = f"path string, guess int, version int, old_mac boolean, fast_saved boolean, error_code string, error_msg string, paragraphs array<{PARAGRAPH}>, pieces array<{PIECE}>, summary {SUMMARY}, sections array<{SECTION}>, headers array<{HEADER}>"
#: Larger files aren't loaded, since a row can't hold them; they are rows with an error.
MOST_BYTES = 1 << 30


def files(spark: SparkSession, path: str, most_bytes: int = MOST_BYTES) -> DataFrame:
    """(path, length, content) of all files under a path.  The content of larger files than `most_bytes` is null and isn't read: the size is
    known from the listing; `parsed` makes error rows of them."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    small = found.filter(F.col("length") <= most_bytes).select("path", "length", "content")
    return small.unionByName(found.filter(F.col("length") > most_bytes).select("path", "length", F.lit(None).cast("binary").alias("content")))


def stream_files(spark: SparkSession, path: str) -> DataFrame:
    """The same of files as they arrive."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", "true").load(path).select("path", "length", "content")


def parsed(rows: DataFrame, show_hidden: bool = False, show_removed: bool = False, text_compat: bool = False) -> DataFrame:
    """One nested row for each row of (path, content); text_compat: only styles, not runs, hide, remove or capitalise text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = arrow_schema()
        for b in batches:
            for path, content, unread in zip(*b.columns, strict=True):
                found = parser.Parsed(error_code="too_large", error_msg="the file is larger than a row can be") if unread.as_py() else parser.parse(content.as_py(), show_hidden, show_removed, text_compat)
                row = asdict(found) | {"path": path.as_py()}
                yield pa.RecordBatch.from_pylist([row], schema)

    unread = F.col("content").isNull() & (F.col("length") > 0) if "length" in rows.columns else F.lit(False)
    return rows.select(F.col("path").cast("string"), F.col("content").cast("binary"), unread.alias("unread")).mapInArrow(run, SCHEMA)


def arrow_schema() -> pa.Schema:
    run = pa.struct([("text", pa.string()), ("style", pa.int32())])
    paragraph = pa.struct([("seq", pa.int32()), ("char_pos", pa.int64()), ("list_id", pa.string()), ("kind", pa.string()), *[(n, pa.int32()) for n in ("istd", "alignment", "left_twips", "before_twips", "after_twips", "right_twips", "list_index", "list_level", "nfc")], ("mark", pa.string()), ("start_at", pa.int32()), ("pause", pa.bool_()), ("label", pa.string()), ("runs", pa.list_(run)), ("cells", pa.list_(pa.string())), ("widths", pa.list_(pa.int32()))])
    piece = pa.struct([("seq", pa.int32()), ("file_offset", pa.int64()), ("char_pos", pa.int64()), ("length", pa.int64()), ("is_unicode", pa.bool_()), ("prop_mod", pa.int32())])
    summary = pa.struct([(n, pa.string()) for n in ("title", "subject", "author", "app_name", "manager", "company")] + [("created", pa.int64()), ("last_saved", pa.int64()), ("lid", pa.int32()), ("hdrftr_spec", pa.int32()), ("default_tab", pa.int32()), ("created_dttm", pa.int64()), ("revised_dttm", pa.int64())])
    return pa.schema([("path", pa.string()), ("guess", pa.int32()), ("version", pa.int32()), ("old_mac", pa.bool_()), ("fast_saved", pa.bool_()), ("error_code", pa.string()), ("error_msg", pa.string()), ("paragraphs", pa.list_(paragraph)), ("pieces", pa.list_(piece)), ("summary", summary), ("sections", pa.list_(pa.struct([("char_pos", pa.int64()), ("new_page", pa.bool_())]))), ("headers", pa.list_(pa.struct([("section", pa.int32()), ("kind", pa.string()), ("text", pa.string())])))])


def paragraphs(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.explode("paragraphs").alias("p")).select("path", "p.*")


def runs(docs: DataFrame) -> DataFrame:
    return paragraphs(docs).select("path", "seq", "list_id", F.posexplode("runs").alias("run", "r")).select("path", "seq", "list_id", "run", "r.*")


def pieces(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.explode("pieces").alias("p")).select("path", "p.*")


def metadata(docs: DataFrame) -> DataFrame:
    """Kind, version, errors and summary of each file; times are timestamps."""
    from scriptorium.functions.units import language

    s = F.col("summary")
    return docs.select("path", "guess", "version", "old_mac", "fast_saved", "error_code", "error_msg", *[s[c].alias(c) for c in ("title", "subject", "author", "app_name", "manager", "company")], F.timestamp_seconds(s["created"]).alias("created"), F.timestamp_seconds(s["last_saved"]).alias("last_saved"), language(s["lid"]).alias("lang"))


def sections(docs: DataFrame) -> DataFrame:
    return docs.select("path", F.posexplode("sections").alias("section", "s")).select("path", "section", "s.*")


def headers(docs: DataFrame) -> DataFrame:
    """(path, section, and the text of each kind of header and footer); those that a section lacks are those of the section before."""
    rows = docs.select("path", F.explode("headers").alias("h")).select("path", "h.*")
    wide = rows.groupBy("path", "section").pivot("kind", list(parser.HEADERS)).agg(F.first("text"))
    return inherited(wide, ["path"], "section", list(parser.HEADERS))


def header_on_page(pages: DataFrame, headers: DataFrame) -> DataFrame:
    """`pages` (path, section, page, first_in_section) with `header` and `footer`; sections beyond the last known one show its."""
    last = headers.groupBy("path").agg(F.max("section").alias("_last"))
    found = pages.join(last, "path", "left").withColumn("_section", F.greatest(F.lit(0), F.least("section", "_last"))).join(headers.withColumnRenamed("section", "_section"), ["path", "_section"], "left")

    def shown(side: str) -> Column:
        return F.when(F.col("first_in_section"), F.col(f"{side}_first")).when(F.col("page") % 2 == 1, F.col(f"{side}_odd")).otherwise(F.col(f"{side}_even"))

    return found.select(*pages.columns, shown("hdr").alias("header"), shown("ftr").alias("footer"))


def properties(docs: DataFrame) -> DataFrame:
    """Default tab in millipoints and the times of creation and revision in the document's own properties."""
    from scriptorium.functions.dates import dttm
    from scriptorium.functions.units import tab_width

    s = F.col("summary")
    return docs.select("path", tab_width(s["default_tab"]).alias("tab"), dttm(s["created_dttm"]).alias("created"), dttm(s["revised_dttm"]).alias("revised"), s["hdrftr_spec"].alias("hdrftr_spec"))


def table_rows(docs: DataFrame) -> DataFrame:
    return paragraphs(docs).filter("kind = 'row'").select("path", "seq", "cells", "widths")


def unmatched_rows(docs: DataFrame) -> DataFrame:
    """Rows whose cells don't match their columns: they are left out of texts."""
    return table_rows(docs).filter(F.size("cells") != F.size("widths"))


def marks(text: str, style: int) -> str:
    body = text.strip(" ")
    if not body:
        return text
    on = "".join(c for bit, c in ((parser.BOLD, "*"), (parser.ITALIC, "/"), (parser.UNDERLINE, "_")) if style & bit)
    at = text.index(body)
    return text[:at] + on + body + on[::-1] + text[at + len(body) :]


CHAR = 6400
JUSTIFIED = 3


def chars(twips: int) -> int:
    """Whole characters of a width, towards 0."""
    return int(twips * 50 / CHAR)


def row_lines(cells: list[str], widths: list[int], width: int) -> list[str]:
    """A table row; rows whose cells don't match their columns have no lines."""
    if len(cells) != len(widths):
        return []
    factor = min(max(width or 145, 45), 145) / 76
    cols = [int((w * 50 * factor + CHAR / 2) / CHAR) for w in widths]
    return render_row(cells, [max(1, c - 1) for c in cols])


def paragraph_lines(text: str, p: dict, width: int) -> list[str]:
    """A paragraph between its indents; the label of a list hangs before its first line."""
    label, indent, right = p["label"], chars(p["left_twips"]), chars(p["right_twips"])
    out = []
    for k, part in enumerate(text.split("\n")):
        lines = wrap(part, max(1, width + right), indent) if width else [part]
        heads = [label if not k and not i else "" for i in range(len(lines))]
        for i, (head, line) in enumerate(zip(heads, lines, strict=True)):
            line, pad = head + line, max(0, indent - len(head))
            if width and p["alignment"] == JUSTIFIED and i < len(lines) - 1:
                line = justify(line, width + right - pad)
            elif width and p["alignment"] in (1, 2) and line.strip() and not head:
                room = max(0, width - columns(line.rstrip()))
                pad += room // 2 if p["alignment"] == 1 else room
            out.append(" " * pad + line if line else "")
    return out


def text_of(found: list[dict], width: int = 76, formatted: bool = False) -> str:
    """A document's paragraphs as lines; notes follow a rule."""
    out: list[str] = []
    for place, name in enumerate(parser.PRINTED):
        own = [p for p in found if p["list_id"] == name]
        if own and place and out:
            out.append("-" * 23)
        for p in own:
            if p["kind"] == "row":
                out += row_lines(p["cells"], p["widths"], width)
                continue
            before, after = p["before_twips"] * 50 >= 6000, p["after_twips"] * 50 >= 6000
            line = "".join(marks(r["text"], r["style"]) if formatted else r["text"] for r in p["runs"])
            out += [""] * before + paragraph_lines(line, p, width) + [""] * after
    return "\n".join(out) + "\n"


#: Numerations of DocBook lists by number format; others are arabic, bullets have none.
NUMERATION = {1: "upperroman", 2: "lowerroman", 3: "upperalpha", 4: "loweralpha"}


def note_texts(found: list[dict]) -> list[str]:
    """The footnotes in order, as paragraphs of DocBook; what leads up to a note's text goes."""
    notes: list[list[str]] = []
    for p in found:
        if p["list_id"] == "footnote" and p["kind"] == "para":
            own = "".join(r["text"] for r in p["runs"] if not r["style"] & parser.NOTE).replace("\t", " ")
            if not notes or any(r["style"] & parser.NOTE for r in p["runs"]):
                notes.append([])
            notes[-1].append(escaped(own.strip(" ")))
    return ["<para>" + "</para><para>".join([x for x in n if x] or [""]) + "</para>" for n in notes]


def book_of(found: list[dict], summary: dict | None) -> str:
    s = summary or {}
    info = {tag: s[k] for k, tag in (("title", "title"), ("subject", "subtitle"), ("author", "author"), ("company", "corpname")) if s.get(k)}
    book, notes = Book(title=s.get("title") or "", info=info), iter(note_texts(found))

    def xml(r: dict) -> str:
        if r["style"] & parser.NOTE:
            return f"<footnote>{next(notes, '<para></para>')}</footnote>"
        return inline(r["text"], *[bool(r["style"] & bit) for bit in (parser.BOLD, parser.ITALIC, parser.UNDERLINE, parser.STRIKE, parser.SUPER, parser.SUB)])

    for p in found:
        if p["list_id"] != "text":
            continue
        body = "".join(map(xml, p["runs"]))
        if p["kind"] == "row":
            if len(p["cells"]) == len(p["widths"]):
                book.row(p["cells"], p["widths"])
        elif 1 <= p["istd"] <= 9:
            add(book, f"h{p['istd']}", "".join(r["text"] for r in p["runs"] if not r["style"] & parser.NOTE))
        elif p["list_index"]:
            book.item(body, None if p["nfc"] in parser.UNNUMBERED else NUMERATION.get(p["nfc"], "arabic"), not p["pause"])
        else:
            book.paragraph(body)
    return HEAD + book.finish()


def rendered(docs: DataFrame, to: str = "text", width: int = 76) -> DataFrame:
    """(path, text) of each file without an error; to: text, formatted or docbook."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = []
            for found, summary in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                texts.append(book_of(found, summary) if to == "docbook" else text_of(found, width, to == "formatted"))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["path", "text"])

    return docs.filter("error_code is null").select("path", "paragraphs", "summary").mapInArrow(run, "path string, text string")
