"""DocBook XML.  Tables, paragraphs and books of rows are column expressions and running values; `Book` keeps a stack of open tags for the
renderer of parsed files, which has a document at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from scriptorium.functions.text import xml_escape

HEAD = '<?xml version="1.0" encoding="UTF-8"?>\n<!DOCTYPE book PUBLIC "-//OASIS//DTD DocBook XML V4.1.2//EN" "http://www.oasis-open.org/docbook/xml/4.1.2/docbookx.dtd">\n'
SECTIONS = ("chapter", "sect1", "sect2", "sect3", "sect4", "sect5")


def tables(rows: DataFrame, key: list[str], order: str, cells: str, widths: list[int]) -> DataFrame:
    """(key, xml): the rows of each key as a table; widths are in twips, columns at least a point wide."""
    entries = F.array_join(F.transform(cells, lambda c: F.concat(F.lit("<entry>"), xml_escape(c), F.lit("</entry>"))), "")
    row = F.concat(F.lit("<row>"), entries, F.lit("</row>"))
    specs = "".join(f'<colspec colwidth="{max(1.0, w / 20):.2f}pt"/>' for w in widths)
    body = rows.select(*key, F.struct(F.col(order).alias("o"), row.alias("r")).alias("x")).groupBy(*key).agg(F.sort_array(F.collect_list("x")).alias("rows"))
    head = f'<informaltable frame="all" colsep="1" rowsep="1"><tgroup cols="{len(widths)}">{specs}<tbody>'
    return body.select(*key, F.concat(F.lit(head), F.array_join(F.transform("rows", lambda x: x["r"]), ""), F.lit("</tbody></tgroup></informaltable>")).alias("xml"))


def escaped(text: str) -> str:
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")


def inline(text: str, bold: bool = False, italic: bool = False, underline: bool = False, strike: bool = False, raised: bool = False, lowered: bool = False) -> str:
    """A run; of several styles the first counts."""
    body = escaped(text)
    role = ' role="bold"' if bold else "" if italic else ' role="underline"' if underline else ' role="strikethrough"' if strike else None
    if role is not None:
        body = f"<emphasis{role}>{body}</emphasis>"
    tag = "superscript" if raised else "subscript" if lowered else None
    return f"<{tag}>{body}</{tag}>" if tag and text else body


class Book:
    """Builds a book from paragraphs, given as XML; keeps what is open."""

    def __init__(self, title: str = "", lang: str | None = None, info: dict[str, str] | None = None):
        self.out = [f'<book lang="{lang}">' if lang else "<book>", "<bookinfo>" if info else ""]
        if title:
            self.out.insert(1, f"<title>{escaped(title)}</title>")
        for tag, value in (info or {}).items():
            inner = f"<surname>{escaped(value)}</surname>" if tag == "author" else escaped(value)
            self.out.append(f"<{tag}>{inner}</{tag}>")
        self.out.append("</bookinfo>" if info else "")
        self.open: list[str] = []  # sections, then a list
        self.filled = True  # whether the innermost section has a body
        self.columns = 0  # of the open table

    def section(self, level: int, title: str) -> None:
        self.end_list()
        while len(self.open) >= level:
            self.close()
        while len(self.open) < level - 1:  # levels that the document skips
            self.start(SECTIONS[len(self.open)], "")
        self.start(SECTIONS[level - 1], title)

    def start(self, tag: str, title: str) -> None:
        self.out.append(f"<{tag}>" + (f"<title>{escaped(title)}</title>" if title else "<title/>"))
        self.open.append(tag)
        self.filled = False

    def close(self) -> None:
        if not self.filled:
            self.out.append("<para/>")
        self.out.append(f"</{self.open.pop()}>")
        self.filled = True

    def body(self, xml: str) -> None:
        if not self.open:
            self.start("chapter", "")
        self.out.append(xml)
        self.filled = True

    def start_list(self, numeration: str | None) -> None:
        self.body(f'<orderedlist numeration="{numeration}">' if numeration else '<itemizedlist mark="bullet">')
        self.open.append("orderedlist" if numeration else "itemizedlist")

    def item(self, xml: str, numeration: str | None, marked: bool = True) -> None:
        self.end_table()
        if not (self.open and self.open[-1].endswith("list")):
            self.start_list(numeration)
        self.out.append(("<listitem>" if marked else '<listitem override="none">') + f"<para>{xml}</para></listitem>")

    def row(self, cells: list[str], widths: list[int]) -> None:
        """A table row; rows of another number of columns begin a new group of the same table."""
        if self.columns and self.columns != len(cells):
            self.out.append("</tbody></tgroup>")
        elif not self.columns:
            self.end_list()
            self.body('<informaltable frame="none" colsep="0" rowsep="0">')
        if self.columns != len(cells):
            self.columns = len(cells)
            self.out.append(f'<tgroup cols="{self.columns}">' + "".join(f'<colspec colwidth="{max(1.0, w / 20):.2f}pt"/>' for w in widths) + "<tbody>")
        self.out.append("<row>" + "".join(f"<entry>{escaped(c)}</entry>" for c in cells) + "</row>")

    def end_table(self) -> None:
        if self.columns:
            self.out.append("</tbody></tgroup></informaltable>")
            self.columns = 0

    def end_list(self) -> None:
        self.end_table()
        if self.open and self.open[-1].endswith("list"):
            self.out.append(f"</{self.open.pop()}>")

    def paragraph(self, xml: str) -> None:
        self.end_list()
        self.body(f"<para>{xml}</para>" if xml else "<para/>")

    def finish(self) -> str:
        self.end_list()
        if not self.open:
            self.start("chapter", "")
        while self.open:
            self.close()
        return "".join(self.out) + "</book>"


def add(book: Book, kind: str, text: str) -> None:
    """Add a paragraph of one of the kinds of `tag_events` to a book."""
    if kind[:1] == "h" and kind[1:].isdigit():
        if int(kind[1:]) <= len(SECTIONS):
            book.section(int(kind[1:]), text)
        else:
            book.paragraph(escaped(text))
    elif kind.startswith("item:"):
        book.item(escaped(text), None if kind == "item:bullet" else kind[5:])
    else:
        book.paragraph(escaped(text))


def tag_events(paragraphs: DataFrame, key: str, order: str, kind: str, text: str) -> DataFrame:
    """(key, order, seq, xml): the opening tags, closing tags and bodies that make each key's book, in their order.

    kind: h1 to h9 (those from h7 on don't show), item:bullet, item:arabic and so on, or para.  What is open before a paragraph follows from the
    last heading, so each paragraph's tags are known from running values over one sort; no stack is kept.  A level that a document skips gets
    an empty title, a section without a body an empty paragraph.
    """
    k, body = F.coalesce(F.col(kind), F.lit("para")), xml_escape(F.coalesce(F.col(text), F.lit("")))
    number = F.regexp_extract(k, "^h([0-9])$", 1)
    w = Window.partitionBy(key).orderBy(order)
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    rows = paragraphs.select(F.col(key), F.col(order), F.when(number.between("1", str(len(SECTIONS))), number.cast("int")).alias("_level"), F.when(k.startswith("item:"), F.substring(k, 6, 1 << 20)).alias("_item"), body.alias("_body"))
    depth = F.coalesce(F.last("_level", ignorenulls=True).over(before), F.when(F.row_number().over(w) > 1, 1).otherwise(0))
    rows = rows.withColumn("_depth", depth).withColumn("_after", F.lead(F.struct("_level", "_item")).over(w)).withColumn("_in_list", F.lag("_item").over(w).isNotNull())
    rows = rows.withColumn("_list", F.last(F.when(~F.col("_in_list"), F.col("_item")), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))  # the item that began the list
    none, names = F.expr("cast(array() as array<string>)"), F.array(*map(F.lit, SECTIONS))
    level, last = F.col("_level"), F.col("_after").isNull()
    one = lambda c: F.array(c)
    name = lambda i: F.element_at(names, i)
    closing = lambda from_, to: F.when(from_ >= to, F.transform(F.sequence(from_, to, F.lit(-1)), lambda i: F.concat(F.lit("</"), name(i), F.lit(">")))).otherwise(none)
    listed = F.when(F.col("_list") == "bullet", "itemizedlist").otherwise("orderedlist")
    chapter = F.when(F.col("_depth") == 0, one(F.lit("<chapter><title/>"))).otherwise(none)
    # a heading closes what is as deep as itself or deeper; of what is left the levels down to its own are opened
    left = F.least(F.col("_depth"), level - 1)
    skipped = F.when(left + 1 < level, F.transform(F.sequence(left + 1, level - 1), lambda i: F.concat(F.lit("<"), name(i), F.lit("><title/>")))).otherwise(none)
    title = F.when(F.col("_body") == "", "<title/>").otherwise(F.concat(F.lit("<title>"), F.col("_body"), F.lit("</title>")))
    heading = F.concat(closing(F.col("_depth"), level), skipped, one(F.concat(F.lit("<"), name(level), F.lit(">"), title)))
    # the next row or the end closes it at once
    bare = F.when(last | (F.col("_after._level") <= level), one(F.lit("<para/>"))).otherwise(none)
    opened = F.when(F.col("_list") == "bullet", '<itemizedlist mark="bullet">').otherwise(F.concat(F.lit('<orderedlist numeration="'), F.col("_list"), F.lit('">')))
    item = F.concat(F.when(F.col("_in_list"), none).otherwise(F.concat(chapter, one(opened))), one(F.concat(F.lit("<listitem><para>"), "_body", F.lit("</para></listitem>"))))
    end_list = F.when(last | F.col("_after._item").isNull(), one(F.concat(F.lit("</"), listed, F.lit(">")))).otherwise(none)
    para = F.concat(chapter, one(F.when(F.col("_body") == "", "<para/>").otherwise(F.concat(F.lit("<para>"), "_body", F.lit("</para>")))))
    own = F.when(level.isNotNull(), F.concat(heading, bare)).when(F.col("_item").isNotNull(), F.concat(item, end_list)).otherwise(para)
    now = F.when(level.isNotNull(), level).otherwise(F.greatest(F.col("_depth"), F.lit(1)))
    ends = F.when(last, closing(now, F.lit(1))).otherwise(none)
    return rows.select(key, order, F.posexplode(F.concat(own, ends)).alias("seq", "xml"))


def documents(paragraphs: DataFrame, key: str, order: str, kind: str, text: str) -> DataFrame:
    """(key, xml): a book for each key."""
    events = tag_events(paragraphs, key, order, kind, text)
    books = events.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(order, "seq", "xml"))).alias("e"))  # a document is one row in the end
    return books.select(F.col(key).cast("long").alias(key), F.concat(F.lit(HEAD + "<book>"), F.array_join(F.transform("e", lambda e: e["xml"]), ""), F.lit("</book>")).alias("xml"))
