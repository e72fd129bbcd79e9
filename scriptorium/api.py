"""One call from files to a rendering, with the options of a conversion."""

from __future__ import annotations

import os
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.units import MAX_WIDTH, MIN_WIDTH, PAPERS
from scriptorium.sinks import pages
from scriptorium.sinks.docbook import HEAD
from scriptorium.sources import documents, resources


@dataclass(frozen=True)
class Options:
    """to: text, formatted, docbook, ps or pdf; width: characters a line, 0 for no breaks; show_hidden and show_removed: keep such text;
    text_compat: only styles, not runs, hide, remove or capitalise text; mapping: name of a mapping file, in the first of `folders` that has
    it, whose characters the output is limited to: each is at its place in the code page, which the file's text is in."""

    to: str = "text"
    width: int = 76
    paper: str = "a4"
    landscape: bool = False
    encoding: str = "latin_1"
    image_level: int = 2
    show_hidden: bool = False
    show_removed: bool = False
    text_compat: bool = False
    mapping: str | None = None
    folders: tuple[str, ...] = ()

    def checked(self) -> Options:
        if self.to not in ("text", "formatted", "docbook", "ps", "pdf"):
            raise ValueError(f"no such output: {self.to}")
        if self.to in ("ps", "pdf"):
            if self.paper.lower() not in PAPERS:
                raise ValueError(f"no such paper: {self.paper}")
            if self.encoding == "utf_8" or self.to == "pdf" and self.encoding == "cyrillic":
                raise ValueError(f"{self.to} can't hold {self.encoding}")
        if self.mapping and self.to == "docbook":
            raise ValueError("docbook is always in UTF-8")
        if not 0 <= self.image_level <= 3:
            raise ValueError("image levels are 0 to 3")
        return self

    @property
    def line(self) -> int:
        """Characters of a line."""
        if self.to == "docbook":
            return 0
        if self.to in ("ps", "pdf"):
            return pages.line_chars(self.paper, self.landscape)
        return 0 if self.width == 0 else max(MIN_WIDTH, min(MAX_WIDTH, self.width))


def terminal_width() -> int:
    """Width for the terminal in $COLUMNS, less a margin."""
    columns = os.environ.get("COLUMNS", "")
    return max(MIN_WIDTH, min(MAX_WIDTH, int(columns) - 4)) if columns.isdigit() else 76


def convert(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """(path, text), or (path, content) for ps and pdf, of the readable files under a path."""
    o = options.checked()
    docs = documents.parsed(documents.files(spark, path), o.show_hidden, o.show_removed, o.text_compat)
    out = documents.rendered(docs, "text" if o.to in ("ps", "pdf") else o.to, o.line)
    if o.mapping:
        pairs = resources.char_map(spark, resources.found(spark, o.mapping, list(o.folders))).select("local", "unicode").limit(resources.MAPPING_ROWS).collect()  # the limit is the format's
        out = out.withColumn("text", resources.in_code_page(F.col("text"), [tuple(p) for p in pairs]))
    return pages.printed(out, o.to, o.paper, o.landscape) if o.to in ("ps", "pdf") else out


def errors(spark: SparkSession, path: str) -> DataFrame:
    """(path, error_code, error_msg) of the files that can't be read."""
    return documents.metadata(documents.parsed(documents.files(spark, path))).filter(F.col("error_code").isNotNull()).select("path", "error_code", "error_msg")


def book_set(books: DataFrame) -> DataFrame:
    """(place, path, text): the parts of one DocBook set of several books: a prologue, the books by path, and an end.

    The parts in order make the set; no row holds more than a book.
    """
    prologue, end = HEAD.replace("DOCTYPE book", "DOCTYPE set") + "<set>", "</set>"
    edges = books.sparkSession.createDataFrame([(0, None, prologue), (2, None, end)], "place int, path string, text string")
    return edges.unionByName(books.select(F.lit(1).alias("place"), "path", F.regexp_extract("text", "(?s)(<book.*)$", 1).alias("text")))


def save_set(books: DataFrame, folder: str) -> None:
    """Write a set as files whose names are in its order: concatenated they are the set.  Books are dealt out by ranges of their paths."""
    book_set(books).orderBy("place", "path").select(F.col("text").alias("value")).write.option("lineSep", "\n").text(folder)
