"""PDF and PostScript: a document's lines on pages, in a fixed-pitch font.  Each document is built by itself in a Python worker."""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions.units import PAPERS

MARGIN, SIZE, LEADING = 72, 10, 12
#: Fixed width of a Courier character, in parts of the size.
PITCH = 0.6
#: The byte below 0x8C that PDF shows.
EURO = b"\x80"


def line_chars(paper: str, landscape: bool = False) -> int:
    """Characters between the margins."""
    w, h = PAPERS[paper.lower()]
    return int(((h if landscape else w) - 2 * MARGIN) / (SIZE * PITCH))


def paged(lines: list[str], height: int) -> list[list[str]]:
    """Lines in pages; a form feed begins a new page."""
    most, out = max(1, (height - 2 * MARGIN) // LEADING), [[]]
    for line in lines:
        if line.startswith("\f") or len(out[-1]) >= most:
            out.append([])
        out[-1].append(line.lstrip("\f"))
    return out


def escaped(text: str, kept: bytes = b"") -> bytes:
    """A string between parentheses: signs that mean something get a backslash, control characters but `kept` are blanks, others octal."""
    out = bytearray()
    for b in text.encode("cp1252", "replace"):
        if b in b"()\\":
            out += b"\\" + bytes([b])
        elif b < 0x20 or 0x7F <= b <= 0x8B and b not in kept:
            out += b" "
        else:
            out += bytes([b]) if b < 0x80 else b"\\%03o" % b
    return bytes(out)


def ascii85(raw: bytes) -> str:
    """ASCII 85 in lines of 64; a line doesn't begin with a per cent sign."""
    text = base64.a85encode(raw).decode()
    lines = [text[i : i + 64] for i in range(0, len(text), 64)]
    return "\n".join(" " + x if x.startswith("%") else x for x in lines) + "~>"


def pdf(lines: list[str], paper: str = "a4", landscape: bool = False, info: dict[str, str] | None = None) -> bytes:
    w, h = PAPERS[paper.lower()]
    if landscape:
        w, h = h, w
    pages = paged(lines, h)
    objects = [b"<< /Type /Catalog /Pages 2 0 R >>", b"<< /Type /Pages /Kids [%s] /Count %d >>" % (b" ".join(b"%d 0 R" % (5 + 2 * i) for i in range(len(pages))), len(pages)), b"<< /Type /Font /Subtype /Type1 /BaseFont /Courier /Encoding /WinAnsiEncoding >>"]
    objects.append(b"<< " + b" ".join(b"/%s (%s)" % (k.encode(), escaped(v, EURO)) for k, v in (info or {}).items()) + b" >>")
    for i, page in enumerate(pages):
        body = b"BT\n/F1 %d Tf\n%d TL\n%d %d Td\n" % (SIZE, LEADING, MARGIN, h - MARGIN - SIZE) + b"".join(b"(%s) Tj T*\n" % escaped(x, EURO) for x in page) + b"ET\n"
        objects.append(b"<< /Type /Page /Parent 2 0 R /MediaBox [0 0 %d %d] /Resources << /Font << /F1 3 0 R >> >> /Contents %d 0 R >>" % (w, h, 6 + 2 * i))
        objects.append(b"<< /Length %d >>\nstream\n%sendstream" % (len(body), body))
    out, places = bytearray(b"%PDF-1.3\n"), []
    for i, o in enumerate(objects):
        places.append(len(out))
        out += b"%d 0 obj\n%s\nendobj\n" % (i + 1, o)
    start = len(out)
    out += b"xref\n0 %d\n0000000000 65535 f \n" % (len(objects) + 1) + b"".join(b"%010d 00000 n \n" % p for p in places)
    return bytes(out + b"trailer\n<< /Size %d /Root 1 0 R /Info 4 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(objects) + 1, start))


def postscript(lines: list[str], paper: str = "a4", landscape: bool = False, info: dict[str, str] | None = None) -> bytes:
    w, h = PAPERS[paper.lower()]
    pages = paged(lines, w if landscape else h)
    out = bytearray(b"%%!PS-Adobe-2.0\n%%%%Title: %s\n%%%%Pages: %d\n%%%%BoundingBox: 0 0 %d %d\n%%%%EndComments\n" % (escaped((info or {}).get("Title", "")), len(pages), w, h))
    for i, page in enumerate(pages):
        top = (w if landscape else h) - MARGIN - SIZE
        out += b"%%%%Page: %d %d\ngsave\n" % (i + 1, i + 1) + (b"90 rotate 0 -%d translate\n" % w if landscape else b"") + b"/Courier findfont %d scalefont setfont\n" % SIZE
        for j, line in enumerate(page):
            out += b"%d %d moveto (%s) show\n" % (MARGIN, top - j * LEADING, escaped(line))
        out += b"grestore\nshowpage\n"
    return bytes(out + b"%%EOF\n")


def printed(texts: DataFrame, to: str = "pdf", paper: str = "a4", landscape: bool = False) -> DataFrame:
    """(path, content) of (path, text) of wrapped lines."""
    make = {"pdf": pdf, "ps": postscript}[to]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = [make((t or "").split("\n"), paper, landscape, {"Title": (p or "").rpartition("/")[2]}) for p, t in zip(*(c.to_pylist() for c in b.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary())], ["path", "content"])

    return texts.select(F.col("path").cast("string"), F.col("text").cast("string")).mapInArrow(run, "path string, content binary")
