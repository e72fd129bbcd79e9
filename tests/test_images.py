"""Pictures and streams."""

import struct
import zlib

from files import dos

from scriptorium.sources import images
from scriptorium.streaming import ingest


def png(w=3, h=2, bits=8, colour=2, interlace=0):
    body = b"IHDR" + struct.pack(">IIBBBBB", w, h, bits, colour, 0, 0, interlace)
    return b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + body + struct.pack(">I", zlib.crc32(body))


def jpeg(w=30, h=20, parts=3, marker=0xC0):
    return b"\xff\xd8\xff\xe0\x00\x04ab\xff" + bytes([marker]) + struct.pack(">HBHHB", 8 + 3 * parts, 8, h, w, parts) + b"\0" * 3 * parts


def dib(w=5, h=4, bits=8, packed=0):
    return struct.pack("<IIIHHI", 40, w, h, 1, bits, packed) + b"\0" * 20


def picture(image, record, kind=100, twips=2000, scale=1000):
    name, skip, plain = images.BLIPS[record]
    body = struct.pack("<HHI", plain << 4, record, skip + len(image)) + b"\0" * skip + image
    head = struct.pack("<IHH", 68 + len(body), 68, kind) + b"\0" * 20 + struct.pack("<4H", twips, twips // 2, scale, scale)
    return head.ljust(68, b"\0") + body


def test_headers():
    assert images.png(png()) == {"width_px": 3, "height_px": 2, "components": 3, "bits": 8, "compression": "deflate"}
    assert images.png(png(interlace=1)) is None and images.png(png(bits=16)) is None and images.png(b"x") is None
    assert images.jpeg(jpeg())["width_px"] == 30 and images.jpeg(jpeg(marker=0xC2)) is None and images.jpeg(jpeg(parts=2)) is None and images.jpeg(b"") is None
    assert images.dib(dib())["compression"] == "none" and images.dib(dib(bits=4, packed=1)) is None and images.dib(dib(bits=16)) is None


def test_pictures(spark):
    rows = [("png", picture(png(), 0xF01E)), ("jpeg", picture(jpeg(), 0xF01D)), ("dib", picture(dib(), 0xF01F)), ("emf", picture(b"x" * 20, 0xF01A)), ("tiny", picture(png(), 0xF01E, twips=2)), ("link", picture(b"path" * 5, 0xF01E, kind=102)), ("junk", b"abc"), ("null", None)]
    got = {r.name: r for r in images.examined(spark.createDataFrame(rows, "name string, content binary")).collect()}
    assert [(got[n].kind, got[n].level) for n in ("png", "jpeg", "dib", "emf", "tiny", "link", "junk", "null")] == [("png", "full"), ("jpeg", "full"), ("dib", "full"), ("emf", "minimal"), (None, "none"), ("external", "minimal"), (None, "none"), (None, "none")]
    assert (got["png"].width_pt, got["png"].height_pt, got["png"].width_px) == (100, 50, 3)
    assert images.fitted(1000, 100) == (451, 45) and images.fitted(100, 100) == (100, 100)


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for i in range(3):
        (tmp_path / "in" / f"{i}.doc").write_bytes(dos(b"text %d\r" % i))
        q = ingest.to_parquet(ingest.texts(spark, str(tmp_path / "in")), str(tmp_path / "out"), str(tmp_path / "cp"))
        q.awaitTermination()
    assert sorted(r.text for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["text 0\n", "text 1\n", "text 2\n"]
