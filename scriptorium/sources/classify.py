"""What kind of file a BINARY column holds, in column expressions: nothing is parsed for files that aren't documents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: First bytes of the kinds, in hex.
DOS = "31be000000ab"
WIN = ("9ba52100", "dba52d00")
MAC = ("fe37001c0000", "fe3700230000")
OLE = "d0cf11e0a1b11ae1"
RTF = "7b5c72746631"
WORDPERFECT = "ff575043"


def starts(content: Column, head: str) -> Column:
    return F.hex(F.substring(content, 1, len(head) // 2)) == head.upper()


def ole_size(size: Column) -> Column:
    """At least three blocks of 512 bytes; one or two bytes more are allowed unless the size leaves the same rest by 3."""
    tail = size % 512
    return (size >= 1536) & ((tail == 0) | (tail.isin(1, 2) & (size % 3 != tail)))


def guess(content: Column, size: Column) -> Column:
    """0: DOS, 2: Windows 1 and 2, 5: Macintosh 4 and 5, 6: OLE container, -1: none of these."""
    return (
        F.when((size >= 128) & starts(content, DOS), 0)
        .when((size >= 384) & (starts(content, WIN[0]) | starts(content, WIN[1])), 2)
        .when(starts(content, MAC[0]) | starts(content, MAC[1]), 5)
        .when(ole_size(size) & starts(content, OLE), 6)
        .otherwise(-1)
    )


def other_kind(content: Column) -> Column:
    """rtf or wordperfect for files that say so; they can't be read."""
    return F.when(starts(content, RTF), "rtf").when(starts(content, WORDPERFECT), "wordperfect")


def version(nfib: Column, chse: Column, byte5: Column) -> tuple[Column, Column]:
    """Version of a header (-1: unknown), and whether it is of a Macintosh."""
    late = nfib.isin(103, 104)
    mac7 = late & (chse != 0) & ((chse == 256) | (byte5 != 0xE0))
    number = (
        F.when(nfib == 0, 0).when(nfib == 28, 4).when(nfib == 33, 1).when(nfib == 35, 5).when(nfib == 45, 2).when(nfib.isin(101, 102), 6)
        .when(late, F.when(mac7, 6).otherwise(7)).when(nfib >= 192, 8).otherwise(-1)
    )
    return number, nfib.isin(28, 35) | mac7
