"""Number formats of lists, headings and notes, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Digits of roman numerals by power of ten.
ROMAN = (("", "m", "mm", "mmm"), ("", "c", "cc", "ccc", "cd", "d", "dc", "dcc", "dccc", "cm"), ("", "x", "xx", "xxx", "xl", "l", "lx", "lxx", "lxxx", "xc"), ("", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"))
#: Numbers up to here have an alphabetic form of at most three letters.
ALPHA_MOST = 26 + 26**2 + 26**3
#: Number format codes of lists.
ARABIC, UPPER_ROMAN, LOWER_ROMAN, UPPER_ALPHA, LOWER_ALPHA, ORDINAL, OUTLINE, BULLET = 0, 1, 2, 3, 4, 5, 22, 23


def roman(n: Column, upper: bool = False) -> Column:
    """Roman numeral of n mod 4000; 0 gives an empty string."""
    n = F.pmod(n.cast("long"), F.lit(4000))
    parts = [F.element_at(F.array(*[F.lit(d) for d in digits]), (F.floor(n / q) % 10).cast("int") + 1) for q, digits in zip((1000, 100, 10, 1), ROMAN, strict=True)]
    out = F.concat(*parts)
    return F.upper(out) if upper else out


def alpha(n: Column, upper: bool = False) -> Column:
    """Bijective base 26 of up to three letters; outside 1 .. ALPHA_MOST an empty string."""
    n, base = n.cast("long"), 65 if upper else 97
    letter = lambda x: F.char(x % 26 + base)
    one, two, three = n - 1, n - 27, n - 27 - 26**2
    return (
        F.when((n < 1) | (n > ALPHA_MOST) | n.isNull(), F.lit(""))
        .when(n <= 26, letter(one))
        .when(n <= 26 + 26**2, F.concat(letter(F.floor(two / 26)), letter(two)))
        .otherwise(F.concat(letter(F.floor(three / 26**2)), letter(F.floor(three / 26)), letter(three)))
    )


def ordinal(n: Column) -> Column:
    """1st, 2nd, 3rd, 4th; only 11, 12 and 13 themselves are exceptions, so 111 gives 111st."""
    last = n % 10
    suffix = F.when((last == 1) & (n != 11), "st").when((last == 2) & (n != 12), "nd").when((last == 3) & (n != 13), "rd").otherwise("th")
    return F.concat(n.cast("string"), suffix)


def outline(n: Column) -> Column:
    """At least two digits."""
    text = n.cast("string")
    return F.when(n < 10, F.concat(F.lit("0"), text)).otherwise(text)


def numbered(n: Column, nfc: Column) -> Column:
    """n in the number format of code nfc; bullets have none, unknown codes are arabic."""
    return (
        F.when(nfc == UPPER_ROMAN, roman(n, True)).when(nfc == LOWER_ROMAN, roman(n)).when(nfc == UPPER_ALPHA, alpha(n, True)).when(nfc == LOWER_ALPHA, alpha(n))
        .when(nfc == ORDINAL, ordinal(n)).when(nfc == OUTLINE, outline(n)).when(nfc == BULLET, F.lit("")).otherwise(n.cast("string"))
    )


def heading_part(n: Column, nfc: Column) -> Column:
    """n in a heading's number; there ordinals are arabic."""
    return numbered(n, F.when(nfc.isin(ORDINAL, BULLET), F.lit(ARABIC)).otherwise(nfc))
