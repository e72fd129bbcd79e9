"""Mapping files and font-name files, read by Spark as text."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions.text import lookalikes

#: Rows of a mapping file that count.
MAPPING_ROWS = 256
#: Mapping files whose characters are of another encoding than Latin 1.
LATIN_2 = ("cp852.txt", "cp1250.txt", "8859-2.txt")
CYRILLIC = ("koi8-r.txt", "koi8-u.txt", "cp866.txt", "cp1251.txt", "8859-5.txt")
#: Mapping files of code sets by their normal names.
MAPPINGS = {
    "iso88591": "8859-1.txt",
    "iso88592": "8859-2.txt",
    "iso88593": "8859-3.txt",
    "iso88594": "8859-4.txt",
    "iso88595": "8859-5.txt",
    "iso88596": "8859-5.txt",
    "iso88597": "8859-7.txt",
    "iso88598": "8859-8.txt",
    "iso88599": "8859-9.txt",
    "iso885910": "8859-10.txt",
    "iso885913": "8859-13.txt",
    "iso885914": "8859-14.txt",
    "iso885915": "8859-15.txt",
    "iso885916": "8859-16.txt",
    "koi8r": "koi8-r.txt",
    "koi8u": "koi8-u.txt",
    "utf8": "UTF-8.txt",
    "cp437": "cp437.txt",
    "cp850": "cp850.txt",
    "cp852": "cp852.txt",
    "cp862": "cp862.txt",
    "cp864": "cp864.txt",
    "cp866": "cp866.txt",
    "cp1250": "cp1250.txt",
    "cp1251": "cp1251.txt",
    "cp1252": "cp1252.txt",
}
#: Default output fonts in plain, bold, italic and bold italic.
SERIF = ("Times-Roman", "Times-Bold", "Times-Italic", "Times-BoldItalic")
SANS = ("Helvetica", "Helvetica-Bold", "Helvetica-Oblique", "Helvetica-BoldOblique")
FIXED = ("Courier", "Courier-Bold", "Courier-Oblique", "Courier-BoldOblique")


#: Mapped characters wait here, a private area, while the others become look-alikes.
WAITING = 0xF700


def found(spark: SparkSession, name: str, folders: list[str]) -> str:
    """Path of a resource file in the first of the folders that has it, listed by Spark, so that folders may be in any store."""
    for folder in folders:
        path = f"{folder.rstrip('/')}/{name}"
        try:
            spark.read.text(path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
        else:
            return path
    raise FileNotFoundError(f"{name} is in none of {', '.join(folders)}")


def char_map(spark: SparkSession, path: str) -> DataFrame:
    """(mapping, local, unicode) of mapping files: lines of two hex numbers; characters that stand for themselves go."""
    rows = spark.read.text(path).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("mapping"), "value")
    code = lambda i: F.conv(F.nullif(F.regexp_extract("value", r"^\s*0x([0-9a-fA-F]+)\s+0x([0-9a-fA-F]+)", i), F.lit("")), 16, 10).cast("int")
    found = rows.filter(~F.col("value").startswith("#")).select("mapping", code(1).alias("local"), code(2).alias("unicode"))
    return found.filter((F.col("local") <= 0xFF) & (F.col("unicode") <= 0xFFFF) & ((F.col("local") != F.col("unicode")) | (F.col("local") >= 0x80)))


def font_map(spark: SparkSession, path: str) -> DataFrame:
    """(line, word_name, italic, bold, our_name, special) of a font-name file."""
    part = lambda i: F.trim(F.regexp_extract("value", r"^([^#,][^,]*),\s*([01])\s*,\s*([01])\s*,\s*([^,\s][^,]*?)\s*,\s*([0-9]+)", i))
    rows = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\r?\n")).alias("line", "value"))
    found = rows.select("line", part(1).alias("word_name"), part(2).cast("int").alias("italic"), part(3).cast("int").alias("bold"), part(4).alias("our_name"), part(5).cast("int").alias("special"))
    return found.filter((F.col("word_name") != "") & (F.length("word_name") < 65) & (F.length("our_name") < 33))


def encoding(mapping: Column) -> Column:
    """Encoding of a mapping file, whatever the case of its name; the ending may be left out."""
    name = F.lower(mapping)
    name = F.when(name.contains("."), name).otherwise(F.concat(name, F.lit(".txt")))
    return F.when(name == "utf-8.txt", "utf_8").when(name.isin(*LATIN_2), "latin_2").when(name.isin(*CYRILLIC), "cyrillic").otherwise("latin_1")


def default_mapping(codeset: Column) -> Column:
    """Mapping file of a code set's normal name, else that of Latin 1."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in MAPPINGS.items() for x in pair]), codeset), F.lit("8859-1.txt"))


def default_font(ffn: Column, emphasis: Column) -> Column:
    """Font for a pitch and family byte: fixed pitch, then serif and sans serif families, else serif."""
    pick = lambda names: F.get(F.array(*map(F.lit, names)), emphasis.cast("int"))
    fixed, family = ffn.bitwiseAND(F.lit(3)) == 1, F.shiftright(ffn, 4).bitwiseAND(F.lit(7))
    return F.when(fixed, pick(FIXED)).when(family == 2, pick(SANS)).otherwise(pick(SERIF))


def matched_fonts(fonts: DataFrame, names: DataFrame) -> DataFrame:
    """`fonts` (name, alt_name, ffn, emphasis) with our_name: of the lines that name the font or its alternative the last; else the
    default of its pitch and family, if the names have a `*` line for the emphasis."""
    emphasis = (F.col("bold") + 2 * F.col("italic")).alias("emphasis")
    by_name = names.select(F.upper("word_name").alias("_w"), emphasis, "line", "our_name")
    keyed = fonts.withColumn("_w", F.explode(F.array_distinct(F.array(F.upper("name"), F.coalesce(F.upper("alt_name"), F.upper("name"))))))
    best = keyed.join(by_name.filter("_w <> '*'"), ["_w", "emphasis"]).groupBy("name", "emphasis").agg(F.max_by("our_name", "line").alias("_own"))
    star = by_name.filter("_w = '*'").select("emphasis", F.lit(True).alias("_star")).distinct()
    out = fonts.join(best, ["name", "emphasis"], "left").join(star, "emphasis", "left")
    return out.select(*fonts.columns, F.coalesce("_own", F.when(F.col("_star"), default_font(F.col("ffn"), F.col("emphasis")))).alias("our_name"))


def to_local(text: Column, pairs: list[tuple[int, int]]) -> Column:
    """Unicode characters as those at their place in a code page (local, unicode); at most MAPPING_ROWS pairs."""
    pairs = pairs[:MAPPING_ROWS]
    return F.translate(text, "".join(chr(u) for _, u in pairs), "".join(chr(x) for x, _ in pairs))


def in_code_page(text: Column, pairs: list[tuple[int, int]]) -> Column:
    """A text for 8-bit output: characters of the code page (local, unicode) at their places, others as look-alikes in ASCII, else `?`."""
    pairs = pairs[:MAPPING_ROWS]
    waiting, places = "".join(chr(WAITING + x) for x, _ in pairs), "".join(chr(x) for x, _ in pairs)
    held = lookalikes(F.translate(text, "".join(chr(u) for _, u in pairs), waiting))
    return F.translate(F.regexp_replace(held, rf"[^\x00-\x7f\x{{{WAITING:x}}}-\x{{{WAITING + 255:x}}}]", "?"), waiting, places)
