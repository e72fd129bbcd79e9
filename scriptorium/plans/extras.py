"""Further operators over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import lists
from scriptorium.operators import relations as ops
from scriptorium.plans.common import Catalog
from scriptorium.plans.scalars import ROMAN_SQL
from scriptorium.sources import resources

catalog = Catalog()
add = catalog.add


@add("C35_default_mapping", """
SELECT p_partkey, CASE WHEN c = 'iso88596' THEN '8859-5.txt' WHEN c LIKE 'iso8859%' THEN '8859-' || substr(c, 8) || '.txt' WHEN c = 'koi8r' THEN 'koi8-r.txt' WHEN c = 'utf8' THEN 'UTF-8.txt' WHEN c IN ('cp852', 'cp1251') THEN c || '.txt' ELSE '8859-1.txt' END AS mapping
FROM (SELECT p_partkey, ['iso88591', 'iso88596', 'iso885915', 'koi8r', 'utf8', 'cp852', 'cp1251', 'other'][CAST(p_partkey % 8 AS INT) + 1] AS c FROM part)""")
def default_mapping(table):
    names = F.array(*map(F.lit, ["iso88591", "iso88596", "iso885915", "koi8r", "utf8", "cp852", "cp1251", "other"]))
    return table("part").select("p_partkey", resources.default_mapping(F.get(names, (F.col("p_partkey") % 8).cast("int"))).alias("mapping"))


@add("C36_mapping_encoding", """
SELECT p_partkey, CASE lower(m) WHEN 'utf-8.txt' THEN 'utf_8' WHEN 'cp852' THEN 'latin_2' WHEN '8859-2.txt' THEN 'latin_2' WHEN 'koi8-r.txt' THEN 'cyrillic' ELSE 'latin_1' END AS encoding
FROM (SELECT p_partkey, ['UTF-8.txt', 'cp852', '8859-2.txt', 'KOI8-R.txt', '8859-1.txt'][CAST(p_partkey % 5 AS INT) + 1] AS m FROM part)""")
def mapping_encoding(table):
    names = F.array(*map(F.lit, ["UTF-8.txt", "cp852", "8859-2.txt", "KOI8-R.txt", "8859-1.txt"]))
    return table("part").select("p_partkey", resources.encoding(F.get(names, (F.col("p_partkey") % 5).cast("int"))).alias("encoding"))


@add("J16_local_bytes", "SELECT doc_id, translate(text, 'éèäüö', chr(233) || chr(8224) || chr(228) || chr(252) || chr(246)) AS text FROM documents")
def local_bytes(table):
    return table("documents").select("doc_id", resources.to_local(F.col("text"), [(233, 0xE9), (8224, 0xE8), (228, 0xE4), (252, 0xFC), (246, 0xF6)]).alias("text"))


@add("J11_font_names", """
WITH f AS (SELECT s_suppkey, 'FONT' || s_suppkey % 7 AS name, CAST(s_suppkey % 4 AS INT) AS emphasis, CAST(s_suppkey % 128 AS INT) AS ffn FROM supplier),
d AS (SELECT *, CASE WHEN ffn % 4 = 1 THEN ['Courier', 'Courier-Bold', 'Courier-Oblique', 'Courier-BoldOblique'] WHEN ffn // 16 % 8 = 2 THEN ['Helvetica', 'Helvetica-Bold', 'Helvetica-Oblique', 'Helvetica-BoldOblique'] ELSE ['Times-Roman', 'Times-Bold', 'Times-Italic', 'Times-BoldItalic'] END[emphasis + 1] AS fallback FROM f)
SELECT s_suppkey, coalesce((SELECT arg_max(n_name, n_nationkey) FROM nation WHERE 'Font' || n_nationkey % 5 = replace(d.name, 'FONT', 'Font') AND n_nationkey // 5 % 4 = d.emphasis), fallback) AS our_name FROM d""")
def font_names(table):
    k, n = F.col("s_suppkey"), F.col("n_nationkey")
    fonts = table("supplier").select("s_suppkey", F.concat(F.lit("FONT"), k % 7, F.lit("")).alias("name"), F.lit(None).cast("string").alias("alt_name"), (k % 128).cast("int").alias("ffn"), (k % 4).cast("int").alias("emphasis"))
    fonts = fonts.withColumn("name", F.concat("name", F.lit("#"), "s_suppkey"))  # each row is a font of its own
    plain = F.regexp_replace("name", "#.*", "")
    level = F.floor(n / 5) % 4
    names = table("nation").select(n.alias("line"), F.concat(F.lit("Font"), n % 5).alias("word_name"), F.floor(level / 2).cast("int").alias("italic"), (level % 2).cast("int").alias("bold"), F.col("n_name").alias("our_name"))
    stars = names.sparkSession.range(4).select(F.lit(1000).alias("line"), F.lit("*").alias("word_name"), F.floor(F.col("id") / 2).cast("int").alias("italic"), (F.col("id") % 2).cast("int").alias("bold"), F.lit("x").alias("our_name"))
    return resources.matched_fonts(fonts.withColumn("alt_name", plain), names.unionByName(stars)).select("s_suppkey", "our_name")


@add("J10_section_at_break", """
WITH s AS (SELECT l_orderkey AS k, CAST(l_linenumber * 3 AS BIGINT) AS p, max(l_partkey) AS v FROM lineitem GROUP BY ALL),
b AS (SELECT DISTINCT l_orderkey AS k, CAST(l_linenumber * 2 - l_linenumber % 2 AS BIGINT) AS p FROM lineitem),
j AS (SELECT b.k, b.p, coalesce(x.v, y.v) AS v FROM b LEFT JOIN s x ON b.k = x.k AND b.p = x.p LEFT JOIN s y ON b.k = y.k AND b.p + 1 = y.p)
SELECT k, p, last_value(v IGNORE NULLS) OVER (PARTITION BY k ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS v FROM j""")
def section_at_break(table):
    line = F.col("l_linenumber")
    sections = table("lineitem").groupBy(F.col("l_orderkey").alias("k"), (line * 3).cast("long").alias("p")).agg(F.max("l_partkey").alias("v"))
    breaks = table("lineitem").select(F.col("l_orderkey").alias("k"), (line * 2 - line % 2).cast("long").alias("p")).distinct()
    return lists.section_at(breaks, sections, ["k"], "p", "p", "v")


@add("J12_property_modifiers", "SELECT p_partkey, CASE WHEN m = 0 THEN 'none' WHEN m % 2 = 0 THEN 'inline' ELSE 'index' END AS kind, CAST(CASE WHEN m <> 0 THEN m // 2 END AS BIGINT) AS number FROM (SELECT p_partkey, p_partkey % 37 AS m FROM part)")
def property_modifiers(table):
    kind, number = lists.property_modifier(F.col("p_partkey") % 37)
    return table("part").select("p_partkey", kind.alias("kind"), number.alias("number"))


@add("J14_page_headers", "SELECT o_orderkey, CASE WHEN o_orderkey % 2 = 0 THEN 'hdr' ELSE 'ftr' END || CASE WHEN o_custkey % 5 = 0 THEN '_first' WHEN o_custkey % 2 = 1 THEN '_odd' ELSE '_even' END AS kind FROM orders")
def page_headers(table):
    return table("orders").select("o_orderkey", lists.shown_kind(F.col("o_custkey") % 5 == 0, F.col("o_custkey") % 2 == 1, F.col("o_orderkey") % 2 == 0).alias("kind"))


@add("J3_sequence_numbers", """
WITH p AS (SELECT conv_id AS k, turn, CAST(length(text) AS BIGINT) AS len, turn * 10000 AS fo FROM conversations),
q AS (SELECT *, CAST(coalesce(sum(len) OVER (PARTITION BY k ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS seq FROM p)
SELECT k, turn, CASE WHEN turn % 3 < len THEN seq + turn % 3 END AS seq FROM q""")
def sequence_numbers(table):
    pieces = table("conversations").select(F.col("conv_id").alias("k"), "turn", F.length("text").cast("long").alias("len"), (F.col("turn") * 10000).alias("fo"))
    pieces = ops.running_start(pieces, ["k"], ["turn"], "len", "seq")
    points = pieces.select("k", "turn", (F.col("fo") + F.col("turn") % 3).alias("at"))
    return ops.locate(points, pieces.select("k", "fo", "len", "seq"), ["k"], "at", "fo", "len", ["seq"]).select("k", "turn", (F.col("seq") + F.col("delta")).alias("seq"))


@add("L7_list_labels", f"""
SELECT conv_id, turn, CASE WHEN l <= 0 THEN '' ELSE CASE f WHEN 2 THEN {ROMAN_SQL.format(n="(turn + 1)")} WHEN 23 THEN '' WHEN 22 THEN CASE WHEN turn + 1 < 10 THEN '0' ELSE '' END || (turn + 1) ELSE CAST(turn + 1 AS VARCHAR) END || '. ' END AS label
FROM (SELECT conv_id, turn, [0, 2, 22, 23][CAST(turn % 4 AS INT) + 1] AS f, turn % 5 * 360 AS l FROM conversations)""")
def list_labels(table):
    nfc = F.get(F.array(*map(F.lit, [0, 2, 22, 23])), (F.col("turn") % 4).cast("int"))
    return table("conversations").select("conv_id", "turn", lists.label(F.col("turn") + 1, nfc, F.lit("."), F.col("turn") % 5 * 360).alias("label"))


@add("L8_tab_stops", "SELECT p_partkey, CAST(6 - p_size % 6 AS BIGINT) AS blanks FROM part")
def tab_stops(table):
    return table("part").select("p_partkey", F.length(lists.expanded_tab(F.col("p_size"), 6)).cast("long").alias("blanks"))


@add("F15_printed_lists", "SELECT event_type, CAST(count(*) AS BIGINT) AS n FROM events WHERE event_type NOT IN ('click', 'view') GROUP BY event_type")
def printed_lists(table):
    return table("events").filter(~F.col("event_type").isin("click", "view")).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
