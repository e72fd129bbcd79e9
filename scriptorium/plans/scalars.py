"""Predicates and scalar functions over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import dates, numbers, text, units
from scriptorium.plans.common import Catalog
from scriptorium.sources import classify

catalog = Catalog()
add = catalog.add

#: Heads of files that the classification tells apart, in hex.
HEADS = ["31be000000ab", "dba52d00", "9ba52100", "fe37001c0000", "fe3700230000", "d0cf11e0a1b11ae1", "7b5c72746631", "ff575043", "00112233"]


#: The look-alikes of one character and then those that go, and what they become, for SQL's translate().
LOOK_FROM = "".join(c for c, x in text.LOOKALIKES.items() if len(x) == 1) + "".join(c for c, x in text.LOOKALIKES.items() if not x)
LOOK_TO = "".join(x for x in text.LOOKALIKES.values() if len(x) == 1).replace("'", "''")


@add("F1_classify_magic", f"""
SELECT doc_id, CASE WHEN size >= 128 AND h = '31be000000ab' THEN 0 WHEN size >= 384 AND h IN ('9ba52100', 'dba52d00') THEN 2
  WHEN h IN ('fe37001c0000', 'fe3700230000') THEN 5 WHEN h = 'd0cf11e0a1b11ae1' AND size >= 1536 AND (size % 512 = 0 OR (size % 512 IN (1, 2) AND size % 3 <> size % 512)) THEN 6 ELSE -1 END AS guess,
  CASE WHEN h = '7b5c72746631' THEN 'rtf' WHEN h = 'ff575043' THEN 'wordperfect' END AS other
FROM (SELECT doc_id, n_chars AS size, {HEADS}[CAST(doc_id % {len(HEADS)} AS INT) + 1] AS h FROM documents)""")
def classify_magic(table):
    head = F.element_at(F.array(*[F.lit(h) for h in HEADS]), (F.col("doc_id") % len(HEADS)).cast("int") + 1)
    content = F.unhex(F.rpad(head, 20, "0"))
    return table("documents").select("doc_id", classify.guess(content, F.col("n_chars")).cast("int").alias("guess"), classify.other_kind(content).alias("other"))


@add("F3_ole_size_rule", "SELECT doc_id, n_chars >= 1536 AND (n_chars % 512 = 0 OR (n_chars % 512 IN (1, 2) AND n_chars % 3 <> n_chars % 512)) AS ok FROM documents")
def ole_size(table):
    return table("documents").select("doc_id", classify.ole_size(F.col("n_chars")).alias("ok"))


@add("F9_fib_version", """
SELECT o_orderkey, nfib, chse, CASE WHEN nfib = 0 THEN 0 WHEN nfib = 28 THEN 4 WHEN nfib = 33 THEN 1 WHEN nfib = 35 THEN 5 WHEN nfib = 45 THEN 2 WHEN nfib IN (101, 102) THEN 6
  WHEN nfib IN (103, 104) THEN CASE WHEN chse = 0 THEN 7 WHEN chse = 256 THEN 6 WHEN b5 = 224 THEN 7 ELSE 6 END WHEN nfib >= 192 THEN 8 ELSE -1 END AS version,
  nfib IN (28, 35) OR (nfib IN (103, 104) AND chse <> 0 AND (chse = 256 OR b5 <> 224)) AS old_mac
FROM (SELECT o_orderkey, CAST(o_orderkey % 260 AS BIGINT) AS nfib, CAST((o_custkey % 3) * 256 AS BIGINT) AS chse, CAST(CASE WHEN o_custkey % 2 = 0 THEN 224 ELSE 0 END AS BIGINT) AS b5 FROM orders)""")
def fib_version(table):
    rows = table("orders").select("o_orderkey", (F.col("o_orderkey") % 260).alias("nfib"), (F.col("o_custkey") % 3 * 256).alias("chse"), F.when(F.col("o_custkey") % 2 == 0, 224).otherwise(0).alias("b5"))
    version, mac = classify.version(F.col("nfib"), F.col("chse"), F.col("b5"))
    return rows.select("o_orderkey", "nfib", "chse", version.cast("int").alias("version"), mac.alias("old_mac"))


@add("F13_strip_field_codes", """
SELECT doc_id, regexp_replace(regexp_replace(t, '[\\x13][^\\x14\\x15]*[\\x14\\x15]?', '', 'g'), '[\\x14\\x15]', '', 'g') AS text
FROM (SELECT doc_id, replace(replace(replace(text, ' of ', ' ' || chr(19) || 'PAGE' || chr(20) || '7' || chr(21)), ' the ', chr(19) || 'HYPERLINK' || chr(21)), ' and ', chr(20)) AS t FROM documents)""")
def strip_fields(table):
    t = F.replace(F.replace(F.replace("text", F.lit(" of "), F.lit(" \x13PAGE\x147\x15")), F.lit(" the "), F.lit("\x13HYPERLINK\x15")), F.lit(" and "), F.lit("\x14"))
    return table("documents").select("doc_id", text.strip_fields(t).alias("text"))


@add("F14_strip_ignorable_chars", "SELECT doc_id, translate(text, chr(3) || chr(4) || chr(5) || chr(8) || chr(10) || chr(31) || chr(8231), '') AS text FROM documents")
def strip_ignored(table):
    return table("documents").select("doc_id", text.strip_ignored(F.col("text")).alias("text"))


@add("F17_empty_boxes", "SELECT conv_id, turn, regexp_replace(text, '[\\x00\\r\\n\\f\\t\\x0b ]', '', 'g') <> '' AS has_text FROM conversations")
def empty_boxes(table):
    return table("conversations").select("conv_id", "turn", text.box_has_text(F.col("text")).alias("has_text"))


@add("F18_drop_blank_paragraphs", "SELECT doc_id, count(*) AS n_paragraphs FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS p FROM documents) WHERE regexp_matches(p, '[^ \\t-\\r]') GROUP BY doc_id")
def drop_blank(table):
    return table("documents").select("doc_id", F.explode(F.split("text", "\n")).alias("p")).filter(text.has_text(F.col("p"))).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n_paragraphs"))


@add("F22_style_clamps", """
SELECT p_partkey, CASE WHEN heading AND CASE WHEN b > 32767 THEN 0 WHEN b > 2160 THEN 2160 ELSE b END < 120 THEN 120 WHEN b > 32767 THEN 0 WHEN b > 2160 THEN 2160 ELSE b END AS before_twips,
  greatest(x, 0) AS left_twips, least(x, 0) AS right_twips FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * 1000 AS b, p_partkey % 2 = 0 AS heading, CAST(p_size - 25 AS BIGINT) AS x FROM part)""")
def style_clamps(table):
    size = F.col("p_size").cast("long")
    return table("part").select("p_partkey", units.before_after(size * 1000, F.col("p_partkey") % 2 == 0).alias("before_twips"), units.left_indent(size - 25).alias("left_twips"), units.right_indent(size - 25).alias("right_twips"))


@add("F23_font_clamps", """
SELECT p_partkey, greatest(8, least(240, CASE WHEN script THEN (s * 2) // 3 ELSE s END)) AS size, CAST(CASE WHEN c = 8 THEN 16 ELSE c END AS BIGINT) AS colour
FROM (SELECT p_partkey, p_partkey % 5 = 0 AS script, p_partkey % 17 AS c, CASE WHEN p_partkey % 3 = 0 THEN (p_size * 6 * 4) // 5 ELSE CAST(p_size AS BIGINT) * 6 END AS s FROM part)""")
def font_clamps(table):
    key = F.col("p_partkey")
    return table("part").select("p_partkey", units.font_size(F.col("p_size").cast("long") * 6, key % 3 == 0, key % 5 == 0).alias("size"), units.font_colour(key % 17).alias("colour"))


@add("F24_negative_widths", "SELECT n_regionkey, list(greatest(CAST(n_nationkey AS BIGINT) - 12, 0) ORDER BY n_nationkey)::VARCHAR AS widths FROM nation GROUP BY n_regionkey")
def negative_widths(table):
    rows = table("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", (F.col("n_nationkey").cast("long") - 12).alias("w")))).alias("w"))
    return rows.select("n_regionkey", F.transform("w", lambda x: F.greatest(x["w"], F.lit(0))).cast("string").alias("widths"))


@add("C3_ascii_lookalikes", f"""
SELECT doc_id, replace(translate(t, '{LOOK_FROM}', '{LOOK_TO}'), '…', '...') AS text
FROM (SELECT doc_id, replace(replace(replace(text, 'the', '‘th’e'), 'e.', 'e…'), 'nd', 'n–d┌') AS t FROM documents)""")
def ascii_lookalikes(table):
    t = F.replace(F.replace(F.replace("text", F.lit("the"), F.lit("‘th’e")), F.lit("e."), F.lit("e…")), F.lit("nd"), F.lit("n–d┌"))
    return table("documents").select("doc_id", text.lookalikes(t).alias("text"))


@add("C6_nbsp_to_space", "SELECT doc_id, replace(replace(text, ' of', chr(160) || 'of'), chr(160), ' ') AS text FROM documents")
def nbsp(table):
    return table("documents").select("doc_id", text.nbsp_to_space(F.replace("text", F.lit(" of"), F.lit("\xa0of"))).alias("text"))


@add("C7_locale_free_upper", "SELECT doc_id, translate(upper(translate(text, 'ßÿ', chr(57345) || chr(57346))), chr(57345) || chr(57346), 'ßÿ') AS text FROM documents")
def upper(table):
    return table("documents").select("doc_id", text.upper(F.col("text")).alias("text"))


@add("C10_display_width", "SELECT doc_id, CAST(length(text) - (length(text) - length(regexp_replace(text, '[\\x00-\\x1f\\x7f-\\x{9f}]', '', 'g'))) AS BIGINT) AS width FROM documents")
def display_width(table):
    return table("documents").select("doc_id", text.display_width(F.col("text")).alias("width"))


ROMAN_SQL = "['', 'm', 'mm', 'mmm'][{n} // 1000 % 10 + 1] || ['', 'c', 'cc', 'ccc', 'cd', 'd', 'dc', 'dcc', 'dccc', 'cm'][{n} // 100 % 10 + 1] || ['', 'x', 'xx', 'xxx', 'xl', 'l', 'lx', 'lxx', 'lxxx', 'xc'][{n} // 10 % 10 + 1] || ['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][{n} % 10 + 1]"


@add("C14_roman_numbers", f"SELECT o_orderkey, {ROMAN_SQL.format(n='(o_orderkey % 4000)')} AS roman, upper({ROMAN_SQL.format(n='(o_orderkey % 4000)')}) AS upper_roman FROM orders")
def roman(table):
    return table("orders").select("o_orderkey", numbers.roman(F.col("o_orderkey")).alias("roman"), numbers.roman(F.col("o_orderkey"), True).alias("upper_roman"))


@add("C15_alpha_numbers", """
SELECT n, CASE WHEN n < 1 OR n > 18278 THEN '' WHEN n <= 26 THEN chr(CAST(96 + n AS INT)) WHEN n <= 702 THEN chr(CAST(97 + (n - 27) // 26 AS INT)) || chr(CAST(97 + (n - 27) % 26 AS INT))
  ELSE chr(CAST(97 + (n - 703) // 676 AS INT)) || chr(CAST(97 + (n - 703) // 26 % 26 AS INT)) || chr(CAST(97 + (n - 703) % 26 AS INT)) END AS alpha FROM (SELECT CAST(o_orderkey AS BIGINT) - 3 AS n FROM orders)""")
def alpha(table):
    return table("orders").select((F.col("o_orderkey") - 3).alias("n")).select("n", numbers.alpha(F.col("n")).alias("alpha"))


@add("C16_ordinal_numbers", "SELECT o_orderkey, o_orderkey || CASE WHEN o_orderkey % 10 = 1 AND o_orderkey <> 11 THEN 'st' WHEN o_orderkey % 10 = 2 AND o_orderkey <> 12 THEN 'nd' WHEN o_orderkey % 10 = 3 AND o_orderkey <> 13 THEN 'rd' ELSE 'th' END AS ordinal FROM orders")
def ordinal(table):
    return table("orders").select("o_orderkey", numbers.ordinal(F.col("o_orderkey")).alias("ordinal"))


@add("C17_outline_numbers", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber < 10 THEN '0' || l_linenumber ELSE CAST(l_linenumber AS VARCHAR) END AS outline FROM lineitem")
def outline(table):
    return table("lineitem").select("l_orderkey", "l_linenumber", numbers.outline(F.col("l_linenumber")).alias("outline"))


@add("C18_basename", "SELECT page_id, CASE WHEN coalesce(url, '') = '' THEN 'null' ELSE regexp_extract(url, '[^/]*$', 0) END AS name FROM pages")
def basename(table):
    return table("pages").select("page_id", text.basename(F.col("url")).alias("name"))


@add("C20_dttm_decode", "SELECT event_id, date_trunc('minute', ts) AS ts FROM events")
def dttm(table):
    ts = F.col("ts")
    bits = F.minute(ts) + F.hour(ts) * 64 + F.dayofmonth(ts) * 2048 + F.month(ts) * 65536 + (F.year(ts) - 1900).cast("long") * 1048576
    return table("events").select("event_id", dates.dttm(bits).cast("timestamp_ntz").alias("ts"))


@add("C21_filetime_decode", "SELECT event_id, date_trunc('second', ts) AS ts FROM events")
def filetime(table):
    steps = F.unix_timestamp(F.col("ts").cast("timestamp")).cast("long") * 10_000_000 + dates.EPOCH_STEPS
    rows = table("events").select("event_id", steps.alias("f"))
    return rows.select("event_id", dates.filetime(F.col("f").bitwiseAND(F.lit(2**32 - 1)), F.shiftright("f", 32)).cast("timestamp_ntz").alias("ts"))


@add("C22_dos_date_parse", "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d FROM orders")
def dos_date(table):
    return table("orders").select("o_orderkey", dates.dos_date(F.date_format("o_orderdate", "M/d/yy")).alias("d"))


@add("C23_date_formats", "SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS saved, strftime(o_orderdate, 'D:%Y%m%d%H%M') AS pdf FROM orders")
def date_formats(table):
    return table("orders").select("o_orderkey", dates.last_saved(F.col("o_orderdate")).alias("saved"), dates.pdf_date(F.col("o_orderdate")).alias("pdf"))


def _map(d: dict) -> str:
    return "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in d.items()) + "}"


@add("C24_language_tag", f"""
SELECT o_orderkey, lid, CASE WHEN lid >= 999 AND lid <> 65535 THEN coalesce({_map(units.LANGUAGES)}[lid], {_map(units.PRIMARY)}[lid % 256]) END AS tag
FROM (SELECT o_orderkey, CAST((o_orderkey % 17) * 1024 + o_orderkey // 17 % 70 AS INT) AS lid FROM orders)""")
def language(table):
    lid = (F.col("o_orderkey") % 17 * 1024 + F.floor(F.col("o_orderkey") / 17) % 70).cast("int")
    return table("orders").select("o_orderkey", lid.alias("lid")).withColumn("tag", units.language(F.col("lid")))


@add("C26_summary_trim", "SELECT c_custkey, nullif(trim(v), '') AS title FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN '   ' ELSE '  ' || c_name || ' ' END AS v FROM customer)")
def summary_trim(table):
    v = F.when(F.col("c_custkey") % 3 == 0, F.lit("   ")).otherwise(F.concat(F.lit("  "), "c_name", F.lit(" ")))
    return table("customer").select("c_custkey", text.trimmed(v).alias("title"))


@add("C27_xml_escape", "SELECT page_id, replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS xml FROM pages")
def xml_escape(table):
    return table("pages").select("page_id", text.xml_escape(F.col("html")).alias("xml"))


PS_SQL = "array_to_string(list_transform(string_split(regexp_replace(regexp_replace(html, '([()\\\\])', '\\\\\\1', 'g'), '[\\x00-\\x1f\\x7f{after}-\\x{{8b}}]', ' ', 'g'), ''), lambda c: CASE WHEN unicode(c) BETWEEN 128 AND 255 THEN chr(92) || printf('%o', unicode(c)) ELSE c END), '')"


@add("C28_ps_escape", f"SELECT page_id, {PS_SQL.format(after='')} AS ps, {PS_SQL.format(after=chr(92) + 'x{81}')} AS pdf FROM pages")
def ps_escape(table):
    return table("pages").select("page_id", text.ps_escape(F.col("html")).alias("ps"), text.ps_escape(F.col("html"), text.PDF_BLANK).alias("pdf"))


@add("C1_full_width", "SELECT page_id, html AS plain, html AS folded FROM pages")
def full_width(table):
    """ASCII as its full-width likeness, and back."""
    wide = F.translate("html", "".join(map(chr, range(0x21, 0x7F))), "".join(map(chr, range(0xFF01, 0xFF5F))))
    return table("pages").select("page_id", F.col("html").alias("plain"), text.fold_full_width(wide).alias("folded"))


@add("C30_leading", """
SELECT p_partkey, ((CAST(p_size AS BIGINT) * 500 * CASE WHEN p_size < 18 THEN 112 WHEN p_size < 28 THEN 124 WHEN p_size < 48 THEN 104 ELSE 100 END * 16 + 12) // 25 + 50) // 100 AS leading FROM part""")
def leading(table):
    return table("part").select("p_partkey", units.leading(F.col("p_size")).alias("leading"))


@add("C31_colour_rgb", f"SELECT p_partkey, CASE WHEN p_partkey % 20 < 17 THEN {units.COLOURS}[CAST(p_partkey % 20 AS INT) + 1] ELSE '000000' END AS rgb FROM part")
def colour(table):
    return table("part").select("p_partkey", units.colour(F.col("p_partkey") % 20).alias("rgb"))


@add("C32_style_codes", "SELECT p_partkey, CASE WHEN s = 222 THEN 4095 WHEN s BETWEEN 1 AND 9 OR s BETWEEN 246 AND 254 THEN 255 - s ELSE s END AS istd FROM (SELECT p_partkey, p_partkey % 256 AS s FROM part)")
def style_codes(table):
    return table("part").select("p_partkey", units.style_number(F.col("p_partkey") % 256).alias("istd"))


@add("C33_level_types", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 THEN 'outline' WHEN p_size = 10 THEN 'numbering' WHEN p_size = 11 THEN 'sequence' WHEN p_size = 12 THEN 'pause' ELSE 'none' END AS level_type FROM part")
def level_types(table):
    return table("part").select("p_partkey", units.level_type(F.col("p_size")).alias("level_type"))


@add("C34_implies_list", "SELECT p_partkey, CASE WHEN p_size BETWEEN 1 AND 9 THEN false WHEN p_partkey % 9 < 8 THEN p_partkey % 4 <> 0 ELSE p_partkey % 3 <> 0 END AS in_list FROM part")
def implies_list(table):
    k = F.col("p_partkey")
    return table("part").select("p_partkey", units.implies_list(F.col("p_size"), k % 9, k % 4, k % 3).alias("in_list"))


@add("C37_paper_size_lookup", "SELECT p_partkey, CAST({'a4': 595, 'a3': 842, 'legal': 612, 'letter': 612}[lower(n)] AS BIGINT) AS width, CAST({'a4': 842, 'a3': 1191, 'legal': 1008, 'letter': 792}[lower(n)] AS BIGINT) AS height FROM (SELECT p_partkey, ['A4', 'a3', 'Legal', 'none', 'LETTER'][CAST(p_partkey % 5 AS INT) + 1] AS n FROM part)".replace("{'a4': 595, 'a3': 842, 'legal': 612, 'letter': 612}", "MAP {'a4': 595, 'a3': 842, 'legal': 612, 'letter': 612}").replace("{'a4': 842,", "MAP {'a4': 842,"))
def paper(table):
    name = F.element_at(F.array(*map(F.lit, ["A4", "a3", "Legal", "none", "LETTER"])), (F.col("p_partkey") % 5).cast("int") + 1)
    return table("part").select("p_partkey", units.paper(name, 0).alias("width"), units.paper(name, 1).alias("height"))


@add("C38_char_width_limits", "SELECT p_partkey, CAST(CASE WHEN w = 0 THEN 2147483647 ELSE greatest(45, least(145, w)) * 6400 END AS BIGINT) AS millipoints FROM (SELECT p_partkey, p_partkey % 200 AS w FROM part)")
def width_limits(table):
    return table("part").select("p_partkey", units.screen_width(F.col("p_partkey") % 200).alias("millipoints"))


@add("unit_conversions", """
SELECT p_partkey, x * 50 AS millipoints, x / 20.0 AS points, x * 6400 AS char_millipoints, CAST(trunc((x * 50 + 3200) / 6400) AS BIGINT) AS chars, CAST(trunc((x * 100 + 2048) / 4096) AS BIGINT) AS draw_chars,
  CAST(trunc((x * 25 + 8) / 16) AS BIGINT) AS draw_millipoints, CAST(trunc((x * 16 + 12) / 25) AS BIGINT) AS draw FROM (SELECT p_partkey, (CAST(p_size AS BIGINT) - 25) * 97 AS x FROM part)""")
def conversions(table):
    x = F.col("x")
    rows = table("part").select("p_partkey", ((F.col("p_size").cast("long") - 25) * 97).alias("x"))
    return rows.select("p_partkey", units.twips_to_millipoints(x).alias("millipoints"), units.twips_to_points(x).alias("points"), units.chars_to_millipoints(x).alias("char_millipoints"), units.millipoints_to_chars(x * 50).alias("chars"), units.draw_to_chars(x * 100).alias("draw_chars"), units.draw_to_millipoints(x).alias("draw_millipoints"), units.millipoints_to_draw(x).alias("draw"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
