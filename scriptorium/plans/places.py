"""Positions, pages, widths and heights over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.operators import places
from scriptorium.operators import relations as ops
from scriptorium.plans.common import Catalog
from scriptorium.sinks.text import banner

catalog = Catalog()
add = catalog.add

WIDTH_SQL = "length(regexp_replace({t}, '[\\x00-\\x1f\\x7f-\\x{{9f}}]', '', 'g')) * 6400"
TRIMMED_SQL = "regexp_replace(text, '[ \\t-\\r]+$', '')"


def turns(table):
    return table("conversations").select("conv_id", "turn", "role", F.length("text").cast("long").alias("len"))


@add("J1_best_guess", """
WITH p AS (SELECT l_orderkey AS k, CAST(l_linenumber AS BIGINT) AS piece, CAST(l_linenumber * 50 AS BIGINT) AS start, CAST(max(l_quantity) AS BIGINT) AS len FROM lineitem GROUP BY ALL),
n AS (SELECT *, lead(piece) OVER (PARTITION BY k ORDER BY start) AS after FROM p),
q AS (SELECT o_orderkey AS k, o_custkey, CAST(50 + o_custkey % 7 * 50 + o_custkey % 51 AS BIGINT) AS pos FROM orders)
SELECT q.k, q.pos, coalesce(a.piece, b.after) AS piece, CASE WHEN a.piece IS NOT NULL THEN q.pos - a.start WHEN b.after IS NOT NULL THEN 0 END AS delta
FROM q LEFT JOIN p a ON q.k = a.k AND q.pos >= a.start AND q.pos < a.start + a.len LEFT JOIN n b ON q.k = b.k AND q.pos = b.start + b.len""")
def best_guess(table):
    pieces = table("lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("piece"), (F.col("l_linenumber") * 50).cast("long").alias("start")).agg(F.max("l_quantity").cast("long").alias("len"))
    c = F.col("o_custkey")
    points = table("orders").select(F.col("o_orderkey").alias("k"), (50 + c % 7 * 50 + c % 51).cast("long").alias("pos"))
    return places.located_best(points, pieces, ["k"], "pos", "start", "len", ["piece"])


@add("J2_header_positions", """
WITH b AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS len, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations)
SELECT q.conv_id, q.turn, CAST(b.turn * 100000 + q.turn * 97 - b.start AS BIGINT) AS char_pos FROM conversations q LEFT JOIN b ON q.conv_id = b.conv_id AND q.turn * 97 >= b.start AND q.turn * 97 < b.start + b.len""")
def header_positions(table):
    blocks = turns(table).withColumn("char_pos", (F.col("turn") * 100000).cast("long"))
    points = turns(table).select("conv_id", "turn", (F.col("turn") * 97).cast("long").alias("offset"))
    return places.offset_to_position(points, blocks, ["conv_id"], "offset", ["turn"], "len", "char_pos").drop("offset")


@add("J6_list_of_style", """
WITH l AS (SELECT CASE WHEN n_nationkey % 6 = 0 THEN 4095 ELSE CAST(n_nationkey // 2 AS INT) END AS style, n_nationkey, n_name FROM nation)
SELECT p_partkey, (SELECT arg_min(n_name, n_nationkey) FROM l WHERE l.style = p.style AND l.style NOT IN (65535, 4095, 4094)) AS list FROM (SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 4095 ELSE CAST(p_size AS INT) END AS style FROM part) p""")
def list_of_style(table):
    n = F.col("n_nationkey")
    lists = table("nation").select(F.when(n % 6 == 0, 4095).otherwise(F.floor(n / 2)).cast("int").alias("style"), "n_nationkey", F.col("n_name").alias("list"))
    rows = table("part").select("p_partkey", F.when(F.col("p_partkey") % 7 == 0, 4095).otherwise(F.col("p_size")).cast("int").alias("style"))
    return places.list_of_style(rows, lists, "style", ["n_nationkey"], "list").select("p_partkey", "list")


@add("J8_offset_picture", "SELECT o_orderkey, v AS picture FROM orders LEFT JOIN (SELECT l_orderkey, arg_min(l_partkey, (l_linenumber, l_partkey)) AS v FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey")
def offset_picture(table):
    pictures = table("lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_partkey").alias("picture"))
    return ops.first_match(table("orders").select("o_orderkey"), pictures.withColumn("_p", F.col("picture")), ["o_orderkey"], ["l_linenumber", "_p"], "picture", None)


@add("J13_data_offsets", """
WITH b AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS len, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations)
SELECT q.conv_id, q.turn, CAST(b.turn * 4096 + q.turn * 61 - b.start AS BIGINT) AS file_offset FROM conversations q LEFT JOIN b ON q.conv_id = b.conv_id AND q.turn * 61 >= b.start AND q.turn * 61 < b.start + b.len""")
def data_offsets(table):
    blocks = turns(table).withColumn("file_offset", (F.col("turn") * 4096).cast("long"))
    points = turns(table).select("conv_id", "turn", (F.col("turn") * 61).cast("long").alias("data_pos"))
    return places.offset_to_position(points, blocks, ["conv_id"], "data_pos", ["turn"], "len", "file_offset").drop("data_pos")


@add("W3_coalesce_data", """
WITH n AS (SELECT user_id, event_id, CASE WHEN lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) = event_id - 1 THEN 0 ELSE 1 END AS new FROM events),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM n)
SELECT user_id, min(event_id) AS start, count(*) AS len, count(*) AS n_pieces FROM i GROUP BY user_id, island""")
def coalesce_data(table):
    rows = table("events").select("user_id", F.col("event_id").alias("start"), F.lit(1).cast("long").alias("len"))
    return ops.coalesce_runs(rows, ["user_id"], ["start"], "start", "len", [])


LIST_SQL = "CASE role WHEN 'user' THEN 'text' WHEN 'assistant' THEN 'footnote' ELSE 'macro' END"


def listed(table):
    return turns(table).withColumn("list_id", F.when(F.col("role") == "user", "text").when(F.col("role") == "assistant", "footnote").otherwise("macro"))


@add("A5_document_length", f"SELECT conv_id, CAST(coalesce(sum(length(text)) FILTER ({LIST_SQL} <> 'macro'), 0) AS BIGINT) AS length FROM conversations GROUP BY conv_id")
def document_length(table):
    return listed(table).groupBy("conv_id").agg(F.sum(F.when(F.col("list_id").isin(*places.COUNTED), F.col("len")).otherwise(0)).alias("length"))


@add("A8_text_boxes", "SELECT conv_id, coalesce(bool_or(role = 'system' AND length(text) > 0), false) AS text_box FROM conversations GROUP BY conv_id")
def text_boxes(table):
    return turns(table).groupBy("conv_id").agg(F.coalesce(F.bool_or((F.col("role") == "system") & (F.col("len") > 0)), F.lit(False)).alias("text_box"))


@add("F16_styled_lists", f"SELECT conv_id, turn, {LIST_SQL} AS list_id FROM conversations WHERE {LIST_SQL} NOT IN ('hdrftr', 'macro', 'annotation')")
def styled_lists(table):
    return listed(table).filter(~F.col("list_id").isin(*places.UNSTYLED)).select("conv_id", "turn", "list_id")


@add("F19_valid_blocks", """
SELECT place, len, wide, count(*) AS n FROM (SELECT CAST(l_partkey - 20 AS BIGINT) AS place, CAST(l_quantity AS BIGINT) - 5 AS len, l_linenumber % 2 = 0 AS wide FROM lineitem) WHERE place >= 0 AND len > 0 AND NOT (wide AND len % 2 <> 0) GROUP BY ALL""")
def valid_blocks(table):
    rows = table("lineitem").select((F.col("l_partkey") - 20).cast("long").alias("place"), (F.col("l_quantity").cast("long") - 5).alias("len"), (F.col("l_linenumber") % 2 == 0).alias("wide"))
    return places.valid_blocks(rows, "place", "len", "wide").groupBy("place", "len", "wide").agg(F.count(F.lit(1)).alias("n"))


@add("F20_all_zero", "SELECT doc_id, doc_id % 3 = 0 OR text = '' AS zero FROM documents")
def all_zero(table):
    content = F.when(F.col("doc_id") % 3 == 0, F.unhex(F.repeat(F.lit("00"), (F.col("doc_id") % 100).cast("int")))).otherwise(F.col("text").cast("binary"))
    return table("documents").select("doc_id", places.all_zero(content).alias("zero"))


@add("C13_string_width", f"SELECT doc_id, CAST({WIDTH_SQL.format(t='text')} AS BIGINT) AS width FROM documents")
def string_width(table):
    return table("documents").select("doc_id", places.string_width(F.col("text")).alias("width"))


@add("A1_line_width", f"SELECT doc_id, CAST({WIDTH_SQL.format(t='text')} AS BIGINT) AS width FROM documents")
def line_width(table):
    return table("documents").select("doc_id", places.line_width(F.split("text", "\n")).alias("width"))


@add("A2_net_width", f"SELECT doc_id, CAST({WIDTH_SQL.format(t=TRIMMED_SQL)} AS BIGINT) AS width FROM documents")
def net_width(table):
    return table("documents").select("doc_id", places.net_width(F.array(F.lit(""), F.col("text"))).alias("width"))


@add("A10_header_height", """
WITH l AS (SELECT l_orderkey, CAST(l_linenumber * 6 + 8 AS BIGINT) AS size, l_returnflag = 'R' AS ends FROM lineitem),
r AS (SELECT *, CASE WHEN size < 18 THEN 112 WHEN size < 28 THEN 124 WHEN size < 48 THEN 104 ELSE 100 END AS rate FROM l)
SELECT l_orderkey, CAST(sum((size * 500 * rate * 16 + 12) // 25 // 100 + CASE WHEN (size * 500 * rate * 16 + 12) // 25 % 100 >= 50 THEN 1 ELSE 0 END + CASE WHEN ends THEN (size * 200 * 16 + 12) // 25 ELSE 0 END) AS BIGINT) AS height FROM r GROUP BY l_orderkey""")
def header_height(table):
    rows = table("lineitem").select("l_orderkey", (F.col("l_linenumber") * 6 + 8).cast("long").alias("size"), (F.col("l_returnflag") == "R").alias("ends"))
    return places.height(rows, ["l_orderkey"], "size", "ends")


@add("W14_page_numbers", """
WITH s AS (SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'system' AND n > 1 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS section FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS n FROM conversations)),
p AS (SELECT *, row_number() OVER (PARTITION BY conv_id, section ORDER BY turn) - 1 AS n FROM s)
SELECT conv_id, turn, section, CAST(sum(CASE WHEN n % 2 = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS page, n < 2 AS first_in_section FROM p""")
def page_numbers(table):
    rows = table("conversations").select("conv_id", "turn", (F.col("role") == "system").alias("new"))
    return places.page_numbers(rows, ["conv_id"], ["turn"], "new", 2).drop("new")


@add("C25_languages", """
SELECT o_orderkey, CAST(CASE c WHEN 850 THEN 2057 WHEN 862 THEN 1037 WHEN 866 THEN 1049 ELSE 1033 END AS INT) AS dos, CAST(CASE WHEN o_orderkey % 2000 >= 999 THEN o_orderkey % 2000 ELSE CASE o_orderkey % 2000 WHEN 2 THEN 3084 WHEN 31 THEN 1043
  WHEN 33 THEN 1036 WHEN 34 THEN 1034 WHEN 36 THEN 1038 WHEN 39 THEN 1040 WHEN 44 THEN 2057 WHEN 45 THEN 1030 WHEN 46 THEN 1055 WHEN 47 THEN 1044 WHEN 48 THEN 1045 WHEN 49 THEN 1031 WHEN 351 THEN 2070 WHEN 358 THEN 1035 ELSE 1033 END END AS INT) AS old
FROM (SELECT *, o_custkey % 30 + 840 AS c FROM orders)""")
def languages(table):
    return table("orders").select("o_orderkey", places.codepage_language(F.col("o_custkey") % 30 + 840).alias("dos"), places.country_language(F.col("o_orderkey") % 2000).alias("old"))


@add("L21_one_cell_a_line", "SELECT n_regionkey, CAST(row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS INT) AS cell, n_name AS line FROM nation")
def one_cell_a_line(table):
    rows = table("nation").groupBy("n_regionkey").agg(F.transform(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda c: c["n_name"]).alias("cells"))
    return rows.select("n_regionkey", F.posexplode("cells").alias("cell", "line"))


@add("U3_several_files", """
SELECT doc_id, 0 AS part, repeat(':', 14) || chr(10) || doc_id || '.doc' || chr(10) || repeat(':', 14) AS text FROM documents UNION ALL SELECT doc_id, 1, text FROM documents""")
def several_files(table):
    docs = table("documents")
    heads = docs.select("doc_id", F.lit(0).alias("part"), banner(F.concat(F.lit("in/"), "doc_id", F.lit(".doc"))).alias("text"))
    return heads.unionByName(docs.select("doc_id", F.lit(1).alias("part"), "text"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
