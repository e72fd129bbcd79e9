"""Lines, tables and markup over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions import units
from scriptorium.operators import layout
from scriptorium.plans.common import Catalog
from scriptorium.sinks import docbook, markup, text

catalog = Catalog()
add = catalog.add

#: The lines of `p` (k, i, t) at 76 columns in SQL, one line of every paragraph a round; its characters take one column each.
WRAPPED_SQL = """
w AS (SELECT k, i, CAST(0 AS BIGINT) AS n, CAST(NULL AS VARCHAR) AS line, t AS rest FROM p
  UNION ALL SELECT k, i, n + 1, CASE WHEN length(rest) < 76 THEN rest WHEN place < 1 THEN head ELSE rtrim(substr(head, 1, CAST(place + CASE WHEN substr(head, CAST(place + 1 AS BIGINT), 1) = '-' THEN 1 ELSE 0 END AS BIGINT)), chr(32) || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)) END,
    CASE WHEN length(rest) < 76 THEN NULL WHEN place < 1 THEN substr(rest, 77) ELSE substr(rest, CAST(place + 2 AS BIGINT)) END
  FROM (SELECT *, greatest(length(regexp_extract(head, '(?s)^(.+) ', 1)), length(regexp_extract(head, '(?s)^(.*[^ ])-', 1))) AS place FROM (SELECT *, substr(rest, 1, 76) AS head FROM w WHERE rest IS NOT NULL)))"""


@add("L3_flagship_paragraph_lines", f"""
WITH RECURSIVE p AS (SELECT doc_id AS k, i, string_split(text, chr(10))[i] AS t FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents) WHERE regexp_matches(t, '[^ \\t\\r\\x0b\\x0c]')),
{WRAPPED_SQL}
SELECT k AS doc_id, row_number() OVER (PARTITION BY k ORDER BY i, n) AS line_no, line FROM w WHERE n > 0""")
def flagship(table):
    return layout.paragraph_lines(table("documents"))


@add("L10_split_paragraphs", "SELECT doc_id, CAST(i AS BIGINT) AS para_no, string_split(text, chr(10))[i] AS paragraph FROM (SELECT doc_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents)")
def split_paragraphs(table):
    return table("documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "paragraph")).select("doc_id", (F.col("i") + 1).cast("long").alias("para_no"), "paragraph")


@add("L4_align_right_center", """
SELECT p_partkey, CASE WHEN rtrim(p_name) = '' THEN p_name ELSE repeat(' ', CAST(greatest((76 - length(rtrim(p_name))) // 2, 0) AS INT)) || p_name END AS centred,
  CASE WHEN rtrim(p_name) = '' THEN p_name ELSE repeat(' ', CAST(greatest(76 - length(rtrim(p_name)), 0) AS INT)) || p_name END AS flush_right FROM part""")
def aligned(table):
    return table("part").select("p_partkey", layout.align(F.col("p_name"), "center").alias("centred"), layout.align(F.col("p_name"), "right").alias("flush_right"))


@add("L5_justify_line", f"""
WITH RECURSIVE p AS (SELECT item_id AS k, i, string_split(text, chr(10))[i] AS t FROM (SELECT item_id, text, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM benchmark) WHERE regexp_matches(t, '[^ \\t\\r\\x0b\\x0c]')),
{WRAPPED_SQL},
l AS (SELECT k, i, n, line, n = max(n) OVER (PARTITION BY k, i) OR trim(line) = '' AS plain, 76 - length(rtrim(line)) AS lacking, len(regexp_extract_all(line, '[\\t-\\r ]+')) AS gaps, string_split_regex(line, ' +') AS words, regexp_extract_all(line, ' +') AS blanks FROM w WHERE n > 0)
SELECT k AS item_id, row_number() OVER (PARTITION BY k ORDER BY i, n) AS line_no, CASE WHEN plain OR lacking <= 0 THEN line ELSE array_to_string(list_transform(range(1, len(words) + 1), lambda x: words[x] || CASE WHEN x < len(words) THEN blanks[x] || repeat(' ', CAST(lacking // greatest(gaps, 1) + CASE WHEN x > gaps - lacking % greatest(gaps, 1) THEN 1 ELSE 0 END AS INT)) ELSE '' END), '') END AS line FROM l""")
def justify(table):
    return layout.justified(table("benchmark"), "item_id", "text")


@add("L9_paragraph_gaps", "SELECT p_partkey, CASE WHEN CAST(p_size AS BIGINT) * 5 * 50 >= 6000 THEN 1 ELSE 0 END AS blank_lines FROM part")
def gaps(table):
    return table("part").select("p_partkey", text.blank_lines(F.col("p_size").cast("long") * 5).alias("blank_lines"))


@add("L11_table_cells", "SELECT n_regionkey, CAST(count(*) AS BIGINT) AS n_cells, string_agg(n_name, '|' ORDER BY n_nationkey) AS cells FROM nation GROUP BY n_regionkey")
def table_cells(table):
    rows = table("nation").groupBy("n_regionkey").agg(F.sort_array(F.collect_list(F.struct("n_nationkey", "n_name"))).alias("c"))
    row = F.concat(F.array_join(F.transform("c", lambda x: x["n_name"]), "\x07"), F.lit("\x07\x07"))
    found = layout.cells(row)
    return rows.select("n_regionkey", F.size(found).cast("long").alias("n_cells"), F.array_join(found, "|").alias("cells"))


@add("L12_unmatched_rows", "SELECT l_orderkey, count(DISTINCT l_returnflag) AS n_cells, max(CAST(l_linenumber AS BIGINT)) AS n_columns FROM lineitem GROUP BY l_orderkey HAVING count(DISTINCT l_returnflag) <> max(l_linenumber)")
def unmatched(table):
    rows = table("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("cells"), F.max(F.col("l_linenumber").cast("long")).alias("n_columns"))
    return layout.unmatched(rows, "cells", "n_columns").select("l_orderkey", F.size("cells").cast("long").alias("n_cells"), "n_columns")


@add("L13_column_width", """
SELECT p_partkey, CAST(CASE WHEN n <= 1 THEN 1 ELSE n - 1 END AS BIGINT) AS chars
FROM (SELECT p_partkey, floor((CAST(p_size AS BIGINT) * 60 * 50 * (CAST(CASE WHEN b = 0 OR b >= 145 THEN 145 WHEN b <= 45 THEN 45 ELSE b END AS DOUBLE) / 76.0::DOUBLE) + 3200.0::DOUBLE) / 6400.0::DOUBLE) AS n FROM (SELECT p_partkey, p_size, p_partkey % 160 AS b FROM part))""")
def column_width(table):
    return table("part").select("p_partkey", units.column_chars(F.col("p_size").cast("long") * 60, F.col("p_partkey") % 160).alias("chars"))


@add("L14_table_row_render", """
WITH RECURSIVE w AS (SELECT conv_id, turn, 0 AS n, CAST(NULL AS VARCHAR) AS line, text AS rest FROM conversations
  UNION ALL SELECT conv_id, turn, n + 1, CASE WHEN cut THEN substr(own, 1, place) ELSE own END,
    nullif(ltrim(CASE WHEN length(cell) > 18 THEN CASE WHEN cut THEN substr(own, place + 2) ELSE '' END || substr(cell, 19) || chr(10) || more ELSE more END, ' '), '')
  FROM (SELECT *, length(own) >= 18 AND length(cell) > 18 AND substr(cell, 19, 1) <> ' ' AND contains(own, ' ') AS cut, length(regexp_extract(own, '(?s)^(.*) ', 1)) AS place
    FROM (SELECT *, rtrim(substr(cell, 1, 18), ' ') AS own FROM (SELECT *, regexp_extract(rest, '(?s)^([^\\n]*)', 1) AS cell, regexp_extract(rest, '(?s)^[^\\n]*\\n(.*)$', 1) AS more FROM w WHERE rest IS NOT NULL)))),
d AS (SELECT conv_id, max(n) AS lines FROM w GROUP BY conv_id),
r AS (SELECT DISTINCT conv_id, turn, unnest(range(1, lines + 1)) AS n FROM conversations JOIN d USING (conv_id))
SELECT conv_id, CAST(n AS BIGINT) AS line_no, '|' || string_agg(rpad(coalesce(line, ''), 18, ' '), '|' ORDER BY turn) || '|' AS line FROM r LEFT JOIN w USING (conv_id, turn, n) GROUP BY conv_id, n""")
def render(table):
    rows = table("conversations").groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", "text"))).alias("c"))
    return layout.table_lines(rows.select("conv_id", F.transform("c", lambda x: x["text"]).alias("texts"), F.transform("c", lambda x: F.lit(18)).alias("widths")), "conv_id", "texts", "widths")


@add("L14_table_row_short", """
SELECT n_nationkey, CAST(1 AS BIGINT) AS line_no, '|' || rpad(CAST(n_nationkey AS VARCHAR), 6, ' ') || '|' || rpad(n_name, 30, ' ') || '|' AS line FROM nation""")
def render_short(table):
    rows = table("nation").select("n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("texts"), F.array(F.lit(6), F.lit(30)).alias("widths"))
    return layout.table_lines(rows, "n_nationkey", "texts", "widths").select(F.col("n_nationkey").cast("int"), "line_no", "line")


@add("L15_table_font", "SELECT p_partkey, CAST(greatest(16, least(20, (CAST(p_size AS BIGINT) * 5) // 6)) AS BIGINT) AS size FROM part")
def table_font(table):
    return table("part").select("p_partkey", units.table_font_size(F.col("p_size").cast("long")).alias("size"))


@add("A3_max_run_size", "SELECT l_orderkey, CAST(greatest(8, max(l_linenumber * 3)) AS BIGINT) AS size FROM lineitem GROUP BY l_orderkey")
def max_run_size(table):
    return table("lineitem").groupBy("l_orderkey").agg(F.greatest(F.lit(8).cast("long"), F.max((F.col("l_linenumber") * 3).cast("long"))).alias("size"))


@add("A7_holes", "SELECT doc_id, CAST(len(regexp_extract_all(text, '[\\t-\\r ]+')) AS BIGINT) AS holes FROM documents")
def holes(table):
    return table("documents").select("doc_id", layout.holes(F.col("text")).alias("holes"))


@add("U2_separator_line", "SELECT DISTINCT lang, repeat('-', 23) AS line FROM documents")
def separator(table):
    return table("documents").select("lang").distinct().select("lang", text.separator().alias("line"))


@add("K1_text_lines_joined", "SELECT conv_id, string_agg(text, chr(10) ORDER BY turn) || chr(10) AS text FROM conversations GROUP BY conv_id")
def joined(table):
    return text.joined(table("conversations"), ["conv_id"], "turn", "text")


@add("K2_fmt_text_marks", """
SELECT conv_id, turn, CASE WHEN trim(t) = '' THEN t ELSE regexp_extract(t, '^ *', 0) || CASE role WHEN 'user' THEN '*' WHEN 'system' THEN '/_' ELSE '' END || trim(t) || CASE role WHEN 'user' THEN '*' WHEN 'system' THEN '_/' ELSE '' END || regexp_extract(t, ' *$', 0) END AS line
FROM (SELECT conv_id, turn, role, CASE WHEN turn % 2 = 0 THEN '  ' || text || ' ' ELSE text END AS t FROM conversations)""")
def fmt_text(table):
    t = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("  "), "text", F.lit(" "))).otherwise(F.col("text"))
    system = F.col("role") == "system"
    return table("conversations").select("conv_id", "turn", markup.marked(t, F.col("role") == "user", system, system).alias("line"))


@add("K6_docbook_para", """
SELECT conv_id, turn, '<para>' || CASE role WHEN 'user' THEN '<emphasis role="bold">' || x || '</emphasis>' WHEN 'system' THEN '<emphasis>' || x || '</emphasis>' ELSE x END || '</para>' AS xml
FROM (SELECT conv_id, turn, role, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM conversations)""")
def docbook_para(table):
    no = F.lit(False)
    return table("conversations").select("conv_id", "turn", markup.paragraph(markup.emphasised(F.col("text"), F.col("role") == "user", F.col("role") == "system", no, no, no, no)).alias("xml"))


@add("K10_docbook_table", """
SELECT n_regionkey, '<informaltable frame="all" colsep="1" rowsep="1"><tgroup cols="2"><colspec colwidth="36.00pt"/><colspec colwidth="72.00pt"/><tbody>' ||
  string_agg('<row><entry>' || n_nationkey || '</entry><entry>' || n_name || '</entry></row>', '' ORDER BY n_nationkey) || '</tbody></tgroup></informaltable>' AS xml FROM nation GROUP BY n_regionkey""")
def docbook_table(table):
    rows = table("nation").select("n_regionkey", "n_nationkey", F.array(F.col("n_nationkey").cast("string"), F.col("n_name")).alias("cells"))
    return docbook.tables(rows, ["n_regionkey"], "n_nationkey", "cells", [720, 1440])


@add("K3_docbook_document", f"""
WITH c AS (SELECT conv_id, turn, turn > 0 AND role = 'system' AS h2, replace(replace(replace(coalesce(text, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS x FROM conversations),
s AS (SELECT *, sum(CAST(h2 AS INT)) OVER (PARTITION BY conv_id ORDER BY turn) AS s FROM c),
g AS (SELECT conv_id, s, max(s) OVER (PARTITION BY conv_id) AS last, string_agg(CASE WHEN x = '' THEN '<para/>' ELSE '<para>' || x || '</para>' END, '' ORDER BY turn) FILTER (turn > 0 AND NOT h2) AS body, coalesce(max(x) FILTER (turn = 0 OR h2), '') AS title FROM s GROUP BY conv_id, s),
t AS (SELECT *, CASE WHEN title = '' THEN '<title/>' ELSE '<title>' || title || '</title>' END AS head FROM g)
SELECT conv_id, '{docbook.HEAD}<book>' || string_agg(CASE WHEN s > 0 THEN '<sect1>' || head || coalesce(body, '<para/>') || '</sect1>' ELSE '<chapter>' || head || coalesce(body, CASE WHEN last = 0 THEN '<para/>' ELSE '' END) END, '' ORDER BY s) || '</chapter></book>' AS xml FROM t GROUP BY conv_id""")
def docbook_document(table):
    kind = F.when(F.col("turn") == 0, "h1").when(F.col("role") == "system", "h2").otherwise("para")
    return docbook.documents(table("conversations").select("conv_id", "turn", kind.alias("kind"), "text"), "conv_id", "turn", "kind", "text")


QUERIES, ORACLE = catalog.queries, catalog.oracle
