"""Joins, islands, running values and counters over the test tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from scriptorium.functions.numbers import roman
from scriptorium.functions.text import has_text
from scriptorium.operators import numbering
from scriptorium.operators import relations as ops
from scriptorium.plans.common import Catalog
from scriptorium.plans.scalars import ROMAN_SQL

catalog = Catalog()
add = catalog.add


@add("W2_coalesce_blocks", """
WITH p AS (SELECT l_partkey, l_suppkey, l_orderkey, l_linenumber, CAST(l_quantity AS BIGINT) AS len, l_returnflag AS same FROM lineitem),
s AS (SELECT *, sum(len + CASE WHEN l_linenumber = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, len, same) - len AS start FROM p),
n AS (SELECT *, CASE WHEN lag(start + len) OVER w = start AND lag(same) OVER w = same THEN 0 ELSE 1 END AS new FROM s WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, len, same)),
i AS (SELECT *, sum(new) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, len, same) AS island FROM n)
SELECT l_orderkey, same, CAST(min(start) AS BIGINT) AS start, CAST(sum(len) AS BIGINT) AS len, count(*) AS n_pieces FROM i GROUP BY l_orderkey, island, same""")
def coalesce_blocks(table):
    from pyspark.sql import Window

    rows = table("lineitem").select("l_partkey", "l_suppkey", "l_orderkey", "l_linenumber", F.col("l_quantity").cast("long").alias("len"), F.col("l_returnflag").alias("same"))
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "len", "same")
    rows = rows.withColumn("start", (F.sum(F.col("len") + F.when(F.col("l_linenumber") == 1, 1).otherwise(0)).over(w) - F.col("len")).cast("long"))
    return ops.coalesce_runs(rows, ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "len", "same"], "start", "len", ["same"])


@add("W4_keep_last_of_run", """
SELECT event_id, user_id, h FROM (SELECT event_id, user_id, h, lead(h) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM (SELECT *, CAST(extract(hour FROM ts) AS BIGINT) AS h FROM events)) WHERE n IS NULL OR n <> h""")
def keep_last(table):
    rows = table("events").select("event_id", "user_id", "ts", F.hour("ts").cast("long").alias("h"))
    return ops.keep_last_of_run(rows, ["user_id"], ["ts", "event_id"], "h").select("event_id", "user_id", "h")


SPLIT = [("text", 0, 400), ("footnote", 400, 900), ("header", 900, 1500), ("rest", 1500, 1_000_000_000)]


@add("W5_prefix_split_lists", f"""
WITH p AS (SELECT conv_id, turn, CAST(length(text) AS BIGINT) AS len, CAST(coalesce(sum(length(text)) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM conversations),
b(list_id, a, z) AS (VALUES {", ".join(map(str, SPLIT))})
SELECT conv_id, turn, list_id, CAST(greatest(start, a) AS BIGINT) AS from_pos, CAST(least(start + len, z) AS BIGINT) AS to_pos FROM p, b WHERE greatest(start, a) < least(start + len, z)""")
def split_lists(table):
    rows = table("conversations").select("conv_id", "turn", F.length("text").cast("long").alias("len"))
    rows = ops.running_start(rows, ["conv_id"], ["turn"], "len")
    bounds = [(n, F.lit(a).cast("long"), F.lit(z).cast("long")) for n, a, z in SPLIT]
    return ops.split_by_totals(rows, "len", "start", bounds).select("conv_id", "turn", "list_id", "from_pos", "to_pos")


@add("W5b_block_round_up", "SELECT doc_id, CAST(CASE WHEN doc_id % 4 <> 3 AND n_chars % 512 <> 0 THEN (n_chars // 512 + 1) * 512 ELSE n_chars END AS BIGINT) AS length FROM documents")
def block_round_up(table):
    return table("documents").select("doc_id", ops.rounded_blocks(F.col("n_chars"), F.col("doc_id") % 4 == 3).alias("length"))


@add("J1_range_locate", """
WITH p AS (SELECT l_orderkey AS k, l_linenumber, CAST(l_quantity AS BIGINT) AS len, CAST(coalesce(sum(CAST(l_quantity AS BIGINT)) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM (SELECT l_orderkey, l_linenumber, max(l_quantity) AS l_quantity FROM lineitem GROUP BY ALL)),
q AS (SELECT o_orderkey AS k, CAST(o_custkey % 150 AS BIGINT) AS pos FROM orders)
SELECT q.k, q.pos, CAST(p.l_linenumber AS BIGINT) AS piece, CAST(q.pos - p.start AS BIGINT) AS delta FROM q LEFT JOIN p ON q.k = p.k AND q.pos >= p.start AND q.pos < p.start + p.len""")
def range_locate(table):
    pieces = table("lineitem").groupBy(F.col("l_orderkey").alias("k"), F.col("l_linenumber").cast("long").alias("piece")).agg(F.max("l_quantity").cast("long").alias("len"))
    pieces = ops.running_start(pieces, ["k"], ["piece"], "len")
    points = table("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 150).alias("pos"))
    return ops.locate(points, pieces, ["k"], "pos", "start", "len", ["piece"]).select("k", "pos", "piece", F.col("delta").cast("long"))


@add("J4_asof_style", """
SELECT e.event_id, coalesce((SELECT arg_max(c.event_id, (c.ts, c.event_id)) FROM events c WHERE c.user_id = e.user_id AND c.event_id % 5 = 0 AND (c.ts, c.event_id) <= (e.ts, e.event_id)), 0) AS istd FROM events e WHERE e.event_id % 5 <> 0""")
def asof_style(table):
    rows = table("events").select("event_id", "user_id", F.struct("ts", "event_id").alias("at"))
    styles = rows.filter("event_id % 5 = 0").select("user_id", "at", F.col("event_id").alias("istd"))
    return ops.as_of(rows.filter("event_id % 5 <> 0"), styles, ["user_id"], "at", "istd", 0).select("event_id", "istd")


@add("J5_near_match_join", """
WITH d AS (SELECT l_orderkey AS k, CAST(l_linenumber - 1 AS BIGINT) AS level, max(l_partkey) AS v FROM lineitem GROUP BY ALL),
q AS (SELECT o_orderkey AS k, o_custkey % 9 AS level FROM orders)
SELECT q.k, q.level, coalesce(a.v, b.v) AS v FROM q LEFT JOIN d a ON q.k = a.k AND q.level = a.level LEFT JOIN d b ON q.k = b.k AND b.level = 0""")
def near_match(table):
    defs = table("lineitem").groupBy(F.col("l_orderkey").alias("k"), (F.col("l_linenumber") - 1).cast("long").alias("level")).agg(F.max("l_partkey").alias("v"))
    rows = table("orders").select(F.col("o_orderkey").alias("k"), (F.col("o_custkey") % 9).alias("level"))
    return ops.exact_or_near(rows, defs, ["k"], "level", "v")


@add("J7_first_match_default", """
SELECT c_custkey, coalesce(v, 'none') AS first_supplier FROM customer LEFT JOIN (SELECT s_nationkey, CAST(s_acctbal > 5000 AS INT) AS high, arg_min(s_name, s_suppkey) AS v FROM supplier GROUP BY ALL) ON c_nationkey = s_nationkey AND CAST(c_acctbal > 5000 AS INT) = high""")
def first_match(table):
    high = lambda c: (F.col(c) > 5000).alias("high")
    right = table("supplier").select(F.col("s_nationkey").alias("c_nationkey"), high("s_acctbal"), "s_suppkey", F.col("s_name").alias("first_supplier"))
    return ops.first_match(table("customer").select("c_custkey", "c_nationkey", high("c_acctbal")), right, ["c_nationkey", "high"], ["s_suppkey"], "first_supplier", "none").select("c_custkey", "first_supplier")


@add("J9_note_kind", """
WITH n AS (SELECT source, count(*) FILTER (WHERE quality = 0) AS f, count(*) FILTER (WHERE toxic = 1) AS e FROM documents LEFT JOIN labels USING (doc_id) GROUP BY source)
SELECT doc_id, CASE WHEN f = 0 AND e = 0 THEN 'unknown' WHEN e = 0 THEN 'footnote' WHEN f = 0 THEN 'endnote' WHEN quality = 0 THEN 'footnote' WHEN toxic = 1 THEN 'endnote' ELSE 'unknown' END AS kind
FROM documents LEFT JOIN labels USING (doc_id) JOIN n USING (source)""")
def note_kind(table):
    rows = table("documents").select("doc_id", "source").join(table("labels"), "doc_id", "left")
    n = rows.groupBy("source").agg(F.count_if(F.col("quality") == 0).alias("f"), F.count_if(F.col("toxic") == 1).alias("e"))
    found = F.when(F.col("quality") == 0, "footnote").when(F.col("toxic") == 1, "endnote")
    return rows.join(n, "source").select("doc_id", ops.note_kind(found, F.col("f"), F.col("e")).alias("kind"))


@add("W1_carry_forward_attr", """
SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN 'B' || event_id WHEN event_id % 7 = 0 THEN 'default' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS font FROM events""")
def carry(table):
    explicit = F.when(F.col("event_type") == "purchase", F.concat(F.lit("B"), "event_id"))
    return table("events").select("event_id", ops.effective(explicit, F.lit("default"), F.col("event_id") % 7 == 0, ["user_id"], ["ts", "event_id"]).alias("font"))


@add("W6_row_pairing", """
WITH e AS (SELECT *, event_type = 'click' AS o, event_type = 'purchase' AS c FROM events),
n AS (SELECT *, sum(CAST(c AS INT)) OVER (PARTITION BY user_id ORDER BY ts, event_id) - CAST(c AS INT) AS n FROM e),
r AS (SELECT user_id, n, min(CASE WHEN o THEN (ts, event_id) END) AS s, max(CASE WHEN c THEN (ts, event_id) END) AS z FROM n GROUP BY ALL)
SELECT user_id, s[2] AS start_event, z[2] AS end_event FROM r WHERE s IS NOT NULL AND z IS NOT NULL AND s <= z""")
def row_pairing(table):
    rows = table("events").withColumn("at", F.struct("ts", "event_id"))
    out = ops.paired_rows(rows, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "purchase", "at")
    return out.select("user_id", F.col("start.event_id").alias("start_event"), F.col("end.event_id").alias("end_event"))


@add("W7_list_values", """
WITH RECURSIVE p AS (SELECT l_orderkey AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) AS o, CAST(l_partkey % 3 AS INT) AS l, CAST(l_suppkey % 4 AS BIGINT) AS s, l_suppkey % 2 = 0 AS r FROM lineitem),
f AS (SELECT k, CAST(0 AS BIGINT) AS o, CAST(NULL AS INT) AS l, CAST(NULL AS BIGINT) AS value, [CAST(NULL AS BIGINT), NULL, NULL] AS c FROM (SELECT DISTINCT k FROM p)
  UNION ALL SELECT p.k, p.o, p.l, coalesce(f.c[p.l + 1] + 1, p.s), list_transform([0, 1, 2], lambda i: CASE WHEN i = p.l THEN coalesce(f.c[p.l + 1] + 1, p.s) WHEN i > p.l AND NOT p.r THEN NULL ELSE f.c[i + 1] END) FROM f JOIN p ON f.k = p.k AND p.o = f.o + 1)
SELECT k, o, CAST(l AS BIGINT) AS l, value FROM f WHERE o > 0""")
def list_values(table):
    from pyspark.sql import Window

    order = ["l_linenumber", "l_partkey", "l_suppkey"]
    rows = table("lineitem").select(F.col("l_orderkey").alias("k"), *order, (F.col("l_partkey") % 3).alias("l"), (F.col("l_suppkey") % 4).alias("s"), (F.col("l_suppkey") % 2 == 0).alias("r"), F.lit(1).alias("list"))
    o = F.row_number().over(Window.partitionBy("k", "list").orderBy(*order)).cast("long")  # by the same sort
    return numbering.list_values(rows, ["k"], order, "list", "l", "s", "r").select("k", o.alias("o"), "l", "value")


@add("W8_old_list_values", """
WITH e AS (SELECT event_id, user_id, ts, event_id // 3 AS seq, event_id % 2 = 0 AS is_seq, event_id % 5 = 0 AS pause, CAST(event_id % 4 AS BIGINT) AS start_at FROM events),
n AS (SELECT *, CASE WHEN seq = lag(seq) OVER w OR (seq = lag(seq) OVER w + 1 AND is_seq) THEN 0 ELSE 1 END AS new FROM e WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS island FROM n)
SELECT event_id, CAST(sum(CASE WHEN new = 1 THEN start_at WHEN pause THEN 0 ELSE 1 END) OVER (PARTITION BY user_id, island ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value FROM i""")
def old_list_values(table):
    k = F.col("event_id")
    rows = table("events").select("event_id", "user_id", "ts", F.floor(k / 3).alias("seq"), (k % 2 == 0).alias("is_seq"), (k % 5 == 0).alias("pause"), (k % 4).alias("start_at"))
    return numbering.old_list_values(rows, ["user_id"], ["ts", "event_id"], "seq", "is_seq", "pause", "start_at").select("event_id", "value")


@add("W9_heading_numbers", """
WITH RECURSIVE p AS (SELECT conv_id AS k, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS o, CAST(length(text) % 4 + 1 AS INT) AS i FROM conversations),
f AS (SELECT k, CAST(0 AS BIGINT) AS o, 0 AS i, [0, 0, 0, 0] AS c FROM (SELECT DISTINCT k FROM p)
  UNION ALL SELECT p.k, p.o, p.i, list_transform([1, 2, 3, 4], lambda x: CASE WHEN x = p.i THEN f.c[x] + 1 WHEN x > p.i THEN 0 WHEN f.c[x] = 0 THEN 1 ELSE f.c[x] END) FROM f JOIN p ON f.k = p.k AND p.o = f.o + 1)
SELECT k, o, CAST(i AS BIGINT) AS i, array_to_string(c[1:i], '.') AS number FROM f WHERE o > 0""")
def heading_numbers(table):
    from pyspark.sql import Window

    o = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")).cast("long")
    rows = table("conversations").select(F.col("conv_id").alias("k"), o.alias("o"), (F.length("text") % 4 + 1).alias("i"))
    return numbering.heading_numbers(rows, ["k"], "o", "i", F.lit(True), F.lit(0))


@add("W10_hdrftr_inherit", """
WITH s AS (SELECT o_custkey AS k, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS section, CASE WHEN o_orderkey % 3 = 0 THEN 'e' || o_orderkey END AS e, CASE WHEN o_orderkey % 4 = 0 THEN 'o' || o_orderkey END AS o, CASE WHEN o_orderkey % 2 = 0 THEN 'f' || o_orderkey END AS f FROM orders),
t AS (SELECT k, section, CASE WHEN section = 1 THEN coalesce(e, f) ELSE e END AS e, CASE WHEN section = 1 THEN coalesce(o, f) ELSE o END AS o, f FROM s)
SELECT k, section, last_value(e IGNORE NULLS) OVER w AS hdr_even, last_value(o IGNORE NULLS) OVER w AS hdr_odd, last_value(f IGNORE NULLS) OVER w AS hdr_first FROM t WINDOW w AS (PARTITION BY k ORDER BY section ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)""")
def hdrftr(table):
    from pyspark.sql import Window

    n = F.col("o_orderkey")
    text = lambda m, c: F.when(n % m == 0, F.concat(F.lit(c), n))
    rows = table("orders").select(F.col("o_custkey").alias("k"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).cast("long").alias("section"), text(3, "e").alias("hdr_even"), text(4, "o").alias("hdr_odd"), text(2, "f").alias("hdr_first"))
    return ops.inherited(rows, ["k"], "section", ["hdr_even", "hdr_odd", "hdr_first"])


@add("W11_stylesheet_fixpoint", """
WITH RECURSIVE s AS (SELECT p_partkey AS k, p_partkey // 2 AS b, CASE WHEN p_size % 3 = 0 THEN CAST(p_size AS BIGINT) END AS v FROM part),
r AS (SELECT k, b, v FROM s UNION SELECT r.k, s.b, s.v FROM r JOIN s ON r.b = s.k WHERE r.v IS NULL AND r.b <> r.k)
SELECT s.k, max(r.v) AS v FROM s LEFT JOIN r ON s.k = r.k AND r.v IS NOT NULL GROUP BY s.k""")
def stylesheet(table):
    rows = table("part").select(F.col("p_partkey").alias("k"), F.floor(F.col("p_partkey") / 2).alias("b"), F.when(F.col("p_size") % 3 == 0, F.col("p_size").cast("long")).alias("v"))
    return ops.base_chain(rows, [], "k", "b", "v")


@add("W12_list_sequence", """
SELECT conv_id, turn, CAST(sum(CASE WHEN inl AND NOT coalesce(p, false) THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS list_no
FROM (SELECT *, lag(inl) OVER (PARTITION BY conv_id ORDER BY turn) AS p FROM (SELECT conv_id, turn, length(text) % 2 = 0 AS inl FROM conversations))""")
def list_sequence(table):
    rows = table("conversations").select("conv_id", "turn", (F.length("text") % 2 == 0).alias("inl"))
    return ops.list_sequence(rows, F.col("inl"), ["conv_id"], ["turn"]).select("conv_id", "turn", "list_no")


@add("W13_note_markers", f"""
SELECT conv_id, turn, CASE WHEN role = 'user' THEN '[' || n || ']' WHEN role = 'assistant' THEN '[' || {ROMAN_SQL.format(n="n")} || ']' ELSE '[?]' END AS mark
FROM (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS n FROM conversations)""")
def note_markers(table):
    kind = F.when(F.col("role") == "user", "footnote").when(F.col("role") == "assistant", "endnote").otherwise(F.col("role"))
    return ops.note_marks(table("conversations").select("conv_id", "turn", kind.alias("kind")), ["conv_id"], ["turn"], "kind", roman).select("conv_id", "turn", "mark")


@add("A4_list_lengths", "SELECT conv_id, role, CAST(sum(CASE WHEN turn % 2 = 0 THEN length(text) // 2 ELSE length(text) END) AS BIGINT) AS n_chars FROM conversations GROUP BY ALL")
def list_lengths(table):
    rows = table("conversations").select("conv_id", "role", "turn", F.length("text").cast("long").alias("len"))
    return ops.list_lengths(rows, ["conv_id", "role"], "len", F.col("turn") % 2 == 0)


@add("A6_section_count", "SELECT doc_id, CAST(len(string_split(text, chr(10))) AS BIGINT) AS n_sections FROM documents")
def section_count(table):
    return table("documents").select("doc_id", F.size(F.split("text", "\n")).cast("long").alias("n_sections"))


@add("A9_good_files", "SELECT source, count(*) AS n_files, CAST(sum(CAST(regexp_matches(text, '[^ \\t-\\r]') AS INT)) AS BIGINT) AS n_good FROM documents GROUP BY source")
def good_files(table):
    return table("documents").groupBy("source").agg(F.count(F.lit(1)).alias("n_files"), F.sum(has_text(F.col("text")).cast("long")).alias("n_good"))


@add("U1_concat_lists", "SELECT doc_id, 'text' AS list_id, CAST(0 AS BIGINT) AS list_order FROM documents UNION ALL SELECT doc_id, 'footnote', 1 FROM labels WHERE quality = 0 UNION ALL SELECT doc_id, 'endnote', 2 FROM labels WHERE toxic = 1")
def concat_lists(table):
    labels = table("labels")
    return ops.concatenated([("text", table("documents").select("doc_id")), ("footnote", labels.filter("quality = 0").select("doc_id")), ("endnote", labels.filter("toxic = 1").select("doc_id"))])


@add("L16_blank_after_table", "SELECT conv_id, turn, coalesce(lag(role) OVER (PARTITION BY conv_id ORDER BY turn) = 'assistant' AND role <> 'assistant', false) AS blank FROM conversations")
def blank_after_table(table):
    from pyspark.sql import Window

    before = F.lag("role").over(Window.partitionBy("conv_id").orderBy("turn"))
    return table("conversations").select("conv_id", "turn", F.coalesce((before == "assistant") & (F.col("role") != "assistant"), F.lit(False)).alias("blank"))


QUERIES, ORACLE = catalog.queries, catalog.oracle
