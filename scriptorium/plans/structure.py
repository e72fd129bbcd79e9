"""Chains of blocks, records in bytes, merged streams, pages by height, font metrics and tags as rows, over the test tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from scriptorium import api
from scriptorium.functions import binary, text
from scriptorium.functions.text import PRIVATE, SYMBOLS
from scriptorium.operators import chains, lists, metrics, paging, streams, textblocks
from scriptorium.operators import relations as ops
from scriptorium.plans.common import Catalog
from scriptorium.plans.layouts import ORACLE as LAYOUTS
from scriptorium.sinks import docbook

catalog = Catalog()
add = catalog.add

#: Characters of a block in the chained texts.
SIZE = 512


def little(number, width: int):
    """A number as hex digits of `width` bytes, the low byte first."""
    digits = F.lpad(F.hex(number.cast("long")), 2 * width, "0")
    return binary.let(digits, lambda d: F.concat(*[F.substring(d, 2 * i + 1, 2) for i in reversed(range(width))]))


# chains of blocks


def blocks_of_texts(table):
    """(doc_id, block, next, content): texts in blocks that lie zigzag: the even ones from the front, the odd ones from the back."""
    texts = table("documents").select("doc_id", "text", F.greatest(F.ceil(F.length("text") / SIZE), F.lit(1)).cast("long").alias("m"))
    each = texts.select("doc_id", "m", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda i: F.struct(i.alias("i"), F.substring("text", (i * SIZE + 1).cast("int"), SIZE).alias("content")))).alias("b"))
    place = lambda i: F.when(i % 2 == 0, F.floor(i / 2)).otherwise(F.col("m") - 1 - F.floor(i / 2)).cast("long")
    i = F.col("b.i")
    return each.select("doc_id", place(i).alias("block"), F.when(i + 1 < F.col("m"), place(i + 1)).otherwise(-2).alias("next"), F.col("b.content").alias("content"))


@add("S5_chained_read", f"SELECT doc_id, CASE WHEN length(text) >= doc_id % 1500 + {SIZE} THEN substr(text, doc_id % 1500 + 1, {SIZE}) END AS content FROM documents")
def chained_read(table):
    blocks = blocks_of_texts(table)
    found = chains.followed(blocks.drop("content"), blocks.filter("block = 0").select("doc_id", F.col("block").alias("start")), ["doc_id"])
    return chains.read(found, blocks, ["doc_id"], SIZE, F.col("doc_id") % 1500, F.lit(SIZE)).select("doc_id", "content")


#: The orders of a customer as a chain, from each customer's first one.
ORDER_CHAIN = "SELECT o_custkey, o_orderkey, lead(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS next, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS n FROM orders"


def order_chain(table):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table("orders").select("o_custkey", "o_orderkey", F.lead("o_orderkey").over(w).alias("next"), F.row_number().over(w).alias("n"))
    return chains.followed(rows, rows.filter("n = 1").select("o_custkey", F.col("o_orderkey").alias("start")), ["o_custkey"], "o_orderkey")


@add("S7_small_block_list", f"""
WITH RECURSIVE e AS ({ORDER_CHAIN}),
c AS (SELECT o_custkey, o_orderkey AS start, CAST(0 AS BIGINT) AS rank, o_orderkey, next FROM e WHERE n = 1
  UNION ALL SELECT c.o_custkey, c.start, c.rank + 1, e.o_orderkey, e.next FROM c JOIN e ON c.o_custkey = e.o_custkey AND c.next = e.o_orderkey)
SELECT o_custkey, start, rank, o_orderkey FROM c""")
def small_block_list(table):
    return order_chain(table)


@add("S6_block_offsets", f"""
WITH e AS ({ORDER_CHAIN}), q AS (SELECT l_orderkey, l_linenumber, CAST(l_linenumber * 9 + l_orderkey % 5 AS BIGINT) AS i, o_custkey FROM lineitem JOIN orders ON l_orderkey = o_orderkey)
SELECT q.l_orderkey, q.l_linenumber, q.i, coalesce(((e.o_orderkey + 1) * 8 + q.i % 8) * 64, 0) AS file_offset, (q.i + 1) * 512 AS big_offset FROM q LEFT JOIN e ON q.o_custkey = e.o_custkey AND q.i // 8 = e.n - 1""")
def block_offsets(table):
    rows = table("lineitem").join(table("orders"), F.col("l_orderkey") == F.col("o_orderkey")).select("l_orderkey", "l_linenumber", (F.col("l_linenumber") * 9 + F.col("l_orderkey") % 5).cast("long").alias("i"), "o_custkey")
    found = chains.small_offsets(rows, order_chain(table), ["o_custkey"], "i", "o_orderkey")
    return found.select("l_orderkey", "l_linenumber", "i", "file_offset", chains.offset_of_big(F.col("i")).alias("big_offset"))


@add("S8_index_blocks", "SELECT s_suppkey, place, s_suppkey * 1000 + place AS block FROM supplier, unnest(range(s_suppkey * 7 % 500)) t(place)")
def index_blocks(table):
    """Block numbers of suppliers' files: 109 in the header, 127 in each further block, the last four bytes of which name the next."""
    n = F.col("s_suppkey") * 7 % 500
    rows = table("supplier").select("s_suppkey", n.alias("n"))
    number = lambda i: little(F.col("s_suppkey") * 1000 + i, 4)
    numbers = lambda first, count: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda i: number(first + i)), "")
    headers = rows.select("s_suppkey", "n", F.lit(0).alias("first"), F.unhex(F.concat(F.repeat(F.lit("00"), chains.HEADER_AT), numbers(F.lit(0), chains.IN_HEADER))).alias("header"))
    count = F.ceil((F.col("n") - chains.IN_HEADER) / chains.IN_BLOCK)
    more = rows.filter(F.col("n") > chains.IN_HEADER).select("s_suppkey", "n", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("block"))
    last = F.when(F.col("block") + 1 < F.ceil((F.col("n") - chains.IN_HEADER) / chains.IN_BLOCK), little(F.col("block") + 1, 4)).otherwise("FEFFFFFF")
    blocks = more.select("s_suppkey", "block", F.unhex(F.concat(numbers(F.col("block") * chains.IN_BLOCK + chains.IN_HEADER, chains.IN_BLOCK), last)).alias("content"))
    return chains.header_blocks(headers, blocks, ["s_suppkey"], "n", "first").select("s_suppkey", "place", "block")


@add("W11_circular_bases", """
WITH RECURSIVE s AS (SELECT p_partkey AS k, p_partkey * 3 % 250 AS b, CASE WHEN p_size % 9 = 0 THEN CAST(p_size AS BIGINT) END AS v FROM part),
r AS (SELECT k, b, v FROM s UNION SELECT r.k, s.b, s.v FROM r JOIN s ON r.b = s.k WHERE r.v IS NULL)
SELECT k, max(v) AS v, max(v) IS NULL AND bool_and(b IN (SELECT k FROM s)) AS circular FROM r GROUP BY k""")
def circular_bases(table):
    """Bases that end in circles, or at a part that there isn't: all numbers below 250 have a base below 250."""
    rows = table("part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 3 % 250).alias("b"), F.when(F.col("p_size") % 9 == 0, F.col("p_size").cast("long")).alias("v"))
    return ops.base_chain(rows, [], "k", "b", "v", "circular")


# records


def byte_sql(at: str) -> str:
    return f"(CASE WHEN {at} < n THEN CAST('0x' || substr(h, 2 * ({at}) + 1, 2) AS INT) ELSE 0 END)"


def walk_sql(select: str, key: str, size: str, op: str) -> str:
    """The records of a walk, by recursion; `size` and `op` are over AT, h and n."""
    return f"""
WITH RECURSIVE b AS (SELECT {key}, hex(encode(t)) AS h, strlen(t) AS n FROM ({select})),
w AS (SELECT {key}, h, n, 0 AS p, {size.replace("AT", "0")} AS size FROM b WHERE n > 0
  UNION ALL SELECT {key}, h, n, p + size, {size.replace("AT", "(p + size)")} FROM w WHERE p + size < n)
SELECT {key}, p AS "at", CAST(size AS INT) AS size, {op.replace("AT", "p")} AS op FROM w"""


OP8 = f"({byte_sql('AT')} + 256 * {byte_sql('(AT + 1)')})"
SIZE8 = f"""CASE {OP8} // 8192 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 3 THEN 6 WHEN 7 THEN 5 WHEN 6 THEN
  CASE WHEN {OP8} = 50709 AND {byte_sql('(AT + 2)')} = 255 THEN 5 + 4 * {byte_sql('(AT + 3)')} + 3 * {byte_sql('(AT + 4 + 4 * ' + byte_sql('(AT + 3)') + ')')} ELSE 3 + {byte_sql('(AT + 2)')} END ELSE 4 END"""
OP6 = byte_sql("AT")
_SIZES6 = " ".join(f"WHEN {OP6} IN ({', '.join(map(str, ops_))}) THEN {n}" for n, ops_ in ((3, binary.TWO), (4, binary.THREE), (5, binary.FOUR), (6, binary.FIVE), (13, binary.TWELVE)))
SIZE6 = f"""CASE WHEN {OP6} = 23 AND {byte_sql('(AT + 1)')} = 255 THEN 4 + 4 * {byte_sql('(AT + 2)')} + 3 * {byte_sql('(AT + 3 + 4 * ' + byte_sql('(AT + 2)') + ')')}
  WHEN {OP6} = 23 OR {OP6} IN ({', '.join(map(str, binary.COUNTED6))}) THEN 2 + {byte_sql('(AT + 1)')} {_SIZES6} ELSE 2 END"""


@add("P1_property_records", walk_sql("SELECT conv_id, turn, text AS t FROM conversations", "conv_id, turn", SIZE8, OP8))
def property_records(table):
    """The bytes of texts as property lists of version 8."""
    content = F.col("text").cast("binary")
    return table("conversations").select("conv_id", "turn", F.explode(binary.records8(content)).alias("r")).select("conv_id", "turn", "r.*")


@add("P1_old_property_records", walk_sql("SELECT page_id, url AS t FROM pages", "page_id", SIZE6, OP6))
def old_property_records(table):
    """The bytes of urls as property lists of versions 6 and 7."""
    return table("pages").select("page_id", F.explode(binary.records6(F.col("url").cast("binary"))).alias("r")).select("page_id", "r.*")


def complex_files(table):
    """(l_orderkey, content): orders as the text information of files: a padding, a property list a line and a table of pieces a line."""
    lines = table("lineitem").groupBy("l_orderkey", F.col("l_linenumber").cast("long").alias("line")).agg(F.max("l_quantity").cast("long").alias("chars"), F.max("l_partkey").alias("part"), F.max("l_suppkey").alias("supp"))
    return lines.groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("line", "chars", "part", "supp"))).alias("p")).select("l_orderkey", F.unhex(F.concat(*_parts(F.col("p")))).alias("content"))


def _parts(p):
    lists_ = F.array_join(F.transform(p, lambda x: F.concat(F.lit("01"), little(x["line"], 2), F.repeat(F.lpad(F.hex(x["line"]), 2, "0"), x["line"].cast("int")))), "")
    ends = F.transform(F.sequence(F.lit(0), F.size(p)), lambda i: little(F.aggregate(F.slice(p, 1, i), F.lit(0).cast("long"), lambda n, x: n + x["chars"]), 4))
    place = lambda x: F.when(x["line"] % 2 == 0, x["part"] * 64).otherwise(x["part"] * 128 + textblocks.NARROW)
    table = F.array_join(F.transform(p, lambda x: F.concat(F.lit("0000"), little(place(x), 4), little(x["supp"] % 65536, 2))), "")
    return F.lit("0000"), lists_, F.lit("02"), little(F.size(p) * 12 + 4, 4), F.array_join(ends, ""), table


LINES = "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS line, CAST(max(l_quantity) AS BIGINT) AS chars, max(l_partkey) AS part, max(l_suppkey) AS supp FROM lineitem GROUP BY ALL"


@add("P19_piece_table", f"""
SELECT l_orderkey, row_number() OVER w - 1 AS piece, CAST(sum(chars) OVER w - chars AS BIGINT) AS start, part * 64 AS file_offset, CASE WHEN line % 2 = 0 THEN chars * 2 ELSE chars END AS length, line % 2 = 0 AS is_unicode, CAST(supp % 65536 AS INT) AS prop_mod
FROM ({LINES}) WINDOW w AS (PARTITION BY l_orderkey ORDER BY line)""")
def piece_table(table):
    return complex_files(table).select("l_orderkey", F.posexplode(textblocks.pieces(F.col("content"))).alias("piece", "p")).select("l_orderkey", F.col("piece").cast("long").alias("piece"), "p.*")


@add("P19_property_lists", f"SELECT l_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY line) - 1 AS index, repeat(printf('%02X', line), CAST(line AS INT)) AS properties FROM ({LINES})")
def property_lists(table):
    lists_ = complex_files(table).select("l_orderkey", F.posexplode(textblocks.property_lists(F.col("content"))).alias("index", "properties"))
    return lists_.select("l_orderkey", F.col("index").cast("long").alias("index"), F.hex("properties").alias("properties"))


MOD_SQL = "CASE o_custkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 48 + 256 * (o_orderkey % 2) WHEN 2 THEN 50 + 256 * (o_orderkey % 2) ELSE 2 * (o_custkey % 9) + 1 END"


@add("L22_modifier_rows", f"""
WITH l AS (SELECT l_orderkey, l_linenumber - 1 AS i, max(l_returnflag) AS f, max(l_linestatus) AS s FROM lineitem GROUP BY ALL),
p AS (SELECT o_orderkey, o_custkey, {MOD_SQL} AS m FROM orders)
SELECT o_orderkey, CAST(m AS BIGINT) AS prop_mod, info AS row_info, o_custkey % 11 = 0 OR coalesce(info = 'end_of_row', false) AS ends_row FROM (
  SELECT o_orderkey, o_custkey, m, CASE WHEN m = 0 THEN NULL WHEN m % 2 = 0 THEN CASE WHEN m % 256 = 48 THEN CASE WHEN m // 256 % 2 = 1 THEN 'cell' ELSE 'not_cell' END WHEN m // 256 % 2 = 0 THEN 'not_end_of_row' END
    WHEN i IS NULL THEN NULL WHEN s = 'O' AND i % 2 = 0 THEN 'end_of_row' WHEN s <> 'O' AND i % 2 <> 0 THEN 'not_end_of_row' WHEN f = 'R' THEN 'cell' WHEN f = 'A' THEN 'not_cell' END AS info
  FROM p LEFT JOIN l ON o_orderkey = l_orderkey AND m % 2 = 1 AND m // 2 = i)""")
def modifier_rows(table):
    """Orders as fast-saved pieces whose modifier is none, an inline opcode, or the number of a line's property list; every second list has widths."""
    lists_ = table("lineitem").groupBy("l_orderkey", F.col("l_linenumber").alias("line")).agg(F.max("l_returnflag").alias("f"), F.max("l_linestatus").alias("s"))
    in_table = F.when(F.col("f") == "R", "1801").when(F.col("f") == "A", "1800").otherwise("")
    widths = F.when(F.col("line") % 2 == 1, "BE0401000000").otherwise("")
    lists_ = lists_.select(F.col("l_orderkey").alias("o_orderkey"), (F.col("line") - 1).cast("long").alias("index"), F.unhex(F.concat(F.lit("05FF"), widths, in_table, F.when(F.col("s") == "O", "1901").otherwise("1900"))).alias("properties"))
    pieces = table("orders").select("o_orderkey", "o_custkey", F.expr(MOD_SQL).cast("long").alias("prop_mod"))
    rows = textblocks.modifiers(pieces, lists_, ["o_orderkey"], "prop_mod")
    ended = textblocks.row_ends(rows, F.col("o_custkey") % 11 == 0, F.col("properties"), 6)
    return ended.select("o_orderkey", "prop_mod", textblocks.row_info(F.col("properties"), 6).alias("row_info"), "ends_row")


# streams, headers and pages


@add("J15_merged_streams", """
WITH t AS (SELECT user_id, event_id AS a, CASE WHEN event_id % 3 = 0 THEN event_id END AS font, CASE WHEN event_type = 'purchase' THEN event_id END AS style, CASE WHEN event_id % 17 = 0 THEN event_id END AS section FROM events),
s AS (SELECT * FROM t WHERE font IS NOT NULL OR style IS NOT NULL OR section IS NOT NULL OR a % 2 = 0)
SELECT user_id, a AS "at", lead(a) OVER w AS until, last_value(font IGNORE NULLS) OVER w AS font, last_value(style IGNORE NULLS) OVER w AS style, last_value(section IGNORE NULLS) OVER w AS section FROM s WINDOW w AS (PARTITION BY user_id ORDER BY a)""")
def merged_streams(table):
    """Three streams of events by user, and one that only has bounds, merged by their numbers."""
    e = table("events").select("user_id", F.col("event_id").alias("at"), F.col("event_id").alias("v"), "event_type")
    some = lambda condition: e.filter(condition).select("user_id", "at", "v")
    out = streams.merged({"font": some("at % 3 = 0"), "style": some("event_type = 'purchase'"), "section": some("at % 17 = 0"), "line": some("at % 2 = 0")}, ["user_id"], "at")
    return out.select("user_id", "at", "until", *[F.col(f"{c}.v").alias(c) for c in ("font", "style", "section")])


@add("J14_headers_on_pages", """
WITH s AS (SELECT o_custkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS section, o_orderkey AS k FROM orders),
m AS (SELECT o_custkey, max(section) AS last FROM s GROUP BY o_custkey),
p AS (SELECT c_custkey, turn, greatest(least(turn % 30, last), 0) AS section, turn % 5 = 0 AS first, turn % 2 = 1 AS odd FROM (SELECT c_custkey, unnest(range(8)) * 4 + c_custkey % 3 AS turn FROM customer) LEFT JOIN m ON c_custkey = o_custkey)
SELECT c_custkey, turn, CASE WHEN first THEN 'f' WHEN odd THEN 'o' ELSE 'e' END || k AS header, CASE WHEN NOT first AND NOT odd THEN 'x' || k END AS footer FROM p LEFT JOIN s ON c_custkey = o_custkey AND p.section = s.section""")
def headers_on_pages(table):
    """Customers' orders as sections; each customer has pages of some sections, also of numbers that they don't reach."""
    w = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    text = lambda c: F.concat(F.lit(c), F.col("o_orderkey"))
    sections = table("orders").select(F.col("o_custkey").alias("c_custkey"), (F.row_number().over(w) - 1).cast("long").alias("section"), text("f").alias("hdr_first"), text("o").alias("hdr_odd"), text("e").alias("hdr_even"), text("x").alias("ftr_even"))
    pages = table("customer").select("c_custkey", F.explode(F.transform(F.sequence(F.lit(0).cast("long"), F.lit(7).cast("long")), lambda i: i * 4 + F.col("c_custkey") % 3)).alias("turn")).withColumn("section", F.col("turn") % 30)
    out = lists.on_page(pages, sections, ["c_custkey"], "section", F.col("turn") % 5 == 0, F.col("turn") % 2 == 1, ["hdr_first", "hdr_odd", "hdr_even", "ftr_even"])
    return out.select("c_custkey", "turn", "header", "footer")


ROOM = 2500


@add("W14_pages_by_height", f"""
WITH RECURSIVE l AS (SELECT event_id, user_id, event_id // 2500 AS section, event_id * 37 % 900 + 200 + CASE WHEN event_id % 50 = 0 THEN 3000 ELSE 0 END AS height, row_number() OVER (PARTITION BY user_id, event_id // 2500 ORDER BY event_id) AS i FROM events),
p AS (SELECT *, CAST(1 AS BIGINT) AS page_in_section, CAST(0 AS BIGINT) AS top FROM l WHERE i = 1
  UNION ALL SELECT l.*, CASE WHEN p.top + p.height + l.height > {ROOM} THEN p.page_in_section + 1 ELSE p.page_in_section END, CASE WHEN p.top + p.height + l.height > {ROOM} THEN 0 ELSE p.top + p.height END FROM p JOIN l ON p.user_id = l.user_id AND p.section = l.section AND l.i = p.i + 1)
SELECT event_id, user_id, section, height, page_in_section, top, CAST(sum(CASE WHEN top = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY section, i) AS BIGINT) AS page FROM p""")
def pages_by_height(table):
    """Users' events as lines of unequal height, some higher than a page, in sections."""
    e = F.col("event_id")
    rows = table("events").select("event_id", "user_id", F.floor(e / 2500).alias("section"), (e * 37 % 900 + 200 + F.when(e % 50 == 0, 3000).otherwise(0)).alias("height"))
    return paging.paged(rows, ["user_id"], ["event_id"], "section", "height", ROOM)


# widths


def fonts(table):
    """(font, bold, widths): metrics by a rule, for the fonts that nations stand for."""
    base = table("nation").select(F.col("n_nationkey").cast("long").alias("font")).select("font", F.explode(F.array(F.lit(False), F.lit(True))).alias("bold"))
    return base.select("font", "bold", F.transform(F.sequence(F.lit(0), F.lit(metrics.CODES - 1)), lambda c: (250 + (c * 37 + F.col("font") * 11) % 500 + F.col("bold").cast("int") * 50).cast("int")).alias("widths"))


def code_sql(f: str, bold: str) -> str:
    return f"CASE WHEN unicode(c) < 256 THEN 250 + (unicode(c) * 37 + {f} * 11) % 500 + {bold} * 50 ELSE 600 END"


#: Thousandths of a text in the font f, bold or not, and millipoints at a size.
RELATIVE = "coalesce(list_sum(list_transform(string_split({t}, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE " + code_sql("{f}", "{b}") + " END)), 0)"
POINTS = "(({w} * {s} + 1) // 2)"


def texts_in_fonts(table):
    rows = table("documents").select("doc_id", "text", (F.col("doc_id") % 25).alias("font"), (F.col("doc_id") % 3 == 0).alias("bold"), (F.col("doc_id") % 20 + 12).alias("size"))
    return metrics.with_metrics(rows, fonts(table), ["font", "bold"])


F_SQL = "SELECT *, doc_id % 25 AS f, CAST(doc_id % 3 = 0 AS INT) AS b, doc_id % 20 + 12 AS s FROM documents"


@add("C13_metric_width", f"SELECT doc_id, CAST({POINTS.format(w=RELATIVE.format(t='text', f='f', b='b'), s='s')} AS BIGINT) AS width FROM ({F_SQL})")
def metric_width(table):
    return texts_in_fonts(table).select("doc_id", metrics.text_width(F.col("text"), F.col("widths"), F.col("size")).alias("width"))


def runs_of_lines(table):
    """(conv_id, parts): conversations as lines whose turns are runs in fonts of their own."""
    rows = table("conversations").select("conv_id", "turn", "text", (F.col("turn") % 25).alias("font"), (F.col("role") == "user").alias("bold"))
    runs = metrics.with_metrics(rows, fonts(table), ["font", "bold"])
    part = F.struct(F.concat("text", F.lit("  ")).alias("text"), "widths", (F.col("turn") + 16).alias("size"))
    return runs.groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", F.col("font"), part.alias("p")))), lambda x: x["p"]).alias("parts"))


RUNS = "SELECT conv_id, turn, text, turn % 25 AS f, CAST(role = 'user' AS INT) AS b, turn + 16 AS s, max(turn) OVER (PARTITION BY conv_id) AS last FROM conversations"


@add("A1_metric_line", f"SELECT conv_id, CAST(sum({POINTS.format(w=RELATIVE.format(t='text || chr(32) || chr(32)', f='f', b='b'), s='s')}) AS BIGINT) AS width FROM ({RUNS}) GROUP BY conv_id")
def metric_line(table):
    return runs_of_lines(table).select("conv_id", metrics.line_width(F.col("parts")).alias("width"))


_NET = "CASE WHEN turn = last THEN regexp_replace(text, '[ \\t-\\r]+$', '') ELSE text || chr(32) || chr(32) END"


@add("A2_metric_net", f"SELECT conv_id, CAST(sum({POINTS.format(w=RELATIVE.format(t='t', f='f', b='b'), s='s')}) AS BIGINT) AS width FROM (SELECT *, {_NET} AS t FROM ({RUNS})) GROUP BY conv_id")
def metric_net(table):
    return runs_of_lines(table).select("conv_id", metrics.net_width(F.col("parts")).alias("width"))


METRIC_ROOM = 300_000
_WORD = RELATIVE.format(t="w", f="f", b="b")
_BLANK = "(250 + (32 * 37 + f * 11) % 500 + b * 50)"


@add("C13_metric_lines", f"""
WITH RECURSIVE d AS (SELECT doc_id, f, b, s, string_split(text, ' ') AS words FROM ({F_SQL})),
x AS (SELECT doc_id, f, b, s, i, w, {_WORD} AS own FROM (SELECT doc_id, f, b, s, unnest(words) AS w, unnest(range(1, len(words) + 1)) AS i FROM d)),
r AS (SELECT doc_id, f, b, s, i, CAST(1 AS BIGINT) AS line, CAST(own AS BIGINT) AS width, w FROM x WHERE i = 1
  UNION ALL SELECT x.doc_id, x.f, x.b, x.s, x.i, CASE WHEN fits THEN line ELSE line + 1 END, CAST(CASE WHEN fits THEN longer ELSE own END AS BIGINT), x.w
  FROM (SELECT x.*, r.line, r.width + (250 + (32 * 37 + x.f * 11) % 500 + x.b * 50) + x.own AS longer, ((r.width + (250 + (32 * 37 + x.f * 11) % 500 + x.b * 50) + x.own) * x.s + 1) // 2 <= {METRIC_ROOM} AS fits FROM r JOIN x ON r.doc_id = x.doc_id AND x.i = r.i + 1) x)
SELECT doc_id, line, string_agg(w, ' ' ORDER BY i) AS text, CAST((max(width) * any_value(s) + 1) // 2 AS BIGINT) AS width FROM r GROUP BY doc_id, line""")
def metric_lines(table):
    """Texts broken at blanks by the widths of their font."""
    lines = texts_in_fonts(table).select("doc_id", F.posexplode(metrics.broken(F.col("text"), F.col("widths"), F.col("size"), METRIC_ROOM)).alias("line", "l"))
    return lines.select("doc_id", (F.col("line") + 1).cast("long").alias("line"), "l.text", "l.width")


LETTERS = "abcdefghijklmnopqrstuvwxyz"


@add("C1_private_symbols", f"SELECT doc_id, translate(text, '{LETTERS}.,', '{''.join(SYMBOLS[ord(c)] for c in LETTERS)}.?') AS text FROM documents")
def private_symbols(table):
    """Texts whose small letters and full stops a symbol font has put in the private area, and whose commas are a character that it doesn't have."""
    moved = F.translate("text", LETTERS + ".,", "".join(chr(PRIVATE + ord(c)) for c in LETTERS) + chr(PRIVATE + ord(".")) + chr(PRIVATE + 0x80))
    return table("documents").select("doc_id", text.private_symbols(moved).alias("text"))


TAB_CHARS = 8


@add("L8_expanded_tabs", rf"""
WITH t AS (SELECT doc_id, replace(text, ',', chr(9)) AS t FROM documents),
l AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS l, unnest(range(len(string_split(t, chr(10))))) AS i FROM t),
e AS (SELECT doc_id, i, list_reduce(string_split(l, chr(9)), lambda a, p: a || repeat(' ', {TAB_CHARS} - length(regexp_replace(a, '[\x00-\x1f\x7f-\x9f]', '', 'g')) % {TAB_CHARS}) || p) AS l FROM l)
SELECT doc_id, string_agg(l, chr(10) ORDER BY i) AS text FROM e GROUP BY doc_id""")
def expanded_tabs(table):
    """Texts with tabs for their commas."""
    return table("documents").select("doc_id", lists.expanded(F.replace("text", F.lit(","), F.lit("\t")), TAB_CHARS).alias("text"))


@add("K13_book_set", f"""
WITH b AS ({LAYOUTS["K3_docbook_document"]})
SELECT 0 AS place, NULL AS path, '{docbook.HEAD.replace("DOCTYPE book", "DOCTYPE set")}<set>' AS text UNION ALL SELECT 2, NULL, '</set>' UNION ALL SELECT 1, 'c' || conv_id, substr(xml, {len(docbook.HEAD) + 1}) FROM b""")
def book_set(table):
    kind = F.when(F.col("turn") == 0, "h1").when(F.col("role") == "system", "h2").otherwise("para")
    books = docbook.documents(table("conversations").select("conv_id", "turn", kind.alias("kind"), "text"), "conv_id", "turn", "kind", "text")
    return api.book_set(books.select(F.concat(F.lit("c"), "conv_id").alias("path"), F.col("xml").alias("text")))


QUERIES, ORACLE = catalog.queries, catalog.oracle
