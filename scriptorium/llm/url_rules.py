"""URL filters, in DataFrame functions and Spark's FP-growth only.

Listed rules (host, path) come first: a rule fits its host and all its subdomains if the url's path starts with the rule's; the
longest that fits wins, of equally long ones that of the longer host.

The method judges the others.  FP-growth mines the token combinations of labelled urls, where `block` is one more token of those
with a bad label.  A combination of tokens becomes a rule if it holds at least SUPPORT urls (SUPPORT_SHARE of
the labelled ones, if that is more), of which the part CONFIDENCE at least is bad, LIFT times the part among all labelled urls.
Rules stand in an inverted index under their rarest token, so frequent tokens have few of them; a url's tokens look up their rules,
and a rule matches if the url has all its tokens.

A url's tokens are its scheme, the labels of its host, the path segments with numbers as `#` and the query keys, all of them.
Tokens that the same labelled urls hold are mined as one: any choice of them makes equal rules, so the least one stands for
all, in urls too, and their combinations aren't listed.  Labels carry a page's number.

Defined results: a null url, or one without `://`, has an empty host and path, no rule, no tokens and is allowed; null labels
count as none; repeated rows get equal results; with no labels there are no mined rules; other columns aren't read.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import cut, lookup, lower_ascii

RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]
SUPPORT, SUPPORT_SHARE = 20, 0.002
CONFIDENCE, LIFT = 0.5, 1.5
BAD = "label:block"
#: So many rules are broadcast to the urls; more are joined by shuffle on their anchor.
FEW_RULES = 10_000


def parts(url: Column) -> tuple[Column, Column]:
    """Host and path."""
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    return lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """struct<verdict, rule> of the longest rule that fits, or null."""
    out = F.lit(None).cast("struct<verdict:string,rule:string>")
    for verdict, rule in sorted(rules, key=lambda r: (len(r[1]), r[1].index("/"))):
        h, p = rule[: rule.index("/")], rule[rule.index("/") :]
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(verdict).alias("verdict"), F.lit(rule).alias("rule"))).otherwise(out)
    return out


def tokens(url: Column, host: Column, path: Column) -> Column:
    url = F.coalesce(url, F.lit(""))
    labels = F.filter(F.split(host, "[.]"), lambda x: x != "")
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    keys = F.filter(F.split(F.regexp_extract(url, r"^[^?#]*[?]([^#]*)", 1), "&"), lambda x: x != "")
    found = F.concat(
        F.array(F.concat(F.lit("scheme:"), lower_ascii(F.regexp_extract(url, r"^(.*?)://", 1)))),
        F.transform(F.reverse(labels), lambda x: F.concat(F.lit("host:"), x)),
        F.transform(segments, lambda x: F.concat(F.lit("path:"), F.regexp_replace(x, "[0-9]+", "#"))),
        F.transform(keys, lambda x: F.concat(F.lit("query:"), F.regexp_extract(x, "^[^=]*", 0))),
    )
    return F.when(F.contains(url, F.lit("://")), F.array_distinct(found)).otherwise(F.expr("cast(array() as array<string>)"))


def classes(labelled: DataFrame) -> DataFrame:
    """One row, `same`: tokens that stand in the same rows of (tokens, bad) as a lesser one, with the least of those; rarer ones than rules need are left out."""
    total = labelled.count()
    each = labelled.select(F.monotonically_increasing_id().alias("id"), F.explode("tokens").alias("token"))
    held = each.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("id").cast("decimal(38,0)")).alias("h"), F.min("id").alias("first")).filter(F.col("n") >= max(SUPPORT, total * SUPPORT_SHARE) * CONFIDENCE)
    least = held.groupBy("n", "h", "first").agg(F.min("token").alias("least"), F.collect_list("token").alias("tokens"))
    pairs = least.select(F.explode("tokens").alias("token"), "least").filter("token != least")
    return cut(pairs.agg(F.map_from_entries(F.collect_list(F.struct("token", "least"))).alias("same")))  # frequent tokens only


def merged(rows: DataFrame, same: DataFrame) -> DataFrame:
    """`rows` with the tokens' classes for their tokens."""
    new = F.array_distinct(F.transform("tokens", lambda x: F.coalesce(F.try_element_at("same", x), x)))
    return rows.crossJoin(F.broadcast(same)).withColumn("tokens", new).drop("same")


def mined(labelled: DataFrame) -> DataFrame:
    """(antecedent, anchor, n, confidence): rules from (tokens, bad)."""
    labelled = cut(labelled)
    total, bad = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("bad").cast("long")), F.lit(0))).first()
    empty = labelled.sparkSession.createDataFrame([], "antecedent array<string>, anchor string, n long, confidence double")
    if not total or not bad:
        return empty
    least = max(SUPPORT, -(-total * SUPPORT_SHARE // 1))
    if least > total:
        return empty
    items = labelled.select(F.when(F.col("bad"), F.concat("tokens", F.array(F.lit(BAD)))).otherwise(F.col("tokens")).alias("items"))
    # combinations with the label may be as rare as CONFIDENCE allows
    freq = cut(FPGrowth(itemsCol="items", minSupport=least * CONFIDENCE / total).fit(items).freqItemsets.select(F.array_sort("items").alias("items"), "freq"))
    with_label = freq.filter(F.array_contains("items", BAD) & (F.size("items") > 1)).select(F.array_remove("items", BAD).alias("antecedent"), F.col("freq").alias("n_bad"))
    rules = with_label.join(freq.select(F.col("items").alias("antecedent"), F.col("freq").alias("n")), "antecedent").filter(F.col("n") >= least)
    rules = rules.withColumn("confidence", F.col("n_bad") / F.col("n")).filter((F.col("confidence") >= CONFIDENCE) & (F.col("confidence") * total >= LIFT * bad))
    single = freq.filter((F.size("items") == 1)).select(F.get("items", F.lit(0)).alias("token"), F.col("freq").alias("f"))
    rarest = rules.select("antecedent", F.explode("antecedent").alias("token")).join(single, "token").groupBy("antecedent").agg(F.min_by("token", F.struct("f", "token")).alias("anchor"))
    return cut(rules.join(rarest, "antecedent").select("antecedent", "anchor", "n", "confidence"))


def judged(pages: DataFrame, labels: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict and mined_confidence (null: no mined rule matches) of each row."""
    host, path = parts(F.col("url").cast("string"))
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), host.alias("host"), path.alias("path"))
    rows = rows.withColumn("tokens", tokens(F.col("url"), F.col("host"), F.col("path")))
    # one label for each page: any bad one makes it bad
    marks = labels.filter("quality is not null").groupBy(F.col("doc_id").cast("long").alias("page_id")).agg((F.min("quality") == 0).alias("bad"))
    labelled = cut(rows.filter(F.size("tokens") > 0).join(marks, "page_id").select("tokens", "bad"))
    same = classes(labelled)
    index = mined(merged(labelled, same))
    urls = merged(rows.groupBy("url", "tokens").agg(F.count(F.lit(1)).alias("n_rows")), same)
    few = index.count() <= FEW_RULES
    each = urls.select("url", "n_rows", "tokens", F.explode("tokens").alias("anchor"))
    hits = each.join(F.broadcast(index) if few else index, "anchor").filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    best = cut(hits.groupBy("url").agg(F.max("n_rows").alias("n"), F.max("confidence").alias("mined_confidence")))
    fixed = listed(F.col("host"), F.col("path"), rules)
    out = lookup(rows, best, "url", "page_id", rows.count()).withColumn("_r", fixed)
    method = F.when(F.col("mined_confidence").isNotNull(), "block").otherwise("allow")
    return out.select("page_id", "host", "path", F.col("_r.rule").alias("rule"), F.coalesce(F.col("_r.verdict"), method).alias("verdict"), "mined_confidence")


def oracle() -> str:
    """The same in SQL: combinations of one to three tokens are counted by joins of a url's tokens with themselves."""
    lower = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rules = sorted(RULES, key=lambda r: (-len(r[1]), -r[1].index("/")))
    fits = [(v, r, r[: r.index("/")], r[r.index("/") :]) for v, r in rules]
    case = lambda out: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{out(v, r)}'" for v, r, h, p in fits)
    return rf"""
WITH u AS (SELECT page_id, coalesce(url, '') AS url, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT page_id, url, {lower.format("regexp_extract(rest, '^[^/?#]*', 0)")} AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
t AS (SELECT *, CASE WHEN instr(url, '://') = 0 THEN [] ELSE list_distinct(list_concat(
    ['scheme:' || {lower.format("regexp_extract(url, '^(.*?)://', 1)")}],
    list_transform(list_reverse(list_filter(string_split(host, '.'), lambda x: x <> '')), lambda x: 'host:' || x),
    list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: 'path:' || regexp_replace(x, '[0-9]+', '#', 'g')),
    list_transform(list_filter(string_split(regexp_extract(url, '^[^?#]*[?]([^#]*)', 1), '&'), lambda x: x <> ''), lambda x: 'query:' || regexp_extract(x, '^[^=]*', 0)))) END AS tokens FROM p),
m AS (SELECT doc_id AS page_id, min(quality) = 0 AS bad FROM labels WHERE quality IS NOT NULL GROUP BY doc_id),
l AS (SELECT row_number() OVER () AS id, tokens, bad FROM t JOIN m USING (page_id) WHERE len(tokens) > 0),
n AS (SELECT count(*) AS total, sum(CAST(bad AS INT)) AS bad, greatest({SUPPORT}, ceil(count(*) * {SUPPORT_SHARE})) AS least FROM l),
x AS (SELECT id, bad, unnest(tokens) AS k FROM l),
c AS (
  SELECT [k] AS a, count(*) AS n, sum(CAST(bad AS INT)) AS nb FROM x GROUP BY ALL
  UNION ALL SELECT [a.k, b.k], count(*), sum(CAST(a.bad AS INT)) FROM x a JOIN x b ON a.id = b.id AND a.k < b.k GROUP BY ALL
  UNION ALL SELECT [a.k, b.k, d.k], count(*), sum(CAST(a.bad AS INT)) FROM x a JOIN x b ON a.id = b.id AND a.k < b.k JOIN x d ON a.id = d.id AND b.k < d.k GROUP BY ALL),
r AS (SELECT a, nb / c.n AS confidence FROM c, n WHERE c.n >= n.least AND n.bad > 0 AND nb / c.n >= {CONFIDENCE} AND nb / c.n * n.total >= {LIFT} * n.bad),
best AS (SELECT page_id, url, max(confidence) AS mined_confidence FROM t JOIN r ON list_has_all(t.tokens, r.a) GROUP BY ALL)
SELECT t.page_id, host, path, {case(lambda v, r: r)} END AS rule,
  coalesce({case(lambda v, r: v)} END, CASE WHEN best.mined_confidence IS NULL THEN 'allow' ELSE 'block' END) AS verdict, best.mined_confidence
FROM t LEFT JOIN best ON t.page_id = best.page_id AND t.url = best.url
"""
