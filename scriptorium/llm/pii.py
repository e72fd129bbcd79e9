"""Personal data, and the terms around it that give it away, in DataFrame functions only.

Base spans come from four patterns.  Positions, which Spark's functions don't return, are sums of the lengths of matches and of
the gaps that split() leaves between them.  The patterns are the contract's, written so that long runs of one kind of character
take linear time and no recursion.

The method measures disclosure.  A protected entity e is the value of a base span; a context of it is the REACH words on either side
of one.  All counts are of distinct texts, so copies of a text count once: n, of those that hold e, those with a term t in a
context of e, and those that hold t anywhere.  PMI(e; t) = log2(p(t | e) / p(t)), where p(t | e) is the part of e's texts with t in a
context and p(t) the part of all texts that hold t.  IC(e) = -log2 p(e) is what there is to disclose.  A term discloses e if
SUPPORT texts at least have it in a context of e and PMI / IC is at least GENERALISE; from REMOVE on it is removed, below it is
generalised to the shape of the term.  Terms are words of letters only, and of LEAST_LETTERS at least.  A text that holds e has
every occurrence of e's disclosing terms as a span of kind `term`.

Only texts with disclosing terms are shuffled, by their digest, frequent ones under salts; all others stay where they are.

Defined results: a null or empty text has no spans; of overlapping spans the earlier kind in the list, then the earlier start is
the one that a text's replacement uses; repeated rows get equal results; rows of one doc_id with other texts are kept apart by a
digest of the text; no rows give no rows; other columns, whatever their names, are left alone.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import lookup, shared_folder

KINDS = ("email", "ip", "card", "phone")
#: With `\\G` a match may start where the last one ended, else only where no earlier start of the same run was tried.
#: Emails: a dot must follow a letter, digit or hyphen; cards: a blank or hyphen must follow a digit.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+[.](?=[A-Za-z0-9-])(?:[A-Za-z0-9.-](?<=[A-Za-z0-9-]|[A-Za-z0-9-][.]))+(?<=[A-Za-z0-9-])",
    "ip": r"(?:\G|(?<![0-9]))[0-9]+[.][0-9]+[.][0-9]+[.][0-9]+",
    "card": r"[0-9](?:[0-9 -](?<=[0-9]|[0-9][ -]))+(?<=[0-9])",
    "phone": r"\+[0-9][ ().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
TERM = r"\p{L}+"
REACH = 8
#: Characters beside a span that are looked at for REACH words, one window after the other until one holds them; then all.
WINDOWS = (320, 4096)
SUPPORT = 3
GENERALISE, REMOVE = 0.85, 0.97
LEAST_LETTERS = 4
#: So many candidate terms are broadcast to the words of all documents; more are joined with the words' counts by shuffle.
FEW_TERMS = 20_000
#: The digests of so many texts with disclosing terms are broadcast; with more, all texts are joined under salts.
FEW_TEXTS = 1_000_000


def digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(number: Column) -> Column:
    """Whether a string of digits passes the Luhn test."""
    values = F.transform(F.split(F.reverse(number), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(values, F.lit(0), lambda a, v: a + F.coalesce(v, F.lit(0))) % 10 == 0


def fits(kind: str, match: Column) -> Column:
    if kind == "ip":
        return F.forall(F.split(match, "[.]"), lambda p: (F.length(F.ltrim(p, F.lit("0"))) <= 3) & (F.coalesce(F.nullif(F.ltrim(p, F.lit("0")), F.lit("")), F.lit("0")).substr(1, 3).cast("int") <= 255))
    if kind == "card":
        return F.length(digits(match)).between(13, 19) & luhn(digits(match))
    if kind == "phone":
        return F.length(digits(match)).between(9, 15)
    return F.lit(True)


SPAN = "struct<kind:string,start:int,end:int,value:string>"


def matches(text: Column, pattern: str, kind: str, keep) -> Column:
    """array<SPAN>: the matches of a pattern for which keep(match) holds, leftmost first, with their places."""
    gaps = F.transform(F.split(text, pattern, -1), lambda g: F.length(g))
    step = F.zip_with(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), gaps, lambda m, g: F.struct(m.alias("m"), g.alias("g"), F.coalesce(F.length(m), F.lit(0)).alias("n")))

    def add(a: Column, s: Column) -> Column:
        start = a["at"] + s["g"]
        span = F.struct(F.lit(kind).alias("kind"), start.alias("start"), (start + s["n"]).alias("end"), s["m"].alias("value"))
        kept = s["m"].isNotNull() & F.coalesce(keep(s["m"]), F.lit(False))
        return F.struct((start + s["n"]).alias("at"), F.when(kept, F.concat(a["out"], F.array(span))).otherwise(a["out"]).alias("out"))

    return F.aggregate(step, F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out")), add)["out"]


def base_spans(text: Column) -> Column:
    """array<SPAN> of the four kinds, by kind, then start."""
    none = F.expr(f"cast(array() as array<{SPAN}>)")
    parts = []
    for kind in KINDS:
        there = F.regexp_like(text, F.lit(PATTERNS[kind])) if NEEDS[kind] is None else text.contains(NEEDS[kind]) & F.regexp_like(text, F.lit(PATTERNS[kind]))
        parts.append(F.when(there, matches(text, PATTERNS[kind], kind, lambda m, k=kind: fits(k, m))).otherwise(none))
    return F.concat(*parts)


def terms(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TERM), F.lit(0))


def around(text: str, span: Column) -> Column:
    """The distinct lower-cased terms of the REACH words on either side of a span, sorted."""
    whole = F.col(text)
    before = F.coalesce(*[words_beside(span["start"] <= n, F.substring(whole, F.greatest(span["start"] - n + 1, F.lit(1)), F.least(span["start"], F.lit(n))), True) for n in WINDOWS], words_beside(F.lit(True), F.substring(whole, F.lit(1), span["start"]), True))
    after = F.coalesce(*[words_beside(F.length(whole) - span["end"] <= n, F.substring(whole, span["end"] + 1, F.lit(n)), False) for n in WINDOWS], words_beside(F.lit(True), F.substring(whole, span["end"] + 1, F.length(whole)), False))
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.concat(before, after), lambda x: F.lower(x)), lambda x: F.length(x) >= LEAST_LETTERS)))


def words_beside(reaches: Column, window: Column, before: bool) -> Column:
    """The last, or first, REACH words of a window beside a span; null if the window holds fewer and doesn't reach the text's end.

    A word at the window's far edge may go on beyond it, so it doesn't count there."""

    def chosen(found: Column) -> Column:
        n = F.size(found)
        edge = (~reaches & F.regexp_like(window, F.lit(rf"^{TERM}" if before else rf"{TERM}$"))).cast("int")
        near = F.slice(F.reverse(found) if before else found, 1, F.least(n - edge, F.lit(REACH)))
        return F.when(reaches | (n - edge >= REACH), near)

    return F.get(F.transform(F.array(terms(window)), chosen), F.lit(0))


def entities(spans: str) -> Column:
    """The distinct entities of base spans."""
    return F.array_distinct(F.transform(spans, entity))


def entity(span: Column) -> Column:
    return F.concat_ws(":", span["kind"], F.lower(span["value"]))


def disclosing(found: DataFrame, docs: DataFrame) -> DataFrame:
    """(entity, term, strength): terms that disclose an entity; found: (key, t, spans) of all documents with a base span, key: the text's digest.

    Candidates are written to the shared folder, so that their number is known before the documents' words are joined with them.
    """
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/pii-{uuid.uuid4().hex}"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    held = found.select("key", F.explode(entities("spans")).alias("entity")).distinct().groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity")).filter(F.col("n_entity") >= SUPPORT)
    near = found.select("key", "t", F.explode("spans").alias("s")).select("key", entity(F.col("s")).alias("entity"), F.explode(around("t", F.col("s"))).alias("term")).distinct()
    pairs = near.groupBy("entity", "term").agg(F.count(F.lit(1)).alias("n_both")).filter(F.col("n_both") >= SUPPORT)
    # a term is in at least as many texts as have it near an entity: what can't disclose even so is no candidate
    least = near.select("key", "term").distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_near")).filter(F.col("n_near") >= SUPPORT)
    n = docs.select(F.xxhash64(text).alias("key")).distinct().count()
    pairs.join(held, "entity").join(least, "term").filter(strength(F.col("n_near"), n) >= GENERALISE).select("entity", "term", "n_both", "n_entity").write.parquet(f"{folder}/pairs")
    pairs = spark.read.parquet(f"{folder}/pairs")
    pairs.select("term").distinct().write.parquet(f"{folder}/terms")
    wanted = spark.read.parquet(f"{folder}/terms")
    if wanted.isEmpty():
        return spark.createDataFrame([], "entity string, term string, strength double")
    seen = docs.select(F.xxhash64(text).alias("key"), F.explode(F.array_distinct(F.transform(terms(text), lambda x: F.lower(x)))).alias("term"))
    if wanted.count() <= FEW_TERMS:
        seen = seen.join(F.broadcast(wanted), "term", "left_semi")
    df = seen.distinct().groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))
    return pairs.join(df, "term").select("entity", "term", strength(F.col("n_term"), n).alias("strength")).filter(F.col("strength") >= GENERALISE)


def strength(n_term: Column, n: int) -> Column:
    """PMI / IC of a pair (n_both, n_entity) whose term is in n_term of n texts, at most 1; null if there is nothing to disclose."""
    pmi = F.log2((F.col("n_both") / F.col("n_entity")) / (n_term / F.lit(n)))
    ic = -F.log2(F.col("n_entity") / F.lit(n))
    return F.when(ic > 0, F.least(pmi / ic, F.lit(1.0)))


def found_spans(docs: DataFrame) -> DataFrame:
    """(row, spans): rows as structs, with base spans and terms as array<struct<kind, start, end, value, strength>>, by kind as listed, then start."""
    spark, folder = docs.sparkSession, f"{shared_folder(docs.sparkSession)}/pii-{uuid.uuid4().hex}"
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # one pass finds the base spans; only rows with some are written, with their texts
    docs.select(text.alias("t"), base_spans(text).alias("spans")).filter(F.size("spans") > 0).withColumn("key", F.xxhash64("t")).write.parquet(f"{folder}/found")
    found = spark.read.parquet(f"{folder}/found")
    disclosing(found, docs).write.parquet(f"{folder}/told")
    told = spark.read.parquet(f"{folder}/told")
    rows = docs.select(F.struct("*").alias("row"), text.alias("t"), F.xxhash64(text).alias("key"))
    base = F.transform(base_spans(F.col("t")), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(1.0).alias("strength")))
    if told.isEmpty():
        return rows.select("row", base.alias("spans"))
    by_text = found.select("key", F.explode(entities("spans")).alias("entity")).groupBy("key", "entity").agg(F.count(F.lit(1)).alias("n")).join(told, "entity")
    by_text = by_text.groupBy("key", "term").agg(F.max("strength").alias("strength"), F.max("n").alias("n"))
    by_text.groupBy("key").agg(F.map_from_entries(F.collect_list(F.struct("term", "strength"))).alias("told"), F.max("n").alias("n")).write.parquet(f"{folder}/by_text")
    by_text = spark.read.parquet(f"{folder}/by_text")
    own = matches(F.col("t"), TERM, "term", lambda m: F.map_contains_key(F.col("told"), F.lower(m)))
    clear = F.filter(own, lambda s: ~F.exists("base", lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    more = F.transform(clear, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.element_at(F.col("told"), F.lower(s["value"])).alias("strength")))
    keys, total = by_text.select("key"), found.count()
    if by_text.count() > FEW_TEXTS:
        return lookup(rows, by_text, "key", "row.doc_id", total).withColumn("base", base).select("row", F.when(F.col("told").isNull(), F.col("base")).otherwise(F.concat("base", more)).alias("spans"))
    plain = rows.join(F.broadcast(keys), "key", "left_anti").select("row", base.alias("spans"))  # FEW_TEXTS longs at most
    telling = lookup(rows.join(F.broadcast(keys), "key", "left_semi"), by_text, "key", "row.doc_id", total)
    return plain.unionByName(telling.withColumn("base", base).select("row", F.concat("base", more).alias("spans")))


def sanitised(text: Column, spans: Column) -> Column:
    """The text with base spans replaced by their kind, terms by their shape or by nothing; the first of overlapping spans counts."""
    mark = F.struct(
        F.lit(0).alias("at"), F.lit("").alias("out")
    )
    new = lambda s: F.when(s["kind"] != "term", F.concat(F.lit("["), F.upper(s["kind"]), F.lit("]"))).when(s["strength"] >= REMOVE, F.lit("")).otherwise(F.when(F.regexp_like(s["value"], F.lit(r"^\p{Lu}")), F.lit("[NAME]")).otherwise(F.lit("[TERM]")))
    order = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), new(s).alias("new"))))
    done = F.aggregate(
        order,
        mark,
        lambda a, s: F.when(s["start"] < a["at"], a).otherwise(F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), s["new"]).alias("out"))),
        lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))),
    )
    return F.when(F.size(spans) > 0, done).otherwise(text)


def sanitise(docs: DataFrame) -> DataFrame:
    """`docs` with personal data and disclosing terms replaced in the text."""
    text = F.col("row.text").cast("string")
    return found_spans(docs).select(*[(sanitised(text, F.col("spans")) if c == "text" else F.col("row").getField(c)).alias(c) for c in docs.columns])


def of_kind(spans: Column, kind: str) -> Column:
    return F.filter(spans, lambda s: s["kind"] == kind)


def listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, the four counts, the digest of the base spans and all spans of each row."""
    base = F.filter("spans", lambda s: s["kind"] != "term")
    counts = [F.size(of_kind(F.col("spans"), k)).cast("long").alias(f"n_{k}") for k in KINDS]
    return found_spans(docs).select(F.col("row.doc_id").cast("long").alias("doc_id"), *counts, F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))
