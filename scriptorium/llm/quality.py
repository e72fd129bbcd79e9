"""Host-level quality rules, in DataFrame functions only.

Two rules reject a document by themselves: fewer than 50 words, or more than half its words in 3-word windows that its text has twice
or more.  Three more are too coarse for that and only speak of hosts: words of a mean length outside WORD_LENGTH, more than one symbol to SYMBOL_WORDS words, and
more than DUP_LINES of the lines equal to an earlier one.  Failures of any rule are counted by host (the column `source`).  Host
rates are shrunk with an empirical beta prior, whose mean and
weight come from the hosts' rates by the method of moments: a host of few documents keeps near the mean of all.  A host is
rejected if its shrunk rate is at least HOST_RATE; its verdict is joined back to its documents.

The rates are one row for each host; hosts above a share of the documents are broadcast, the others joined by shuffle.

Defined results: a null or empty text has no words and fails; a null host is a host of its own; ties and repeated rows are
counted as often as they occur; no rows give no rows; other columns aren't read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import SALTS, SPACE, cut, lookup, words

LEAST_WORDS = 50
#: A document fails if 100 * n_repeat_words > MOST_REPEATED * n_words.
MOST_REPEATED = 50
SYMBOLS = "[#*$%&|<>]"
#: Least and greatest mean length of words; one symbol to so many words; parts in a hundred of the lines.
WORD_LENGTH, SYMBOL_WORDS, DUP_LINES = (3, 10), 10, 30
#: Shrunk failure rate from which a host is rejected as a whole.
HOST_RATE = 0.8
#: Bits of a packed long that hold a window's place; the others hold the head of its hash.
PLACE_BITS = 31
#: So many rejected hosts are broadcast to the documents.
FEW_HOSTS = 10_000


def repeated_words(w: Column) -> Column:
    """How many of the words lie in 3-word windows that occur twice or more.

    Windows are hashed to 64 bits.  Longs of the hash's head and the window's place are sorted, a sort of primitive values;
    neighbours with equal heads are candidates, and those alone are compared by the full hash.
    """
    place = F.lit((1 << PLACE_BITS) - 1).cast("long")
    head = F.lit(-(1 << PLACE_BITS)).cast("long")
    last = F.size(w) - 3
    windows = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)))

    def of_windows(h: Column) -> Column:
        packed = F.sort_array(F.transform(h, lambda x, i: x.bitwiseAND(head).bitwiseOR(i.cast("long"))))
        return of_packed(h, packed)

    def of_packed(h: Column, packed: Column) -> Column:
        def near(i: Column, j: Column, p: Column) -> Column:
            return F.coalesce(F.get(p, i).bitwiseXOR(F.get(p, j)).bitwiseAND(head) == 0, F.lit(False))

        places = let(packed, lambda p: F.transform(F.filter(F.sequence(F.lit(0), F.size(p) - 1), lambda i: near(i, i - 1, p) | near(i, i + 1, p)), lambda i: F.get(p, i).bitwiseAND(place).cast("int")))
        found = F.sort_array(F.transform(places, lambda i: F.struct(F.get(h, i).alias("h"), i.alias("i"))))
        return let(found, covered)

    def covered(c: Column) -> Column:
        def same(i: Column, j: Column) -> Column:
            return F.coalesce(F.get(c, i)["h"] == F.get(c, j)["h"], F.lit(False))

        twice = F.transform(F.filter(F.sequence(F.lit(0), F.size(c) - 1), lambda i: same(i, i - 1) | same(i, i + 1)), lambda i: F.get(c, i)["i"])
        return F.size(F.array_distinct(F.flatten(F.transform(twice, lambda i: F.array(i, i + 1, i + 2)))))

    counted = let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(of_windows(h)))
    return F.when(last < 1, F.lit(0)).otherwise(counted).cast("long")


def fails(text: Column) -> Column:
    """Whether a rule rejects the text."""
    return let(words(text), lambda w: (F.size(w) < LEAST_WORDS) | (100 * repeated_words(w) > MOST_REPEATED * F.size(w)))


def let(value: Column, body) -> Column:
    """body(value), with the value computed once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, host, n_words, word_chars, n_symbols, n_repeat_words, n_dup_lines, base_failed, any_failed) of each row."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string").alias("host"), text.alias("t")).withColumn("w", words(F.col("t")))
    lines = F.filter(F.split("t", "\n"), lambda x: F.trim(x, F.lit(" \t\x0b\x0c\r")) != "")
    sizes = let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n"), F.size(F.array_distinct(x)).cast("long").alias("distinct")))
    out = rows.select(
        "doc_id",
        "host",
        F.size("w").cast("long").alias("n_words"),
        F.length(F.array_join("w", "")).cast("long").alias("word_chars"),
        F.regexp_count("t", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        sizes.alias("lines"),
        repeated_words(F.col("w")).alias("n_repeat_words"),
    )
    out = out.withColumn("n_dup_lines", F.col("lines.n") - F.col("lines.distinct"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    odd = ~F.col("word_chars").between(WORD_LENGTH[0] * F.col("n_words"), WORD_LENGTH[1] * F.col("n_words")) | (SYMBOL_WORDS * F.col("n_symbols") > F.col("n_words")) | (100 * F.col("n_dup_lines") > DUP_LINES * F.col("lines.n"))
    return out.withColumn("base_failed", failed).withColumn("any_failed", failed | odd).drop("lines")


def host_rates(rows: DataFrame) -> DataFrame:
    """(host, n, failed, rate) of each host; rate: shrunk with the beta prior of all hosts.

    With mean m and variance v of the hosts' rates, each weighted by its documents, the prior is beta(m k, (1 - m) k),
    k = m (1 - m) / v - 1.  With one host, or hosts all alike, v is 0 and there is nothing to shrink between: all get m.
    """
    by_host = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("any_failed").cast("long")).alias("failed"))
    raw = F.col("failed") / F.col("n")
    # one row: sums over the hosts, whose rates are exact ratios of counts
    prior = by_host.agg(F.sum("n").alias("N"), F.sum("failed").alias("A"), F.sum(F.col("failed") * raw).alias("Q"))
    mean, total = F.col("A") / F.col("N"), F.col("N")
    var = F.greatest(F.col("Q") / total - mean * mean, F.lit(0.0))
    prior = prior.select(mean.alias("m"), F.when(var > 1e-12, F.greatest(mean * (1 - mean) / var - 1, F.lit(0.0))).alias("k"))
    shrunk = F.when(F.col("k").isNull(), F.col("m")).otherwise((F.col("failed") + F.col("m") * F.col("k")) / (F.col("n") + F.col("k")))
    return by_host.join(F.broadcast(prior), F.lit(True)).select("host", "n", "failed", shrunk.alias("rate"))  # the prior is one row


def judged(docs: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """measured(docs) with host_rate and kept: false if a rule fails, or the host is rejected."""
    rows = cut(measured(docs))
    rates = cut(host_rates(rows).select(F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("_host"), "n", F.col("rate").alias("host_rate")))
    keyed = rows.withColumn("_host", F.coalesce(F.concat(F.lit("="), "host"), F.lit("")))
    out = lookup(keyed, rates, "_host", "doc_id", rows.count()).drop("_host")
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("host_rate") < host_rate))


def keep_good(docs: DataFrame, host_rate: float = HOST_RATE) -> DataFrame:
    """The rows that pass the rules and whose host does; their rules are measured where they are, only hosts' rates are joined."""
    rates = host_rates(cut(measured(docs).select("host", "any_failed")))
    bad = cut(rates.filter(F.col("rate") >= host_rate).select(F.coalesce(F.concat(F.lit("="), "host"), F.lit("")).alias("_host")))
    host = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))
    good = docs.filter(~fails(F.col("text").cast("string"))).select(F.struct("*").alias("row"), host.alias("_host"))
    if bad.count() <= FEW_HOSTS:
        kept = good.join(F.broadcast(bad), "_host", "left_anti")
    else:
        # too many to broadcast: each rejected host under all salts, a document under one, so that no host's documents meet in a task
        salted = bad.select("_host", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"))
        kept = good.withColumn("_salt", F.pmod(F.xxhash64("row.text"), F.lit(SALTS)).cast("int")).join(salted, ["_host", "_salt"], "left_anti")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


ORACLE = rf"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, source, t, list_filter(regexp_split_to_array(t, '[{SPACE}]+'), lambda x: x <> '') AS w FROM d),
win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS k FROM win) WHERE k > 1),
cov AS (SELECT doc_id, count(DISTINCT j) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS j FROM rep) GROUP BY doc_id),
lines AS (SELECT doc_id, list_filter(string_split(t, chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) <> '') AS l FROM d),
m AS (
  SELECT w.doc_id, w.source, CAST(len(w.w) AS BIGINT) AS n_words,
    CAST(length(array_to_string(w.w, '')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '{SYMBOLS}', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(len(l.l) - len(list_distinct(l.l)) AS BIGINT) AS n_dup_lines, len(l.l) AS n_lines,
    CAST(coalesce(cov.n, 0) AS BIGINT) AS n_repeat_words
  FROM w JOIN lines l USING (doc_id) LEFT JOIN cov USING (doc_id)),
f AS (SELECT *, n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed FROM m),
o AS (SELECT *, base_failed OR word_chars < {WORD_LENGTH[0]} * n_words OR word_chars > {WORD_LENGTH[1]} * n_words OR {SYMBOL_WORDS} * n_symbols > n_words OR 100 * n_dup_lines > {DUP_LINES} * n_lines AS any_failed FROM f),
h AS (SELECT source, count(*) AS n, sum(CAST(any_failed AS INT)) AS failed FROM o GROUP BY source),
p AS (SELECT sum(failed) / sum(n) AS mean, greatest(sum(failed * (failed / n)) / sum(n) - (sum(failed) / sum(n)) * (sum(failed) / sum(n)), 0) AS var FROM h),
r AS (SELECT source, CASE WHEN var > 1e-12 THEN (failed + mean * greatest(mean * (1 - mean) / var - 1, 0)) / (n + greatest(mean * (1 - mean) / var - 1, 0)) ELSE mean END AS rate FROM h, p)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND rate < {HOST_RATE} AS kept
FROM f JOIN r ON f.source IS NOT DISTINCT FROM r.source
"""
