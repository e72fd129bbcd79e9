"""Importance resampling towards a target text, by hashed n-grams.

Words get numbers in a dictionary of the distinct words of both tables.  An n-gram is the tuple of its words' numbers; the bytes of
each distinct tuple are put together from the dictionary and hashed once, and what is known of the bucket is joined back to the
tuples.  A one-word n-gram's tuple is its word's number, so its bytes are the dictionary's word.  A bucket's gain is the logarithm of
its share in the target against its share in the documents; a document's weight is the floored mean gain of its n-grams.
Documents are drawn without replacement by the greatest sums of weight and Gumbel noise, which a digest of the doc_id gives.

Texts become blocks (see blocks.py), so distinct words and tuples of blocks are shuffled, not tokens: a word in all documents is a row a
block.  Gains are one row a bucket.  Ranks come from rows sorted in ranges, which the row's own number splits where scores and
doc_ids are equal, and the sizes of the ranges; the latter alone reach the driver.

Defined results: null, empty and blank texts have no words, weight 0 and are never drawn; a null doc_id is hashed as an empty one
and comes last among equal scores; repeated rows are ranked each; a target without words makes gains of the documents alone; no rows
give no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from scriptorium.llm import blocks
from scriptorium.llm.common import lower_ascii, written

BUCKETS, SCALE, SEED = 10_000, 1000, "2024"
#: A document can be drawn from so many words; so many of a hundred such documents are drawn.
LEAST_WORDS, DRAWN = 20, 10
WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def grams(ids: np.ndarray, sizes: np.ndarray, lead: int, low: int, high: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each length: (length, rows of the n-grams, their codes 0.., a place where each code ends), n-grams that end after the lead."""
    n = len(ids)
    row = np.repeat(np.arange(len(sizes)), sizes)
    begin = np.cumsum(sizes) - sizes + lead
    begin[:1] = 0
    of = np.concatenate([np.zeros(lead, np.int64), row])
    code, place = ids.astype(np.int64), np.arange(n)
    for k in range(1, high + 1):
        if k > 1:
            ok = place[place - k + 1 >= begin[of[place]]]
            joint = np.zeros(n, np.int64)
            joint[ok] = code[ok - 1] * n + ids[ok]
            code = np.zeros(n, np.int64)
            code[ok] = np.unique(joint[ok], return_inverse=True)[1]
            place = ok
        if k >= low:
            mine = place[place >= lead]
            _, first, codes = np.unique(code[mine], return_index=True, return_inverse=True)
            yield k, of[mine], codes, mine[first]


def dictionary_of(words: DataFrame) -> DataFrame:
    """(word, id, n_docs, n_target) of each distinct word, written."""
    return written(words.groupBy("word").agg(*sums()).withColumn("id", F.monotonically_increasing_id()), "dictionary")


def sums() -> list[Column]:
    return [F.sum(F.when(F.col("class") == c, F.col("n")).otherwise(F.lit(0))).alias(name) for c, name in enumerate(("n_docs", "n_target"))]


def bucket_of(text: str, buckets: int) -> Column:
    return F.pmod(F.crc32(F.col(text).cast("binary")), F.lit(buckets)).cast("int")


def features(tokens: DataFrame, low: int, high: int, buckets: int) -> tuple[DataFrame, DataFrame]:
    """(block, at, key, n, class) of each block's distinct n-grams, and (key, n_docs, n_target, bucket) of all distinct ones."""
    words = tokens.select("block", "class", F.explode(F.transform("words", lambda w, i: F.struct(i.alias("at"), w.alias("word"), F.get("counts", i).cast("long").alias("n")))).alias("w")).select("block", "class", "w.at", "w.word", "w.n")
    dictionary = dictionary_of(words)
    if high == 1:
        return words.filter("n > 0").withColumnRenamed("word", "key"), written(dictionary.select(F.col("word").alias("key"), "id", "n_docs", "n_target", bucket_of("word", buckets).alias("bucket")), "hashed")

    def tuples(left: pa.Table, right: pa.Table) -> pa.Table:
        out = {"block": [], "class": [], "at": [], "key": [], "n": []}
        for t in left.to_pylist():
            number = np.zeros(t["n_words"], np.int64)
            number[right["at"].to_numpy()] = right["id"].to_numpy()
            sizes, at = np.array(t["sizes"], np.int64), 0
            ids = blocks.unpacked(t["ids"], int(sizes.sum()) + t["lead"], 4, np.uint32)
            for k, _, codes, ends in grams(ids, sizes, t["lead"], low, high):
                out["key"] += number[ids[ends[:, None] + np.arange(1 - k, 1)]].tolist()
                out["n"] += np.bincount(codes, minlength=len(ends)).tolist()
                out["at"] += range(at, at + len(ends))
                at += len(ends)
            out["block"] += [t["block"]] * at
            out["class"] += [t["class"]] * at
        return pa.table(out, pa.schema({"block": pa.int64(), "class": pa.int32(), "at": pa.int32(), "key": pa.list_(pa.int64()), "n": pa.int64()}))

    ids = words.join(dictionary.select("word", "id"), "word").select(F.col("block").alias("of"), "at", "id")
    bare = tokens.drop("words", "counts", "rows", "doc_ids")
    found = written(bare.groupBy("block").cogroup(ids.groupBy("of")).applyInArrow(tuples, "block long, class int, at int, key array<long>, n long"), "tuples")
    distinct = written(found.groupBy("key").agg(*sums()).withColumn("no", F.monotonically_increasing_id()), "distinct")
    spelt = distinct.select("no", F.posexplode("key").alias("pos", "id")).join(dictionary.select("id", "word"), "id").groupBy("no").agg(F.array_sort(F.collect_list(F.struct("pos", "word"))).alias("w"))  # a tuple's words
    text = spelt.select("no", F.array_join(F.col("w.word"), " ").alias("text"))
    return found, written(distinct.join(text, "no").select("key", F.col("no").alias("id"), "n_docs", "n_target", bucket_of("text", buckets).alias("bucket")), "hashed")


def gains(hashed: DataFrame, buckets: int) -> DataFrame:
    """(bucket, gain): one row for each bucket that n-grams fall into."""
    by = hashed.groupBy("bucket").agg(F.sum("n_docs").alias("s"), F.sum("n_target").alias("t"))
    total = by.agg(F.sum("s").alias("all_s"), F.sum("t").alias("all_t"))
    ratio = ((F.col("t") + 1) * (F.col("all_s") + buckets)).cast("double") / ((F.col("s") + 1) * (F.col("all_t") + buckets)).cast("double")
    return by.join(F.broadcast(total), F.lit(True)).select("bucket", F.floor(SCALE * F.log(ratio)).cast("int").alias("gain"))  # the totals are one row


def weighted(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(row, doc_id, n_words, n_features, weight) of each row of docs; `row` numbers the rows."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    both = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.lit(0).alias("class")).unionByName(target.select(F.lit(None).cast("long").alias("doc_id"), text.alias("text"), F.lit(1).alias("class")))
    tokens = written(blocks.token_blocks(both, blocks.alphanumeric(), lead=high - 1), "tokens")
    found, hashed = features(tokens, low, high, buckets)
    rated = hashed.join(F.broadcast(gains(hashed, buckets)), "bucket").select("key", "gain")  # one row for each of `buckets`
    back = found.filter("class = 0").join(rated, "key").select(F.col("block").alias("of"), "at", "gain")

    def summed(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        for t in left.to_pylist():
            gain = np.zeros(len(right), np.int64)
            gain[right["at"].to_numpy()] = right["gain"].to_numpy()
            sizes = np.array(t["sizes"], np.int64)
            ids = blocks.unpacked(t["ids"], int(sizes.sum()) + t["lead"], 4, np.uint32)
            n, total = sizes, None
            if high == 1:
                dense = np.zeros(t["n_words"], np.int64)
                dense[right["at"].to_numpy()] = right["gain"].to_numpy()
                total = blocks.by_row(dense[ids[t["lead"] :]], sizes)
            else:
                n, total, at = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64), 0
                for _, of, codes, ends in grams(ids, sizes, t["lead"], low, high):
                    counted = np.bincount(of, minlength=len(sizes))
                    n, total, at = n + counted, total + blocks.by_row(gain[at + codes], counted), at + len(ends)
            out.append(pa.table({"row": pa.array(t["rows"], pa.int64()), "doc_id": pa.array(t["doc_ids"], pa.int64()), "n_words": sizes, "n_features": n, "total": total}))
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], pa.int64()) for c in ("row", "doc_id", "n_words", "n_features", "total")})

    own = tokens.filter("class = 0").select("block", "rows", "doc_ids", "sizes", "lead", "n_words", "ids")
    parts = own.groupBy("block").cogroup(back.groupBy("of")).applyInArrow(summed, "row long, doc_id long, n_words long, n_features long, total long")
    rows = parts.groupBy("row", "doc_id").agg(F.sum("n_words").alias("n_words"), F.sum("n_features").alias("n_features"), F.sum("total").alias("total"))
    return rows.withColumn("weight", F.when(F.col("n_features") > 0, F.expr("(total - pmod(total, n_features)) div n_features")).otherwise(F.lit(0).cast("long"))).drop("total")


def noise(doc_id: Column, seed: str = SEED) -> Column:
    """floor(-1000 ln(-ln u)) for the u that a digest of the doc_id gives."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def drawn(rows: DataFrame, least: int = LEAST_WORDS, share: int = DRAWN) -> DataFrame:
    """rows with score and rank: 1, 2, 3... by score for floor(share * N / 100) of the N rows of `least` words, null for others."""
    scored = written(rows.withColumn("score", F.col("weight") + noise(F.col("doc_id"))), "scored")
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")]
    able = scored.filter(F.col("n_words") >= least).repartitionByRange(*order).sortWithinPartitions(*order)
    able = written(able.withColumn("_part", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "able")
    sizes = {r["_part"]: r.n for r in able.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}  # one row a partition
    n, before, shift = sum(sizes.values()), 0, []
    for part in sorted(sizes):
        shift.append((part, before))
        before += sizes[part]
    spark = rows.sparkSession
    offsets = F.broadcast(spark.createDataFrame(shift, "_part int, _before long"))
    rank = F.col("_before") + F.col("_at") + 1
    ranked = able.join(offsets, "_part").withColumn("rank", F.when(rank <= share * n // 100, rank)).drop("_part", "_at", "_before")
    return ranked.unionByName(scored.filter(F.col("n_words") < least).withColumn("rank", F.lit(None).cast("long")))


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score and rank of each row."""
    return drawn(weighted(docs, target)).select("doc_id", "n_features", "weight", "score", "rank")


def crc(text: str) -> str:
    """SQL for the CRC-32 of a text's bytes, by the table `crc` of one row with the list `v`."""
    byte = f"CAST('0x' || substr(hex(encode({text})), 2 * i + 1, 2) AS UBIGINT)"
    return f"xor(list_reduce(list_transform(range(0, strlen({text})), lambda i: {byte}), lambda c, b: xor(c >> 8, v[CAST(xor(c & 255, b) AS INT) + 1]), CAST(4294967295 AS UBIGINT)), 4294967295)"


ORACLE = rf"""
WITH RECURSIVE bits AS (
  SELECT CAST(i AS UBIGINT) AS i, CAST(i AS UBIGINT) AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS v FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') AS w FROM documents),
q AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}')) AS w FROM benchmark),
dw AS (SELECT r, unnest(w) AS w FROM d),
n AS (SELECT w, sum(s) AS s, sum(t) AS t FROM (SELECT w, count(*) AS s, 0 AS t FROM dw GROUP BY w UNION ALL SELECT w, 0, count(*) FROM q GROUP BY w) GROUP BY w),
h AS (SELECT w, s, t, CAST({crc("w")} % {BUCKETS} AS INT) AS bucket FROM n, crc),
b AS (SELECT bucket, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(t) AS DOUBLE) AS t FROM h GROUP BY bucket),
g AS (SELECT bucket, CAST(floor({SCALE} * ln((t + 1) * ((SELECT sum(s) FROM b) + {BUCKETS}) / ((s + 1) * ((SELECT sum(t) FROM b) + {BUCKETS})))) AS BIGINT) AS gain FROM b),
e AS (SELECT r, count(*) AS n, sum(gain) AS total FROM dw JOIN h USING (w) JOIN g USING (bucket) GROUP BY r),
s AS (
  SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_features, CAST(coalesce(floor(total / n), 0) AS BIGINT) AS weight, len(d.w) AS words,
    CAST(floor(-{SCALE} * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS noise
  FROM d LEFT JOIN e USING (r)),
k AS (SELECT *, row_number() OVER (PARTITION BY words >= {LEAST_WORDS} ORDER BY weight + noise DESC, doc_id NULLS LAST) AS place, count(*) FILTER (words >= {LEAST_WORDS}) OVER () AS n_able FROM s)
SELECT doc_id, n_features, weight, weight + noise AS score, CASE WHEN words >= {LEAST_WORDS} AND place <= {DRAWN} * n_able // 100 THEN CAST(place AS BIGINT) END AS rank
FROM k
"""
