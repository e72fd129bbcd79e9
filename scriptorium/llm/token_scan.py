"""Token counts by a separator scan of flat, unindexed token files.

A token file is a run of little-endian unsigned integers of WIDTH bytes, with an end-of-document identifier after each document
and nothing else.  Files are read as they are and cut into blocks of BLOCK tokens.  Each block is searched for separators at once,
as an array; on its own it knows the lengths of documents that lie inside it, and how many tokens precede its first separator and
follow its last.  A prefix scan over the blocks' summaries (one row for each block) stitches the documents that run across blocks,
and numbers them.

`write_tokens` makes such files from texts with Spark's text writer: a row is the document's bytes, the line separator is the
identifier.  A task begins a file when the one before would pass FILE_BYTES, by a running sum of bytes, since a reader holds one file.
Tokens there are words hashed to 16 bits, 0 being the separator: a stand-in for a tokenizer that costs little; the scan doesn't
depend on it.  A document begins with KEY tokens that spell its doc_id, so that the scan can say whose length it found; blocks
overlap by as many tokens, for documents that begin at a block's end.

Defined results: a document without tokens (null, empty or blank text) has length 0; tokens after the last separator of a file are a
document that has no end (`ended` false); an empty file has no documents; a file that ends inside a token is an error; repeated rows
are documents of their own; a null doc_id comes back as null; no rows give no rows; other columns aren't read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from scriptorium.llm.common import shared_folder

WIDTH = 2
BLOCK = 1 << 19
EOD = 0
#: Bytes in a file, unless a single document has more.
FILE_BYTES = 1 << 30
#: Tokens that spell a doc_id: digits to the base 65,535, each as its value plus 1.
KEY, BASE = 5, 65_535


def word_tokens(text: str | None) -> bytes:
    """Words hashed to 1 .. 65535, as little-endian bytes."""
    crc = zlib.crc32
    return np.array([crc(w) % BASE + 1 for w in (text or "").encode("utf-8", "surrogatepass").split()], "<u2").tobytes()


def key_tokens(doc_id: int | None) -> bytes:
    value = 0 if doc_id is None else doc_id + (1 << 63) + 1
    return np.array([value // BASE**k % BASE + 1 for k in range(KEY)], "<u2").tobytes()


def doc_id_of(tokens: np.ndarray) -> int | None:
    """The doc_id that the first KEY tokens of a document spell."""
    value = sum((int(t) - 1) * BASE**k for k, t in enumerate(tokens[:KEY]))
    return value - (1 << 63) - 1 if value else None


def write_tokens(docs: DataFrame, path: str) -> None:
    """Token files of the documents under `path`, in a folder for each place in a task's sequence of files."""
    most = FILE_BYTES

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        file, size = 0, 0
        for b in batches:
            tokens, files = [], []
            for i, t in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                tokens.append(key_tokens(i) + word_tokens(t.as_py()))
                own = len(tokens[-1]) + WIDTH
                if size and size + own > most:
                    file, size = file + 1, 0
                size += own
                files.append(file)
            yield pa.RecordBatch.from_arrays([pa.array(files, pa.int32()), pa.array(tokens, pa.binary())], ["file", "tokens"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, "file int, tokens binary")
    rows.select("file", F.col("tokens").cast("string").alias("value")).write.partitionBy("file").option("lineSep", "\0" * WIDTH).option("compression", "none").text(path)


def blocks(spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK) -> DataFrame:
    """(file, block, tokens, after): the files' bytes in blocks of `block` tokens, and the KEY tokens that follow each."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").option("recursiveFileLookup", "true").load(path).filter("length > 0")
    step = width * block
    number = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / step).cast("int")))
    cells = files.select(F.regexp_extract("path", "(file=[^/]*/)?[^/]*$", 0).alias("file"), "content", number.alias("block"))
    return cells.select("file", "block", F.expr(f"substring(content, block * {step} + 1, {step})").alias("tokens"), F.expr(f"substring(content, (block + 1) * {step} + 1, {width * KEY})").alias("after"))


def scan(spark: SparkSession, path: str, width: int = WIDTH, block: int = BLOCK, eod: int = EOD, keyed: bool = False) -> DataFrame:
    """(file, document, start, n_tokens, ended, doc_id) of each document; start: its first token's place in the file.

    doc_id: what the first tokens of a document spell if the files are `keyed`, else null.
    """
    kind = {1: "<u1", 2: "<u2", 4: "<u4", 8: "<u8"}[width]
    schema = "file string, block int, n long, n_ends int, head long, tail long, starts array<int>, lengths array<int>, ids array<long>, leads long, opens long"
    whole = pa.list_(pa.int32())
    types = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), whole, whole, pa.list_(pa.int64()), pa.int64(), pa.int64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for file, number, raw, after in zip(*b.columns, strict=True):
                data = raw.as_buffer()
                if data.size % width:
                    raise ValueError(f"{file}: {data.size} bytes end inside a token")
                tokens = np.frombuffer(data, kind)
                ends = np.flatnonzero(tokens == eod)
                head, tail = (int(ends[0]), int(len(tokens) - 1 - ends[-1])) if len(ends) else (len(tokens), len(tokens))
                begins = ends + 1 if number.as_py() else np.append(0, ends + 1)  # documents that begin here, the last perhaps at the block's end
                ids: list[int | None] = [None] * len(begins)
                if keyed:
                    more = np.concatenate([tokens, np.frombuffer(after.as_py(), kind)])
                    ids = [doc_id_of(more[k : k + KEY]) if k < len(more) else None for k in begins.tolist()]
                inner = ids[:-1] if number.as_py() else ids[1:-1]
                leads, opens = None if number.as_py() else ids[0], ids[-1] if ids else None
                row = file.as_py(), number.as_py(), len(tokens), len(ends), head, tail, ends[:-1] + 1, np.diff(ends) - 1, inner, leads, opens
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], [c.split()[0] for c in schema.split(", ")])

    found = blocks(spark, path, width, block).mapInArrow(run, schema)
    order = Window.partitionBy("file").orderBy("block")
    before, zero = order.rowsBetween(Window.unboundedPreceding, -1), F.lit(0).cast("long")
    begins = (F.col("n_ends") > 0) | (F.col("block") == 0)
    placed = (
        found.withColumn("at", F.coalesce(F.sum("n").over(before), zero))  # tokens before the block
        .withColumn("k", F.coalesce(F.sum("n_ends").over(before), zero))  # documents that ended before it
        # the document that reaches into it: where it starts, and its doc_id
        .withColumn("open", F.coalesce(F.max(F.when(F.col("n_ends") > 0, F.col("at") + F.col("n") - F.col("tail"))).over(before), zero))
        .withColumn("own", F.when(F.col("block") == 0, F.col("leads")).otherwise(F.max_by("opens", F.when(begins, F.col("block"))).over(before)))
        .withColumn("last", F.lead("block").over(order).isNull())
    )

    def document(k, start, n, ended: bool, doc_id):
        size = F.greatest(n - KEY, F.lit(0)) if keyed else n
        return F.struct(k.cast("long").alias("document"), start.cast("long").alias("start"), size.cast("long").alias("n_tokens"), F.lit(ended).alias("ended"), doc_id.alias("doc_id"))

    none = F.expr("cast(array() as array<struct<document:bigint,start:bigint,n_tokens:bigint,ended:boolean,doc_id:bigint>>)")
    some = F.col("n_ends") > 0
    first = F.when(some, F.array(document(F.col("k"), F.col("open"), F.col("at") + F.col("head") - F.col("open"), True, F.col("own")))).otherwise(none)
    inner = F.transform(F.arrays_zip("starts", "lengths", "ids"), lambda x, i: document(F.col("k") + 1 + i, F.col("at") + x["starts"], x["lengths"], True, x["ids"]))
    begun = F.when(some, F.col("at") + F.col("n") - F.col("tail")).otherwise(F.col("open"))
    left = F.col("at") + F.col("n") - begun
    rest = F.when(F.col("last") & (left > 0), F.array(document(F.col("k") + F.col("n_ends"), begun, left, False, F.when(some, F.col("opens")).otherwise(F.col("own"))))).otherwise(none)
    return placed.select("file", F.explode(F.concat(first, inner, rest)).alias("d")).select("file", "d.*")


def counted(docs: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ended) of each document: token files are made of the texts in the shared folder, then scanned."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/tokens-{uuid.uuid4().hex}"
    write_tokens(docs, path)
    return scan(spark, path, keyed=True).select("doc_id", "n_tokens", "ended")
