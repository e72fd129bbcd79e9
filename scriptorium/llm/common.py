"""Small helpers that the training-data operators share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The contract's white space: U+0020 and U+0009 to U+000D, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"
#: A key counts as heavy if it holds more than one in HEAVY of all rows, so at most HEAVY keys are heavy.
HEAVY = 1000
#: Heavy rows are dealt over so many salts.
SALTS = 64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of our own, in local mode alone: a cluster's machines don't share it."""
    sc = spark.sparkContext
    known = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir")
    if not known:
        if not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        known = tempfile.mkdtemp(prefix="scriptorium-checkpoint-")
        sc.setCheckpointDir(known)
    return known


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage with a checkpoint in the shared folder; the shuffle files behind it aren't needed any more and go."""
    shared_folder(df.sparkSession)
    with cleaning(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # a new statement, under that setting


def words(text: Column) -> Column:
    """The words `[^\\x20\\x09-\\x0D]+` of a text; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def lookup(left: DataFrame, right: DataFrame, key: str, spread: str, total: int) -> DataFrame:
    """Left join of `right`, unique in `key`, whose column `n` counts the key's rows in `left`.

    Keys that hold more than one in HEAVY of the `total` rows are broadcast: there are at most HEAVY of
    them.  Their rows then take part in the shuffled join under one of SALTS salts, drawn from the column
    `spread`, so that no task gets them all.
    """
    values = [c for c in right.columns if c not in (key, "n")]
    heavy = right.filter(F.col("n") * HEAVY > F.lit(total))
    light = right.filter(F.col("n") * HEAVY <= F.lit(total))
    top = F.broadcast(heavy.select(F.col(key).alias("_hk"), *[F.col(c).alias(f"_h_{c}") for c in values]))
    rest = light.select(F.col(key).alias("_lk"), F.lit(0).alias("_ls"), *[F.col(c).alias(f"_l_{c}") for c in values])
    salted = left.join(top, F.col(key) == F.col("_hk"), "left").withColumn(
        "_salt", F.when(F.col("_hk").isNotNull(), F.pmod(F.xxhash64(spread), F.lit(SALTS)).cast("int") + 1).otherwise(0)
    )
    joined = salted.join(rest, (F.col(key) == F.col("_lk")) & (F.col("_salt") == F.col("_ls")), "left")
    return joined.select(*left.columns, *[F.coalesce(F.col(f"_h_{c}"), F.col(f"_l_{c}")).alias(c) for c in values])


#: Shuffle files of a statement go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Statements begun here let their shuffle files go when they end."""
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def written(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in the shared folder and read again; the shuffle files behind it aren't needed any more and go."""
    spark, path = df.sparkSession, f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with cleaning(spark):
        df.write.parquet(path)
    return spark.read.parquet(path)


def dealt(docs: DataFrame) -> DataFrame:
    """Rows for a costly step: an input of fewer parts than there are cores, such as one small file, is dealt to all; others stay where they lie.

    For tables as they are read: asking for the parts of shuffled rows runs the shuffle."""
    cores = docs.sparkSession.sparkContext.defaultParallelism
    return docs.repartition(cores) if docs.rdd.getNumPartitions() < cores else docs


def n_chars(docs: DataFrame) -> Column:
    return F.length(F.coalesce(docs["text"].cast("string"), F.lit(""))).cast(docs.schema["n_chars"].dataType)
