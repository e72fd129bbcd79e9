"""Documents as they arrive: each file is parsed once, without state, and its rendering is appended to a sink.

A file's row doesn't depend on others, so there is no watermark and no state store; a restart goes on from the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from scriptorium.api import Options
from scriptorium.sources import documents


def texts(spark: SparkSession, path: str, options: Options = Options()) -> DataFrame:
    """(path, text) of the files that appear under a path."""
    o = options.checked()
    return documents.rendered(documents.parsed(documents.stream_files(spark, path), o.show_hidden, o.show_removed), o.to, o.line)


def to_parquet(rows: DataFrame, path: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Append a stream to Parquet; once: what is there now, in several batches, then stop."""
    writer = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if once else writer).start()
