"""Keeping an index up to date from a stream of files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from delvework.operators.index import BUCKETS, build

SCHEMA = "file_path string, module string, content string, version long"


def watch(spark: SparkSession, source: str, folder: str, checkpoint: str, size: int = 60, overlap: int = 10, buckets: int = BUCKETS) -> StreamingQuery:
    """Indexes the files that arrive as Parquet ``file_path, module, content, version`` in ``source``, batch by batch.

    Every batch is merged into the newest snapshot and becomes a new one; only the parts of the index in which its files
    lie are read and written. Of the versions of a file (null counts as 0) the highest holds, whatever the order in
    which they arrive; null content removes a file. A batch that is run again leads to the same state.
    """
    def step(batch: DataFrame, number: int) -> None:
        build(spark, batch, folder, size, overlap, now=number, buckets=buckets, partial=True)

    stream = spark.readStream.schema(SCHEMA).parquet(source)
    return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
