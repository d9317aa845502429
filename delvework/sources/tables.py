"""Reading the index tables of one snapshot folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """The table ``name`` of a snapshot folder that holds one Parquet file or folder per table."""
    return spark.read.parquet(f"{folder}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """A table that is read by fewer tasks than there are cores, dealt out to all of them; any other table as it is.

    A small Parquet file with one row group is read by one task, which would then also do all the work behind it.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
