"""Ranked lists: top-k with ranks, and Reciprocal Rank Fusion."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

RRF_K = 60


def top(rows: DataFrame, limit: int, key: str = "id") -> DataFrame:
    """The ``limit`` best rows by ``score``, ties by ``key``, with ``rank`` from 1.

    The ranks are given to rows that are already limited, so the one ordered partition never has more than ``limit``.
    """
    best = rows.orderBy(F.desc("score"), F.asc(key)).limit(limit)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), F.asc(key))))


def fuse(lists: list[DataFrame], limit: int, key: str = "id") -> DataFrame:
    """``key, score, rank`` of several ranked lists (``key, score, rank``) by Reciprocal Rank Fusion.

    Empty lists don't count: where only one list has rows it keeps its raw scores. Ties are broken by the key.
    """
    named = [d.select(key, "score", "rank", F.lit(i).alias("list_no")) for i, d in enumerate(lists)]
    all_ = reduce(DataFrame.unionByName, named)
    per = all_.groupBy(key).agg(
        F.sum(1.0 / (RRF_K + F.col("rank"))).alias("rrf"), F.min_by("score", "list_no").alias("raw"), F.min("list_no").alias("lo"), F.max("list_no").alias("hi")
    )
    # a window over ranked lists, which hold no more rows than were asked for
    whole = Window.partitionBy()
    used = F.max("hi").over(whole) > F.min("lo").over(whole)
    fused = per.select(key, F.round(F.when(used, F.col("rrf")).otherwise(F.col("raw")), 6).alias("score"))
    return top(fused, limit, key)
