"""BM25 over substring terms and CJK bigrams, with column weights."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from delvework.functions import text as T
from delvework.session import checkpointed

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6


def unique(chunks: DataFrame, *columns: str) -> DataFrame:
    """One row per chunk id with the given columns, of the version indexed last; null ids are left out.

    Rows with equal id carry equal content, so only the columns asked for are compared and moved.
    """
    rest = [c for c in columns if c != "id"]
    latest = F.max(F.struct(F.col("last_indexed"), *rest)) if "last_indexed" in chunks.columns else F.max(F.struct(*rest))
    return chunks.where("id IS NOT NULL").groupBy("id").agg(latest.alias("_r")).select("id", *(F.col(f"_r.{c}").alias(c) for c in rest))


def _score(tfs: list[Column], tokens: Column, stats: Column, idfs: list[Column]) -> Column:
    total = F.lit(0.0)
    for tf, idf in zip(tfs, idfs):
        total = total + idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * tokens / stats["avg"]))
    return total


def scored(
    rows: DataFrame,
    terms: list[str],
    columns: dict[str, float],
    count: Callable[[Column, str], Column],
    size: Callable[[Column], Column],
) -> DataFrame:
    """``id, module, score, all_terms`` of the rows that hold at least one term; ``all_terms`` tells whether each.

    Rows of a table with ``last_indexed`` count once per id, as indexed last; other tables have unique ids.
    ``columns`` gives the weight of each text column, ``count`` how often a term occurs in a text, ``size`` a text's
    length in tokens. The number of rows, of rows per term and the mean length are those of all ``rows``. One pass over
    the texts leaves the counts of the rows that are met and one row of totals, written once, from which all else is
    taken; filters belong behind this.
    """
    tfs = [sum((w * count(F.col(c), t) for c, w in columns.items()), F.lit(0.0)) for t in terms]
    tokens = sum((size(F.col(c)) for c in columns), F.lit(0).cast("long"))
    keep = [c for c in ("id", "module") if c in rows.columns]
    counts = ["_d", *(f"_tf{i}" for i in range(len(terms)))]
    version = ["last_indexed"] if "last_indexed" in rows.columns else []
    base = rows.where("id IS NOT NULL").select(*keep, *version, tokens.alias("_d"), *(tf.alias(f"_tf{i}") for i, tf in enumerate(tfs)))
    if version:  # only the counts are moved, never the texts
        base = unique(base, *keep, *counts)
    hits = [F.col(f"_tf{i}") > 0 for i in range(len(terms))]
    any_, all_ = F.lit(False), F.lit(True)
    for h in hits:
        any_, all_ = any_ | h, all_ & h
    # texts are read once: rows without any term shrink to one row of totals per task, the others are kept
    keys = [F.when(any_, F.col(k)).alias(k) for k in keep]
    met = checkpointed(base.groupBy(*keys).agg(F.count("*").alias("_n"), F.sum("_d").alias("_sum"), *(F.max(c).alias(c) for c in counts)))
    n = F.sum("_n").cast("double")
    idf = []
    for i in range(len(terms)):
        df = F.count_if(F.col("id").isNotNull() & hits[i])
        x = F.ln((n - df + 0.5) / (df + 0.5))
        idf.append(F.when(x <= 0, LEAST_IDF).otherwise(x).alias(f"idf{i}"))
    stats = met.agg(F.struct(F.greatest(F.sum("_sum") / n, F.lit(1e-9)).alias("avg"), *idf).alias("s")).scalar()
    out = met.where("id IS NOT NULL").withColumn("_s", stats)
    score = _score([F.col(f"_tf{i}") for i in range(len(terms))], F.col("_d").cast("double"), F.col("_s"), [F.col(f"_s.idf{i}") for i in range(len(terms))])
    return out.select(*keep, F.round(score, 6).alias("score"), all_.alias("all_terms"))


def trigram_scored(rows: DataFrame, terms: list[str], columns: dict[str, float]) -> DataFrame:
    """BM25 of substring terms; terms of fewer than three characters match nothing."""
    def count(c: Column, t: str) -> Column:
        return T.occurrences(c, t) if len(t) >= 3 else F.lit(0).cast("long")

    return scored(rows, terms, columns, count, T.trigram_count)


def bigram_scored(rows: DataFrame, terms: list[str], columns: dict[str, float]) -> DataFrame:
    """BM25 of CJK bigrams."""
    def count(c: Column, t: str) -> Column:
        if len(t) == 1:  # a character that stands alone is a token of its own
            return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"(?<![{T.CJK}]){t}(?![{T.CJK}])")).cast("long")
        return F.regexp_count(F.coalesce(c, F.lit("")), F.lit(f"(?={t})")).cast("long")

    return scored(rows, terms, columns, count, T.bigram_count)
