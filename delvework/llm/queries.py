"""The registered queries of the training-data operators, and what SQL says about them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from delvework.llm import doc_pairs, leakage, mixing, nl_in_code, provenance, reading_level, secrets, splitting
from delvework.sources.tables import spread, table

Query = Callable[[SparkSession, str], DataFrame]


def _languages(spark: SparkSession, d: str) -> DataFrame:
    return nl_in_code.languages_in_code(spread(table(spark, d, "chunks")), table(spark, d, "notes"))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return nl_in_code.files_by_language(spread(table(spark, d, "chunks")), table(spark, d, "notes"))


def _split(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_oversized(spread(table(spark, d, "chunks")), *splitting.config_of(table(spark, d, "chunk_config"), "code"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return splitting.cut_lines(_split(spark, d))


def p2_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.pieces(_split(spark, d))


def p2_cover(spark: SparkSession, d: str) -> DataFrame:
    """``id, digest, longest``: what the pieces of each chunk give back without their overlap, and whether all fit."""
    limit, _ = splitting.config_of(table(spark, d, "chunk_config"), "code")
    own = F.substr("content", F.col("own_at") + 1)
    gathered = p2_pieces(spark, d).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("piece_no", "own_line", "end_line", own.alias("own")))).alias("p"), F.max(F.length("content")).alias("longest"))
    # a piece that begins on another line than the one before ended on is behind a line end
    joined = F.aggregate(
        "p",
        F.struct(F.lit("").alias("text"), F.lit(None).cast("int").alias("last")),
        lambda a, x: F.struct(F.concat(a["text"], F.when(x["own_line"] > a["last"], "\n").otherwise(""), x["own"]).alias("text"), x["end_line"].alias("last")),
    )["text"]
    return gathered.select("id", F.md5(joined).alias("digest"), (F.col("longest") <= limit).alias("fits"))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return secrets.places(secrets.redact_secrets(spread(table(spark, d, "chunks"))))


def p3_redacted(spark: SparkSession, d: str) -> DataFrame:
    return secrets.redact_secrets(spread(table(spark, d, "chunks"))).select("id", "file_path", "redacted")


def p3_lines(spark: SparkSession, d: str) -> DataFrame:
    """``id, lines``: each chunk with the number of its lines once its credentials are taken out."""
    chunks = spread(table(spark, d, "chunks"))
    once = chunks.where("id IS NOT NULL AND content IS NOT NULL").select("id", F.length(F.regexp_replace("content", "[^\n]", "")).alias("n")).distinct()
    out = secrets.redact_secrets(chunks).select("id", F.length(F.regexp_replace("redacted", "[^\n]", "")).alias("redacted"))
    return once.join(out, "id", "left").select("id", (F.coalesce("redacted", "n") + 1).cast("long").alias("lines"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return provenance.found(provenance.not_handwritten(spread(table(spark, d, "chunks"))))


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return provenance.not_handwritten(spread(table(spark, d, "chunks")))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return doc_pairs.found(doc_pairs.documented_functions(spread(table(spark, d, "chunks"))))


def p5_pairs(spark: SparkSession, d: str) -> DataFrame:
    chunks = spread(table(spark, d, "chunks"))
    return doc_pairs.whole_bodies(doc_pairs.documented_functions(chunks), chunks)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.found(leakage.contaminated(spread(table(spark, d, "documents")), table(spark, d, "eval_items"), likenesses=False))


def p6_leaks(spark: SparkSession, d: str) -> DataFrame:
    return leakage.contaminated(spread(table(spark, d, "documents")), table(spark, d, "eval_items"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(spread(table(spark, d, "documents")), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(p7_mix(spark, d), table(spark, d, "mix_targets"))


def p7_limits(spark: SparkSession, d: str) -> DataFrame:
    """``source, met, capped``: whether each source has its part of the shares that can be met, but for one text of its
    own or a hundredth of the mix, and keeps its repeats."""
    mixed = p7_mix(spark, d)
    got = mixing.shares(mixed, table(spark, d, "mix_targets")).join(mixed.groupBy("source").agg(F.max("tokens").alias("longest")), "source", "left")
    t = table(spark, d, "mix_targets").select(F.lower(F.trim("source")).alias("source"), "max_repeats")
    can = got.where("tokens > 0").agg(F.sum("target_share")).scalar()
    whole = mixed.agg(F.sum(F.col("tokens") * F.col("copies"))).scalar()
    due = F.when(F.col("tokens") > 0, F.col("target_share") / can * whole).otherwise(0.0)
    met = F.abs(F.col("tokens") - due) <= F.greatest(F.coalesce("longest", F.lit(0)), whole / 100)
    return got.join(t, "source").select("source", met.alias("met"), (F.col("most_copies") <= F.col("max_repeats")).alias("capped"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.found(p8_levels(spark, d))


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading_level.reading_levels(spread(table(spark, d, "documents")), table(spark, d, "level_labels"))


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_shares": _languages,
    "p2_found": p2_found,
    "p2_pieces": p2_pieces,
    "p2_cover": p2_cover,
    "p3_found": p3_found,
    "p3_redacted": p3_redacted,
    "p3_lines": p3_lines,
    "p4_found": p4_found,
    "p4_kinds": p4_kinds,
    "p5_found": p5_found,
    "p5_pairs": p5_pairs,
    "p6_found": p6_found,
    "p6_leaks": p6_leaks,
    "p7_mix": p7_mix,
    "p7_shares": p7_shares,
    "p7_limits": p7_limits,
    "p8_found": p8_found,
    "p8_levels": p8_levels,
}

#: No operator is expressible in SQL over whole texts; their tests compare them with brute force, exact round trips and
#: held-out accuracy. What must hold of any right result is: that pieces give back their chunk and fit, that redaction
#: leaves all lines, that a mix keeps shares and repeats.
SQL: dict[str, str] = {
    "p2_cover": """SELECT id, md5(replace(any_value(content), chr(13) || chr(10), chr(10))) AS digest, true AS fits FROM chunks
      WHERE id IS NOT NULL AND length(content) > (SELECT min(max_chars) FROM chunk_config WHERE scope = 'code') GROUP BY id""",
    "p3_lines": "SELECT DISTINCT id, len(string_split(content, chr(10))) AS lines FROM chunks WHERE id IS NOT NULL AND content IS NOT NULL",
    "p7_limits": "SELECT DISTINCT lower(trim(source)) AS source, true AS met, true AS capped FROM mix_targets WHERE source IS NOT NULL",
}
