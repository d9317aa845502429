"""Putting files together again from their chunks, in aligned blocks of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def line_blocks(chunks: DataFrame, block_lines: int, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per file and block of ``block_lines`` lines: ``file_path, block, first_line, offs, texts``.

    Every chunk is cut at multiples of ``block_lines``, the pieces are gathered by (file, block) and laid over each
    other, so repeated and overlapping chunks count once; lines that no chunk has are empty. A block never gets more
    distinct lines than ``block_lines``, however large the file is. Where chunks disagree about a line, the one
    indexed last holds (then the larger text). Rows without path or content are left out; a null start line is 1. Columns to ``carry`` keep their
    largest value in a block.
    """
    b = F.lit(block_lines)
    c = chunks.select(
        "file_path",
        (F.coalesce("start_line", F.lit(1)) - 1).alias("_s"),
        F.regexp_replace("content", "\r\n", "\n").alias("_c"),
        *carry,
    ).where("file_path IS NOT NULL AND _c IS NOT NULL AND _s >= 0")
    c = c.withColumn("_e", F.col("_s") + F.length("_c") - F.length(F.replace("_c", F.lit("\n"), F.lit(""))))
    first, last = F.floor(F.col("_s") / b), F.floor(F.col("_e") / b)
    c = c.withColumn("block", F.explode(F.sequence(first, last)))
    lines = F.split("_c", "\n")
    at = F.greatest(F.lit(0), F.col("block") * b - F.col("_s"))
    off = F.greatest(F.lit(0), F.col("_s") - F.col("block") * b)
    cut = F.array_join(F.slice(lines, (at + 1).cast("int"), (b - off).cast("int")), "\n")
    c = c.select(
        "file_path",
        F.col("block").cast("int").alias("block"),
        *carry,
        F.struct(off.cast("int").alias("off"), F.when(first == last, F.col("_c")).otherwise(cut).alias("text")).alias("_p"),
    )
    pieces = F.array_sort(F.collect_set("_p"))
    g = c.groupBy("file_path", "block").agg(pieces.alias("_p"), *(F.max(k).alias(k) for k in carry))
    return g.select("file_path", "block", *carry, (F.col("block") * b + 1).cast("int").alias("first_line"), F.col("_p.off").alias("offs"), F.col("_p.text").alias("texts"))


def overlay(offs, texts) -> str:
    """The text of a block from its pieces: later pieces fill what earlier ones lack."""
    if len(texts) == 1 and offs[0] == 0:
        return texts[0]
    out: list[str] = []
    for off, text in sorted(zip(offs, texts), key=lambda x: (x[0], -len(x[1]), x[1])):
        ls = text.split("\n")
        if off > len(out):
            out.extend([""] * (off - len(out)))
        have = len(out) - off
        if have < len(ls):
            out.extend(ls[have:])
    return "\n".join(out)
