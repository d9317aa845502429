"""Notes and corrections: blocks, tags, dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def note_block(ts: Column, module: Column, body: Column, tags: Column) -> Column:
    """The Markdown block of a note: a heading with time and module, the body, a line of tags."""
    head = F.concat(F.lit("## ["), F.date_format(ts, "yyyy-MM-dd HH:mm"), F.lit(" UTC]"), F.when(module.isNotNull(), F.concat(F.lit("  Module: "), module)).otherwise(F.lit("")))
    line = F.when(F.size(F.coalesce(tags, F.array())) > 0, F.concat(F.lit("\n\n"), F.array_join(F.transform(tags, lambda t: F.concat(F.lit("#"), t)), " "))).otherwise(F.lit(""))
    return F.concat(head, F.lit("\n\n"), F.coalesce(body, F.lit("")), line)


def blocks(text: Column) -> Column:
    """The ``## `` blocks of a notes file, what stands before the first left out."""
    parts = F.split(F.concat(F.lit("\n"), text), "\n(?=## )", -1)
    return F.transform(F.filter(parts, lambda p: p.startswith("## ")), lambda p: F.regexp_replace(p, r"\n+$", ""))


def with_tag(files: DataFrame, tag: str) -> DataFrame:
    """``file_path, block``: blocks of ``files(file_path, content)`` that hold ``#tag`` in a line other than the heading.

    The tag is looked for as text: ``#a`` is in ``#ab`` as well.
    """
    out = files.where("content IS NOT NULL").select("file_path", F.explode(blocks(F.col("content"))).alias("block"))
    return out.where(F.contains(F.regexp_replace("block", r"^[^\n]*", ""), F.lit(f"#{tag}")))


def notes_with_tag(notes: DataFrame, tag: str) -> DataFrame:
    """The notes, each once, one of whose tags begins with ``tag``."""
    hit = F.exists(F.coalesce("tags", F.array().cast("array<string>")), lambda t: F.coalesce(F.startswith(t, F.lit(tag)), F.lit(False)))
    return notes.where(hit).dropDuplicates(["note_id"])


def corrections(notes: DataFrame, since: str | None = None, module: str | None = None) -> DataFrame:
    """The notes, each once, from a day on, whose module or text holds a word, whatever the case.

    A ``since`` that is no date (``yyyy-MM-dd``) doesn't filter.
    """
    out = notes.dropDuplicates(["note_id"])
    if since is not None:
        day = F.try_to_date(F.lit(since), "yyyy-MM-dd")
        out = out.where(day.isNull() | (F.to_date("ts") >= day))
    if module is not None:
        low = F.lit(module.lower())
        out = out.where(F.contains(F.lower(F.coalesce("module", F.lit(""))), low) | F.contains(F.lower(F.coalesce("body", F.lit(""))), low))
    return out


def newest_headings(notes: DataFrame, limit: int = 10) -> DataFrame:
    """``rank, heading`` of the newest global notes, for a summary file."""
    from delvework.operators.fusion import top

    glob = notes.where("module IS NULL AND ts IS NOT NULL").dropDuplicates(["note_id"])
    scored = glob.select(F.col("note_id").alias("id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("score"), F.get(F.split("body", "\n"), F.lit(0)).alias("heading"))
    return top(scored, limit).select("rank", "id", "heading")


def added(notes: DataFrame, fresh: DataFrame) -> DataFrame:
    """The notes with fresh ones appended; ids that are known already are not added again."""
    new = fresh.dropDuplicates(["note_id"]).join(notes.select("note_id"), "note_id", "left_anti")
    return notes.unionByName(new.select(*notes.columns))


def for_module(notes: DataFrame, key: str, newest_days: int = 10) -> DataFrame:
    """The notes, each once, of the newest days that speak of a module: by its key or by the last part of it."""
    once = notes.where("ts IS NOT NULL").dropDuplicates(["note_id"])
    days = once.select(F.to_date("ts").alias("day")).distinct().orderBy(F.desc("day")).limit(newest_days)
    text = F.lower(F.concat_ws("\n", "module", "body"))
    hit = F.contains(text, F.lit(key.lower())) | F.contains(text, F.lit(key.rsplit("/", 1)[-1].lower()))
    # as many days as were asked for, so they can be sent to every executor
    return once.where(hit).withColumn("day", F.to_date("ts")).join(F.broadcast(days), "day", "left_semi")
