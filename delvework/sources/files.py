"""Scanning a source tree into ``file_path, module, content``."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from delvework.functions.text import normal_path
from delvework.operators.chunking import indexable


def excluded(path: Column, patterns: list[str]) -> Column:
    """Whether a path is excluded: ``*x`` excludes names that end in ``x``, anything else a whole component."""
    hit = F.lit(False)
    for p in patterns:
        if p.startswith("*"):
            hit = hit | F.endswith(path, F.lit(p[1:]))
        else:
            hit = hit | F.array_contains(F.split(path, "/"), p.strip("/"))
    return hit


def _rules(path: str, text: str | None) -> list[tuple[str, int, str, bool]]:
    """(directory, place, pattern of what it ignores below, whether it takes back) for each line of an ignore file."""
    base, out = path.rpartition("/")[0], []
    for k, line in enumerate((text or "").split("\n")):
        line = line.rstrip("\r").rstrip() if not line.rstrip("\r").endswith("\\ ") else line.rstrip("\r")
        if not line or line.startswith("#"):
            continue
        back = line.startswith("!")
        glob = line[1:] if back else line.removeprefix("\\")
        only_dirs, glob = glob.endswith("/"), glob.rstrip("/")
        anchored = "/" in glob
        rx = ""
        for part in re.findall(r"\*\*/|/\*\*|\*\*|\*|\?|\[[^\]]+\]|.", glob.removeprefix("/"), re.S):
            rx += {"**/": "(?:.*/)?", "/**": "/.*", "**": ".*", "*": "[^/]*", "?": "[^/]"}.get(part) or (part.replace("[!", "[^") if part[0] == "[" and len(part) > 2 else re.escape(part))
        out.append((base, k, f"^{'' if anchored else '(?:.*/)?'}{rx}{'/.*' if only_dirs else '(?:/.*)?'}$", back))
    return out


def ignored(paths: DataFrame, ignore_files: DataFrame) -> DataFrame:
    """``path``: which of ``paths(path)`` the ignore files ``(file_path, content)`` leave out.

    An ignore file rules what lies below its directory; of the rules that fit, the last line of the deepest file holds.
    Paths meet the directories above them on equality.
    """
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([r for p, t in zip(pdf["file_path"], pdf["content"]) for r in _rules(p, t)], columns=["directory", "place", "pattern", "back"])

    rules = ignore_files.where("file_path IS NOT NULL").select("file_path", "content").mapInPandas(run, "directory string, place int, pattern string, back boolean")
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.struct(F.array_join(F.slice(parts, 1, i), "/").alias("directory"), F.array_join(F.slice(parts, i + 1, F.size(parts)), "/").alias("rest"), i.alias("depth")))
    each = paths.where("path IS NOT NULL").select("path").distinct().withColumn("a", F.explode(above)).select("path", "a.*")
    fits = each.join(rules, "directory").where(F.expr("rest RLIKE pattern"))
    return fits.groupBy("path").agg(F.max_by("back", F.struct("depth", "place")).alias("back")).where("NOT back").select("path")


def ignore_files(spark: SparkSession, root: str, depth: int, name: str = ".gitignore") -> DataFrame:
    """``file_path, content`` of the ignore files of a tree, down to a depth of directories.

    Spark's own readers pass over hidden files, so these are looked up by name in the file system: one lookup per level.
    They are rules, of which a tree has few; pass them to :func:`scan` as a table where there are many.
    """
    jvm = spark._jvm
    top = jvm.org.apache.hadoop.fs.Path(root.rstrip("/"))
    fs = top.getFileSystem(spark._jsc.hadoopConfiguration())
    base, rows = fs.makeQualified(top).toString().rstrip("/") + "/", []
    for level in range(depth + 1):
        for status in fs.globStatus(jvm.org.apache.hadoop.fs.Path(base + "*/" * level + name)) or ():
            stream = fs.open(status.getPath())
            text = jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
            stream.close()
            rows.append((status.getPath().toString().removeprefix(base), text))
    return spark.createDataFrame(rows, "file_path string, content string")


def scan(spark: SparkSession, root: str, exclude: list[str] | None = None, ignore_name: str | None = ".gitignore", rules: DataFrame | None = None) -> DataFrame:
    """The readable text files of a tree that are indexable and not excluded; null content where bytes are no UTF-8.

    ``module`` is the full directory of a file. What files named ``ignore_name`` leave out is left out (None: nothing); the
    ignore files may be given as ``rules(file_path, content)`` instead.
    Files of any size that a row can hold (2 GB) are read whole; a larger one raises.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    base = root.rstrip("/")
    rel = F.regexp_replace("path", f"^.*?{base.removeprefix('file://')}/", "")
    every = raw.select(normal_path(rel).alias("file_path"), "content")
    f = every.where(indexable(F.col("file_path")) & ~excluded(F.col("file_path"), exclude or []))
    if ignore_name and rules is None:
        depth = f.agg(F.max(F.size(F.split("file_path", "/")))).first()[0] or 1
        rules = ignore_files(spark, root, depth - 1, ignore_name)
    if rules is not None:
        f = f.join(ignored(f.select(F.col("file_path").alias("path")), rules).withColumnRenamed("path", "file_path"), "file_path", "left_anti")
    text = F.try_validate_utf8(F.col("content").cast("string"))
    return f.select("file_path", F.regexp_replace("file_path", r"/?[^/]*$", "").alias("module"), text.alias("content"))
