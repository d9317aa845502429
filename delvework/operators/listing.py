"""Listings of a source tree: extensions, languages, directories."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from delvework.functions.text import extension


def _directories(paths: DataFrame, depth: int) -> DataFrame:
    parts = F.split("path", "/")
    up = F.sequence(F.lit(0), F.least(F.size(parts) - 1, F.lit(depth)))
    dirs = F.transform(up, lambda i: F.when(i == 0, F.lit(".")).otherwise(F.array_join(F.slice(parts, 1, i), "/")))
    return paths.select("path", F.explode(dirs).alias("directory"))


def extension_counts(paths: DataFrame, depth: int = 4) -> DataFrame:
    """``directory, extension, files`` for each directory down to a depth, files below it included."""
    p = paths.where("path IS NOT NULL").select("path").distinct()
    return _directories(p, depth).groupBy("directory", extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files"))


def tree(paths: DataFrame, depth: int = 4) -> DataFrame:
    """``directory, level, files, extensions``: the directory tree, with the extensions of the files below."""
    per = extension_counts(paths, depth).groupBy("directory").agg(
        F.sum("files").alias("files"), F.array_join(F.array_sort(F.collect_list(F.concat("extension", F.lit(":"), F.col("files").cast("string")))), " ").alias("extensions")
    )
    level = F.when(F.col("directory") == ".", 0).otherwise(F.size(F.split("directory", "/")))
    return per.select("directory", level.alias("level"), "files", "extensions")


def languages(paths: DataFrame, more_than: int = 2) -> DataFrame:
    """``extension, files``: extensions of more than ``more_than`` files."""
    p = paths.where("path IS NOT NULL").select("path").distinct()
    return p.groupBy(extension(F.col("path")).alias("extension")).agg(F.count("*").alias("files")).where((F.col("files") > more_than) & (F.col("extension") != "~"))


#: Directories a summary passes over, names of files by which a project is entered, and source extensions (fixed values).
PRUNED = ("node_modules", "target", "dist", "build", "vendor")
ENTRIES = ("main.rs", "lib.rs", "index.ts", "index.js", "main.py", "app.py", "main.go", "App.vue", "App.tsx", "server.ts", "server.js", "main.kt", "Main.java", "vite.config.ts", "vite.config.js")
SOURCES = "rs ts tsx js jsx mjs cjs vue svelte py pyi go java kt kts swift cpp cc cxx c h hpp cs rb php scala lua sh bash".split()


def project_summary(paths: DataFrame, depth: int = 4, more_than: int = 2) -> DataFrame:
    """One row ``files, languages, entries``: what a project holds down to a depth.

    Hidden and built directories are passed over; ``languages`` are the extensions of more than ``more_than`` files.
    """
    p = paths.where("path IS NOT NULL").select("path", F.split("path", "/").alias("parts")).distinct()
    hidden = F.exists("parts", lambda x: x.startswith(".") | x.isin(*PRUNED))
    p = p.where((F.size("parts") <= depth) & ~hidden)
    per = p.groupBy(extension(F.col("path")).alias("e")).agg(
        F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.element_at("parts", -1).isin(*ENTRIES), F.col("path")))).alias("entry")
    )
    named = F.when((F.col("n") > more_than) & (F.col("e") != "~"), F.col("e"))
    return per.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("files"),
        F.array_join(F.sort_array(F.collect_list(named)), ", ").alias("languages"),
        F.array_join(F.sort_array(F.flatten(F.collect_list("entry"))), ", ").alias("entries"),
    )


def module_sources(paths: DataFrame, modules: DataFrame) -> DataFrame:
    """``module_key, path``: the source files of each module, all below its directory; of the root only those directly in it."""
    from delvework.operators.modules import changes_by_module

    return changes_by_module(paths.where(extension(F.col("path")).isin(*SOURCES)).select("path"), modules)
