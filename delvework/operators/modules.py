"""Module state: status records, which modules changed files belong to, and what becomes outdated."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ROOT = "_root_"
STATES = ("unknown", "analyzing", "partial", "understood", "outdated")


def parse_status(raw: Column, now: int) -> Column:
    """A struct ``state, since, reason`` of a status record ``state[:epoch[:reason]]``.

    Blank and unknown words are unknown without a time; an epoch that is no number becomes ``now``; colons behind the
    second one belong to the reason, which only outdated records have.
    """
    text = F.regexp_replace(F.coalesce(raw, F.lit("")), r"^\s+|\s+$", "")
    parts = F.split(text, ":", 3)
    state = F.when(parts[0].isin("analyzing", "partial", "understood", "outdated"), parts[0]).otherwise(F.lit("unknown"))
    epoch = F.coalesce(F.when(F.get(parts, F.lit(1)).rlike(r"^[+-]?\d{1,12}$"), F.get(parts, F.lit(1)).cast("long")), F.lit(now).cast("long"))
    return F.struct(
        state.alias("state"),
        F.when(state != "unknown", epoch).alias("since"),
        F.when(state == "outdated", F.coalesce(F.get(parts, F.lit(2)), F.lit(""))).alias("reason"),
    )


def status_text(state: Column, since: Column, reason: Column) -> Column:
    """The record of a status: the inverse of :func:`parse_status`."""
    return (
        F.when(state == "unknown", "unknown")
        .when(state == "outdated", F.concat(state, F.lit(":"), since.cast("string"), F.lit(":"), F.coalesce(reason, F.lit(""))))
        .otherwise(F.concat(state, F.lit(":"), since.cast("string")))
    )


def statuses(modules: DataFrame, now: int) -> DataFrame:
    """``module_key, state, since, reason`` of ``modules(module_key, raw_status)``."""
    return modules.select("module_key", parse_status(F.col("raw_status"), now).alias("s")).select("module_key", "s.*")


def registry(files: DataFrame, root: str = "modules") -> DataFrame:
    """``module_key, raw_status``: the modules of a tree of documents, at any depth.

    ``files(file_path, content)``; a directory below ``root`` with a file ``STATUS`` is a module, its key is its path.
    """
    of = F.regexp_extract("file_path", rf"(?:^|/){root}/(.+)/STATUS$", 1)
    return files.where("file_path IS NOT NULL").select(of.alias("module_key"), F.col("content").alias("raw_status")).where("module_key <> ''").dropDuplicates(["module_key"])


def doc_key(path: Column, root: str = "modules") -> Column:
    """The module of a document: its directory below ``root``, or its own name where it lies directly there."""
    below = F.regexp_replace(path, f"^{root}/", "")
    return F.when(F.contains(below, F.lit("/")), F.regexp_replace(below, "/[^/]*$", "")).otherwise(F.regexp_replace(below, r"(?:\.md)+$", ""))


def overview(modules: DataFrame, now: int) -> DataFrame:
    """``module_key, state, since, reason, outdated``: the status of each module, beside how many are outdated in all."""
    status = statuses(modules, now)
    n = status.agg(F.count_if(F.col("state") == "outdated")).scalar()
    return status.withColumn("outdated", n)


def analyzed(modules: DataFrame, keys: DataFrame, now: int, force: bool = False) -> DataFrame:
    """``module_key, raw_status``: the modules after work on those of ``keys(module_key)`` has begun.

    They become analyzing, new keys as well; those that are understood stay so unless ``force``.
    """
    asked = keys.where("module_key IS NOT NULL").select("module_key").distinct()
    both = modules.select("module_key", "raw_status").join(asked.withColumn("_asked", F.lit(True)), "module_key", "full_outer")
    open_ = F.col("_asked") & (F.lit(force) | (parse_status(F.col("raw_status"), now)["state"] != "understood"))
    begun = status_text(F.lit("analyzing"), F.lit(now), F.lit(None).cast("string"))
    return both.select("module_key", F.when(open_, begun).otherwise(F.col("raw_status")).alias("raw_status"))


def safe_label(key: Column) -> Column:
    """A module's key as the name of one file."""
    return F.replace(key, F.lit("/"), F.lit("_"))


def rollup(status: DataFrame) -> DataFrame:
    """``state, n``: modules per state, with a row for each state."""
    all_ = status.sparkSession.createDataFrame([(s,) for s in STATES], "state string")
    return all_.join(status.groupBy("state").count(), "state", "left").select("state", F.coalesce("count", F.lit(0)).cast("long").alias("n"))


def set_status(status: DataFrame, keys: list[str], state: str, now: int, reason: str = "") -> DataFrame:
    """The statuses with those of ``keys`` set; ``analyzing`` is not set by hand."""
    if state not in ("unknown", "partial", "understood", "outdated"):
        raise ValueError(f"no status to set: {state!r}")
    hit = F.col("module_key").isin(*keys)
    return status.select(
        "module_key",
        F.when(hit, state).otherwise(F.col("state")).alias("state"),
        F.when(hit, F.lit(now if state != "unknown" else None).cast("long")).otherwise(F.col("since")).alias("since"),
        F.when(hit, F.lit(reason if state == "outdated" else None).cast("string")).otherwise(F.col("reason")).alias("reason"),
    )


def normal_changes(changes: DataFrame) -> DataFrame:
    """``path``: changed paths with forward slashes and without leading ``./``, once each."""
    from delvework.functions.text import normal_path

    return changes.where("path IS NOT NULL AND path <> ''").select(normal_path(F.col("path")).alias("path")).distinct()


def _prefixes(paths: DataFrame) -> DataFrame:
    """``path, module_key``: each path with every directory above it, the path itself, and the root for loose files."""
    parts = F.split("path", "/")
    ups = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))
    keys = F.when(F.size(parts) == 1, F.array(F.col("path"), F.lit(ROOT))).otherwise(ups)
    return paths.select("path", F.explode(keys).alias("module_key"))


def changes_by_module(changes: DataFrame, modules: DataFrame) -> DataFrame:
    """``module_key, path``: which changed files lie in which modules, by whole path components.

    A path meets its own prefixes, so this is a join on equality; the root module has the files directly in the root.
    """
    return _prefixes(normal_changes(changes)).join(modules.select("module_key").distinct(), "module_key")


def unmatched(changes: DataFrame, modules: DataFrame) -> DataFrame:
    """``path``: changed files that lie in no module."""
    return normal_changes(changes).join(changes_by_module(changes, modules).select("path").distinct(), "path", "left_anti")


def outdated(changes: DataFrame, modules: DataFrame, now: int) -> DataFrame:
    """``module_key, state, files, names, new_status``: modules with changed files and what they become.

    Understood and partial modules become outdated, with the number of changed files and their first three names; the
    others keep their status (``new_status`` is null).
    """
    name = F.element_at(F.split("path", "/"), -1)
    each = changes_by_module(changes, modules)
    # only the first three of a module are gathered, however many it has
    place = F.row_number().over(Window.partitionBy("module_key").orderBy("path"))
    first = each.withColumn("_k", place).where("_k <= 3").groupBy("module_key").agg(F.array_sort(F.collect_list(F.struct("path", name.alias("name")))).alias("p"))
    names = first.select("module_key", F.array_join(F.transform("p", lambda x: x["name"]), ", ").alias("names"))
    per = each.groupBy("module_key").agg(F.count("*").alias("files")).join(names, "module_key")
    out = per.join(statuses(modules, now), "module_key")
    reason = F.concat(F.col("files").cast("string"), F.lit(" file(s) changed: "), F.col("names"))
    new = F.when(F.col("state").isin("understood", "partial"), status_text(F.lit("outdated"), F.lit(now), reason))
    return out.select("module_key", "state", "files", "names", new.alias("new_status"))


def added(modules: DataFrame, keys: DataFrame, known_paths: DataFrame) -> DataFrame:
    """The modules with new ``keys(module_key)`` whose directory holds a known path, as unknown; known keys stay."""
    dirs = _prefixes(known_paths.select("path").distinct()).select("module_key").distinct()
    fresh = keys.select("module_key").distinct().join(modules.select("module_key"), "module_key", "left_anti")
    real = fresh.join(dirs.unionByName(modules.sparkSession.createDataFrame([(ROOT,)], "module_key string")), "module_key", "left_semi")
    return modules.select("module_key", "raw_status").unionByName(real.select("module_key", F.lit("unknown").alias("raw_status")))


def load(modules: DataFrame, notes: DataFrame, docs: DataFrame, now: int) -> DataFrame:
    """``module_key, state, notes, last_note, docs``: each module with its notes and documents."""
    n = notes.where("module IS NOT NULL").dropDuplicates(["note_id"]).groupBy(F.col("module").alias("module_key")).agg(F.count("*").alias("notes"), F.max("ts").alias("last_note"))
    d = docs.where("module IS NOT NULL").groupBy(F.col("module").alias("module_key")).agg(F.countDistinct("file_path").alias("docs"))
    out = statuses(modules, now).join(n, "module_key", "left").join(d, "module_key", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("notes", "docs")]
    return out.select("module_key", "state", zero[0], "last_note", zero[1])


def removed(modules: DataFrame, keys: list[str], hard: bool = False) -> tuple[DataFrame, DataFrame]:
    """(modules, archive) without or with cleared ``keys``: cleared ones become unknown, ``hard`` ones leave.

    The archive has the rows of ``keys`` as they were; it replaces what was archived of them before.
    """
    hit = F.col("module_key").isin(*keys)
    kept = modules.where(~hit) if hard else modules.select("module_key", F.when(hit, "unknown").otherwise(F.col("raw_status")).alias("raw_status"))
    return kept.select("module_key", "raw_status"), modules.where(hit).select("module_key", "raw_status")


#: Kinds of a module's documents, in the order they are listed (fixed values).
DOCUMENTS = ("api", "internals", "notes")


def documents(docs: DataFrame) -> DataFrame:
    """``module_key, documents``: which kinds of documents each module has, by the beginning of the file's name."""
    kind = F.regexp_extract("file_path", rf"(?:^|/)({'|'.join(DOCUMENTS)})[^/]*\.md$", 1)
    per = docs.where("module IS NOT NULL AND file_path IS NOT NULL").groupBy(F.col("module").alias("module_key")).agg(F.collect_set(kind).alias("k"))
    listed = F.filter(F.array(*(F.lit(d) for d in DOCUMENTS)), lambda d: F.array_contains("k", d))
    return per.select("module_key", F.array_join(listed, ", ").alias("documents"))
