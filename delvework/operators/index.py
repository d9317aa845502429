"""Index maintenance: content hashes, change detection, incremental merge, statistics and snapshots on disk."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from delvework.session import checkpointed

Provider = Callable[[list[str]], list[list[float]]]


def file_hashes(chunks: DataFrame, prefix: str = "") -> DataFrame:
    """``path, sha256`` of the files behind chunks: a hash over their distinct chunks in line order.

    A file's chunks are gathered as hashes, so a task never holds a file's text.
    """
    per = chunks.where("file_path IS NOT NULL").select(
        "file_path", F.coalesce("start_line", F.lit(0)).alias("a"), F.coalesce("end_line", F.lit(0)).alias("b"), F.sha2(F.coalesce("content", F.lit("")), 256).alias("h")
    )
    joined = F.array_join(F.transform(F.array_sort(F.collect_set(F.struct("a", "b", "h"))), lambda x: x["h"]), ",")
    return per.groupBy("file_path").agg(F.sha2(joined, 256).alias("sha256")).select(F.concat(F.lit(prefix), "file_path").alias("path"), "sha256")


def content_hashes(files: DataFrame) -> DataFrame:
    """``path, sha256`` of whole files ``file_path, content``; unreadable content hashes to ''. A version is kept."""
    version = [c for c in files.columns if c == "version"]
    return files.select(F.col("file_path").alias("path"), F.coalesce(F.sha2("content", 256), F.lit("")).alias("sha256"), *version)


def changed(current: DataFrame, stored: DataFrame) -> DataFrame:
    """``path, change``: files that are new, have another hash than stored, or are gone.

    An empty or null stored hash counts as another hash; paths stored twice with different hashes as changed.
    """
    s = stored.where("path IS NOT NULL").groupBy("path").agg(F.min(F.coalesce("sha256", F.lit(""))).alias("old"), F.max(F.coalesce("sha256", F.lit(""))).alias("old2"))
    c = current.where("path IS NOT NULL").dropDuplicates(["path"])
    both = c.join(s, "path", "full_outer")
    kind = F.when(F.col("old").isNull(), "new").when(F.col("sha256").isNull(), "gone").when((F.col("old") != F.col("sha256")) | (F.col("old2") != F.col("sha256")), "changed")
    return both.select("path", kind.alias("change")).where("change IS NOT NULL")


def merged(previous: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """The new state: rows of ``previous`` whose file is not in ``touched(path)``, and the rows of ``fresh``.

    Rows of files that are gone are in ``touched`` and have no fresh rows. For tables of any origin: ids that occur
    twice are kept once, as indexed last (rows without id as one). Every row is compared by id, so give no columns that
    aren't needed; the tables of an index need no such comparison (:func:`replaced`).
    """
    kept = previous.join(touched.select(F.col("path").alias("file_path")).distinct(), "file_path", "left_anti").select(*previous.columns)
    both = kept.unionByName(fresh.select(*previous.columns))
    rest = [c for c in previous.columns if c not in ("id", "last_indexed")]
    return both.groupBy("id").agg(F.max(F.struct("last_indexed", *rest)).alias("r")).select(*(F.col("id") if c == "id" else F.col(f"r.{c}").alias(c) for c in previous.columns))


def stats(chunks: DataFrame) -> DataFrame:
    """One row: distinct chunks, files, modules, and the time of the last indexing."""
    return chunks.agg(
        F.countDistinct("id").alias("chunks"), F.countDistinct("file_path").alias("files"), F.countDistinct(F.nullif("module", F.lit(""))).alias("modules"), F.max("last_indexed").alias("last_indexed")
    )


#: Parts into which the tables of an index are cut, by file.
BUCKETS = 64
#: What the path of a document has before it among the hashes.
DOCS = "docs:"


def bucket_of(path: Column, buckets: int) -> Column:
    """The part of an index in which the rows of a file lie."""
    return F.pmod(F.xxhash64(F.regexp_replace(path, f"^{DOCS}", "")), F.lit(buckets)).cast("int")


class Snapshots:
    """Snapshots of an index in a folder: each build writes a new one, so readers see one whole state.

    Tables lie in parts by file. A snapshot writes the parts that changed and names those of older snapshots for the
    rest, so a small change neither reads nor moves the others.
    """

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        self._fs, self._path = path.getFileSystem(spark._jsc.hadoopConfiguration()), spark._jvm.org.apache.hadoop.fs.Path

    def _names(self, folder: str) -> list[str]:
        at = self._path(folder)
        return sorted(s.getPath().getName() for s in self._fs.listStatus(at)) if self._fs.exists(at) else []

    def current(self) -> str | None:
        """The folder of the newest finished snapshot."""
        done = [n for n in self._names(self.folder) if n.startswith("v") and self._fs.exists(self._path(f"{self.folder}/{n}/_DONE"))]
        return f"{self.folder}/{done[-1]}" if done else None

    def meta(self) -> dict:
        """What the newest snapshot says of itself; {} where there is none."""
        at = self.current()
        return json.loads(self.spark.read.text(f"{at}/meta", wholetext=True).first()[0]) if at else {}

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame | None:
        """A table of the newest snapshot, or those of its parts that are named; None where there is no such table."""
        kept = self.meta().get("tables", {}).get(table)
        if kept is None:
            return None
        paths = [f"{self.folder}/{v}" for b, v in sorted(kept["parts"].items()) if buckets is None or int(b) in buckets]
        schema = StructType.fromJson(kept["schema"])
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def write(self, tables: dict[str, tuple[DataFrame, str]], meta: dict, changed: dict[str, list[int]] | None = None, buckets: int = BUCKETS) -> str:
        """Writes ``tables`` (rows and the column with their file) as a new snapshot and finishes it.

        ``changed`` names, per table, the parts that are replaced by the rows given; the others are taken over. Without
        it all are new.
        """
        name = f"v{time.time_ns():020d}"
        before = self.meta().get("tables", {}) if changed is not None else {}
        kept = {}
        for table, (df, key) in tables.items():
            at = f"{self.folder}/{name}/{table}"
            parts = df.withColumn("_bucket", bucket_of(F.col(key), buckets))
            # parts of like size for the tasks, large ones cut: a table of any size is written by all of them
            parts.hint("rebalance", "_bucket").write.partitionBy("_bucket").parquet(at)
            new = {n.split("=")[1]: f"{name}/{table}/{n}" for n in self._names(at) if n.startswith("_bucket=")}
            old = {b: v for b, v in before.get(table, {}).get("parts", {}).items() if int(b) not in changed[table]} if changed is not None else {}
            kept[table] = {"schema": json.loads(df.schema.json()), "parts": {**old, **new}}
        said = json.dumps({**meta, "tables": kept}, sort_keys=True)
        self.spark.createDataFrame([(said,)], "value string").coalesce(1).write.text(f"{self.folder}/{name}/meta")
        self._fs.create(self._path(f"{self.folder}/{name}/_DONE")).close()
        return f"{self.folder}/{name}"

    def clear(self) -> None:
        """Removes all snapshots."""
        self._fs.delete(self._path(self.folder), True)


def replaced(previous: DataFrame, fresh: DataFrame, touched: DataFrame) -> DataFrame:
    """The rows of ``previous`` whose file is not in ``touched(file_path)``, and those of ``fresh``, ids once.

    For tables whose ids are unique already, as those of an index: only what is fresh is compared among itself.
    """
    kept = previous.join(touched.select("file_path").distinct(), "file_path", "left_anti").select(*previous.columns)
    return kept.unionByName(fresh.dropDuplicates(["id"]).select(*previous.columns))


def build(
    spark: SparkSession, files: DataFrame, folder: str, size: int = 60, overlap: int = 10, force: bool = False, now: int = 0, docs: DataFrame | None = None, provider: Provider | None = None, buckets: int = BUCKETS, partial: bool = False
) -> str:
    """Brings the index in ``folder`` up to date with ``files(file_path, module, content)`` and returns the new snapshot.

    ``docs``, of the same form, are chunked by their headings into a table of their own (``section`` for
    ``symbol_name``). With a ``provider`` the vectors of all chunks and document chunks are kept as well. Only files
    whose hash changed are chunked and embedded again, and only the parts of the tables they lie in are rewritten;
    chunks and vectors of files that are gone leave. Another configuration or ``force`` starts from nothing. With
    ``partial``, ``files`` and ``docs`` are only those that may have changed: others stay, files of null content leave,
    and of the versions of a file (a column ``version``, else 0) the highest counts, never one below what is indexed.
    """
    from delvework.operators import vectors
    from delvework.operators.chunking import chunk_files, heading_sections

    store = Snapshots(spark, folder)
    config = {"size": size, "overlap": overlap, "buckets": buckets, "docs": docs is not None, "provider": getattr(provider, "__name__", None)}
    fresh_start = force or store.meta().get("config") != config
    files, docs = _versions(files), _versions(docs) if docs is not None else None
    hashes = _hashed(files)
    if docs is not None:
        hashes = hashes.unionByName(_hashed(docs, DOCS))
    hit: dict[str, list[int]] | None = None
    touched = None
    if not fresh_start:
        stored = store.read("hashes")
        if partial:
            older = hashes.alias("h").join(stored.alias("s"), "path").where("h.version < s.version").select("path")
            hashes = hashes.join(older, "path", "left_anti")
        differ = changed(hashes, stored)
        differ = differ.join(hashes, "path", "left_semi") if partial else differ
        touched = checkpointed(differ.select("path", F.regexp_replace("path", f"^{DOCS}", "").alias("file_path"), F.startswith("path", F.lit(DOCS)).alias("doc")))
        parts = touched.select(bucket_of(F.col("path"), buckets).alias("b"), "doc").distinct().collect()  # no more than there are buckets, twice
        hit = {"chunks": [r.b for r in parts if not r.doc], "docs": [r.b for r in parts if r.doc]}
        hit["hashes"] = hit["vectors"] = sorted({*hit["chunks"], *hit["docs"]})
        inside = bucket_of(F.col("path"), buckets).isin(hit["hashes"])
        hashes = hashes.join(touched, "path", "left_semi").unionByName(store.read("hashes", hit["hashes"]).join(touched, "path", "left_anti")) if partial else hashes.where(inside)
    if partial:
        hashes = hashes.where("sha256 <> ''")
    stamp = F.lit(now).cast("long").alias("last_indexed")
    kinds = [("chunks", files, lambda f: chunk_files(f, size, overlap).select("*", stamp))]
    if docs is not None:
        kinds.append(("docs", docs, lambda f: heading_sections(f).withColumnRenamed("symbol_name", "section").select("*", stamp)))
    tables, made = {"hashes": (hashes, "path")}, []
    for name, source, chunk in kinds:
        if touched is None:
            rows = chunk(source).dropDuplicates(["id"])
        else:
            mine = touched.where(F.col("doc") == (name == "docs")).select("file_path")
            fresh = chunk(source.join(mine, "file_path", "left_semi").select(*source.columns))
            rows = replaced(store.read(name, hit[name]), fresh, mine)
            made.append(fresh)
        tables[name] = rows, "file_path"
    if provider is not None:
        texts = [df.select("id", "file_path", "content") for df in (made if touched is not None else [rows for n, (rows, _) in tables.items() if n != "hashes"])]
        new = vectors.embed(reduce(DataFrame.unionByName, texts), provider, keep=("file_path",))
        tables["vectors"] = (new if touched is None else replaced(store.read("vectors", hit["vectors"]), new, touched)), "file_path"
    return store.write(tables, {"config": config, "built": now}, hit, buckets)


def _versions(files: DataFrame) -> DataFrame:
    """``file_path, module, content, version``: the files, the highest version of each where they have versions."""
    if "version" not in files.columns:
        return files.select("file_path", "module", "content", F.lit(0).cast("long").alias("version"))
    r = files.where("file_path IS NOT NULL").groupBy("file_path").agg(F.max(F.struct(F.coalesce("version", F.lit(0)).cast("long").alias("version"), F.struct("content", "module").alias("c"))).alias("r"))
    return r.select("file_path", "r.c.module", "r.c.content", "r.version")


def _hashed(files: DataFrame, prefix: str = "") -> DataFrame:
    of = content_hashes(files.select("file_path", "content", "version"))
    return of.withColumn("path", F.concat(F.lit(prefix), "path"))


def describe(store: Snapshots) -> DataFrame:
    """One row: :func:`stats` of the index, the number of document chunks and vectors, the provider and the dimension."""
    meta, docs, vec = store.meta(), store.read("docs"), store.read("vectors")
    of = stats(store.read("chunks"))
    n_docs = docs.agg(F.count("*")).scalar() if docs is not None else F.lit(0)
    n_vec = vec.agg(F.count("*")).scalar() if vec is not None else F.lit(0)
    dim = vec.agg(F.max(F.size("vector"))).scalar() if vec is not None else F.lit(None)
    return of.select("*", n_docs.alias("doc_chunks"), n_vec.alias("vectors"), F.lit(meta["config"]["provider"]).cast("string").alias("model"), dim.cast("int").alias("dimension"))
